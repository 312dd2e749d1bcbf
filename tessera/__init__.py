"""Annotation analytics on Spark: sources, sinks and relational operators over one canonical model."""
