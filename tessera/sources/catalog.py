"""The list of formats: what each can do and how much of the canonical model it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ALIASES, FORMATS

CATALOG = "name string, read boolean, write boolean, lossiness string, layout string, aliases array<string>"


def lossiness_class(name: str) -> str:
    """'lossless', 'conditional' (it depends on the dataset) or 'lossy'."""
    return {"ir-json": "lossless", "coco": "conditional"}.get(name, "lossy")


def catalog() -> list[dict]:
    """One entry for each format, by name."""
    other: dict[str, list[str]] = {}
    for alias, name in ALIASES.items():
        other.setdefault(name, []).append(alias)
    return [
        {"name": n, "read": True, "write": True, "lossiness": lossiness_class(n), "layout": FORMATS[n].layout, "aliases": sorted(other.get(n, []))}
        for n in sorted(FORMATS)
    ]


def catalog_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(e.values()) for e in catalog()], CATALOG)
