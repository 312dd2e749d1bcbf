"""Command line: ``python -m tessera convert|validate|stats|diff|sample|list-formats``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tessera.plans import reports, verbs
from tessera.sources.catalog import catalog


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="Annotation datasets on Spark.")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, about: str, formats: tuple[str, ...] = ("text", "json")) -> argparse.ArgumentParser:
        s = sub.add_parser(name, help=about, description=about)
        s.add_argument("--output-format", choices=formats, default="text")
        return s

    def writes(s: argparse.ArgumentParser) -> None:
        s.add_argument("--from", dest="source_format", default="auto")
        s.add_argument("--to", required=True)
        s.add_argument("-i", "--input", required=True)
        s.add_argument("-o", "--output", required=True)
        s.add_argument("--allow-lossy", action="store_true")
        s.add_argument("--dry-run", action="store_true")

    c = verb("convert", "Write a dataset in another format.")
    writes(c)
    c.add_argument("--strict", action="store_true", help="warnings count as errors")
    c.add_argument("--no-validate", action="store_true")
    c.add_argument("--split", help="one of the source's splits; all of them if not given (yolo, hf)")
    v = verb("validate", "Check a dataset.")
    v.add_argument("input")
    v.add_argument("--format", default="auto")
    v.add_argument("--strict", action="store_true")
    s = verb("stats", "Profile a dataset.", ("text", "json", "html"))
    s.add_argument("input")
    s.add_argument("--format", default="auto")
    s.add_argument("--top", type=int, default=10)
    s.add_argument("--tolerance", type=float, default=0.5)
    d = verb("diff", "Compare two datasets.")
    d.add_argument("input_a")
    d.add_argument("input_b")
    d.add_argument("--format-a", default="auto")
    d.add_argument("--format-b", default="auto")
    d.add_argument("--match-by", choices=("id", "iou"), default="id")
    d.add_argument("--iou-threshold", type=float, default=0.5)
    d.add_argument("--detail", action="store_true")
    m = verb("sample", "Write a subset of a dataset.")
    writes(m)
    m.add_argument("-n", type=int)
    m.add_argument("--fraction", type=float)
    m.add_argument("--seed", type=int, default=0)
    m.add_argument("--strategy", choices=("random", "stratified"), default="random")
    m.add_argument("--categories", default="", help="names, comma-separated")
    m.add_argument("--category-mode", choices=("images", "annotations"), default="images")
    verb("list-formats", "List the formats.")
    return p


def run(a: argparse.Namespace, spark: SparkSession | None) -> tuple[str, int]:
    """The report of a command, and its exit code."""
    plain = a.output_format == "json"
    if a.verb == "list-formats":
        return (reports.to_json(catalog()) if plain else reports.catalog_text(catalog())), 0
    if a.verb == "convert":
        c = verbs.convert(spark, a.input, a.output, a.to, a.source_format, allow_lossy=a.allow_lossy, check=not a.no_validate, strict=a.strict, dry_run=a.dry_run, split=a.split)
        return (reports.to_json(c) if plain else reports.conversion_text(c)), 0
    if a.verb == "sample":
        c = verbs.sample_to(
            spark, a.input, a.output, a.to, a.source_format, n=a.n, fraction=a.fraction, seed=a.seed, strategy=a.strategy,
            categories=[x for x in a.categories.split(",") if x.strip()], mode=a.category_mode, allow_lossy=a.allow_lossy, dry_run=a.dry_run,
        )
        return (reports.to_json(c) if plain else reports.conversion_text(c)), 0
    if a.verb == "validate":
        r = verbs.validation_report(spark, a.input, a.format, a.strict)
        return (reports.to_json(r) if plain else reports.validation_text(r)), int(not r["passes"])
    if a.verb == "diff":
        r = verbs.diff_report(spark, a.input_a, a.input_b, a.format_a, a.format_b, a.match_by, a.iou_threshold, a.detail)
        return (reports.to_json(r) if plain else reports.diff_text(r)), 0
    r = verbs.stats_report(spark, a.input, a.format, a.top, a.tolerance)
    return {"json": reports.to_json, "html": reports.stats_html, "text": reports.stats_text}[a.output_format](r), 0


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = None if a.verb == "list-formats" else SparkSession.builder.appName("tessera").getOrCreate()
    try:
        text, code = run(a, spark)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    print(text)
    return code
