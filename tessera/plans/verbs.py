"""What a user asks for, from paths to reports: convert, validate, stats, diff, sample.

The work runs as Spark jobs; what comes back are a report's few rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import AnnotationDataset
from tessera.operators import diff, lossiness, sample, stats, validate
from tessera.operators.notes import source_notes
from tessera.sources import format_named
from tessera.sources.detect import UnknownFormat, detect

#: Rows that a report shows of a long list.
SHOWN = 20


class Refused(ValueError):
    """A step was refused: the input has errors, or the output would lose something."""


@dataclass(frozen=True)
class Conversion:
    """What a conversion does to the numbers of rows, what it drops, and what reading the source has changed or left out."""

    source: str
    target: str
    before: dict
    after: dict
    dropped: list[dict]
    notes: list[dict] = field(default_factory=list)

    @property
    def warnings(self) -> list[str]:
        return [d["code"] for d in self.dropped] + [n["code"] for n in self.notes if n["severity"] == "warning"]

    @property
    def lossy(self) -> bool:
        return bool(self.warnings)


def load(spark: SparkSession, path: str, name: str = "auto", **options) -> tuple[AnnotationDataset, str]:
    """The dataset at a path and the name of its format, which ``auto`` finds out."""
    found = detect(spark, path) if name == "auto" else name
    f = format_named(found)
    return f.read(spark, path, **options), f.name


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def conversion_report(ds: AnnotationDataset, source: str, target: str) -> Conversion:
    name = format_named(target).name
    before = _rows(ds.images.agg(F.count("*").alias("images")).join(ds.categories.agg(F.count("*").alias("categories"))).join(ds.annotations.agg(F.count("*").alias("annotations"))))[0]
    return Conversion(source, name, before, _rows(lossiness.output_counts(ds, name))[0], _rows(lossiness.lossiness(ds, name).orderBy("code")), source_notes(ds, source))


def _written(ds: AnnotationDataset, source: str, path: str, target: str, allow_lossy: bool, dry_run: bool, **options) -> Conversion:
    report = conversion_report(ds, source, target)
    if report.lossy and not allow_lossy:
        raise Refused(f"{report.source} to {report.target} isn't without loss: {', '.join(report.warnings)}; allow it to go on")
    if not dry_run:
        format_named(target).write(ds, path, **options)
    return report


def convert(spark: SparkSession, source: str, target: str, to: str, name: str = "auto", *, allow_lossy: bool = False, check: bool = True, strict: bool = False, dry_run: bool = False, split: str | None = None, **options) -> Conversion:
    """Read ``source`` or one split of it, check it, and write it as format ``to`` at ``target``; ``options`` go to the writer."""
    ds, found = load(spark, source, name, **({} if split is None else {"split": split}))
    if check and not validate.passes(validate.validate(ds), strict):
        raise Refused(f"{source} doesn't pass validation; see its report")
    return _written(ds, found, target, to, allow_lossy, dry_run, **options)


def validation_report(spark: SparkSession, source: str, name: str = "auto", strict: bool = False) -> dict:
    """Numbers of errors and warnings, issues by code, and the first issues of each code."""
    ds, found = load(spark, source, name)
    issues = validate.validate(ds)
    by_code = _rows(issues.groupBy("severity", "code").agg(F.count("*").alias("count"), F.min("id").alias("first_id"), F.min_by("message", "id").alias("message")).orderBy("severity", "code"))
    errors = sum(r["count"] for r in by_code if r["severity"] == "error")
    warnings = sum(r["count"] for r in by_code if r["severity"] == "warning")
    return {"format": found, "errors": errors, "warnings": warnings, "passes": not errors and not (strict and warnings), "codes": by_code}


def stats_report(spark: SparkSession, source: str, name: str = "auto", top: int = stats.TOP, tolerance: float = stats.TOLERANCE) -> dict:
    """The nine sections as plain values; a JSON file of unknown shape is read as the canonical one."""
    try:
        ds, _ = load(spark, source, name)
    except UnknownFormat:
        if name != "auto" or not source.endswith(".json"):
            raise
        ds, _ = load(spark, source, "ir-json")
    return sections(ds, top, tolerance)


def sections(ds: AnnotationDataset, top: int = stats.TOP, tolerance: float = stats.TOLERANCE) -> dict:
    rows = {k: _rows(df) for k, df in stats.profile(ds, top, tolerance).items()}
    one = lambda k: {n: v for n, v in rows[k][0].items() if v is not None}
    seen = rows["labels"]
    return {
        "summary": one("summary"),
        "labels": {
            "top_n": top, "total_distinct": seen[0]["total_distinct"] if seen else 0, "total_annotations": seen[0]["total_annotations"] if seen else 0,
            "entries": [{"label": r["label"], "count": r["count"]} for r in seen], "other_count": seen[0]["other_count"] if seen else 0,
        },
        "bboxes": one("bboxes"),
        "image_resolutions": one("image_resolutions"),
        "annotation_density": one("annotation_density"),
        "area_distribution": one("area_distribution"),
        "aspect_ratios": {"buckets": [{"name": r["name"], "count": r["count"]} for r in rows["aspect_ratios"]], "invalid": rows["aspect_ratios"][0]["invalid"]},
        "per_category_bbox": [{n: v for n, v in r.items() if v is not None} for r in rows["per_category_bbox"]],
        "cooccurrence_top_pairs": {"top_n": top, "pairs": rows["cooccurrence_top_pairs"]},
    }


def diff_report(spark: SparkSession, a: str, b: str, name_a: str = "auto", name_b: str = "auto", match_by: str = "id", threshold: float = 0.5, detail: bool = False) -> dict:
    """Numbers of shared and own images, categories and annotations; with ``detail`` the first changed annotations and own images."""
    x, y = load(spark, a, name_a)[0], load(spark, b, name_b)[0]
    for ds in (x, y):
        diff.require_unique_names(ds)
    images, categories = diff.image_names(x, y), diff.category_names(x, y)
    by_side = lambda df: {"shared": 0, "only_in_a": 0, "only_in_b": 0} | {r["side"]: r["count"] for r in df.groupBy("side").count().collect()}
    if match_by == "id":
        rows = diff.by_id(x, y)
        annotations = _rows(diff.totals(rows))[0]
    elif match_by == "iou":
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
        annotations = _rows(diff.by_overlap(x, y, threshold).agg(total("shared"), total("only_in_a"), total("only_in_b")))[0] | {"modified": 0}
    else:
        raise ValueError(f"unknown way to match: {match_by}")
    out = {"images": by_side(images), "categories": by_side(categories), "annotations": annotations}
    if detail:
        own = lambda side: [r["file_name"] for r in images.where(F.col("side") == side).orderBy("file_name").limit(SHOWN).collect()]
        out["detail"] = {"images_only_in_a": own("only_in_a"), "images_only_in_b": own("only_in_b")}
        if match_by == "id":
            out["detail"]["modified"] = _rows(rows.where("change is not null").select("file_name", "id", "change").orderBy("file_name", "id").limit(SHOWN))
    return out


def sample_to(spark: SparkSession, source: str, target: str, to: str, name: str = "auto", *, n: int | None = None, fraction: float | None = None, seed: int = 0, strategy: str = "random", categories: list[str] = (), mode: str = "images", allow_lossy: bool = False, dry_run: bool = False, **options) -> Conversion:
    """Filter by categories, draw images, and write what is left."""
    ds, found = load(spark, source, name)
    ds = sample.filter_categories(ds, list(categories), mode)
    if n is not None or fraction is not None:
        ds = sample.sample(ds, n, fraction, seed, strategy)
    elif not categories:
        raise ValueError("give a number, a fraction or categories")
    return _written(ds, found, target, to, allow_lossy, dry_run, **options)
