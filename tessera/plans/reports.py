"""Reports as text, JSON and HTML. They hold a few rows, whatever the dataset's size."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable

from .verbs import Conversion

#: Characters of a full bar.
BAR = 20


def to_json(report, pretty: bool = True) -> str:
    if isinstance(report, Conversion):
        report = {"from": report.source, "to": report.target, "input": report.before, "output": report.after, "lossy": report.lossy, "dropped": report.dropped, "notes": report.notes}
    return json.dumps(report, indent=2 if pretty else None, ensure_ascii=False)


def number(x) -> str:
    """A count with thousands set apart, or a measure with two digits."""
    return f"{x:,}" if isinstance(x, int) else f"{x:,.2f}" if isinstance(x, float) else str(x)


def _table(rows: list[dict]) -> Iterable[str]:
    if not rows:
        return ["  (none)"]
    names = list(dict.fromkeys(k for r in rows for k in r))
    cells = [[number(r[k]) if r.get(k) is not None else "-" for k in names] for r in rows]
    widths = [max(len(n), *(len(c[i]) for c in cells)) for i, n in enumerate(names)]
    return ["  " + "  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip() for line in (names, *cells)]


def _pairs(values: dict) -> list[str]:
    width = max(map(len, values), default=0)
    return [f"  {k.ljust(width)}  {number(v)}" for k, v in values.items()]


def _bars(entries: list[tuple[str, int]]) -> list[str]:
    most, width = max((n for _, n in entries), default=0), max((len(k) for k, _ in entries), default=0)
    return [f"  {k.ljust(width)}  {'#' * (n * BAR // most if most else 0):<{BAR}}  {n:,}" for k, n in entries]


def stats_sections(r: dict) -> list[tuple[str, list[str]]]:
    """Titles and lines of a profile."""
    labels = [(e["label"], e["count"]) for e in r["labels"]["entries"]]
    if r["labels"]["other_count"]:
        labels.append(("(other)", r["labels"]["other_count"]))
    buckets = [(b["name"], b["count"]) for b in r["aspect_ratios"]["buckets"]]
    return [
        ("Summary", _pairs(r["summary"])),
        (f"Labels ({r['labels']['total_distinct']:,} distinct)", _bars(labels)),
        ("Boxes", _pairs(r["bboxes"])),
        ("Image sizes", _pairs(r["image_resolutions"])),
        ("Annotations for each image", _pairs(r["annotation_density"])),
        ("Areas", _bars(list(r["area_distribution"].items()))),
        ("Width over height", [*_bars(buckets), f"  invalid: {r['aspect_ratios']['invalid']:,}"]),
        ("Areas by category", list(_table(r["per_category_bbox"]))),
        ("Labels seen together", list(_table(r["cooccurrence_top_pairs"]["pairs"]))),
    ]


def _text(sections: list[tuple[str, list[str]]]) -> str:
    return "\n\n".join("\n".join([title, *lines]) for title, lines in sections) + "\n"


def stats_text(report: dict) -> str:
    return _text(stats_sections(report))


def stats_html(report: dict, title: str = "Dataset profile") -> str:
    """One page without outside parts."""
    blocks = "".join(f"<section><h2>{html.escape(t)}</h2><pre>{html.escape(chr(10).join(lines))}</pre></section>" for t, lines in stats_sections(report))
    style = "body{font:15px sans-serif;max-width:60em;margin:2em auto;padding:0 1em}pre{background:#f6f6f6;padding:.8em;overflow-x:auto}"
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{blocks}</body></html>'


def validation_text(r: dict) -> str:
    verdict = "passes" if r["passes"] else "fails"
    return _text([(f"Validation {verdict}: {r['errors']:,} errors, {r['warnings']:,} warnings", list(_table(r["codes"])) if r["codes"] else ["  no issues"])])


def conversion_text(c: Conversion) -> str:
    counts = [{"rows": k, "input": c.before[k], "output": c.after[k]} for k in c.before]
    return _text([(f"{c.source} to {c.target}", list(_table(counts))), ("Dropped", list(_table(c.dropped)) if c.dropped else ["  nothing"]), *([("Changed by reading", list(_table(c.notes)))] if c.notes else [])])


def diff_text(r: dict) -> str:
    parts = [("Differences", list(_table([{"rows": k} | r[k] for k in ("images", "categories", "annotations")])))]
    for k, v in r.get("detail", {}).items():
        parts.append((k.replace("_", " "), list(_table(v)) if v and isinstance(v[0], dict) else [f"  {x}" for x in v] or ["  (none)"]))
    return _text(parts)


def catalog_text(entries: list[dict]) -> str:
    rows = [{"format": e["name"], "read": "yes" if e["read"] else "no", "write": "yes" if e["write"] else "no", "lossiness": e["lossiness"], "layout": e["layout"], "other names": ", ".join(e["aliases"])} for e in entries]
    return _text([("Formats", list(_table(rows)))])
