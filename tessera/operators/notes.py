"""What reading a source has already changed or left out, from what its reader noted in the dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.model import AnnotationDataset


@dataclass(frozen=True)
class Note:
    """A code and where its number comes from: ``part`` is 'annotations' or 'images', whose rows with ``key`` are counted, or 'info', where it stands.

    ``value`` is a pattern for the attribute; a note that ``warns`` makes a conversion lossy.
    """

    code: str
    part: str
    key: str
    value: str | None = None
    warns: bool = True


#: The codes of each source.
NOTES = {
    "label-studio": (Note("label_studio_rotation_dropped", "annotations", "ls_rotation_deg"),),
    "labelbox": (
        Note("labelbox_polygon_envelope_applied", "annotations", "labelbox_polygon_enveloped"),
        Note("labelbox_unsupported_objects_skipped", "info", "labelbox_skipped_objects"),
    ),
    "scale-ai": (Note("scale_ai_geometry_envelope_applied", "annotations", "scale_ai_enveloped"),),
    "unity-perception": (Note("unity_perception_unsupported_annotations_skipped", "info", "unity_perception_skipped_annotations"),),
    "voc": (Note("voc_reader_depth_handling", "images", "depth", r"^\s*0*(?!3\s*$)\d+\s*$", warns=False),),
    "labelme": (Note("labelme_polygon_envelope_applied", "annotations", "labelme_shape_type", "^polygon$", warns=False),),
}


def _met(note: Note) -> Column:
    value = F.try_element_at("attributes", F.lit(note.key))
    return F.count_if(value.isNotNull() if note.value is None else F.coalesce(value.rlike(note.value), F.lit(False))).alias(note.code)


def source_notes(ds: AnnotationDataset, source: str) -> list[dict]:
    """Code, severity ('warning' or 'info') and number of rows, for each code of ``source`` that applies."""
    notes = NOTES.get(source, ())
    found = {n.code: int(ds.info.get("attributes", {}).get(n.key, 0)) for n in notes if n.part == "info"}
    for part, rows in (("annotations", ds.annotations), ("images", ds.images)):
        asked = [n for n in notes if n.part == part]
        if asked:
            found |= rows.agg(*[_met(n) for n in asked]).first().asDict()
    return [{"code": n.code, "severity": "warning" if n.warns else "info", "count": found[n.code]} for n in notes if found[n.code]]
