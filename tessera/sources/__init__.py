"""Readers and writers of annotation formats, by name in ``FORMATS``."""

from . import csv_family, json_docs, per_image, tfrecord  # noqa: F401
from .common import FORMATS, Format

#: Other names of formats.
ALIASES = {
    "ir": "ir-json", "coco-json": "coco", "cloud-annotations": "ibm-cloud-annotations", "ibm-cloud": "ibm-cloud-annotations", "cvat-xml": "cvat", "ls": "label-studio",
    "scale": "scale-ai", "unity": "unity-perception", "tfod-csv": "tfod", "tf-record": "tfrecord", "vott": "vott-json", "ultralytics": "yolo", "yolov5": "yolo", "yolov8": "yolo",
    "keras-yolo": "yolo-keras", "pascal-voc": "voc", "huggingface": "hf", "hf-imagefolder": "hf", "sagemaker-manifest": "sagemaker", "createml": "create-ml", "via-json": "via",
    "open-images": "openimages", "automl": "automl-vision", "widerface": "wider-face", "bdd": "bdd100k", "darwin": "v7-darwin", "v7": "v7-darwin",
}


def format_named(name: str) -> Format:
    """A format by its name or another of its names; unknown ones are an error that lists all."""
    name = name.strip().lower()
    found = FORMATS.get(ALIASES.get(name, name))
    if found is None:
        raise ValueError(f"unknown format {name}; there are {', '.join(sorted(FORMATS))}")
    return found
