"""Detection, verbs, reports and the command line."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.cli import main
from tessera.operators.notes import source_notes
from tessera.plans import reports, verbs
from tessera.sources import FORMATS
from tessera.sources.catalog import catalog, catalog_frame
from tessera.sources.detect import UnknownFormat, csv_format, detect, txt_format
from tests.test_formats import make

ROWS = ["coco", "tfod", "udacity", "vott-csv", "kaggle-wheat", "retinanet", "via-csv", "openimages", "automl-vision", "labelbox", "sagemaker", "hf"]
DOCUMENTS = ["ir-json", "create-ml", "bdd100k", "v7-darwin", "label-studio", "scale-ai", "datumaro", "via", "vott-json", "openlabel", "ibm-cloud-annotations", "unity-perception", "edge-impulse"]
FILES = ["cvat", "voc", "tfrecord", "labelme", "superannotate", "supervisely", "cityscapes", "marmot", "yolo", "oidv4", "wider-face"]


@pytest.mark.parametrize("name", [*ROWS, *DOCUMENTS, *FILES])
def test_written_formats_are_detected(spark, tmp_path, name):
    out = str(tmp_path / "out")
    FORMATS[name].write(make(spark, plain=name in ("yolo", "oidv4", "wider-face", "cityscapes")), out)
    assert detect(spark, out) == name


def test_csv_shapes():
    assert csv_format(["image_id,width,height,bbox,source"]) == "kaggle-wheat"
    assert csv_format(['a,10,10,"[1, 2, 3, 4]",x']) == "kaggle-wheat"
    assert csv_format(["filename,width,height,class,xmin,ymin,xmax,ymax", "a,10,10,c,0.1,0.2,0.3,1"]) == "tfod"
    assert csv_format(["filename,width,height,class,xmin,ymin,xmax,ymax", "a,10,10,c,0.1,0.2,0.3,1.5"]) == "udacity"
    assert csv_format(["a.jpg,1,2,3,4,cat"]) == "retinanet"
    assert csv_format(["TRAIN,gs://x/a.jpg,cat,0.1,0.2,,,0.3,0.4,,"]) == "automl-vision"
    assert csv_format(["a,b"]) is None and csv_format([]) is None


def test_txt_shapes():
    assert txt_format(["2", "a/b.jpg", "1", "1 2 3 4 0 0 0 0 0 0"], "x.txt") == "wider-face"
    assert txt_format(["a.jpg 1,2,3,4,0"], "yolo_keras_train.txt") == "yolo-keras"
    assert txt_format(["a.jpg 1,2,3,4,0"], "pytorch-yolov4.txt") == "yolov4-pytorch"
    assert txt_format(["a.jpg 1,2,3,4,0"], "train.txt") is None


def test_nothing_fits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    with pytest.raises(UnknownFormat):
        detect(spark, str(tmp_path))
    (tmp_path / "b.json").write_text('{"x": 1}')
    with pytest.raises(UnknownFormat):
        detect(spark, str(tmp_path / "b.json"))


def test_convert_and_reports(spark, tmp_path):
    coco, ir, out = str(tmp_path / "coco"), str(tmp_path / "ir"), str(tmp_path / "out")
    FORMATS["coco"].write(make(spark), coco)
    c = verbs.convert(spark, coco, ir, "ir-json")
    assert not c.lossy and c.before == c.after
    with pytest.raises(verbs.Refused):
        verbs.convert(spark, coco, out, "tfod")
    c = verbs.convert(spark, coco, out, "tfod", allow_lossy=True)
    assert {d["code"] for d in c.dropped} >= {"drop_annotation_confidence", "drop_images_without_annotations"}
    assert c.before["images"] == 4 and c.after["images"] == 3
    assert "drop_annotation_confidence" in reports.conversion_text(c) and json.loads(reports.to_json(c))["lossy"]
    r = verbs.stats_report(spark, coco)
    assert r["summary"] == {"images": 4, "categories": 3, "annotations": 5, "licenses": 0, "annotated_images": 3}
    assert "Summary" in reports.stats_text(r) and "&lt;y&gt;" in reports.stats_html(r)
    d = verbs.diff_report(spark, coco, ir, detail=True)
    assert d["annotations"] == {"shared": 5, "only_in_a": 0, "only_in_b": 0, "modified": 0} and d["detail"]["modified"] == []
    assert verbs.diff_report(spark, coco, ir, match_by="iou")["annotations"]["shared"] == 5
    assert "images" in reports.diff_text(d)
    v = verbs.validation_report(spark, coco)
    assert v["passes"] and "passes" in reports.validation_text(v)
    s = verbs.sample_to(spark, coco, str(tmp_path / "some"), "coco", n=2, categories=["cat"], allow_lossy=True)
    assert s.before["images"] == 2


def test_command_line(spark, tmp_path, capsys):
    coco = str(tmp_path / "coco")
    FORMATS["coco"].write(make(spark), coco)
    assert main(["list-formats", "--output-format", "json"]) == 0
    assert {e["name"] for e in json.loads(capsys.readouterr().out)} == set(FORMATS)
    assert main(["stats", coco, "--output-format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["annotations"] == 5
    assert main(["validate", coco]) == 0
    assert main(["diff", coco, coco, "--detail"]) == 0
    assert main(["convert", "-i", coco, "-o", str(tmp_path / "no"), "--to", "tfod"]) == 2
    assert main(["sample", "-i", coco, "-o", str(tmp_path / "s"), "--to", "coco", "-n", "1", "--allow-lossy"]) == 0
    assert main(["stats", str(tmp_path), "--format", "nonsense"]) == 2


def test_catalog(spark):
    assert len(catalog()) == 39 and {e["lossiness"] for e in catalog()} == {"lossless", "conditional", "lossy"}
    assert catalog_frame(spark).count() == 39
    assert "ir-json" in reports.catalog_text(catalog())


def test_what_reading_changed(spark, tmp_path):
    at, out = tmp_path / "in.ndjson", str(tmp_path / "out")
    box, shape = {"left": 1, "top": 1, "width": 4, "height": 4}, [{"x": 0, "y": 0}, {"x": 9, "y": 0}, {"x": 9, "y": 5}]
    objects = [{"name": "c", "bounding_box": box}, {"name": "c", "polygon": shape}, {"name": "c", "point": {"x": 1, "y": 1}}, {"name": "d"}]
    row = {"data_row": {"id": "r", "external_id": "a.jpg"}, "media_attributes": {"width": 20, "height": 20}, "projects": {"p": {"labels": [{"annotations": {"objects": objects}}]}}}
    at.write_text(json.dumps(row) + "\n")
    with pytest.raises(verbs.Refused, match="labelbox_polygon_envelope_applied, labelbox_unsupported_objects_skipped"):
        verbs.convert(spark, str(at), out, "ir-json", "labelbox")
    c = verbs.convert(spark, str(at), out, "ir-json", "labelbox", allow_lossy=True)
    assert not c.dropped and [(n["code"], n["severity"], n["count"]) for n in c.notes] == [("labelbox_polygon_envelope_applied", "warning", 1), ("labelbox_unsupported_objects_skipped", "warning", 2)]
    assert c.after["annotations"] == 2 and "Changed by reading" in reports.conversion_text(c) and json.loads(reports.to_json(c))["notes"] == c.notes


def test_notes_that_only_inform(spark, tmp_path):
    ds = make(spark)
    grey = ds.changed(images=ds.images.withColumn("attributes", F.create_map(F.lit("depth"), F.when(F.col("id") == 1, "1").when(F.col("id") == 2, "x").otherwise("3"))))
    assert source_notes(grey, "voc") == [{"code": "voc_reader_depth_handling", "severity": "info", "count": 1}]
    assert source_notes(ds, "voc") == [] and source_notes(grey, "coco") == []
    c = verbs.Conversion("voc", "coco", {}, {}, [], source_notes(grey, "voc"))
    assert not c.lossy and verbs.Conversion("voc", "coco", {}, {}, [], [{"code": "x", "severity": "warning", "count": 1}]).lossy


def test_splits_of_image_folders(spark, tmp_path):
    line = lambda n: json.dumps({"file_name": n, "width": 9, "height": 9, "objects": {"bbox": [[1, 1, 2, 2]], "categories": ["c"]}}) + "\n"
    for split, name in (("train", "a.jpg"), ("test", "b.jpg")):
        (tmp_path / "hf" / split).mkdir(parents=True)
        (tmp_path / "hf" / split / "metadata.jsonl").write_text(line(name))
        (tmp_path / "hf" / split / name).write_bytes(b"\xff\xd8 no text")
    read = FORMATS["hf"].read
    names = lambda ds: sorted(r.file_name for r in ds.images.collect())
    at = str(tmp_path / "hf")
    assert names(read(spark, at)) == ["a.jpg", "b.jpg"] and names(read(spark, at, split="test")) == ["b.jpg"]
    assert names(verbs.load(spark, at, "hf", split="train")[0]) == ["a.jpg"]
    with pytest.raises(ValueError, match="no split 'dev'"):
        read(spark, at, split="dev")
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "metadata.jsonl").write_text(line("c.jpg"))
    assert names(read(spark, str(tmp_path / "one"))) == ["c.jpg"]
    with pytest.raises(ValueError, match="at the root"):
        read(spark, str(tmp_path / "one"), split="train")


def test_splits_of_parquet_files(spark, tmp_path):
    at = tmp_path / "p"
    for place, name in (("data/train-00000-of-00001.parquet", "a.jpg"), ("data/val-00000-of-00001.parquet", "b.jpg"), ("valid/x.parquet", "c.jpg"), ("data/dev.parquet", "d.jpg")):
        (at / place).parent.mkdir(parents=True, exist_ok=True)
        objects = {"bbox": [[1.0, 1.0, 2.0, 2.0]], "categories": ["c"]}
        pq.write_table(pa.Table.from_pylist([{"file_name": name, "width": 9, "height": 9, "objects": objects}]), at / place)
    read = lambda split=None: sorted(r.file_name for r in FORMATS["hf"].read(spark, str(at), parquet=True, split=split).images.collect())
    assert read() == ["a.jpg", "b.jpg", "c.jpg", "d.jpg"]
    assert read("train") == ["a.jpg"] and read("val") == read("validation") == ["b.jpg", "c.jpg"] and read("dev") == ["d.jpg"]
    with pytest.raises(ValueError, match="no Parquet files"):
        read("test")
