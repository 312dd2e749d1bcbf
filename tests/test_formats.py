"""Every format writes a dataset and reads it back."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.model import dataset
from tessera.operators.lossiness import TARGETS
from tessera.sources import ALIASES, FORMATS, format_named
from tessera.sources.common import write_files
from tessera.sources.pictures import image_sizes

IMAGES = [(1, "b one.jpg", 200, 100), (2, "a.png", 64, 48), (3, "c.jpg", 30, 20), (5, "empty.png", 10, 12)]
BOXES = [(1, 1, 1, 10.0, 20.0, 110.5, 60.25, None), (2, 1, 2, 0.0, 0.0, 200.0, 100.0, 0.5), (3, 2, 1, 1.0, 2.0, 3.0, 4.0, 0.25), (4, 3, 2, 3.0, 3.0, 27.0, 18.0, None), (7, 2, 3, 8.0, 8.0, 32.0, 24.0, None)]
NAMES = {1: "cat", 2: 'dog "x", <y> & z', 3: "person"}
WITH_IMAGES = {"openimages", "automl-vision", "ibm-cloud-annotations", "yolo", "kitti"}
ONE_CLASS = {"kaggle-wheat": "wheat_head", "wider-face": "face"}


def png(width, height):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IEND", b"")


def bmp(width, height):
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54, 0, 0, 54, 40, width, height, 1, 24, 0, 0, 0, 0, 0, 0)


def make(spark, plain=False):
    clean = (lambda s: "".join(c if c.isalnum() else "_" for c in s)) if plain else (lambda s: s)
    i = spark.createDataFrame([(a, b.replace(" ", "_") if plain else b, c, d, n) for n, (a, b, c, d) in enumerate(IMAGES)], "id long, file_name string, width long, height long, _ord long").withColumn("attributes", F.create_map().cast("map<string,string>"))
    c = spark.createDataFrame([(k, clean(v), "animal" if k < 3 else None, k) for k, v in NAMES.items()], "id long, name string, supercategory string, _ord long")
    a = spark.createDataFrame([(*b, {}, n) for n, b in enumerate(BOXES)], "id long, image_id long, category_id long, xmin double, ymin double, xmax double, ymax double, confidence double, attributes map<string,string>, _ord long")
    return dataset(i, c, a, info={"name": "test"})


def rows(ds):
    a = ds.annotations.join(ds.images.select(F.col("id").alias("i"), "file_name"), F.col("image_id") == F.col("i")).join(ds.categories.select(F.col("id").alias("c"), "name"), F.col("category_id") == F.col("c"))
    return sorted((r.file_name, r.name, r.xmin, r.ymin, r.xmax, r.ymax, r.confidence) for r in a.collect())


@pytest.mark.parametrize("name", sorted(FORMATS))
def test_round_trip(spark, tmp_path, name):
    f = FORMATS[name]
    plain = name in ("yolo-keras", "yolov4-pytorch", "oidv4", "kitti", "yolo", "wider-face", "cityscapes")
    ds = make(spark, plain)
    out = str(tmp_path / "out")
    f.write(ds, out)
    pictures = tmp_path / "pictures"
    pictures.mkdir()
    for _, n, w, h in IMAGES:
        n = n.replace(" ", "_") if plain else n
        (pictures / n).write_bytes(png(w, h) if n.endswith("png") else bmp(w, h))
    back = f.read(spark, out, images=str(pictures)) if name in WITH_IMAGES else f.read(spark, out)
    got, want = rows(back), rows(ds)
    if name in ONE_CLASS:
        want = sorted((r[0], ONE_CLASS[name], *r[2:]) for r in want)
    if name == "cityscapes":
        fix = lambda n: n.rsplit(".", 1)[0]
        got = sorted((fix(r[0]).replace("train/city/", "").replace("_leftImg8bit", ""), *r[1:]) for r in got)
        want = sorted((fix(r[0]), *r[1:]) for r in want)
    if name in ("oidv4", "marmot"):
        cut = lambda rs: sorted((r[0].rsplit(".", 1)[0], *r[1:]) for r in rs)
        got, want = cut(got), cut(want)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[2:6] == pytest.approx(w[2:6], abs=2e-2 if name == "kitti" else 2e-3)
        if "confidence" in f.keeps and name not in ("openimages", "sagemaker"):
            assert g[6] == w[6]
    assert [r.id for r in back.images.orderBy("file_name").collect()] == ([2, 1, 3, 5] if "ids" in f.keeps else list(range(1, back.images.count() + 1)))


def test_names():
    assert set(FORMATS) == set(TARGETS) and len(FORMATS) == 39
    assert all(v in FORMATS for v in ALIASES.values())
    assert format_named(" Pascal-VOC ").name == "voc"
    with pytest.raises(ValueError):
        format_named("nothing")


def test_strict_writers_reject_orphans(spark, tmp_path):
    ds = make(spark)
    lost = ds.changed(categories=ds.categories.where("id > 1"))
    with pytest.raises(Exception, match="has no category"):
        FORMATS["tfod"].write(lost, str(tmp_path / "a"))
    FORMATS["create-ml"].write(lost, str(tmp_path / "b"))
    assert "unknown" in {r.name for r in FORMATS["create-ml"].read(spark, str(tmp_path / "b")).categories.collect()}


def test_inconsistent_sizes_are_errors(spark, tmp_path):
    (tmp_path / "x.csv").write_text("filename,width,height,class,xmin,ymin,xmax,ymax\na.jpg,10,10,c,0,0,1,1\na.jpg,11,10,c,0,0,1,1\n")
    with pytest.raises(Exception, match="different sizes"):
        FORMATS["udacity"].read(spark, str(tmp_path)).images.collect()


def test_line_order_makes_annotation_ids(spark, tmp_path):
    body = "".join(f"i{n % 7}.jpg,{n},0,{n + 1},1,c\n" for n in range(500))
    (tmp_path / "x.csv").write_text(body)
    got = [r.xmin for r in FORMATS["retinanet"].read(spark, str(tmp_path)).annotations.orderBy("id").collect()]
    assert got == [float(n) for n in range(500)]


def test_sharded_documents(spark, tmp_path):
    ds = make(spark)
    FORMATS["coco"].write(ds, str(tmp_path / "c"), shards=3)
    back = FORMATS["coco"].read(spark, str(tmp_path / "c"))
    assert rows(back) == rows(ds) and back.categories.count() == 3


def test_repeated_annotation_ids_keep_their_labels(spark, tmp_path):
    ds = make(spark)
    ds = ds.changed(annotations=ds.annotations.withColumn("id", F.lit(1).cast("long")))
    for name in ("openlabel", "datumaro", "edge-impulse", "via", "vott-json", "cvat", "coco"):
        FORMATS[name].write(ds, str(tmp_path / name))
        assert [r[:6] for r in rows(FORMATS[name].read(spark, str(tmp_path / name)))] == [r[:6] for r in rows(ds)], name


@pytest.mark.parametrize("name", ["ir-json", "coco", "openlabel", "cvat", "create-ml", "via", "wider-face", "tfrecord"])
def test_documents_of_nothing_and_of_many_shards(spark, tmp_path, name):
    f = FORMATS[name]
    ds = make(spark, True)
    f.write(ds, str(tmp_path / "many"), shards=7)
    assert len(rows(f.read(spark, str(tmp_path / "many")))) == len(BOXES)
    none = ds.changed(images=ds.images.limit(0), annotations=ds.annotations.limit(0))
    f.write(none, str(tmp_path / "none"))
    if name != "tfrecord":  # a file without records is no file
        assert f.read(spark, str(tmp_path / "none")).annotations.count() == 0


@pytest.mark.parametrize("bad", ["../x.jpg", "/etc/x.jpg", "a/../../x.jpg", "C:\\x.jpg", "\\x.jpg"])
def test_files_stay_below_their_folder(spark, tmp_path, bad):
    ds = make(spark)
    with pytest.raises(Exception, match="not a path below the folder"):
        write_files(ds.images.limit(1).select(F.lit(bad).alias("name"), F.lit("x").alias("content")), str(tmp_path / "out"))


def test_sizes_far_into_a_file(spark, tmp_path):
    segment = b"\xff\xe2" + (65533).to_bytes(2, "big") + b"\0" * 65531
    size = b"\xff\xc0" + (17).to_bytes(2, "big") + b"\x08" + (33).to_bytes(2, "big") + (44).to_bytes(2, "big") + b"\0" * 12
    (tmp_path / "far.JPG").write_bytes(b"\xff\xd8" + segment * 6 + size)
    (tmp_path / "near.Gif").write_bytes(b"GIF89a" + (7).to_bytes(2, "little") + (9).to_bytes(2, "little"))
    assert {tuple(r) for r in image_sizes(spark, str(tmp_path)).collect()} == {("far.JPG", 44, 33), ("near.Gif", 7, 9)}
    (tmp_path / "broken.png").write_bytes(b"nothing")
    with pytest.raises(Exception, match="no size found"):
        image_sizes(spark, str(tmp_path)).collect()


def _kept(ds):
    return [dict(r.attributes) for r in ds.annotations.orderBy("id").collect()], [dict(r.attributes) for r in ds.images.orderBy("id").collect()]


def _again(spark, tmp_path, name, ds):
    """What a dataset's attributes are when it is written and read once more."""
    out = str(tmp_path / "again")
    FORMATS[name].write(ds, out)
    return _kept(FORMATS[name].read(spark, out))


def test_cvat_attributes(spark, tmp_path):
    box = '<box label="cat" occluded="1" xtl="1" ytl="2" xbr="3" ybr="4">'
    own = '<attribute name="color">red &amp; blue</attribute><attribute name=" side ">left</attribute><attribute name="color"> green </attribute><attribute name="none"></attribute>'
    (tmp_path / "a.xml").write_text(f'<annotations><image id="0" name="a.png" width="9" height="9">{box}{own}</box>{box}</box></image></annotations>')
    ds = FORMATS["cvat"].read(spark, str(tmp_path / "a.xml"))
    want = {"occluded": "1", "cvat_attr_color": "green", "cvat_attr_side": "left", "cvat_attr_none": ""}
    assert _kept(ds)[0] == [want, {"occluded": "1"}]
    got = _again(spark, tmp_path, "cvat", ds)[0]
    assert [{k: v for k, v in g.items() if k not in ("z_order", "source")} for g in got] == [want, {"occluded": "1"}]


def test_via_attributes(spark, tmp_path):
    shape = '"shape_attributes":{"name":"rect","x":1,"y":2,"width":3,"height":4}'
    regions = ",".join(f'{{{shape},"region_attributes":{r}}}' for r in ('{"label":"cat","class":"x","n":2}', '{"label":"","class":"dog","age":"3"}', '{"kind":"bird"}', '{"a":"1","b":"2"}'))
    (tmp_path / "a.json").write_text(f'{{"a.png7":{{"filename":"a.png","size":7,"regions":[{regions}],"file_attributes":{{"place":"sea","gone":null}}}}}}')
    ds = FORMATS["via"].read(spark, str(tmp_path / "a.json"))
    want = [{"via_region_attr_class": "x", "via_region_attr_n": "2"}, {"via_region_attr_label": "", "via_region_attr_age": "3"}, {}]
    image = [{"via_size_bytes": "7", "via_file_attr_place": "sea"}]
    assert _kept(ds) == (want, image)
    assert [r[1] for r in rows(ds)] == ["bird", "cat", "dog"]
    # a blank label beside the one in use isn't written
    assert _again(spark, tmp_path, "via", ds) == ([want[0], {"via_region_attr_age": "3"}, {}], image)


def test_unity_attributes(spark, tmp_path):
    text = '{"frame":3,"sequence":1,"step":2,"timestamp":0.5,"captures":[{"id":"cam","sequence_id":"s 1","filename":"a.png","dimension":[9,9],"annotations":[]}]}'
    (tmp_path / "step0.frame_data.json").write_text(text)
    ds = FORMATS["unity-perception"].read(spark, str(tmp_path))
    want = {"capture_id": "cam", "sequence_id": "s 1", "sequence": "1", "step": "2", "frame": "3", "timestamp": "0.5", "sensor_id": "cam"}
    want = [{f"unity_perception_{k}": v for k, v in want.items()}]
    assert _kept(ds)[1] == want
    assert _again(spark, tmp_path, "unity-perception", ds)[1] == want


def _yolo(root, yaml, images, labels):
    for at, (w, h) in images.items():
        (root / at).parent.mkdir(parents=True, exist_ok=True)
        (root / at).write_bytes(png(w, h))
    for at, text in labels.items():
        (root / at).parent.mkdir(parents=True, exist_ok=True)
        (root / at).write_text(text)
    (root / "data.yaml").write_text(yaml)


def test_yolo_splits(spark, tmp_path):
    labels = {"labels/train/a.txt": "0 0.5 0.5 0.2 0.4\n", "labels/train/deep/b.txt": "1 0.5 0.5 1 1\n", "val/labels/a.txt": "1 0.5 0.5 0.5 0.5 0.25\n"}
    images = {"images/train/a.png": (100, 50), "images/train/deep/b.png": (10, 10), "val/images/a.png": (20, 20), "val/images/c.png": (5, 6)}
    _yolo(tmp_path, "path: .\ntrain: images/train  # most\nval: './val'\nnames: [cat, dog]\n", images, labels)
    f = FORMATS["yolo"]
    ds = f.read(spark, str(tmp_path))
    train = [("train/a.png", "cat", 40.0, 15.0, 60.0, 35.0, None), ("train/deep/b.png", "dog", 0.0, 0.0, 10.0, 10.0, None)]
    val = [("val/a.png", "dog", 5.0, 5.0, 15.0, 15.0, 0.25)]
    assert rows(ds) == train + val
    assert ds.info["attributes"] == {"yolo_layout_mode": "split_aware", "yolo_splits_found": "train,val", "yolo_splits_read": "train,val"}
    one = f.read(spark, str(tmp_path), split="val")
    assert rows(one) == val
    assert sorted((r.file_name, r.width) for r in one.images.collect()) == [("val/a.png", 20), ("val/c.png", 5)]
    with pytest.raises(ValueError, match="train, val"):
        f.read(spark, str(tmp_path), split="test")


def test_yolo_image_lists(spark, tmp_path):
    images = {"images/train/a.png": (10, 10), "other/b.png": (10, 10), "images/c.png": (10, 10), "images/train/unlisted.png": (10, 10)}
    labels = {"labels/train/a.txt": "0 0.5 0.5 1 1\n", "other/b.txt": "1 0.5 0.5 1 1\n", "labels/train/unlisted.txt": "0 0.5 0.5 1 1\n"}
    _yolo(tmp_path, "train: train.txt\nnames:\n  0: cat\n  1: dog\n", images, labels)
    (tmp_path / "train.txt").write_text(f"# all\n./images/train/a.png\nother/b.png\n\n{tmp_path}/images/c.png\n")
    ds = FORMATS["yolo"].read(spark, str(tmp_path))
    assert rows(ds) == [("train/a.png", "cat", 0.0, 0.0, 10.0, 10.0, None), ("train/other/b.png", "dog", 0.0, 0.0, 10.0, 10.0, None)]
    assert sorted(r.file_name for r in ds.images.collect()) == ["train/a.png", "train/c.png", "train/other/b.png"]
    (tmp_path / "train.txt").write_text("images/missing.png\n")
    with pytest.raises(Exception, match="isn't there"):
        FORMATS["yolo"].read(spark, str(tmp_path)).images.collect()


def test_yolo_labels_without_an_image(spark, tmp_path):
    _yolo(tmp_path, "names: [cat]\n", {"images/a.png": (10, 10)}, {"labels/a.txt": "0 0.5 0.5 1 1\n", "labels/b.txt": "0 0.5 0.5 1 1\n"})
    with pytest.raises(Exception, match="labels without an image: b"):
        FORMATS["yolo"].read(spark, str(tmp_path)).annotations.collect()
