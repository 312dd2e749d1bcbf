"""TFRecord examples of a batch, by column, against those made and read one by one."""

import pyarrow as pa

from tessera.sources import tfrecord


def batch(images):
    own = [(k, pa.int64()) for k in tfrecord._WHOLES] + [(k, pa.float32()) for k in tfrecord._FLOATS]
    item = pa.struct([("label", pa.string()), ("c", pa.int64()), *[(e, pa.float64()) for e in tfrecord._EDGES], *own])
    return pa.RecordBatch.from_pylist(images, pa.schema([("file_name", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("items", pa.list_(item)), *[(k, pa.string()) for k in tfrecord._OF_IMAGE]]))


def one(label, c, **more):
    return {"label": label, "c": c, "xmin": 0.25, "ymin": 0.1, "xmax": 1.5, "ymax": -2.0} | more


IMAGES = [
    {"file_name": "é" * 200 + ".jpg", "width": 320, "height": 20_000_000, "items": [one("cät", 1, iscrowd=1, area=2.5), one("x" * 20_000, -4, iscrowd=0)], "tfrecord_source_id": "s"},
    {"file_name": "b.jpg", "width": 1, "height": 1, "items": []},
    {"file_name": "c.jpg", "width": 1, "height": 1, "items": None, "tfrecord_format": "png"},
    {"file_name": "d.jpg", "width": 129, "height": 127, "items": [one("a", 300, area=0.1, difficult=1)] * 3},
]


def test_examples_by_column():
    b = batch(IMAGES)
    for sliced, images in ((b, IMAGES), (b.slice(1, 3), IMAGES[1:])):
        expected = []
        for r in images:
            items = r["items"] or []
            f = {"image/filename": [r["file_name"].encode()], "image/width": [r["width"]], "image/height": [r["height"]]}
            f |= {feature: [r[k].encode()] for k, feature in tfrecord._OF_IMAGE.items() if k in r}
            f |= {"image/object/class/text": [x["label"].encode() for x in items], "image/object/class/label": [x["c"] for x in items]}
            f |= {f"image/object/bbox/{e}": [x[e] for x in items] for e in tfrecord._EDGES}
            f |= {feature: [x[k] for x in items] for k, feature in (tfrecord._WHOLES | tfrecord._FLOATS).items() if items and all(k in x for x in items)}
            expected.append(tfrecord.encode_example(f))
        assert tfrecord._encoded(sliced) == expected
        assert tfrecord.frame_each(expected) == [tfrecord.frame(x) for x in expected]


def test_rows_by_column():
    bodies = tfrecord._encoded(batch(IMAGES))
    bodies.append(tfrecord.encode_example({"image/filename": [b"e"], "image/encoded": [b"p"], "odd": [1], "image/object/bbox/xmin": [0.5, 1.0], "image/object/weight": [0.1]}))
    rows = tfrecord._batch_of("p", [0, 9, 20, 30, 44], bodies).to_pylist()
    assert [r["file_name"] for r in rows] == [*(x["file_name"] for x in IMAGES), "e"] and [r["at"] for r in rows] == [0, 9, 20, 30, 44]
    assert rows[0]["texts"] == ["cät", "x" * 20_000] and rows[0]["labels"] == [1, -4] and rows[0]["xmin"] == [0.25, 0.25] and rows[0]["attributes"] == [("tfrecord_source_id", "s")]
    assert rows[0]["own"] == [[("tfrecord_class_label", "1"), ("iscrowd", "1")], [("tfrecord_class_label", "-4"), ("iscrowd", "0")]]
    assert rows[3]["own"][2] == [("tfrecord_class_label", "300"), ("area", "0.1"), ("difficult", "1")] and rows[1]["own"] == [] == rows[2]["texts"]
    assert rows[4]["attributes"] == [("tfrecord_had_encoded_image", "true")] and rows[4]["others"] == ["odd"] and rows[4]["own"] == [[("tfrecord_weight", "0.1")], []]
