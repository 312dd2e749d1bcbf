"""TFRecord files in ranges: the same rows wherever they are cut, and what is broken is found."""

import random
import struct
import time

import pytest

from tessera.sources import FORMATS, tfrecord


def example(i, extra=0, payload=None):
    boxes = {f"image/object/bbox/{e}": [v] * (i % 3) for e, v in zip(("xmin", "ymin", "xmax", "ymax"), (0.0, 0.25, 0.5, 1.0), strict=True)}
    data = random.Random(i).randbytes(extra) if payload is None else payload
    return tfrecord.encode_example({"image/filename": [b"%05d.png" % i], "image/width": [100], "image/height": [80], "image/encoded": [data], "image/object/class/text": [b"cat"] * (i % 3), "image/object/class/label": [1] * (i % 3), **boxes})


def write(path, bodies):
    path.write_bytes(b"".join(map(tfrecord.frame, bodies)))


def rows(spark, path, split):
    ds = FORMATS["tfrecord"].read(spark, str(path), split)
    return sorted(map(tuple, ds.annotations.select("id", "image_id", "category_id", "xmin", "ymin", "xmax", "ymax").collect())), sorted((r.id, r.file_name) for r in ds.images.collect())


def test_same_rows_wherever_files_are_cut(spark, tmp_path):
    root = tmp_path / "some records"
    root.mkdir()
    write(root / "a.tfrecord", [example(i, 20_000 if i == 7 else i) for i in range(40)])  # one record spans ranges
    write(root / "b%20.tfrecord", [example(i, 5) for i in range(40, 43)])
    (root / "none.tfrecord").write_bytes(b"")
    want = rows(spark, root, 1 << 30)
    assert len(want[1]) == 43 and len(want[0]) == sum(i % 3 for i in range(43))
    assert all(rows(spark, root, split) == want for split in (1_000, 4_096))
    assert len(rows(spark, root / "a.tfrecord", 1_000)[1]) == 40
    starts = [r.start for r in tfrecord.ranges(spark, str(root / "a.tfrecord"), 1_000).collect()]
    assert len(starts) > 10 and len(set(starts)) == len(starts)


def test_records_inside_records(spark, tmp_path):
    """A record that holds whole records, right down to their checksums, isn't cut at them."""
    inner = b"".join(tfrecord.frame(example(900 + i, 50)) for i in range(30))
    write(tmp_path / "a.tfrecord", [example(0), example(1, payload=inner), example(2), *[example(i, 300) for i in range(3, 30)]])
    want = [(i + 1, "%05d.png" % i) for i in range(30)]
    assert rows(spark, tmp_path, 700)[1] == want
    assert [r.start for r in tfrecord.ranges(spark, str(tmp_path), 700).collect()] == [0]


@pytest.mark.parametrize("at,what", [(0, "broken record length at byte 0"), (20, "broken record at byte 0"), (-1, "broken record at byte"), (None, "broken record")])
@pytest.mark.parametrize("split", [500, 1 << 20])
def test_broken_files(spark, tmp_path, at, what, split):
    write(tmp_path / "a.tfrecord", [example(i, 200) for i in range(12)])
    data = bytearray((tmp_path / "a.tfrecord").read_bytes())
    if at is None:
        del data[-9:]
    else:
        data[at] ^= 1
    (tmp_path / "a.tfrecord").write_bytes(data)
    with pytest.raises(Exception, match=what):
        tfrecord.ranges(spark, str(tmp_path), split).mapInArrow(tfrecord._examples(tfrecord.qualified(spark, str(tmp_path))), tfrecord._ROW).collect()


def test_attributes_both_ways(spark, tmp_path):
    boxes = {f"image/object/bbox/{e}": [v, v] for e, v in zip(("xmin", "ymin", "xmax", "ymax"), (0.0, 0.25, 0.5, 1.0), strict=True)}
    size = {"image/width": [100], "image/height": [80]}
    more = {"image/object/area": [12.5, 0.1], "image/object/is_crowd": [0, 1], "image/object/weight": [100.0], "image/object/class/label": [7, 8], "image/zoo": [1], "other": [b"x"]}
    first = {"image/filename": [b"a.png"], "image/source_id": [b"s1"], **size, **boxes, **more, "image/encoded": [b"\x89PNG"]}
    again = {"image/filename": [b"a.png"], "image/source_id": [b"s2"], "image/format": [b"png"], **size}
    root = tmp_path / "in"
    root.mkdir()
    write(root / "a.tfrecord", [tfrecord.encode_example(x) for x in (first, again)])
    ds = FORMATS["tfrecord"].read(spark, str(root))
    assert [dict(r.attributes) for r in ds.images.collect()] == [{"tfrecord_source_id": "s1", "tfrecord_format": "png", "tfrecord_had_encoded_image": "true"}]
    own = [dict(r.attributes) for r in ds.annotations.orderBy("id").collect()]
    assert own == [{"tfrecord_class_label": "7", "area": "12.5", "iscrowd": "0", "tfrecord_weight": "100"}, {"tfrecord_class_label": "8", "area": "0.1", "iscrowd": "1"}]
    assert sorted(r.name for r in ds.categories.collect()) == ["7", "8"]
    assert ds.info["attributes"] == {"tfrecord_unsupported_feature_count": "2", "tfrecord_unsupported_feature_keys": "image/zoo,other"}
    FORMATS["tfrecord"].write(ds, str(tmp_path / "out"))
    back = FORMATS["tfrecord"].read(spark, str(tmp_path / "out"))
    assert [dict(r.attributes) for r in back.images.collect()] == [{"tfrecord_source_id": "s1", "tfrecord_format": "png"}]
    # the weight of one box of two isn't written
    assert [dict(r.attributes) for r in back.annotations.orderBy("id").collect()] == [{k: v for k, v in x.items() if k != "tfrecord_weight"} for x in own]
    for bad, what in ((again | {"image/width": [9]}, "differ in the size of image a.png"), (size, "no file name")):
        write(root / "b.tfrecord", [tfrecord.encode_example(bad)])
        with pytest.raises(Exception, match=what):
            FORMATS["tfrecord"].read(spark, str(root)).images.collect()


def test_first_record_in_a_range():
    data = random.Random(1).randbytes(5_000) + tfrecord.frame(b"x" * 100) + struct.pack("<Q", 1 << 40) * 3
    read = lambda at, n: data[at : at + n]
    assert tfrecord.first_record(read, 10, len(data), len(data)) == 5_000
    assert tfrecord.first_record(read, 5_000, 5_001, len(data)) == 5_000
    assert tfrecord.first_record(read, 10, 5_000, len(data)) is None and tfrecord.first_record(read, 5_001, len(data), len(data)) is None
    assert tfrecord.first_record(read, 10, len(data), 5_050) is None  # longer than its file


def test_checksums_of_several():
    rng = random.Random(2)
    bodies = [rng.randbytes(n) for n in (0, 1, 3, 4, 5, 7, 8, 100, 127, 128, 2047, 2048, 5000)] * 3
    assert tfrecord.crc32c_each(bodies) == [tfrecord.crc32c(b) for b in bodies] and tfrecord.crc32c_each([]) == []


def test_short_records_are_checked_fast():
    bodies = [random.Random(3).randbytes(1_000)] * 4_000
    start = time.process_time()
    tfrecord.crc32c_each(bodies)
    assert len(bodies) * 1_000 / (time.process_time() - start) > 20e6
