"""Sizes of images: by range, of the files that references mean, and of no others."""

import struct

import pytest

from tessera.sources import FORMATS, pictures

SOF = b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 33, 44) + b"\0" * 12


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height) + b"\0" * 9


def segment(kind, length):
    return bytes((0xFF, kind)) + length.to_bytes(2, "big") + b"\0" * (length - 2)


def measured(data):
    """The size found and the reads made."""
    reads = []

    def read(at, n):
        reads.append((at, n))
        return data[at : at + n]

    return pictures.size_in(read), reads


def test_heads_of_every_kind():
    small = {
        png(7, 9): (7, 9),
        b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 5, -6): (5, 6),
        b"BM" + b"\0" * 12 + struct.pack("<IHH", 12, 5, 6) + b"\0" * 4: (5, 6),
        b"GIF89a" + struct.pack("<HH", 3, 4): (3, 4),
        b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (9).to_bytes(3, "little") + (19).to_bytes(3, "little"): (10, 20),
        b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + (9 | 19 << 14).to_bytes(4, "little") + b"\0" * 8: (10, 20),
        b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 10, 20): (10, 20),
        b"\xff\xd8" + SOF: (44, 33),
        b"\xff\xd8\xff\xff" + segment(0xE1, 50) + b"\xff\x01" + segment(0xC4, 9) + SOF: (44, 33),
    }
    for data, size in small.items():
        found, reads = measured(data)
        assert found == size and reads == [(0, pictures.HEAD)], data[:16]


@pytest.mark.parametrize("data", [b"", b"nothing", b"\x89PNG\r\n\x1a\n", png(0, 9), b"BM12", b"GIF89a", b"RIFF\0\0\0\0WEBPVP8?" + b"\0" * 20, b"\xff\xd8", b"\xff\xd8" + segment(0xDA, 9) + SOF, b"\xff\xd8\xff\xe1\0\1" + SOF, b"\xff\xd8" + segment(0xE1, 99)[:50]])
def test_no_size(data):
    assert measured(data)[0] is None


def test_reads_are_bounded():
    """A long file costs one read; a JPEG whose size stands behind n long segments costs a short read for each."""
    assert measured(png(7, 9) + bytes(5_000_000))[1] == [(0, pictures.HEAD)]
    found, reads = measured(b"\xff\xd8" + segment(0xE2, 65_535) * 40 + SOF + bytes(5_000_000))
    assert found == (44, 33) and sum(n for _, n in reads) <= pictures.HEAD + 41 * pictures.FURTHER
    found, reads = measured(b"\xff\xd8" + segment(0xE2, 4) * 30_000 + SOF)  # short ones share reads
    assert found == (44, 33) and len(reads) < 50


def _put(root, **files):
    for name, data in files.items():
        at = root / name.replace("__", "/").replace("_dot_", ".")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)


def test_which_file_a_reference_means(spark, tmp_path):
    root = tmp_path / "a b%20"
    _put(root, **{"both_dot_png": png(1, 1), "images__both_dot_png": png(2, 2), "images__deep__in_dot_png": png(3, 3), "bare_dot_png": png(4, 4), "images__bare_dot_jpg": b"\xff\xd8" + SOF, "last_dot_webp": b"bad", "unread_dot_png": b"bad", "up_dot_PNG": png(6, 6), "img_dot_d__x_dot_jpeg": b"\xff\xd8" + SOF})
    want = {"both.png": 1, "images/both.png": 2, "./deep\\in.png": 3, "bare": 44, "bare.png": 4, "bare.jpg": 44, "gone.png": None, "gone": None, "up": None, "up.PNG": 6, "img.d/x": 44, "both.jpg": None}
    refs = spark.createDataFrame([(k, i) for i, k in enumerate(want)], "file_name string, n int")
    got = pictures.with_sizes(refs, refs, spark, str(root)).collect()
    assert {r.file_name: r.width for r in got} == want and len(got) == len(want)
    guessed = pictures.with_sizes(refs, refs, spark, str(root), guessed=True).collect()
    assert {r.file_name: r.width for r in guessed} == want | {"both.jpg": 1}
    with pytest.raises(Exception, match="no size found in image last.webp"):
        pictures.with_sizes(refs, spark.createDataFrame([("last",)], "file_name string"), spark, str(root)).collect()
    nothing = refs.limit(0)
    assert pictures.with_sizes(nothing, nothing, spark, str(root)).count() == 0
    assert pictures.with_sizes(refs, spark.createDataFrame([(None,)], "file_name string"), spark, str(root)).collect()[0].width is None


def test_listing_reads_no_bytes(spark, tmp_path):
    _put(tmp_path, a_dot_png=b"bad")
    plan = pictures.listing(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_automl_looks_for_the_last_part_of_an_address(spark, tmp_path):
    _put(tmp_path, images__c_dot_png=png(100, 50), p__d_dot_png=png(10, 10), e_dot_png=png(20, 20))
    (tmp_path / "x.csv").write_text("TRAIN,gs://bucket/far/away/c.png,cat,0.1,0.2,,,0.5,0.6,,\nTEST,gs://bucket/p/d.png,cat,0,0,,,1,1,,\nTEST,e.png,dog,0,0,,,1,1,,\n")
    ds = FORMATS["automl-vision"].read(spark, str(tmp_path / "x.csv"), str(tmp_path))
    assert sorted((r.file_name, r.width, r.height) for r in ds.images.collect()) == [("e.png", 20, 20), ("far/away/c.png", 100, 50), ("p/d.png", 10, 10)]


def test_oidv4_finds_other_endings(spark, tmp_path):
    _put(tmp_path, Label__a_dot_txt=b"cat 1 2 3 4\n", images__a_dot_png=png(100, 50))
    ds = FORMATS["oidv4"].read(spark, str(tmp_path), str(tmp_path))
    assert [(r.file_name, r.width) for r in ds.images.collect()] == [("a.jpg", 100)]
