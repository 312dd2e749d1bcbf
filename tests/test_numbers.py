"""Numbers as text: every finite double comes back, without exponents."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tessera.sources.common import number


def test_numbers_come_back(spark):
    rng = random.Random(5)
    some = [0.0, -0.0, 1.0, -2.5, 0.1, 1e-3, 9.99e-4, 1e7, 12345678.5, 123456789.125, 1e14, 1e15, 1.5e20, -1.5e20, 1e22, 5e-324, 1.7976931348623157e308, 1e-18, 1.25e-19, 2**53 + 2.0, 1e16 + 2, 123456789012345.6]
    some += [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(300)) if x == x and abs(x) < float("inf")]
    some += [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 18) for _ in range(300)]
    rows = spark.createDataFrame([(x,) for x in some], "x double").select("x", number(F.col("x")).alias("t")).collect()
    for r in rows:
        assert float(r.t) == r.x and "E" not in r.t.upper() and not r.t.endswith("."), (r.x, r.t)
    want = {1.5e20: "150000000000000000000", 1e22: "10000000000000000000000", 1.25e-19: "0.000000000000000000125", 12345678.5: "12345678.5", -2.5: "-2.5", 1.0: "1", 9.99e-4: "0.000999", 123456789.125: "123456789.125"}
    text = {r.x: r.t for r in rows}
    assert {k: text[k] for k in want} == want


def test_what_is_not_a_finite_number(spark):
    one = lambda x: spark.createDataFrame([(x,)], "x double").select(number(F.col("x")).alias("t")).collect()[0].t
    assert one(None) is None and one(float("nan")) == "NaN"
    for x in (float("inf"), float("-inf")):
        with pytest.raises(Exception, match="a number isn't finite"):
            one(x)
