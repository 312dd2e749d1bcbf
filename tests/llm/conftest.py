import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, blanks, a long text, copies, near copies, shared passages, repeated rows and personal data."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(20, 120)) for _ in range(40)]
    passage = words(rng, 60, 10_000)
    texts = [*base, base[0], base[0], base[3], base[3] + " tail", base[5].replace("w1 ", "x ", 1), None, "", " \n\t ", "one", "two words", "a b c\x0bd\x0ce\rf"]
    texts += [words(rng, 15) + "\n" + passage + "\n" + words(rng, 15) for _ in range(4)]
    texts += ["la " * 300, "Hi!! there $$ ## | x\nsame line\nsame line\nsame line", "mail a.b@c.org, call +1 (555) 010-99 88 or 10.0.0.256 or 10.0.0.25 card 4111 1111 1111 1111", words(rng, 6000), "日本 ▁x  y\n\nz"]
    texts += [f"secret agent zebulon lives with agent{i}@spy.org" for i in (7, 7, 7, 7)] + ["nothing about agents here at all, only plain words and more of them"]
    out = [(i, t, "en", None if i % 11 == 0 else f"src{i % 4 if i % 3 else 0}", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[2], out[2], (None, base[7], None, "src1", None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("part", "words", "n", "key", "host", "size", "copies", "__id", "rep", "node", "kept", "score"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
