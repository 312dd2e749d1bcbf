"""What the near-duplicate join leaves on disk beside its result."""

from tessera import storage
from tessera.llm import ngram_join


def test_intermediate_tables_go(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(n, " ".join(words[n % 5 : 40 + n % 5])) for n in range(40)] + [(100 + n, " ".join(words[n:] + [f"x{n}"] * 9)) for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = set(storage._WRITTEN)
    out = ngram_join.ngram_classes(docs, 4, 85)
    left = set(storage._WRITTEN) - before
    # the result, and what each search for components ended with
    assert len(left) <= 4
    assert out.count() == len(rows)
