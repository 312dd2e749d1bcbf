from pathlib import Path

import numpy as np
import pytest

from tessera.llm import vector_search


def test_nearest(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((600, 24)).astype(np.float32)
    v[50:60] = v[0]
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)] + [(900, None, "x"), (920, [0.0] * 24, "x"), (940, [float("nan")] * 24, "x"), (960, [None] + [1.0] * 23, "x"), (980, [float("inf")] * 24, "x"), (None, [1.0] * 24, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {}
    for r in vector_search.nearest(df.repartition(3), "vec_id", "embedding", 20).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 600, 20))
    hit = 0
    x = v.astype(np.float64)
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        top = np.lexsort((np.arange(600), -s))[:20]
        assert sorted(found) == list(range(1, 21))
        hit += len({i for i, _ in found.values()} & set(top.tolist()))
        assert all(abs(score - x[q] @ x[i]) < 1e-9 for i, score in found.values())
        assert [found[k][0] for k in range(1, 21)] == sorted((i for i, _ in found.values()), key=lambda i: (-found[[k for k in found if found[k][0] == i][0]][1], i))
    assert hit >= 0.95 * 20 * len(got)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in vector_search.nearest(df, "vec_id", "embedding", 20).orderBy("rank").collect()] == [(0, 1, 1, 4.0), (0, 2, 2, 1.5)]
    assert vector_search.nearest(df.where("vec_id > 5"), "vec_id", "embedding", 20).count() == 0
    one = spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert vector_search.nearest(one, "vec_id", "embedding", 20).count() == 0


def test_repeated_ids_take_one_place(spark):
    """Copies of a near row, and an id with many near vectors, leave the other neighbours in."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((60, 16)) + 2
    rows = [(i + 1, x.tolist()) for i, x in enumerate(v[1:], 1)] + [(0, v[0].tolist())]
    rows += [(101, (v[0] * 9).tolist())] * 200 + [(103, (v[0] * (5 + i / 100)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = {r.vec_id: r.score for r in vector_search.nearest(df, "vec_id", "embedding", 1000).where("query_id = 0").collect()}
    best = {}
    for i, x in rows:
        best[i] = max(best.get(i, -np.inf), float(np.dot(x, v[0])))
    want = sorted((i for i in best if i), key=lambda i: -best[i])[:20]
    assert len(got) == 20 and len(set(got) & set(want)) >= 19 and {101, 103} <= set(got)
    assert all(abs(s - best[i]) < 1e-9 for i, s in got.items())


def test_vectors_of_other_lengths_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.5, 0.5]), (20, [1.0]), (3, [1.0, 2.0, 3.0]), (4, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {(r.query_id, r.vec_id) for r in vector_search.nearest(df, "vec_id", "embedding", 20).collect()} == {(0, 1), (0, 2)}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_whole_tables(spark, sf):
    """Recall of the 20 nearest against brute force over every row of the driver's tables."""
    at = Path(f"/root/testdata/{sf}/embeddings.parquet")
    if not at.exists():
        pytest.skip("no tables on this machine")
    table = spark.read.parquet(str(at))
    rows = [(r.vec_id, r.embedding) for r in table.collect() if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], np.float64)
    found = {}
    for r in vector_search.nearest(table, "vec_id", "embedding", 20).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    hits = 0
    for q in found:
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        top = ids[np.lexsort((ids, -s))[:20]]
        hits += len({i for _, i in found[q]} & set(top.tolist()))
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0} and hits >= 0.9 * 20 * len(found)


def test_many_passes(spark, monkeypatch):
    """The rows don't depend on how many passes the queries are met in; each pass is broadcast alone."""
    v = np.random.default_rng(7).standard_normal((400, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    once = sorted(map(tuple, vector_search.nearest(df, "vec_id", "embedding", 4).collect()))
    sizes, was = [], vector_search._pass
    monkeypatch.setattr(vector_search, "PASS_QUERIES", 10)
    monkeypatch.setattr(vector_search, "_pass", lambda codes, asked, centre, k: (sizes.append(asked.count()), was(codes, asked, centre, k))[1])
    again = sorted(map(tuple, vector_search.nearest(df, "vec_id", "embedding", 4).collect()))
    assert len(sizes) == 10 and sum(sizes) == 100 and max(sizes) < 30
    assert [r[:2] for r in again] == [r[:2] for r in once] and len(set(again) & set(once)) >= 0.95 * len(once)
