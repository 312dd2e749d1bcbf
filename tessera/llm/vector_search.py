"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Vectors are centred, rotated by a random orthonormal matrix and kept as one sign bit for each
dimension with two scalars: the residual's length and how well the signs point along it. From
packed bits and scalars the inner product with any query is estimated without bias, within an
error bound that holds with high probability. Only vectors whose upper bound reaches the best
lower bounds seen are scored on their original components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Width of the error bound, in standard errors of the estimate.
EPSILON = 3.0
#: Bits of a query's components in the estimate, queries met in one pass over the codes, and rows scored at a time.
QUERY_BITS, PASS_QUERIES, BLOCK = 4, 32_768, 2_048
SEED = 20_240_601


def rotation(dim: int) -> np.ndarray:
    """A random orthonormal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (vec_id, v) whose vector is finite and not zero; ids that are null have no place in a ranking."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(fine)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _coder(centre: np.ndarray, turn: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"))
            o = (v - centre) @ turn
            length = np.linalg.norm(o, axis=1)
            unit = o / np.where(length > 0, length, 1)[:, None]
            bits = np.packbits(o > 0, axis=1)
            along = np.abs(unit).sum(axis=1) / np.sqrt(o.shape[1])
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(length), pa.array(along), pa.array(v @ centre), b.column("v")],
                ["vec_id", "code", "length", "along", "near", "v"],
            )

    return run


CODES = "vec_id long, code binary, length double, along double, near double, v array<double>"


def index(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The codes of the distinct rows of (vec_id, v), stored, and the centre.

    A product needs vectors of one length: those of another than the most common, of two such the
    greater, take no part.
    """
    dims = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not dims:
        return vectors.sparkSession.createDataFrame([], CODES), np.zeros(1)
    dim = dims[0]["d"]
    vectors = vectors.where(F.size("v") == dim)
    centre = np.array(vectors.select(*[F.avg(F.get("v", i)).alias(f"c{i}") for i in range(dim)]).first())
    return stored(vectors.dropDuplicates(["vec_id", "v"]).mapInArrow(_coder(centre, rotation(dim)), CODES)), centre


def _scan(ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int):
    """Over a task's codes: each query's best ``k`` ids of that task, scored exactly."""
    dim = queries.shape[1]
    moved = (queries - centre) @ turn
    base = queries @ centre - centre @ centre
    span = np.linalg.norm(moved, axis=1)
    # components in QUERY_BITS bits: bit planes meet the codes by AND and bit counts
    low = moved.min(axis=1)
    step = np.maximum((moved.max(axis=1) - low) / (2**QUERY_BITS - 1), 1e-300)
    whole = np.rint((moved - low[:, None]) / step[:, None]).astype(np.uint8)
    planes = [np.packbits((whole >> j) & 1, axis=1) for j in range(QUERY_BITS)]
    width = -planes[0].shape[1] % 8
    as_words = lambda x: np.ascontiguousarray(np.pad(x, ((0, 0), (0, width)))).view(np.uint64)
    planes = [as_words(p) for p in planes]
    total = whole.sum(axis=1).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_s = np.full((len(ids), k), -np.inf)
        best_i = np.full((len(ids), k), np.iinfo(np.int64).max)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                own = np.asarray(b.column("vec_id"))
                v = _matrix(b.column("v"))
                bits = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(own), -1)
                code = as_words(bits)
                ones = np.bitwise_count(code).sum(axis=1).astype(np.float64)
                length, along, near = (np.asarray(b.column(c)) for c in ("length", "along", "near"))
                along = np.where(along > 0, along, 1)
                # ids with several vectors count once: where each id's rows begin, in order of the ids
                by_id = np.argsort(own, kind="stable")
                begin = np.flatnonzero(np.concatenate([[True], own[by_id][1:] != own[by_id][:-1]]))
                for q0 in range(0, len(ids), 256):
                    q = slice(q0, min(q0 + 256, len(ids)))
                    meet = np.zeros((q.stop - q0, len(own)))
                    for j, p in enumerate(planes):
                        for c in range(code.shape[1]):
                            meet += np.bitwise_count(p[q, c][:, None] & code[None, :, c]) * float(1 << j)
                    # <signs, query> from the bits that are set: signs are +1 or -1 over sqrt(dim)
                    dot = (2 * (step[q, None] * meet + low[q, None] * ones) - (step[q] * total[q] + dim * low[q])[:, None]) / np.sqrt(dim)
                    guess = dot / along * length + near + base[q, None]
                    room = length * np.sqrt(1 - np.minimum(along, 1) ** 2) / along / np.sqrt(max(1, dim - 1)) * EPSILON * span[q, None]
                    room += length / along * (step[q, None] / 2)
                    floor = best_s[q, -1]
                    if len(begin) > k:
                        sure = guess - room
                        if len(begin) < len(own):
                            sure = np.maximum.reduceat(sure[:, by_id], begin, axis=1)
                        floor = np.maximum(floor, np.partition(sure, len(begin) - k - 1, axis=1)[:, len(begin) - k - 1])
                    r, c = np.nonzero(guess + room >= floor[:, None])
                    keep = ids[q0 + r] != own[c]
                    r, c = r[keep], c[keep]
                    score = np.einsum("ij,ij->i", queries[q0 + r], v[c])
                    keep = score >= best_s[q0 + r, -1]
                    r, c, score = r[keep], c[keep], score[keep]
                    if not len(r):
                        continue
                    rows = np.unique(r)
                    r_all = np.concatenate([r, np.repeat(rows, k)])
                    s_all = np.concatenate([score, best_s[q0 + rows].ravel()])
                    i_all = np.concatenate([own[c], best_i[q0 + rows].ravel()])
                    order = np.lexsort((-s_all, i_all, r_all))
                    r_all, s_all, i_all = r_all[order], s_all[order], i_all[order]
                    again = np.flatnonzero((r_all[1:] == r_all[:-1]) & (i_all[1:] == i_all[:-1])) + 1
                    s_all[again], i_all[again] = -np.inf, np.iinfo(np.int64).max
                    order = np.lexsort((i_all, -s_all, r_all))
                    r_all, s_all, i_all = r_all[order], s_all[order], i_all[order]
                    first = np.searchsorted(r_all, rows)
                    take = first[:, None] + np.arange(k)
                    best_s[q0 + rows], best_i[q0 + rows] = s_all[take], i_all[take]
        r, c = np.nonzero(best_s > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(best_i[r, c]), pa.array(best_s[r, c])], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, id_col: str, vec_col: str, every: int, k: int = 20) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest of each row whose id is divisible by ``every``.

    All rows but the query's own id are candidates. Queries are met in passes of about
    ``PASS_QUERIES``: one pass's queries are broadcast, it reads the codes once, keeps at most
    ``k`` rows for each query and task, and stores each query's ``k`` best before the next pass
    begins. So the driver holds one pass's queries at a time, however many there are. Null, zero and
    non-finite vectors and those of another length take no part; an empty table gives no rows; an id
    repeated with other vectors keeps its best. Ties go to the smaller id.
    """
    spark: SparkSession = vectors.sparkSession
    clean = usable(vectors, id_col, vec_col)
    codes, centre = index(clean)
    asked = codes.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v")
    n = asked.count()
    passes = max(1, -(-n // PASS_QUERIES))
    by_pass = asked.withColumn("p", F.pmod(F.xxhash64("vec_id"), F.lit(passes)))
    if passes > 1:
        by_pass = stored(by_pass.repartition(passes, "p"))
    found = None
    for p in range(passes):
        got = _pass(codes, by_pass.where(F.col("p") == p).select("vec_id", "v"), centre, k)
        if got is not None:
            found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.sql("select 0L query_id, 0 rank, 0L vec_id, 0D score where false")
    return found


def _pass(codes: DataFrame, asked: DataFrame, centre: np.ndarray, k: int) -> DataFrame | None:
    """The ``k`` nearest of one pass's queries, stored; None where the pass has none."""
    part = asked.toArrow()
    if not part.num_rows:
        return None
    sent = codes.sparkSession.sparkContext.broadcast((np.asarray(part.column("vec_id").combine_chunks()), _matrix(part.column("v"))))
    del part

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scan(*sent.value, centre, rotation(len(centre)), k)(batches)

    found = codes.mapInArrow(scan, "query_id long, vec_id long, score double")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    lists = one.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i")))), 1, k).alias("top"))
    out = lists.select("query_id", F.posexplode("top").alias("at", "t")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.i").alias("vec_id"), (-F.col("t.s")).alias("score"))
    out = stored(out)
    sent.destroy()
    return out
