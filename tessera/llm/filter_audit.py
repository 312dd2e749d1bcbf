"""Filter interaction audit: what five filters remove in each of their orders, with copies found by refining partitions.

Filters, as failure conditions: A under 100 words; B fewer than 80 % of the words distinct; C over 10 %
of the code points in ``A-Z``; D any of ``#$%&*|``; E a text that a smaller doc_id has too.

Null texts count as empty, so all null and empty texts are copies of one another. Rows with a null
doc_id never fail E and make no other row fail it; of rows with equal doc_id and text none is a copy
of the other. An empty table has no parts and no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, small, stored, words_of

#: Code points at which the blocks of a text end; the last block runs to the text's end.
BLOCK_ENDS = (128, 2048)
LETTERS = "ABCDE"


def _block_hash(text: Column, start: int, size: int) -> Column:
    return F.xxhash64(F.substring(text, start + 1, size))


def _signature(text: Column) -> dict[str, Column]:
    """The columns by which texts are split, in turn: length, then a hash for each block."""
    starts = (0, *BLOCK_ENDS)
    sizes = [*(end - start for start, end in zip(starts, BLOCK_ENDS, strict=False)), 2**31 - 1]
    return {"__len": F.char_length(text)} | {f"__block{i}": _block_hash(text, start, size) for i, (start, size) in enumerate(zip(starts, sizes, strict=True))}


def _bit(letter: str, failed: Column) -> Column:
    return F.when(failed, 1 << LETTERS.index(letter)).otherwise(0)


def _failures(text: Column) -> Column:
    """The bits of the conditions A to D that a text fails."""
    by_words = let(words_of(text), lambda w: _bit("A", F.size(w) < 100) + _bit("B", F.size(F.array_distinct(w)) * F.lit(100) < F.size(w) * F.lit(80)))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return by_words + _bit("C", capitals.cast("long") * 100 > F.char_length(text).cast("long") * 10) + _bit("D", F.rlike(text, F.lit("[#$%&*|]")))


def _within(df: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``df`` whose class is among ``classes``."""
    return df.join(small(classes), classes.columns, "left_semi")


def failed_filters(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, part, failed): one for each document, ``failed`` the bits of the filters A to E that it fails.

    Copies: rows are split by length and then by one block hash after another; in each round the
    classes of one row are dropped, on rows that carry hashes only. The texts of what survives are
    compared whole, and a class that holds several texts after all is told apart by them.
    """
    text = F.coalesce("text", F.lit(""))
    signature = _signature(text)
    keys = list(signature)
    rows = stored(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), _failures(text).alias("failed"), *[c.alias(k) for k, c in signature.items()]))
    alive, last = rows, None
    for i in range(1, len(keys) + 1):
        shared = stored(alive.groupBy(keys[:i]).count().where("count > 1").drop("count"))
        alive = _within(rows, shared)
        discard(last)
        last = shared
    texts = docs.select("doc_id", text.alias("__text"), *[c.alias(k) for k, c in signature.items()])
    held = _within(texts, last).groupBy(*keys, "__text").agg(F.min("doc_id").alias("__low"), F.max("doc_id").alias("__high"))
    classes = stored(held.groupBy(keys).agg(F.count("*").alias("__texts"), F.min("__low").alias("__low"), F.max("__high").alias("__high")))
    discard(last)
    whole = classes.where("__texts = 1 and __low < __high").select(*keys, "__low")
    mixed = classes.where("__texts > 1").select(*keys)
    out = rows.join(small(whole), keys, "left").withColumn("__copy", F.coalesce(F.col("doc_id") > F.col("__low"), F.lit(False)))
    if mixed.limit(1).count():
        again = _within(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("__text"), _failures(text).alias("failed"), *[c.alias(k) for k, c in signature.items()]), mixed)
        low = again.groupBy(*keys, "__text").agg(F.min("doc_id").alias("__low"))
        told = again.join(low, [*keys, "__text"]).withColumn("__copy", F.coalesce(F.col("doc_id") > F.col("__low"), F.lit(False)))
        out = out.join(small(mixed), keys, "left_anti").select("doc_id", "part", "failed", "__copy").union(told.select("doc_id", "part", "failed", "__copy"))
    return out.select("doc_id", "part", (F.col("failed") + _bit("E", F.col("__copy"))).alias("failed"))


def _with_steps(masks: DataFrame) -> DataFrame:
    """``masks`` once for each order and step, with ``own``, the bit of the step's filter, and ``before``, those of the filters applied earlier."""
    orders = F.split(F.lit(" ".join(map("".join, permutations(LETTERS)))), " ")
    at = masks.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    bits = [(1 << i, F.instr("filter_order", letter)) for i, letter in enumerate(LETTERS)]
    own = sum((F.when(place == F.col("step"), bit).otherwise(0) for bit, place in bits), F.lit(0))
    before = sum((F.when(place < F.col("step"), bit).otherwise(0) for bit, place in bits), F.lit(0))
    return at.withColumns({"own": own, "before": before})


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, with counts of documents, zeros included.

    ``shapley`` is what the filter removes, summed over all orders: a document that fails m filters
    is removed by each of them in 120 / m orders. Documents are counted by part and failed filters
    before orders are looked at; a document is good or toxic if any of its labels says so.
    """
    marks = labels.groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("__good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("__toxic"))
    marks = marks.where("doc_id is not null and (__good or __toxic)").withColumnRenamed("doc_id", "__labelled")
    failed = failed_filters(docs)
    judged = failed.join(small(marks), F.col("doc_id") == F.col("__labelled"), "left")
    masks = judged.groupBy("part", "failed").agg(F.count("*").alias("n"), F.count_if("__good").alias("n_good"), F.count_if("__toxic").alias("n_toxic"))
    at = _with_steps(masks)
    own, before = F.col("failed").bitwiseAND(F.col("own")) != 0, F.col("failed").bitwiseAND(F.col("before")) != 0
    here = own & ~before

    def total(condition: Column, value: Column) -> Column:
        return F.sum(F.when(condition, value).otherwise(0)).cast("long")

    orders = len(list(permutations(LETTERS)))
    return at.groupBy("part", "filter_order", "step").agg(
        total(~own & ~before, F.col("n")).alias("kept"), total(here, F.col("n")).alias("removed"), total(own & before, F.col("n")).alias("redundant"),
        total(F.col("failed") == F.col("own"), F.col("n")).alias("unique_fails"), total(here, F.col("n_good")).alias("good_lost"),
        total(here, F.col("n_toxic")).alias("toxic_lost"), total(own, F.expr(f"n * {orders} div nullif(bit_count(failed), 0)")).alias("shapley"),
    )
