"""Quality rules judged by document and by host (DataFrame functions only).

Each document gets counts and a few rule failures. Failures are summed by host, each host's
failure rate is shrunk towards the corpus by an empirical beta prior, and the host's verdict
is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, small, stored, words_of

#: Words in a window whose repetition counts.
WINDOW = 5
#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Further rules of a document: symbols for each word, words ending in two marks or more and repeated lines.
MAX_SYMBOLS_PERCENT = 10
MAX_DUP_LINE_PERCENT = 50
#: A host is turned away when its shrunk failure rate reaches this.
HOST_LIMIT = 0.5


def repeated_words(words: Column) -> Column:
    """Words lying in a window of ``WINDOW`` words that occurs twice or more in the array."""
    last = F.size(words) - WINDOW
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(hs: Column) -> Column:
        sorted_at = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        spots = let(sorted_at, lambda at: F.transform(at, lambda x, i: F.when(_same(x, F.get(at, i - 1)) | _same(x, F.get(at, i + 1)), x["i"])))
        return F.aggregate(
            F.array_sort(F.filter(spots, lambda p: p.isNotNull())),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")),
            lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("sum")),
            lambda acc: acc["sum"],
        )

    found = let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(covered(hs)))
    return F.when(last < 1, 0).otherwise(found)


def _same(x: Column, y: Column) -> Column:
    return F.coalesce(x["h"] == y["h"], F.lit(False))


def document_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row for each document: doc_id, a hash of its text, host, the counts of the base rules and ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    read = docs.select(F.col("doc_id"), F.xxhash64("text").alias("part"), F.col(host).cast("string").alias("host"), text.alias("text")).withColumn("words", words_of(F.col("text"))).withColumn("lines", lines)
    bare = F.translate("text", BLANKS, "")
    counts = read.select(
        "doc_id",
        "part",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    return counts.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(judged: DataFrame) -> DataFrame:
    """Rows (host, host_docs, host_rate, host_kept) from rows (host, failed).

    The beta prior has the mean of all documents and the strength that the spread of the hosts'
    own rates suggests (method of moments); few or even hosts give a strong prior.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("k"))
    mean = F.col("total_k") / F.col("total_n")
    prior = hosts.agg(
        F.sum("n").alias("total_n"),
        F.sum("k").alias("total_k"),
        F.count("*").alias("hosts"),
        F.sum(F.col("k") / F.col("n") * F.col("k")).alias("square"),
    ).select(
        mean.alias("mean"),
        # spread between hosts beyond what drawing n documents explains
        (F.col("square") / F.col("total_n") - mean * mean).alias("spread"),
        (mean * (1 - mean) * F.col("hosts") / F.col("total_n")).alias("noise"),
    )
    between = F.greatest(F.col("spread") - F.col("noise"), F.lit(1e-6))
    strength = F.greatest(F.lit(1.0), F.least(F.lit(1e4), F.col("mean") * (1 - F.col("mean")) / between - 1))
    rate = (F.col("k") + strength * F.col("mean")) / (F.col("n") + strength)
    return hosts.join(F.broadcast(prior)).select("host", F.col("n").alias("host_docs"), rate.alias("host_rate"), (rate < HOST_LIMIT).alias("host_kept"))


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """Counts and verdicts of each document; ``part`` is a hash of its text.

    ``kept`` is false where the base rules fail, where the document has too many symbols or
    repeated lines, or where its host's shrunk failure rate reaches ``HOST_LIMIT``. Null texts
    count as empty (and fail); documents without a host form one host; repeated rows each count.
    """
    counts = stored(document_counts(docs, host))
    soft = (100 * F.col("n_symbols") > MAX_SYMBOLS_PERCENT * F.col("n_words")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"))
    judged = counts.withColumn("failed", F.col("base_failed") | soft)
    hosts = small(host_verdicts(judged))
    joined = judged.alias("d").join(hosts.alias("h"), F.col("d.host").eqNullSafe(F.col("h.host")))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("failed") & F.col("host_kept")).alias("kept"), F.round("host_rate", 6).alias("host_rate"), "part",
    )
