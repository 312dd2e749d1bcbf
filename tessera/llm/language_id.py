"""Language identification by compression: the language whose raw-content dictionary makes a text smallest.

Each language has a zstandard dictionary of the words in passages from its own documents. The different
words of a whole text are cut into blocks that are compressed one by one with every dictionary, so all of
a long text counts, repeats add nothing and a block can't lean on those before it. What wins by a narrow
margin is marked as not accepted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .textops import chunks, utf8

#: The sample that a language's dictionary is made of: so many different texts at most, and code points of each.
SAMPLE_TEXTS = 300
SAMPLE_CHARS = 4000
#: Languages at most, so that the dictionaries stay within a bound; more are an error.
MOST_LANGS = 100
LEVEL = 5
#: Bytes compressed at a time.
BLOCK = 6000
#: The share of the second smallest size that the smallest must save to be accepted; there the score is one half.
NARROW = 0.02
UNKNOWN = "und"

#: A-Z are made small beforehand; other ASCII characters than letters separate words.
_ASCII = bytes(i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def learned(doc_id: Column) -> Column:
    """Whether dictionaries may be learned from a document: crc32 of the id as text isn't 2 mod 4; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def _words(text: str) -> list[bytes]:
    """The different words of a text in small letters, in order."""
    return list(dict.fromkeys(utf8(text.lower()).translate(_ASCII).split()))


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """The different words of each language's sample, the language learned from most documents first.

    Of the ``SAMPLE_TEXTS`` different texts whose hashes are smallest, each gives a passage; a long
    text that at a place drawn by its hash. Copies count once.
    """
    draw = F.xxhash64("text", F.lit(11))
    usable = docs.select("doc_id", "text", "lang").where(learned(F.col("doc_id")) & F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}")))
    hashes = usable.select("lang", draw.alias("draw")).distinct()
    sizes = usable.groupBy("lang").count().limit(MOST_LANGS + 1).collect()
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages to learn")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    drawn = stored(hashes.withColumn("place", place).where(F.col("place") <= SAMPLE_TEXTS).select(F.col("lang").alias("_lang"), F.col("draw").alias("_draw")))
    size = F.char_length("text")
    start = F.when(size > SAMPLE_CHARS, F.pmod(draw, (size - SAMPLE_CHARS).cast("long"))).otherwise(0).cast("int")
    hit = (F.col("lang") == F.col("_lang")) & (draw == F.col("_draw"))
    passages = usable.join(F.broadcast(drawn), hit).select("lang", "_draw", F.substring("text", start + 1, F.lit(SAMPLE_CHARS)).alias("passage"))
    words: dict[str, list[bytes]] = {r.lang: [] for r in sorted(sizes, key=lambda r: (-r["count"], utf8(r.lang)))}
    for r in passages.groupBy("lang", "_draw").agg(F.min("passage").alias("passage")).orderBy("lang", "_draw").collect():
        words[r.lang] += _words(r.passage)
    return {lang: b" ".join(dict.fromkeys(x)) for lang, x in words.items()}


def _blocks(text: str) -> list[bytes]:
    """A text's different words in blocks that end at blanks where there are any."""
    plain, out, at = b" ".join(_words(text)), [], 0
    while len(plain) - at > BLOCK:
        end = plain.rfind(b" ", at + 1, at + BLOCK) + 1 or at + BLOCK
        out.append(plain[at:end])
        at = end
    return [*out, plain[at:]]


def _predict(shared) -> Callable:
    """Rows (doc_id, held_out, lang_pred, score, margin): margins are shares of the second smallest size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = list(shared.value)
        coders = []
        for lang in langs:
            held = zstandard.ZstdCompressionDict(shared.value[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
        if len(coders) == 1:  # no rival: the margin is against no dictionary at all
            coders.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False))
        for batch in chunks(batches):
            names, scores, margins = [], [], []
            for text, lettered in zip(batch.column("text").to_pylist(), batch.column("lettered").to_pylist(), strict=True):
                if not lettered or not langs:
                    names.append(UNKNOWN), scores.append(0.0), margins.append(0.0)
                    continue
                blocks = _blocks(text)
                sizes = np.array([sum(len(c.compress(b)) for b in blocks) for c in coders])
                best = int(np.argmin(sizes[: len(langs)]))  # of equal sizes the language learned from most documents
                second = int(np.min(np.delete(sizes, best)))
                margin = max(0.0, (second - sizes[best]) / second)
                names.append(langs[best]), scores.append(margin / (margin + NARROW)), margins.append(margin)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())]
            yield pa.record_batch(columns, ["doc_id", "held_out", "lang_pred", "score", "margin"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, margin, accepted), one for each row of ``docs``.

    ``lang_pred`` is ``und`` with a score of 0 where the text is null or has no letter, and where
    nothing could be learned. The score grows with the margin and is one half at ``NARROW``; below
    that ``accepted`` is false. Of equal sizes the language learned from most documents wins. Documents with null ids are neither learned from nor held out. Equal
    texts get equal rows; other columns are ignored, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    read = docs.select("doc_id", held.alias("held_out"), "text", F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)).alias("lettered"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = read.mapInArrow(_predict(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double, margin double")
    return out.withColumn("accepted", F.col("score") >= 0.5)
