"""Personal data: fixed patterns, and terms that give away whom a document is about.

Patterns find e-mail, IP, card and phone values; these are the protected entities. Following
information-theoretic sanitisation, the corpus tells how strongly a term in an entity's documents
reveals it: the pointwise mutual information of the two as a share of the entity's own information,
and the share of the term's documents that hold the entity (its disclosure). Terms beyond both
thresholds are marked wherever they stand in the documents that hold the entity, and sanitising
generalises or removes them with the entities.

Copies and near copies are no evidence: a term needs the entity in two contexts, the terms around it,
that differ. Two kinds of terms reveal an entity of a single context too, where the corpus has them
hardly anywhere else: names beside it, and words that an e-mail address spells.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, stored

#: The order of kinds, and the patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LETTERS = re.compile(r"[a-z]+")
_TERM = re.compile(r"[^\W\d_][\w'-]*[\w]", re.UNICODE)

#: A term reveals an entity if it gives this share of the information that naming the entity would give, and if
#: this share of its documents hold the entity. The latter counts one document more without the entity, so that
#: a term and an entity that met once by chance stay at a half, but for names beside the entity and words it spells.
INFORMATION, DISCLOSURE = 0.75, 0.6
#: Terms on each side of an entity that are its context, those of them in which names stand beside it, and the
#: fewest letters of a word that an address spells.
CONTEXT, BESIDE, SPELT = 12, 6, 3
#: Distinct words that a task counts before it passes the counts on.
COUNTED = 300_000


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, in time linear in the text: around each @, not from each start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        elif start < at:
            done = at  # letters before this @ can't start a later match: the @ parts them
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches by kind, then start; failing matches are dropped without a retry."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if text.count(".") > 2:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups())]
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 40:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15]
    return out


def _name(kind: str, value: str) -> str:
    """An entity's name in the corpus's statistics: a digest, so no value is written in clear beside the documents."""
    return hashlib.blake2b(f"{kind}:{value.lower()}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _outside(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the terms of a text outside the spans, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a), ends.append(b)
    out = []
    for m in _TERM.finditer(text):
        i = bisect_left(starts, m.end()) - 1
        if i < 0 or ends[i] <= m.start():
            out.append(m.span())
    return out


def _terms(text: str, places: list[tuple[int, int]]) -> dict[str, list[int]]:
    """The terms at the places, in lower case, with the [start, end, ...] of every occurrence."""
    found: dict[str, list[int]] = {}
    for a, b in places:
        found.setdefault(text[a:b].lower(), []).extend((a, b))
    return found


def _titled(text: str, a: int, b: int) -> bool:
    return text[a].isupper() and not text[a:b].isupper()


def _is_name(text: str, places: list[tuple[int, int]], i: int, ends: dict[int, int]) -> bool:
    """A term written as a name: with a capital that no sentence's start gives it, or before another such term. Entities before it, by their ends, are passed over."""
    a, b = places[i]
    if not _titled(text, a, b):
        return False
    before = a - 1
    while before >= 0 and (text[before] in " \t\"'(" or before + 1 in ends):
        before = ends.get(before + 1, before) - 1
    if before >= 0 and text[before] not in ".!?\r\n":
        return True
    return i + 1 < len(places) and places[i + 1][0] == b + 1 and text[b] == " " and _titled(text, *places[i + 1])


def _held(text: str, spans: list[tuple[str, int, int]], places: list[tuple[int, int]], terms: dict[str, list[int]]) -> list[dict]:
    """The entities of a text by name: the digest of the first one's context, and the terms that it needs no second context for."""
    starts = [a for a, _ in places]
    ends = {b: a for _, a, b in spans}
    out: dict[str, dict] = {}
    for kind, a, b in spans:
        at = bisect_left(starts, a)
        if (name := _name(kind, text[a:b])) not in out:
            around = " ".join(text[x:y].lower() for x, y in places[max(0, at - CONTEXT) : at + CONTEXT])
            out[name] = {"entity": name, "context": hashlib.blake2b(around.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest(), "named": set()}
        named = out[name]["named"]
        named.update(text[slice(*places[i])].lower() for i in range(max(0, at - BESIDE), min(len(places), at + BESIDE)) if _is_name(text, places, i, ends))
        if kind == "email":
            named.update(w for w in _LETTERS.findall(text[a:b].split("@")[0].lower()) if len(w) >= SPELT and w in terms)
    return [e | {"named": sorted(e["named"])} for _, e in sorted(out.items())]


_TERMS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("at", T.ArrayType(T.IntegerType()))]))
_ENTITIES = T.ArrayType(T.StructType([T.StructField("entity", T.StringType()), T.StructField("context", T.StringType()), T.StructField("named", T.ArrayType(T.StringType()))]))
_FOUND = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("part", T.StringType()), T.StructField("base", T.StringType()), T.StructField("entities", _ENTITIES), T.StructField("terms", _TERMS), T.StructField("term", T.StringType()), T.StructField("n", T.LongType())]
)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, with entities and terms if it has spans, and rows (term, n): how many of a task's documents hold a term."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_FOUND)
    seen: Counter = Counter()

    def counts() -> pa.RecordBatch:
        terms, ns = list(seen.keys()), list(seen.values())
        nulls = [None] * len(terms)
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([nulls, nulls, nulls, nulls, nulls, terms, ns], schema, strict=True)], schema=schema)
        seen.clear()
        return batch

    for b in batches:
        base, entities, held = [], [], []
        for text in b.column("text").to_pylist():
            text = text or ""
            spans = base_spans(text)
            base.append(_joined(spans))
            if spans:
                places = _outside(text, spans)
                terms = _terms(text, places)
                seen.update(terms.keys())
                entities.append(_held(text, spans, places, terms))
                held.append([{"term": t, "at": at} for t, at in terms.items()])
            else:
                seen.update({t.lower() for t in set(_TERM.findall(text))})
                entities.append(None), held.append(None)
            if len(seen) > COUNTED:
                yield counts()
        nulls = [None] * b.num_rows
        digest = [hashlib.md5((t or "").encode("utf-8", "surrogatepass")).hexdigest() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([b.column("doc_id").to_pylist(), digest, base, entities, held, nulls, nulls], schema, strict=True)], schema=schema)
    yield counts()


def reveal(found: DataFrame) -> DataFrame:
    """Rows (entity, term) beyond the thresholds, from ``_find``'s rows."""
    docs = found.where("part is not null")
    total = docs.count()
    each = docs.where("entities is not null").select(F.inline("entities"), F.col("terms.term").alias("terms"))
    holds = stored(each.groupBy("entity").agg(F.count("*").alias("entity_docs"), (F.min("context") < F.max("context")).alias("differ")))
    single = each.select("entity", "context", F.explode("named").alias("term"), F.lit(True).alias("named"))
    # only entities of contexts that differ can be revealed by any term
    several = each.join(small(holds.where("differ").select("entity")), "entity", "left_semi")
    pairs = single.unionByName(several.select("entity", "context", F.explode(F.array_except("terms", "named")).alias("term"), F.lit(False).alias("named")))
    together = pairs.groupBy("entity", "term").agg(F.count("*").alias("both"), (F.min("context") < F.max("context")).alias("differ"), F.bool_or("named").alias("named"))
    enough = lambda of: F.col("both") / (of + F.when(F.col("named"), 0).otherwise(1)) >= DISCLOSURE
    # a term meets an entity in no more documents than hold the term
    strong = together.where(F.col("named") | F.col("differ")).where(enough(F.col("both"))).join(holds.drop("differ"), "entity")
    of_term = found.where("part is null").groupBy("term").agg(F.sum("n").alias("term_docs"))
    weighed = strong.join(of_term, "term")
    own = F.log2(F.lit(float(max(1, total))) / F.col("entity_docs"))
    information = own + F.log2(F.col("both") / F.col("term_docs"))
    return weighed.where(enough(F.col("term_docs")) & (own > 0) & (information >= INFORMATION * own)).select("entity", "term")


def find_pii(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, part, base, extra): the patterns' spans and those of revealing terms, as text.

    ``part`` is the MD5 of the text, so rows that share a doc_id keep their own spans. Null texts
    count as empty. Documents that are copies, and repeated rows, count each in the corpus's shares, and are
    one context; a term at a threshold exactly is marked. An empty table has no spans.
    """
    found = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find, _FOUND))
    marks = stored(reveal(found))
    held = found.where("entities is not null").select("doc_id", "part", F.explode("entities.entity").alias("entity"), "terms")
    held = held.join(small(marks.select("entity").distinct()), "entity", "left_semi").select("doc_id", "part", "entity", F.inline("terms"))
    spans = held.join(small(marks), ["entity", "term"]).select("doc_id", "part", F.explode(F.transform(F.sequence(F.lit(0), F.size("at") - 2, F.lit(2)), lambda i: F.struct(F.get("at", i).alias("a"), F.get("at", i + 1).alias("b")))).alias("s"))
    spans = spans.groupBy("doc_id", "part").agg(F.array_sort(F.collect_set("s")).alias("s"))
    extra = spans.select("doc_id", "part", F.array_join(F.transform("s", lambda s: F.concat(F.lit("term:"), s["a"].cast("string"), F.lit(":"), s["b"].cast("string"))), ",").alias("extra"))
    d, e = found.where("part is not null").select("doc_id", "part", "base").alias("d"), extra.alias("e")
    joined = d.join(e, F.col("d.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("d.part") == F.col("e.part")), "left")
    return joined.select("d.doc_id", "d.part", "base", F.coalesce("extra", F.lit("")).alias("extra"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term)."""
    found = find_pii(docs)
    n = lambda col, kind: F.size(F.filter(F.split(col, ","), lambda x: F.startswith(x, F.lit(kind + ":")))).cast("long")
    return found.select("doc_id", *[n("base", k).alias(f"n_{k}") for k in KINDS], F.sha2("base", 256).alias("base_sha256"), F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif("extra", F.lit(""))).alias("spans"), n("extra", "term").alias("n_term"))


#: What stands in for each kind. A revealing term written as a name is generalised to that, others are removed.
STAND_INS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "name": "<NAME>", "term": "<REMOVED>"}


def _redact(text: str | None, spans: str) -> str | None:
    if not text or not spans:
        return text
    out, done = [], 0
    for a, b, kind in sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in spans.split(","))):
        b = -b
        if a < done:  # overlapped by one before: what is left of it goes with that one
            done = max(done, b)
            continue
        out += [text[done:a], STAND_INS["name" if kind == "term" and text[a].isupper() else kind]]
        done = b
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind's stand-in; other columns, order and rows as they were.

    ``n_chars``, if there, follows the new text. Only the spans are joined to the documents, by id
    and digest; documents without spans are passed by.
    """
    found = find_pii(docs)
    spans = found.select(F.col("doc_id").alias("__tessera_id"), F.col("part").alias("__tessera_part"), F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif("extra", F.lit(""))).alias("__tessera_spans")).where("__tessera_spans <> ''").dropDuplicates(["__tessera_id", "__tessera_part"])
    names = docs.columns
    part = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(F.col("__tessera_id")) & (part == F.col("__tessera_part")), "left")
    schema = T.StructType([*docs.schema.fields, T.StructField("__tessera_spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            new = [_redact(t, s) if s else t for t, s in zip(b.column("text").to_pylist(), b.column("__tessera_spans").to_pylist(), strict=True)]
            yield b.set_column(at, "text", pa.array(new, b.schema.field("text").type))

    out = joined.select(*names, "__tessera_spans").mapInArrow(run, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__tessera_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*names)

