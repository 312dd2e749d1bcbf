"""The subpackage's queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .collocations import collocations
from .filter_audit import audit
from .language_id import identify
from .licenses import known_licenses, license_scan
from .lm_scoring import in_turn, score
from .mixing import mix
from .ngram_join import ngram_classes
from .pieces import encode
from .pii import pii_digest
from .quality_classifier import classify
from .quality_rules import quality_rules
from .substring_dedup import remove_repeats
from .vector_search import nearest


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores from preference pairs, and predictions."""
    return classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in each document once repeated windows are removed."""
    return remove_repeats(_documents(spark, sf_dir), digest=True).withColumnRenamed("kept", "kept_sha256")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that a mix of all sources takes."""
    return mix(_documents(spark, sf_dir)).drop("part")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled SentencePiece segmentations of each document, digested, and whether they decode to it."""
    return encode(_documents(spark, sf_dir), digest=True)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by the Jaccard similarity of their 4-word shingles."""
    return ngram_classes(_documents(spark, sf_dir), k=4, percent=85)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under models of those not held out."""
    held = in_turn(F.col("doc_id"), 1)
    scored = score(_documents(spark, sf_dir), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences among whole documents and their lines."""
    return license_scan(_documents(spark, sf_dir), known_licenses(spark))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the quality rules and the verdicts of rules and hosts."""
    return quality_rules(_documents(spark, sf_dir)).drop("part")


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 20)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data and of terms that reveal it."""
    return pii_digest(_documents(spark, sf_dir))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, by compression with dictionaries of documents not held out."""
    return identify(_documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's phrases that hold together most."""
    return collocations(_documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove, in every order and at each step."""
    return audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_mixing": op3_mixing,
        "op4_pieces": op4_pieces,
        "op5_ngram_join": op5_ngram_join,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_license_scan": op7_license_scan,
        "op8_quality_rules": op8_quality_rules,
        "op9_vector_search": op9_vector_search,
        "op10_pii": op10_pii,
        "op11_language_id": op11_language_id,
        "op12_collocations": op12_collocations,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": oracles.REMOVED_REPEATS, "op5_ngram_join": oracles.NGRAM_CLASSES, "op7_license_scan": oracles.LICENSES, "op8_quality_rules": oracles.QUALITY_RULES, "op12_collocations": oracles.COLLOCATIONS, "op13_filter_audit": oracles.FILTER_AUDIT}
