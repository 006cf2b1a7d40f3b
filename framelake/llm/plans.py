"""Queries of the text operators (p7 to p9)."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import bpe, packing, pii
from framelake.tables import table

Query = Callable[[SparkSession, str], DataFrame]


@cache
def automaton(path: str | None = None) -> bpe.MergeAutomaton:
    return bpe.MergeAutomaton.load(path or bpe.vocabulary_path())


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"), automaton())


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text as it comes back from its ids; null and empty texts, which have empty lists, as an empty text."""
    return bpe.decode_ids(p7_ids(spark, d), automaton())


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return packing.pack(bpe.count_tokens(docs, automaton()), table(spark, d, "pack_targets"), docs.count())


def p8_use(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and the share of room in use, per target."""
    rows = p8_packed(spark, d).groupBy("target_id", "container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("n"))
    use = rows.groupBy("target_id").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"))
    return use.join(table(spark, d, "pack_targets").distinct(), "target_id").select(
        "target_id", "n_containers", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 4).alias("used")
    )


def p8_faults(spark: SparkSession, d: str) -> DataFrame:
    """Documents placed per target, and broken rules of place, room and wholeness (none)."""
    sizes = bpe.count_tokens(table(spark, d, "documents"), automaton())
    return packing.faults(p8_packed(spark, d), sizes, table(spark, d, "pack_targets"))


def _redactor(spark: SparkSession, d: str) -> pii.Redactor:
    return pii.fit(table(spark, d, "documents"), table(spark, d, "members"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.spans(table(spark, d, "documents"), _redactor(spark, d))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"), _redactor(spark, d))


def queries() -> dict[str, Query]:
    return {"p7_ids": p7_ids, "p7_decoded": p7_decoded, "p8_packed": p8_packed, "p8_use": p8_use, "p8_faults": p8_faults, "p9_found": p9_found, "p9_redacted": p9_redacted}


def oracle_sql() -> dict[str, str]:
    return {
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p8_faults": """
SELECT target_id, (SELECT count(*) FROM documents WHERE text <> '') AS n_items, 0::BIGINT AS n_overfull, 0::BIGINT AS n_misplaced, 0::BIGINT AS n_broken
FROM (SELECT DISTINCT target_id FROM pack_targets WHERE capacity > 0)
""",
    }
