"""The corpus pipeline: each stage works on all that its predecessor kept.

Toxic documents go, one document of each near-duplicate group stays, documents with benchmark passages go, sources are mixed
to their target weights, and what is left is written as token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm import common, op3_toxicity, op5_leaks, op6_ids, op9_jaccard, op10_mix


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go; null, empty and repeated texts are judged as any (see op3_toxicity.keep_clean)."""
    return op3_toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays, that of the smallest id; rows without id come last. Rows without words stay.

    Rows of an id that stands on one row are kept or left by that. Rows without id, or of one that repeats, are told apart by
    the keys of their texts. Empty tables give empty ones; columns may have any names.
    """
    n = docs.count()
    groups = common.written(op9_jaccard.labelled(docs), "groups", n)
    stays = F.col("key").isNull() | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("root")))
    counts = groups.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(stays).alias("stays"))
    again = common.written(counts.where("n > 1").select("doc_id"), "repeated", n)
    gone = common.written(counts.where("n = 1 and not stays").select("doc_id"), "duplicates", n)
    every = common.columns(docs)
    kept = docs.where(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti")
    odd = groups.where(F.col("doc_id").isNull()).limit(1).count()
    if not odd and not again.limit(1).count():
        return kept.select(*every)
    rows = op9_jaccard.keyed(docs.where(F.col("doc_id").isNull()).select(*every).union(docs.join(again, "doc_id", "left_semi").select(*every)), "_near_key")
    stay = groups.where(F.col("key").isNotNull() & stays).select(F.col("doc_id").alias("_near_id"), "key").distinct()
    once = rows.where(F.col("_near_key").isNotNull()).dropDuplicates(["doc_id", "_near_key"])
    once = once.join(stay, (F.col("_near_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("_near_id")), "left_semi")
    wordless = rows.where(F.col("_near_key").isNull())
    return kept.join(again, "doc_id", "left_anti").select(*every).union(once.select(*every)).union(wordless.select(*every))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go; null and empty texts hold none (see op5_leaks.without_leaks)."""
    return op5_leaks.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; a null source is one of the sources (see op10_mix.mix)."""
    return op10_mix.apply_mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes all rows; null texts are empty documents and null ids come first (see op6_ids.write_ids)."""
    path = common.fresh_path(spark, "pipeline-ids")
    op6_ids.write_ids(docs, path, common.tokenizer_path("word_bpe_49k.json"))
    return op6_ids.digest(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: Trained scores, fingerprints and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again before the next, which removes them. The last stage
    writes its files before it returns."""
    docs, held = common.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.discard(*held)
        held = [docs]
    out = STAGES[-1][1](spark, docs, sf_dir)
    common.discard(*held)
    return out
