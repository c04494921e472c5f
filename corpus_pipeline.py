"""Corpus pipeline: quality, exact copies, near copies, source mix, token round trip.

Each stage reads what its predecessor kept and decides anew from that. All but the last return the columns of
documents, whatever their names. Decisions are made and applied row by row: rows that share a doc_id or have none are
told apart by their place in the stored table. The quality stage learns from the labels beside documents, without its
held-out rows.

Defined cases: null text counts as empty and is an exact copy of empty texts; it is never a near copy, and a document
without words comes once out of the mix; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import bpe, quality
from runledger.llm.chunk_dedup import exact_dedup
from runledger.llm.mixing import mix
from runledger.llm.queries import tokenizer_path
from runledger.llm.shingle_join import jaccard_components
from runledger.llm.store import free_name, materialise, narrow_side, with_row_key


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.where(F.col(scored.columns[-1]) >= quality.THRESHOLD).select(*docs.columns)


def _without(rows: DataFrame, key: str, gone: DataFrame, columns: list[str]) -> DataFrame:
    """rows but those whose key is in gone."""
    return rows.join(narrow_side(materialise(gone.select(key), "gone")), key, "left_anti").select(*columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of smallest doc_id."""
    rows, key = with_row_key(docs)
    return _without(rows, key, exact_dedup(rows, key_col=key).where("not kept"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked texts: that of smallest doc_id."""
    rows, key = with_row_key(docs)
    return _without(rows, key, jaccard_components(rows, key_col=key).where("not kept"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix repeats them, whole; a document cut by its source's budget comes if half of it is taken."""
    rows, key = with_row_key(docs)
    times = free_name(rows.columns, "times")
    taken = mix(rows, key_col=key).select(key, F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int").alias(times))
    joined = rows.join(narrow_side(materialise(taken, "times")), key).where(F.col(times) > 0)
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(times)).select(*docs.columns)


def round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and the digest of the text decoded from them."""
    coded = bpe.encode(docs, tokenizer_path(), decoded=True)
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("tokens", round_trip),
]
#: The first stage learns from data, which SQL cannot express; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
