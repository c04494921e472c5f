"""K1, K10, D2 and E5 as streams: a trace log, runs as they come, sources that got no verdict in time, and counters per stretch of time.

A file of a stream is read once, so a writer lands one file per flush. The gate's keyed state is in gate_state.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TRACE_EVENT


def trace_stream(spark: SparkSession, folder: str, schema: str = TRACE_EVENT) -> DataFrame:
    """K1. Events of the files that land in a folder."""
    return spark.readStream.schema(schema).json(folder)


def rungs(runs: DataFrame) -> DataFrame:
    """K10. Runs as they come, each with its verdict and whether the ladder goes on: no later rung is waited for."""
    return runs.withColumn("escalates", F.coalesce(F.col("verdict") == "unknown", F.lit(True)) & F.col("next_k").isNotNull())


def counters(events: DataFrame, delay: str = "1 minute", width: str = "5 minutes") -> DataFrame:
    """Gate counters per stretch of time, for events that come late by less than the delay (E5 over a stream)."""
    at = F.timestamp_seconds("ts")
    rows = events.where("type = 'gate'").withColumn("at", at).withWatermark("at", delay)
    return rows.groupBy(F.window("at", width)).agg(F.count(F.when(F.col("decision") == "block", 1)).alias("n_blocks"), F.count(F.when(F.col("decision") == "pass", 1)).alias("n_passes"))


def unanswered(edits: DataFrame, verdicts: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """D2, H2 over streams. Every edit (rel, digest, edited_at) once: with its verdict (rel, digest, judged_at, verdict) if one of the same content comes within the time, else as stale.

    Either side may come late by `late`; what is later than the watermark is dropped by its side: a late verdict leaves its
    edit stale, which has been said by then, and a late edit is not asked about. An edit without a verdict comes out when
    the watermark has passed its time, so the state holds the edits and verdicts of `within` + `late` only. Several verdicts in time give a row each.
    """
    e = edits.withWatermark("edited_at", late).alias("e")
    v = verdicts.withWatermark("judged_at", late).alias("v")
    in_time = (F.col("v.judged_at") >= F.col("e.edited_at")) & (F.col("v.judged_at") <= F.col("e.edited_at") + F.expr(f"interval {within}"))
    same = (F.col("e.rel") == F.col("v.rel")) & (F.col("e.digest") == F.col("v.digest"))
    rows = e.join(v, same & in_time, "left_outer")
    return rows.select("e.rel", "e.digest", "edited_at", "judged_at", "verdict", F.when(F.col("judged_at").isNull(), "stale").otherwise("judged").alias("status"))
