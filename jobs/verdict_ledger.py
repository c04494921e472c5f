"""The ledger of verification runs, kept up as trace files land: per day and unit, what ran, how it stands, what the gate says.

Who runs a gate over many projects wants to see each morning which units block, without reading the whole trace again.
The job takes the trace files that have come since its last run (a file stream with a checkpoint, all that is there, then
it ends), in two steps:

1. Each batch of files becomes partial rows per day and unit, in `partials`, partitioned by batch and day. A batch
   that is tried again overwrites its own partitions, so nothing counts twice.
2. The days of batches that the ledger does not hold yet are folded again from all their partials and replace
   their partitions of `ledger`. A run that was cut off between the steps is made good by the next.

Counts are sums and the standing verdict is that of the greatest order, so the result depends neither on how files
fall into batches nor on the order in which they come. Late files change the days they belong to, however old. Only the days that
new files touch are read and written again.

Defined cases: a null or unknown type is a failure, as anything but a verified unit and one that waits for a
contract blocks; null units and null times have rows of their own; repeated rows count each; of rows equal in order
the greatest verdict and bound stand, so reruns agree; an empty folder gives an empty ledger.

    python -m jobs.verdict_ledger --events FOLDER-OR-GLOB --out FOLDER --checkpoint FOLDER [--config FILE]
"""

from __future__ import annotations

import argparse
import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, config, counted, write
from runledger.operators import ladders
from runledger.sources import settings

PARTIAL = "batch long, day date, unit long, n_runs long, n_failures long, n_needs_contract long, standing struct<o:struct<{order}>,verdict:string,k:int>"
#: Columns of the ledger; `folded` is the last batch that a day's rows hold.
LEDGER = "day date, unit long, n_runs long, n_failures long, n_needs_contract long, verdict string, k int, decision string, exit_code int, folded long"


def traced(events: DataFrame, conf: dict) -> DataFrame:
    """Trace rows: day, unit, o (their order), verdict, k."""
    words = F.create_map(*[F.lit(w) for pair in conf["verdicts"].items() for w in pair])
    return events.select(
        F.to_date(conf["time"]).alias("day"), F.col(conf["unit"]).cast("long").alias("unit"), F.struct(*conf["order"]).alias("o"),
        F.try_element_at(words, F.col(conf["type"])).alias("verdict"), F.expr(conf["bound"]).alias("k"),
    )


def partial(runs: DataFrame) -> DataFrame:
    """Rows per day and unit that sums and maxima put together again: n_runs, n_failures, n_needs_contract, standing."""
    return runs.groupBy("day", "unit").agg(F.count(F.lit(1)).alias("n_runs"), *ladders.gate_counts(), F.max(F.struct("o", "verdict", "k")).alias("standing"))


def fold(partials: DataFrame) -> DataFrame:
    """Ledger rows of whole days from their partials."""
    sums = [F.sum(c).alias(c) for c in ("n_runs", "n_failures", "n_needs_contract")]
    whole = ladders.gate_said(partials.groupBy("day", "unit").agg(*sums, F.max("standing").alias("s"), F.max("batch").alias("folded")))
    return whole.select("day", "unit", "n_runs", "n_failures", "n_needs_contract", "s.verdict", "s.k", "decision", "exit_code", "folded")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows at a path, none where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def land(spark: SparkSession, events: str, out: str, checkpoint: str, conf: dict) -> int:
    """Step 1: the new files as partials; returns their rows."""
    read = [0]

    def keep(batch: DataFrame, n: int) -> None:
        rows, seen = counted(traced(batch, conf))
        days = partial(rows).withColumn("batch", F.lit(n).cast("long"))
        write(days, f"{out}/partials", lambda w: w.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day"))
        read[0] += seen()
        LOG.info("batch %d: read %d trace rows", n, seen())

    stream = spark.readStream.schema(conf["schema"]).option("maxFilesPerTrigger", conf["max_files_per_batch"]).parquet(events)
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return read[0]


def publish(spark: SparkSession, out: str, conf: dict) -> int:
    """Step 2: the days with batches that the ledger lacks, anew; returns the rows written."""
    orders = dict(zip(conf["order"], (spark.createDataFrame([], conf["schema"]).schema[c].dataType.simpleString() for c in conf["order"]), strict=True))
    partials = _table(spark, f"{out}/partials", PARTIAL.format(order=",".join(f"{c}:{t}" for c, t in orders.items())))
    # One row a day: batch is a partition column of partials, and the two sides are grouped before they meet.
    have = _table(spark, f"{out}/ledger", LEDGER).groupBy("day").agg(F.max("folded").alias("folded"))
    come = partials.groupBy("day").agg(F.max("batch").alias("batch"))
    due = come.join(have, come["day"].eqNullSafe(have["day"]), "left").where("folded is null or folded < batch").select(come["day"].alias("due"))
    # Days are distributed to tasks whole files at a time; a unit's rows of a day are already one row.
    rows = fold(partials.join(due, partials["day"].eqNullSafe(due["due"]), "left_semi")).repartition("day", F.pmod(F.xxhash64("unit"), F.lit(conf["files_per_day"])))
    return write(rows, f"{out}/ledger", lambda w: w.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day"))


def run(spark: SparkSession, events: str, out: str, checkpoint: str, conf: dict | None = None) -> dict[str, int]:
    """Take the trace files of `events` that no run with this checkpoint has taken; returns the rows read and written."""
    conf, out = conf or config("verdict_ledger"), out.rstrip("/")
    with settings.session(spark, {"spark.sql.sources.partitionColumnTypeInference.enabled": "false"}):
        return {"read": land(spark, events, out, checkpoint, conf), "written": publish(spark, out, conf)}


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """The ledger as it stands."""
    return _table(spark, f"{out.rstrip('/')}/ledger", LEDGER).select(*[c.split()[0] for c in LEDGER.split(", ")])


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("events", "out", "checkpoint"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config")
    a = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("verdict_ledger").getOrCreate()
    try:
        LOG.info("done: %s", run(spark, a.events, a.out, a.checkpoint, config("verdict_ledger", a.config)))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
