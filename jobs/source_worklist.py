"""What is left to verify in a tree of sources: each source with the state of its content, and one item of work per open content.

A verification of a large tree should read no content twice. The job digests every source's whole text and puts the sources
beside the verdicts that stand (stamps), the verifications that were begun, and the contents that were there before
anyone worked (baseline). Sources that no verdict covers and that share a content wait for one of them, the lead. Status of a source:

- unreadable: no text; neither fresh nor open, left to the next scan.
- verified, violated, ...: its own stamp's verdict, the worst where there are several.
- reused: another source of the same content has a stamp; `verdict` is the worst of theirs.
- baseline: nobody's work, as the content was there before.
- retry: a verification of it was begun and has not ended; the lead of its content.
- verify: the lead of an open content; these and the retries are the work.
- waits: shares its content with a lead.

Written are `sources`, partitioned by group and status, and `counts`, a row per group and status, partitioned by group. Both are
replaced whole, so a rerun gives the same files' rows, and after a run that was cut off the next one makes both good. Texts are read
once and never shuffled; what is joined are digests. A content that a third of all sources share is one row on the side that
is aggregated, and the other side is split by the session's skew handling.

Defined cases: rows that agree in id, group and content are one source, of n_rows rows; other rows of one id are sources each,
with the stamps of that id; the lead is the smallest id, null ids last, then the smallest group, null last; stamps without a
verdict and without begun work say nothing; an empty group is read back as null, as any partition value; empty tables give
empty output.

    python -m jobs.source_worklist --sources PATH --stamps PATH --baseline PATH --out FOLDER [--config FILE]
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, config, counted, write
from runledger.functions import checker, names
from runledger.operators import ladders
from runledger.sources import readers

SOURCES = "id long, slug string, digest string, n_rows long, n_lines long, n_chars long, verdict string, n_sources long, lead long, work boolean, group string, status string"
COUNTS = "status string, n_sources long, n_contents long, n_lines long, group string"


def line_count(text):
    """Lines of a text, by its line breaks; a break at the end opens no further line, an empty text has none."""
    breaks = F.regexp_count(text, F.lit(checker.LINE_BREAK))
    open_end = ~text.rlike(rf"({checker.LINE_BREAK})\z") & (text != "")
    return (breaks + open_end.cast("int")).cast("long")


def digested(sources: DataFrame, conf: dict) -> DataFrame:
    """Sources without their texts: id, group, slug, digest, n_lines, n_chars, n_rows."""
    text, group = F.col(conf["text"]), F.col(conf["group"])
    unit = F.concat_ws("::", F.coalesce(group, F.lit("none")), F.coalesce(F.col(conf["id"]).cast("string"), F.lit("none")))
    rows = sources.select(
        F.col(conf["id"]).cast("long").alias("id"), group.alias("group"), names.unit_slug(unit).alias("slug"), readers.digest(text).alias("digest"),
        line_count(text).alias("n_lines"), F.length(text).cast("long").alias("n_chars"),
    )
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n_rows"))


def stamped(stamps: DataFrame, conf: dict) -> DataFrame:
    """One row per id: id, verdict (the worst of its stamps, null where none has one), begun."""
    rows = stamps.select(F.col(conf["stamp_id"]).cast("long").alias("id"), F.expr(conf["verdict"]).alias("outcome"), F.coalesce(F.expr(conf["begun"]), F.lit(False)).alias("begun")).where("id is not null")
    known = ladders.worst(rows.where("outcome is not null"), ["id"]).select("id", F.when(F.col("worst") == "clean", "verified").otherwise(F.col("worst")).alias("verdict"))
    return rows.groupBy("id").agg(F.bool_or("begun").alias("begun")).join(known, "id", "left")


def judged(files: DataFrame, stamps: DataFrame, baseline: DataFrame) -> DataFrame:
    """files with status, verdict, n_sources, lead and work."""
    rows = files.join(stamps, "id", "left").withColumn("begun", F.coalesce("begun", F.lit(False)))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("group").isNull().alias("no_group"), "group")
    readable = rows.where("digest is not null")
    open_ = F.col("verdict").isNull()
    contents = readable.groupBy("digest").agg(
        F.sum("n_rows").alias("n_sources"), F.count("verdict").alias("n_stamped"), F.min(F.when(open_, place)).alias("first"),
        F.count(F.when(F.col("verdict") == "violated", 1)).alias("n_violated"), F.count(F.when(F.col("verdict") == "unknown", 1)).alias("n_unknown"), F.count(F.when(F.col("verdict") == "error", 1)).alias("n_error"),
    )
    old = baseline.where("digest is not null").select("digest", F.lit(True).alias("old")).distinct()
    shared = F.when(F.col("n_violated") > 0, "violated").when(F.col("n_unknown") > 0, "unknown").when(F.col("n_error") > 0, "error").when(F.col("n_stamped") > 0, "verified")
    known = contents.join(old, "digest", "left").select("digest", "n_sources", "first", shared.alias("shared"), F.coalesce("old", F.lit(False)).alias("old"))
    leads = F.col("first").eqNullSafe(place)
    status = (
        F.when(F.col("digest").isNull(), "unreadable").when(~open_, F.col("verdict")).when(F.col("shared").isNotNull(), "reused").when(F.col("old"), "baseline")
        .when(leads & F.col("begun"), "retry").when(leads, "verify").otherwise("waits")
    )
    out = rows.join(known, "digest", "left").withColumns({"status": status, "verdict": F.coalesce("verdict", "shared")})
    waiting = F.col("status").isin("retry", "verify", "waits")
    return out.withColumns({"lead": F.when(waiting, F.col("first.id")), "work": F.col("status").isin("retry", "verify"), "n_sources": F.coalesce("n_sources", F.lit(0))})


def run(spark: SparkSession, sources: str, stamps: str, baseline: str, out: str, conf: dict | None = None) -> dict[str, int]:
    """Write the state of all sources and the counts; returns the rows read and written."""
    conf, out = conf or config("source_worklist"), out.rstrip("/")
    texts, n_read = counted(spark.read.parquet(sources))
    before = spark.read.parquet(baseline).select(readers.digest(F.col(conf["baseline_text"])).alias("digest"))
    rows = judged(digested(texts, conf), stamped(spark.read.parquet(stamps), conf), before)
    columns = [c.split()[0] for c in SOURCES.split(", ")]
    # A group's rows of a status go to files_per_part files; a group that holds a third of all rows wants more than one.
    dealt = rows.select(*columns).repartition("group", "status", F.pmod(F.xxhash64("id", "digest"), F.lit(conf["files_per_part"])))
    n_sources = write(dealt, f"{out}/sources", lambda w: w.mode("overwrite").partitionBy("group", "status"))
    LOG.info("read %d sources from %s", n_read(), sources)
    counts = listing(spark, out).groupBy("group", "status").agg(F.sum("n_rows").alias("n_sources"), F.countDistinct("digest").alias("n_contents"), F.sum("n_lines").alias("n_lines"))
    n_counts = write(counts.select("status", "n_sources", "n_contents", "n_lines", "group").coalesce(1), f"{out}/counts", lambda w: w.mode("overwrite").partitionBy("group"))
    return {"read": n_read(), "written": n_sources, "counts": n_counts}


def listing(spark: SparkSession, out: str) -> DataFrame:
    """The sources as they were written."""
    return spark.read.schema(SOURCES).parquet(f"{out.rstrip('/')}/sources")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("sources", "stamps", "baseline", "out"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config")
    a = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("source_worklist").getOrCreate()
    try:
        LOG.info("done: %s", run(spark, a.sources, a.stamps, a.baseline, a.out, config("source_worklist", a.config)))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
