"""Sources. Schemas are explicit; what cannot be read is told apart from what is not there."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import checker, names, udf
from ..schemas import ModelReplyError


def exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def trace_events(spark: SparkSession, path: str, schema: str = schemas.TRACE_EVENT) -> tuple[DataFrame, DataFrame]:
    """A3, K1. (events in line order by `file` and `ord`, lines that are no JSON object). A path that is not there is an empty trace.

    Lines are ordered by their block's offset in the file and their place in the block, so files are split between tasks as usual.
    """
    if not exists(spark, path):
        empty = spark.createDataFrame([], "value string, file string, ord struct<block:bigint,row:bigint>")
    else:
        empty = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("ord"))
    rows = empty.where(checker.strip(F.col("value")) != "")
    parsed = rows.withColumn("e", F.when(F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{"), F.from_json("value", schema)))
    return parsed.where("e is not null").select("file", "ord", "e.*"), parsed.where("e is null").select("file", "ord", "value")


def state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A4. The tables of a gate state document (see schemas.STATE_TABLES); a missing key is empty, a missing or corrupt document a fresh state."""
    shape = (
        f"units map<string,struct<{schemas.STATE_TABLES['units'].split(', ', 1)[1].replace(' ', ':').replace(',:', ',')}>>, scanned map<string,string>, "
        "pending map<string,struct<hash:string,attempts:int,pid:bigint>>, baseline_blobs map<string,array<string>>, stop_attempts int, baseline_head string"
    )
    text = spark.read.text(path, wholetext=True) if exists(spark, path) else spark.createDataFrame([], "value string")
    doc = text.limit(1).select(F.from_json("value", shape).alias("d"))
    pairs = lambda name: doc.select(F.explode(f"d.{name}").alias("key", "v"))
    return {
        "units": pairs("units").select(F.col("key").alias("unit_id"), "v.*"),
        "scanned": pairs("scanned").select(F.col("key").alias("rel"), F.col("v").alias("digest")),
        "pending": pairs("pending").select(F.col("key").alias("rel"), "v.*"),
        "baseline_blobs": pairs("baseline_blobs").select(F.col("key").alias("rel"), F.explode("v").alias("digest")),
        "scalars": spark.range(1).join(doc, how="left").select(F.coalesce("d.stop_attempts", F.lit(0)).alias("stop_attempts"), F.col("d.baseline_head").alias("baseline_head")),
    }


def contents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A10. rel (path as Spark names it), digest: SHA-256 of each file's bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("rel"), F.sha2("content", 256).alias("digest"))


def digest(content: Column) -> Column:
    """A10. SHA-256 of bytes; null stays null: unreadable is no content."""
    return F.sha2(content.cast("binary"), 256)


def unit_texts(spark: SparkSession, path: str, renamed: str = "unit_main") -> DataFrame:
    """A5. One row per source file: path, text with every function main under another name."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), udf.rename_function("value", F.lit("main"), F.lit(renamed)).alias("text"))


def units_from(texts: DataFrame, symbol: str, renamed: str = "unit_main") -> DataFrame:
    """A5. texts (path, text) as units of one function: unit_id, path, symbol, source_text."""
    return texts.select(F.concat_ws("::", "path", F.lit(symbol)).alias("unit_id"), "path", F.lit(symbol).alias("symbol"), udf.rename_function("text", F.lit("main"), F.lit(renamed)).alias("source_text"))


def hook_payload(text: Column, schema: str = "tool_name string, cwd string, tool_input struct<file_path:string,command:string>, stop_hook_active boolean") -> Column:
    """A11. A hook's payload; an empty text is an empty payload, an ill-formed one null."""
    return F.from_json(F.when(checker.strip(F.coalesce(text, F.lit(""))) == "", "{}").otherwise(text), schema)


def edited_sources(command: Column) -> Column:
    """A12. Sources that a patch touches, each once in order: added, updated, or the new name of a moved one."""
    paths = F.regexp_extract_all(F.coalesce(command, F.lit("")), F.lit(r"(?m)^\*\*\* (?:(?:Add|Update) File|Move to): (.+)$"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(paths, checker.strip), lambda p: names.is_edited_source(p)))


def model_reply(envelope: Column, exit_code: Column) -> Column:
    """A14. struct(text, error) of a model call's JSON envelope: every failure is an error, never an empty text."""
    e = F.from_json(envelope, "result string, is_error boolean, subtype string")
    error = schemas.first_reason(
        [
            (~F.coalesce(exit_code == 0, F.lit(False)), F.concat(F.lit("exit "), F.coalesce(exit_code.cast("string"), F.lit("unknown")))),
            (F.try_parse_json(envelope).isNull(), "envelope is not JSON"),
            (e["is_error"], F.concat(F.lit("model error: "), F.coalesce(e["subtype"], F.lit("unknown")))),
            (checker.strip(F.coalesce(e["result"], F.lit(""))) == "", "empty reply"),
        ]
    )
    return F.struct(F.when(error.isNull(), e["result"]).alias("text"), error.alias("error"))


def complete(reply: str, exit_code: int = 0) -> str:
    """A14, L3 on the driver, for one captured envelope."""
    try:
        found = json.loads(reply)
    except ValueError as e:
        raise ModelReplyError("envelope is not JSON") from e
    if exit_code or not isinstance(found, dict) or found.get("is_error") or not str(found.get("result") or "").strip():
        raise ModelReplyError(f"exit {exit_code}" if exit_code else "no reply")
    return found["result"]


#: Seconds beyond the checker's own limit before a run is given up.
GRACE_S = 5.0

RunPort = Callable[[pd.DataFrame], pd.DataFrame]


def runs(requests: DataFrame, port: RunPort) -> DataFrame:
    """A6, L1, L9. Run records of requests (run_id, unit_id, k, argv, timeout_s) through a port, a function of one batch that returns exit_code, duration_s, stdout, stderr.

    A port that raises gives an error record for each of its requests, and one that returns null for exit_code a
    timeout: nothing raises through. Batches may be tried again after a lost executor, so a port must be repeatable.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            try:
                got = port(pdf).reset_index(drop=True)
            except Exception as e:  # noqa: BLE001  any failure of the checker is a record
                got = pd.DataFrame({"exit_code": -1, "duration_s": 0.0, "stdout": "", "stderr": f"ERROR: esbmc invocation failed: {e}"}, index=range(len(pdf)))
            out = pd.concat([pdf.reset_index(drop=True)[["run_id", "unit_id", "k", "argv"]], got], axis=1)
            late = out["exit_code"].isna()
            out.loc[late, "stderr"] = out.loc[late, "stderr"].fillna("") + "\nERROR: Timed out"
            out["exit_code"] = out["exit_code"].fillna(-1).astype("int32")
            yield out[["run_id", "unit_id", "k", "argv", "exit_code", "duration_s", "stdout", "stderr"]]

    return requests.select("run_id", "unit_id", "k", "argv", "timeout_s").mapInPandas(run, "run_id long, unit_id string, k int, argv array<string>, exit_code int, duration_s double, stdout string, stderr string")


def recorded(requests: DataFrame, captured: DataFrame, key: list[str]) -> DataFrame:
    """L1, L2 offline. Requests answered from captured records by key; one without a record is an error, never a pass."""
    rows = requests.join(captured, key, "left")
    return rows.withColumns({"exit_code": F.coalesce("exit_code", F.lit(-1)), "stderr": F.when(F.col("exit_code").isNull(), "ERROR: no captured run").otherwise(F.col("stderr"))})


def fixes(requests: DataFrame, recorded_fixes: DataFrame) -> DataFrame:
    """L2. The recorded fix of each violated source (source, text), null where there is none."""
    return requests.join(recorded_fixes.select("source", F.col("text").alias("fixed_text")), "source", "left")


def guarded(rows: DataFrame, text: str, guards: dict[str, tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """C11. (rows whose JSON payload has the types asked for, the others with reject_reason). guards: reason to (path, how the type's name begins)."""
    typed = lambda path: F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), path, "variant"))
    return schemas.reject(rows, {reason: typed(path).startswith(kind) for reason, (path, kind) in guards.items()})
