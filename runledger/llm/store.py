"""Shared storage for intermediate tables and output files.

Executors may be lost at any time, so lineage is cut with tables written under the folder the
cluster names in ``spark.checkpoint.dir``. Where that setting is absent, a local master gets a folder of its own
machine and any other master an error.
"""

from __future__ import annotations

import tempfile
import time
import uuid
import weakref

import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (ids and small numbers only) may be broadcast; it is counted first.
BROADCAST_ROWS = 1_000_000

#: Rows and bytes that Python workers get at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 8_000_000

#: Seconds between two calls for the driver's garbage.
FREE_SECONDS = 3.0

_own: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_freed: dict[str, float] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application below spark.checkpoint.dir; removed when the driver's JVM ends."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="runledger-"))
    path = f"{root.rstrip('/')}/{sc.applicationId}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the plan above no longer needs df."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    free_shuffles(spark)
    table = spark.read.schema(schema).parquet(path)
    _paths[table] = path
    return table


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are gone: it does so when the driver collects garbage, by itself every half hour only."""
    if time.monotonic() - _freed.get("at", 0.0) > FREE_SECONDS:
        spark.sparkContext._jvm.System.gc()
        _freed["at"] = time.monotonic()


def drop(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for table in tables:
        if folder := _paths.pop(table, None):
            sc = table.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores behind it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and a struct column that tells its rows apart: hash of the file and row in the file. docs that are not read from files are written first."""
    key = free_name(docs.columns, "row_key")

    def keyed(df):
        at = df.metadataColumn("_metadata")
        return df.withColumn(key, F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("row")))

    try:
        found = keyed(docs)
        found.schema  # noqa: B018  fails here where there are no files
    except AnalysisException:
        docs = materialise(docs, "rows")
        found = keyed(docs)
    files = docs.inputFiles()
    if len({xxhash.xxh64_intdigest(f.encode(), 42) for f in files}) < len(set(files)):
        raise ValueError("two files of one hash")
    return found, key


def narrow_side(table: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a narrow, materialised table for broadcast if its counted rows allow it; else leave it to a shuffle join."""
    rows = table.count() if rows is None else rows
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Let Python workers get BATCH_ROWS rows and BATCH_BYTES bytes at a time, unless the session's owner chose otherwise.

    A worker and the JVM beside it each hold a batch or two; Spark's own limits are ten times as large.
    """
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.sparkContext.getConf().get(key) is None:
            spark.conf.set(key, value)


def text_rows(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """doc_id, t (UTF-8 bytes of the text) and more columns, for Python workers."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t"), *more)


def text_volume(docs: DataFrame, col: str = "text") -> int:
    """Bytes of all texts, null as empty."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(col)), F.lit(0)).cast("long")).first()[0]


def text_bytes(col: str = "text"):
    """UTF-8 bytes of a text column, null as empty; Python then never fails on ill-formed text."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))
