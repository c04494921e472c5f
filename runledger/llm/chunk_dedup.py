"""Exact dedup by content-defined chunk recipes.

Each text is normalised, cut at content-defined points and written as a recipe: the ordered list of its
chunks' 128-bit digests. Each distinct chunk moves once, to the task that compares all byte strings under
its digest; a digest that passes is an identifier. From then on only identifier lists move. A digest that
meets two different byte strings is no identifier: documents holding it are compared by the SHA-256 of the
whole normalised text instead.

Defined cases: null text counts as empty; empty texts equal one another; a null doc_id sorts after all
others; of rows that also share their doc_id exactly one is kept; an empty table gives an empty result;
other columns are never read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, materialise, text_rows

WINDOW, CUT_BITS, LEAST, MOST = 16, 10, 256, 8192
SEGMENT = 1 << 20
#: Chunks a task remembers, by digest and SHA-256, so as not to send one again; the memory is emptied when full.
REMEMBERED = 200_000

_SPACES = re.compile(rb"[\x20\x09-\x0D]+")
_UNEVEN = re.compile(rb"[\x09-\x0D]|\x20\x20")
_MIX = np.random.default_rng(20240229).integers(1, 1 << 32, 256, dtype=np.uint32)
_MULT = 2654435761


def normalise(text: bytes) -> bytes:
    """Every run of ASCII white space becomes one space."""
    return _SPACES.sub(b" ", text) if _UNEVEN.search(text) else text


def cut_points(text: bytes) -> list[int]:
    """Ends of the chunks of text; a cut depends on the WINDOW bytes before it and on LEAST and MOST only."""
    size, marks = len(text), []
    if size > LEAST:
        raw = np.frombuffer(text, np.uint8)
        for at in range(0, size, SEGMENT):
            h = _MIX[raw[max(0, at - WINDOW + 1) : at + SEGMENT]]
            step, mult = 1, _MULT
            while step < WINDOW and len(h) > step:
                h = h[:-step] * np.uint32(mult) + h[step:]
                step, mult = step * 2, mult * mult % (1 << 32)
            if step == WINDOW:
                first = max(0, at - WINDOW + 1) + WINDOW
                marks += (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + first).tolist()
    ends, last = [], 0
    for mark in [*marks, size]:
        while mark - last > MOST:
            last += MOST
            ends.append(last)
        if mark - last >= LEAST or mark == size and mark > last:
            last = mark
            ends.append(last)
    return ends


_RECIPES = "row_id long, doc_id long, text_sha256 string, recipe binary, digest binary, chunk binary"


def _recipes(width: int):
    """Batches of doc_id, text and, if wanted, a row's key, which follows the other columns."""
    schema = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("recipe", pa.binary()), ("digest", pa.binary()), ("chunk", pa.binary())])

    def run(batches):
        row, sent = TaskContext.get().partitionId() << 33, set()
        for batch in batches:
            rows, chunks = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text, start, recipe = normalise(text), 0, []
                for end in cut_points(text):
                    chunk = text[start:end]
                    digest = xxhash.xxh3_128_digest(chunk)[:width]
                    recipe.append(digest)
                    known = digest + hashlib.sha256(chunk).digest()
                    if known not in sent:
                        sent.add(known)
                        chunks.append((digest, chunk))
                    start = end
                rows.append((row, doc_id, hashlib.sha256(text).hexdigest(), b"".join(recipe)))
                row += 1
            if len(sent) > REMEMBERED:
                sent.clear()
            n, m = len(rows), len(chunks)
            if n:
                a, b, c, d = zip(*rows, strict=True)
                own = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, *batch.columns[2:]], names=[*schema.names, *batch.schema.names[2:]])
            if m:
                e, f = zip(*chunks, strict=True)
                own = [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.nulls(m, pa.binary()), pa.array(e, pa.binary()), pa.array(f, pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, *[pa.nulls(m, x.type) for x in batch.columns[2:]]], names=[*schema.names, *batch.schema.names[2:]])

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_width: int = 16, key_col: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and key_col (two longs, see store.with_row_key) if named.

    digest_width: bytes of a chunk's digest.
    """
    own = [F.col(key_col).alias("row_key")] if key_col else []
    schema = _RECIPES + ", row_key struct<file:bigint,row:bigint>" * len(own)
    key = ["row_key"] * len(own)
    found = materialise(text_rows(docs, id_col, text_col, *own).mapInArrow(_recipes(digest_width), schema), "recipes")
    rows = found.filter("row_id is not null").select("row_id", "doc_id", "text_sha256", F.concat(F.lit(b"\x00"), "recipe").alias("key"), *key)
    # All byte strings under a digest meet in one task; only distinct ones are left there.
    distinct = found.filter("digest is not null").select("digest", "chunk").repartition("digest").groupBy("digest", "chunk").agg(F.lit(1).alias("one"))
    unverified = materialise(distinct.groupBy("digest").count().filter("count > 1").select("digest"), "unverified")
    if not unverified.isEmpty():
        parts = F.expr(f"explode(transform(sequence(0, length(key) div {digest_width} - 1), i -> substring(key, 2 + i * {digest_width}, {digest_width})))")
        doubtful = rows.filter("length(key) > 1").select("row_id", parts.alias("digest")).join(unverified, "digest", "left_semi").select("row_id").distinct()
        compared = F.when(F.col("doubt"), F.concat(F.lit(b"\x01"), F.col("text_sha256").cast("binary"))).otherwise(F.col("key")).alias("key")
        rows = materialise(rows.join(doubtful.withColumn("doubt", F.lit(True)), "row_id", "left").select("row_id", "doc_id", "text_sha256", compared, *key), "compared")
    else:
        rows = materialise(rows, "compared")
    drop(found, unverified)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("first")
    groups = materialise(rows.groupBy("key").agg(first, F.count(F.lit(1)).alias("group_size")), "groups")
    named = [F.col(k).alias(key_col) for k in key]
    return rows.join(groups, "key").select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("first.row_id")).alias("kept"), "text_sha256", *named)
