"""Exact top-k inner-product search with vector-approximation files.

Building: each task writes its vectors to a file of its own, block by block: the ids, the cells (one byte a
component: the part of the block's range it lies in) and the exact vectors. A table of the blocks names file,
places and cell widths. No vector moves between tasks.

Searching, a bounded batch of queries at a time: a first scan reads cells only and bounds every score from below
and above; the k best lower bounds of a query over all blocks give the score that its kth result reaches at
least. The second scan opens vectors whose upper bound reaches that: exact vectors are read by position, in the
order of their bounds, until no unread bound reaches the kth exact score found so far.

Components are floor(256 * x) without rounding, and scores are exact integers. Vectors too long for exact sums in
float64 have no cells: they are always read, and multiplied as Python's integers.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; vectors of
another length than a query's are no candidates of it; rows repeated whole are candidates like others, told
apart by nothing but their rank; of query rows that share an id, the smallest vector asks; null ids take no part;
a score beyond a 64-bit integer counts as the nearest one; an empty table gives an empty result; other columns
are never read.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise, new_path, small_batches
from .token_pack import _open

SCALE, CELLS = 256, 256
#: A block holds so many vectors and bytes at most; a batch of queries so many bytes, twice that at worst.
BLOCK_ROWS, BLOCK_BYTES, BATCH_BYTES = 8192, 16_000_000, 4_000_000
#: Queries whose bounds are held at once; exact vectors that far apart in the file are read in one piece.
QUERY_ROWS, GAP = 256, 8
LONG = (-(1 << 63), (1 << 63) - 1)

_MANIFEST = "file string, dims int, n int, at long, low binary, width binary"
_MANIFEST_ARROW = pa.schema([("file", pa.string()), ("dims", pa.int32()), ("n", pa.int32()), ("at", pa.int64()), ("low", pa.binary()), ("width", pa.binary())])


def scaled(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x)


def whole(x: float) -> int:
    return int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(SCALE * x)


def tame(x: np.ndarray) -> np.ndarray:
    """Vectors whose products, sums and bounds are exact in float64."""
    return np.abs(x).max(axis=1) * SCALE + 1 <= math.isqrt((1 << 50) // x.shape[1])


def _build(folder: str):
    def run(batches):
        name, out, at = f"{folder}/{uuid.uuid4().hex}.va", None, 0
        held: dict[tuple[int, bool], list] = {}

        def block(key):
            nonlocal out, at
            dims, has_cells = key
            ids, x = (np.concatenate(c) for c in zip(*held.pop(key), strict=True))
            if out is None:
                system, path = _open(name)
                out = system.open_output_stream(path)
            low = width = cells = b""
            if has_cells:
                v = scaled(x)
                bottom = v.min(0)
                step = np.maximum(1, np.ceil((v.max(0) - bottom + 1) / CELLS))
                low, width, cells = bottom.tobytes(), step.tobytes(), ((v - bottom) // step).astype(np.uint8).tobytes()
            row = (name, dims, len(ids), at, low, width)
            at += out.write(ids.astype("<i8").tobytes() + cells + x.astype("<f8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, _MANIFEST_ARROW.types, strict=True)], schema=_MANIFEST_ARROW)

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            lens, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            ends = np.cumsum(lens)
            for dims in np.unique(lens).tolist():
                own = np.flatnonzero(lens == dims)
                x = flat[(ends[own] - dims)[:, None] + np.arange(dims)]
                calm = tame(x)
                for has_cells in (True, False):
                    pick, key = calm == has_cells, (dims, has_cells)
                    rows = min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * dims)))
                    mine, vectors = ids[own][pick], x[pick]
                    for a in range(0, len(mine), rows):
                        held.setdefault(key, []).append((mine[a : a + rows], vectors[a : a + rows]))
                        if sum(len(i) for i, _ in held[key]) >= rows:
                            yield block(key)
        for key in list(held):
            yield block(key)
        if out is not None:
            out.close()

    return run


class _Block:
    """One block of a file: cells are read whole, exact vectors by position."""

    def __init__(self, file: str, dims: int, n: int, at: int, low: bytes, width: bytes):
        system, path = _open(file)
        self.file, self.dims, self.n, self.has_cells = system.open_input_file(path), dims, n, bool(low)
        self.ids = np.frombuffer(self.file.read_at(8 * n, at), "<i8")
        self.at_cells, self.at_exact = at + 8 * n, at + 8 * n + (n * dims if low else 0)
        self.low, self.width = np.frombuffer(low), np.frombuffer(width)

    def middles(self) -> np.ndarray:
        cells = np.frombuffer(self.file.read_at(self.n * self.dims, self.at_cells), np.uint8).reshape(self.n, self.dims)
        return self.low + cells * self.width + (self.width - 1) / 2

    def slack(self, q: np.ndarray) -> np.ndarray:
        """What a score with a vector of the block may differ from that with its cell's middle."""
        return np.abs(q) @ ((self.width - 1) / 2)

    def exact(self, places: np.ndarray) -> np.ndarray:
        """Vectors at ascending places."""
        out = []
        for run in np.split(places, np.flatnonzero(np.diff(places) > GAP) + 1):
            if len(run):
                first, size = int(run[0]), 8 * self.dims
                raw = self.file.read_at((int(run[-1]) + 1 - first) * size, self.at_exact + first * size)
                out.append(np.frombuffer(raw, "<f8").reshape(-1, self.dims)[run - first])
        return np.concatenate(out) if out else np.empty((0, self.dims))


class _Best:
    """The k best (score, id) of each query so far, best first."""

    def __init__(self, k: int):
        self.k, self.found = k, {}

    def kth(self, query: int):
        own = self.found.get(query, ())
        return own[-1][0] if len(own) == self.k else -math.inf

    def add(self, query: int, ids, scores) -> None:
        own = [*self.found.get(query, ()), *((min(max(int(s), LONG[0]), LONG[1]), int(i)) for s, i in zip(scores, ids, strict=True))]
        self.found[query] = sorted(own, key=lambda r: (-r[0], r[1]))[: self.k]


def _blocks(batch):
    columns = [c.to_pylist() for c in batch.columns]
    return (_Block(*row) for row in zip(*columns, strict=True))


def _bounds_from_below(asked, k: int):
    """Rows query, low: the k best lower bounds of each query over the blocks of a task."""

    def run(batches):
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for block in _blocks(batch):
                if block.has_cells and block.dims in asked.value:
                    ids, x = asked.value[block.dims]
                    calm = np.flatnonzero(tame(x))
                    middles = block.middles()
                    for at in range(0, len(calm), QUERY_ROWS):
                        own = calm[at : at + QUERY_ROWS]
                        q = scaled(x[own])
                        low = q @ middles.T - block.slack(q)[:, None]
                        low[ids[own][:, None] == block.ids[None, :]] = -np.inf
                        top = np.partition(low, max(0, block.n - k), axis=1)[:, max(0, block.n - k) :]
                        for query, row in zip(ids[own].tolist(), top, strict=True):
                            best[query] = np.sort(np.append(best.get(query, ()), row))[-k:]
        rows = [(q, float(b)) for q, row in best.items() for b in row if b > -np.inf]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.float64())], names=["query", "low"])

    return run


def _read_calm(block: _Block, ids, x, least: dict, best: _Best) -> None:
    """The block's vectors that may be among a calm query's k best, in the order of their bounds."""
    middles, have = block.middles(), {}
    for at in range(0, len(ids), QUERY_ROWS):
        own, q = ids[at : at + QUERY_ROWS], scaled(x[at : at + QUERY_ROWS])
        high = q @ middles.T + block.slack(q)[:, None]
        high[own[:, None] == block.ids[None, :]] = -np.inf
        floor = np.array([max(least.get(i, -math.inf), best.kth(i)) for i in own.tolist()])
        rows, places = np.nonzero((high >= floor[:, None]) & (high > -np.inf))
        waiting = {}
        for i, cands in zip(np.unique(rows).tolist(), np.split(places, np.flatnonzero(np.diff(rows)) + 1), strict=False):
            waiting[i] = cands[np.argsort(-high[i, cands], kind="stable")]
        step = 4 * best.k
        while waiting:
            now = {i: c[:step] for i, c in waiting.items()}
            new = np.array(sorted(set(np.concatenate(list(now.values())).tolist()) - have.keys()), np.int64)
            have.update(zip(new.tolist(), scaled(block.exact(new)), strict=True))
            left = {}
            for i, c in now.items():
                best.add(int(own[i]), block.ids[c], np.stack([have[p] for p in c.tolist()]) @ q[i])
                rest = waiting[i][step:]
                rest = rest[high[i, rest] >= best.kth(int(own[i]))]
                if len(rest):
                    left[i] = rest
            waiting, step = left, step * 4


def _read_all(block: _Block, ids, x, best: _Best) -> None:
    """All vectors of the block, in Python's integers."""
    values = [[whole(c) for c in v] for v in block.exact(np.arange(block.n)).tolist()]
    for query, v in zip(ids.tolist(), x.tolist(), strict=True):
        q = [whole(c) for c in v]
        scores = [sum(a * b for a, b in zip(q, c, strict=True)) for c in values]
        other = np.flatnonzero(block.ids != query)
        best.add(query, block.ids[other], [scores[i] for i in other.tolist()])


def _exact_scores(asked, least, k: int):
    """Rows query_id, vec_id, score: the k best of each query over the blocks of a task."""

    def run(batches):
        best = _Best(k)
        for batch in batches:
            for block in _blocks(batch):
                if block.dims in asked.value:
                    ids, x = asked.value[block.dims]
                    calm = tame(x) & block.has_cells
                    if calm.any():
                        _read_calm(block, ids[calm], x[calm], least.value, best)
                    if not calm.all():
                        _read_all(block, ids[~calm], x[~calm], best)
        rows = [(q, i, s) for q, own in best.found.items() for s, i in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def _best_rows(rows: DataFrame, by: str, score: str, k: int, *ties: str) -> DataFrame:
    place = Window.partitionBy(by).orderBy(F.col(score).desc(), *ties)
    return rows.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors of each query, its own id apart."""
    spark, sc = vectors.sparkSession, vectors.sparkSession.sparkContext
    sound = F.size(vector_col) > 0
    sound &= F.forall(F.col(vector_col), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))

    def rows(df):
        known = df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(sound)
        return known.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    small_batches(spark)
    folder = new_path(spark, "vectors")
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    blocks = materialise(rows(vectors).mapInArrow(_build(folder), _MANIFEST), "blocks")
    asked = materialise(rows(queries).groupBy("id").agg(F.min(F.struct(F.size("v").alias("dims"), "v")).alias("q")).select("id", "q.dims", "q.v"), "queries")
    n, total = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum("dims"), F.lit(0))).first()
    n_blocks, parts = blocks.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    result = "query_id long, rank int, vec_id long, score long"
    if not n or not n_blocks:
        return spark.createDataFrame([], result)
    dealt = blocks.repartition(min(n_blocks, max(parts, n_blocks // 64)))
    batches = -(-8 * total // BATCH_BYTES)
    batch = lambda m: F.pmod(F.xxhash64("id"), F.lit(m))
    while batches < n and asked.groupBy(batch(batches)).agg((8 * F.sum("dims")).alias("size")).agg(F.max("size")).first()[0] > 2 * BATCH_BYTES:
        batches *= 2
    found = []
    for b in range(batches):
        by_dims: dict[int, list] = {}
        for r in asked.filter(batch(batches) == b).collect():  # bounded by BATCH_BYTES
            by_dims.setdefault(r["dims"], []).append((r["id"], r["v"]))
        if not by_dims:
            continue
        sent = sc.broadcast({d: (np.array([i for i, _ in q], np.int64), np.array([v for _, v in q], np.float64)) for d, q in by_dims.items()})
        low = _best_rows(dealt.mapInArrow(_bounds_from_below(sent, k), "query long, low double"), "query", "low", k)
        least = sc.broadcast({r[0]: r[1] for r in low.filter(F.col("rank") == k).select("query", "low").collect()})  # one number a query of the batch
        near = dealt.mapInArrow(_exact_scores(sent, least, k), "query_id long, vec_id long, score long")
        found.append(materialise(_best_rows(near, "query_id", "score", k, "vec_id").select("query_id", "rank", "vec_id", "score"), "near"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], result)
