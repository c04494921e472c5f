"""Quality classifier of hashed subword vectors.

A text is the average of learned vectors: one per hashed word and one per hashed character n-gram (n bytes,
n of GRAMS). A softmax layer maps the average to the classes. Training is mini-batch stochastic gradient
descent with per-weight step sizes (Adagrad) in numpy. Classes weigh in as they occur in the labelled rows.

Training takes a bounded sample: of each class the TRAIN_ROWS labelled ids of smallest hash, and of rows that repeat an id
the one of smallest packed bag. Their bags of features, at most BUCKETS weights an id, go compressed to one task, and what it learns to the driver. Scoring reads every whole text: vectors and
softmax layer fold into one number per bucket, as the average and the layer are both linear before the softmax.

Defined cases: null text counts as empty; an empty text scores the bias alone; rows whose id is null are never
learned from and are not held out; of several labels of a row the smallest counts, null labels do not count;
without two classes to learn from, every score is the share of class 1 (1.0 if there is no label); an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .store import free_name, small_batches, text_bytes

#: Ids of each class that are learned from, at most.
TRAIN_ROWS = 2500
BUCKETS, DIM, GRAMS = 1 << 15, 16, (3, 5)
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.2, 11
THRESHOLD = 0.3
#: Bytes of a text hashed at once.
PART = 1 << 20

_BYTE = np.random.default_rng(SEED).integers(1, 1 << 32, 256, dtype=np.uint32)
_MULT = np.uint32(2654435761)


def _fold(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
    return (h ^ (h >> np.uint32(13))) % np.uint32(BUCKETS)


def buckets(text: bytes):
    """Buckets of the words and character n-grams of a text, in parts; every n-gram and word comes exactly once."""
    raw, most = np.frombuffer(text, np.uint8), max(GRAMS)
    for at in range(0, len(raw), PART):
        part = _BYTE[raw[at : at + PART + most - 1]]
        own = min(PART, len(raw) - at)
        for n in GRAMS:
            count = min(own, len(part) - n + 1)
            if count > 0:
                h = part[:count].copy()
                for i in range(1, n):
                    h = h * _MULT + part[i : i + count]
                yield _fold(h + np.uint32(n))
    for at in range(0, len(raw), PART):
        # A part begins at a word's first byte and ends at a space, wherever the plain cuts fall.
        start, end = _word_edge(text, at), _word_edge(text, min(at + PART, len(raw)))
        piece = raw[start:end]
        if len(piece):
            blank = (piece == 32) | ((piece >= 9) & (piece <= 13))
            first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
            if len(first):
                place = (np.arange(len(piece)) - first[np.maximum(np.cumsum(np.isin(np.arange(len(piece)), first, assume_unique=True)) - 1, 0)]).astype(np.uint32)
                mixed = (_BYTE[piece] + place * np.uint32(40503)) * _MULT
                mixed ^= mixed >> np.uint32(16)
                mixed[blank] = 0
                yield _fold(np.add.reduceat(mixed, first, dtype=np.uint32))


def _word_edge(text: bytes, at: int) -> int:
    """First place at or after `at` where no word goes on."""
    while 0 < at < len(text) and text[at - 1] not in b" \t\n\x0b\x0c\r":
        at += 1
    return at


def _bags(batches):
    schema = pa.schema([("label", pa.int32()), ("order", pa.int64()), ("bag", pa.binary())])
    for batch in batches:
        rows = []
        for label, order, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            count = np.zeros(BUCKETS, np.int64)
            for part in buckets(text.as_py()):
                count += np.bincount(part, minlength=BUCKETS)
            used = np.flatnonzero(count)
            rows.append((label, order, zstandard.compress(used.astype("<u2").tobytes() + (count[used] / max(1, count.sum())).astype("<f4").tobytes())))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _unpacked(bag) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(bag)
    n = len(raw) // 6
    return np.frombuffer(raw, "<u2", n), np.frombuffer(raw, "<f4", n, 2 * n)


def sgd(bags: list[tuple[int, bytes]], prior: float) -> tuple[np.ndarray, float]:
    """Learn from (label, packed bag); returns each bucket's part in the log odds of class 1, and the bias."""
    rng = np.random.default_rng(SEED)
    vectors, layer, bias = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM, np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    g_vec, g_layer, g_bias = np.full((BUCKETS, 1), 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    y = np.array([b[0] for b in bags])
    share = y.mean()
    cost = np.where(y == 1, prior / share, (1 - prior) / (1 - share)).astype(np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            parts = [_unpacked(bags[j][1]) for j in own]
            seen = np.zeros(BUCKETS, bool)
            for bucket, _ in parts:
                seen[bucket] = True
            used, place = np.flatnonzero(seen), np.cumsum(seen) - 1
            x = np.zeros((len(own), len(used)), np.float32)
            for i, (bucket, weight) in enumerate(parts):
                x[i, place[bucket]] = weight
            hidden = x @ vectors[used]
            z = hidden @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            d = p * cost[own][:, None] / len(own)
            d_vec, d_layer, d_bias = x.T @ (d @ layer.T), hidden.T @ d, d.sum(0)
            g_vec[used] += (d_vec**2).mean(1, keepdims=True)
            g_layer += d_layer**2
            g_bias += d_bias**2
            vectors[used] -= RATE * d_vec / np.sqrt(g_vec[used])
            layer -= RATE * d_layer / np.sqrt(g_layer)
            bias -= RATE * d_bias / np.sqrt(g_bias)
    w = layer[:, 1] - layer[:, 0]
    return (vectors @ w).astype(np.float64), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """labels: id_col, label (0 or 1). Learns from labelled rows that held_out() leaves."""
    known = labels.where(F.col("label").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.min("label").cast("int").alias("label"))
    known = known.withColumn("order", F.xxhash64(F.lit(SEED), id_col))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows at most
    n1, n = counts.get(1, 0), sum(counts.values())
    prior = n1 / n if n else 1.0
    if prior in (0.0, 1.0):
        return np.zeros(BUCKETS), float(np.log((prior + 1e-9) / (1 - prior + 1e-9)))
    small_batches(docs.sparkSession)
    sample = known.where("label = 0").orderBy("order", id_col).limit(rows).unionByName(known.where("label = 1").orderBy("order", id_col).limit(rows))
    texts = docs.select(F.col(id_col), text_bytes(text_col).alias("t")).join(F.broadcast(sample.select(id_col, "label", "order")), id_col)  # 2 * rows narrow rows
    bags = texts.select("label", "order", "t").mapInArrow(_bags, "label int, order long, bag binary")
    # One bag an id, however many rows repeat it; packed: the task that learns unpacks BATCH of them at a time.
    bags = bags.groupBy("label", "order").agg(F.min("bag").alias("bag")).select("label", "bag")
    # One task gets the sample, 2 * rows bags at most, and the driver only what is learned.
    model = bags.repartition(1).mapInArrow(_learned(prior), "part binary, bias double").first()
    if model is None:
        return np.zeros(BUCKETS), float(np.log(prior / (1 - prior)))
    return np.frombuffer(model["part"], np.float64), model["bias"]


def _learned(prior: float):
    """Learn from batches of label and packed bag: one row, or none without two classes."""

    def run(batches):
        found = [row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        found.sort(key=lambda r: (r[0], xxhash.xxh3_128_digest(r[1])))  # one order whatever the partitions
        if len({label for label, _ in found}) == 2:
            part, bias = sgd(found, prior)
            yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["part", "bias"])

    return run


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _scores(table: bytes, bias: float, name: str = "quality_score"):
    part_of = np.frombuffer(zlib.decompress(table), np.float64)

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(0):
                total, n = 0.0, 0
                for part in buckets(text.as_py()):
                    total += float(part_of[part].sum())
                    n += len(part)
                out.append(1.0 / (1.0 + np.exp(-np.clip(bias + total / max(1, n), -500, 500))))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.float64())], names=[*batch.schema.names[1:], name])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """docs with their columns and, at the end, the probability of class 1: quality_score, or a free name that begins so."""
    small_batches(docs.sparkSession)
    out = free_name(docs.columns, "quality_score")
    schema = StructType([*docs.schema.fields]).add(out, DoubleType())
    return docs.select(text_bytes(text_col).alias(free_name(docs.columns, "text_bytes")), "*").mapInArrow(_scores(zlib.compress(model[0].tobytes()), model[1], out), schema)
