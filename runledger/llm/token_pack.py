"""Token ids in files of fixed-width bits.

A shard holds the ids of a range of documents, each id in the fewest bits the vocabulary needs. Ids stand in
blocks of BLOCK_IDS, whose bytes are whole; offsets of blocks and first ids of documents follow, so a reader
finds any document, reads its blocks only and unpacks them with numpy.

Shard layout, little-endian: magic "RLPK", bits u32, ids per block u32 | packed blocks | doc_id i64 x docs |
doc_id is null u8 x docs | first id of each document and end u64 x (docs + 1) | offset of each block u64 x
blocks | footer: docs u64, ids u64, offset of the doc_id part u64, magic.

Shards are written by tasks under names of their own; the manifest names those of successful tasks, so a lost
executor's half-written shards are never read. Writing goes through pyarrow's file systems (file, hdfs, s3, gs).

Texts are encoded in parts: their words are found by the kinds of bytes for the whole part, Arrow numbers the distinct
ones, and those that the worker does not remember go to the tokenizers library. Texts with other letters than Latin
ones, or with added tokens, are split by the coder text by text.

The number of shards grows with the texts, so a task writes about SHARD_BYTES of text at every size. Rows that share
a doc_id, or have none, may go to several shards.

Defined cases: null text is an empty document and has the end id only; documents of null doc_id come last;
rows that share a doc_id come in order of their text's hash, then text; an empty table gives no shards and no rows;
other columns are never read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Numbered, coder, is_plain, ragged
from .store import text_rows, text_volume

MAGIC, BLOCK_IDS, END_ID = b"RLPK", 4096, 0
#: Words whose ids a worker remembers, before those that came once are forgotten. Bytes of text encoded at once, and held by a shard.
REMEMBERED, PART_BYTES, SHARD_BYTES = 800_000, 8_000_000, 64_000_000
#: A byte that no UTF-8 text has; it stands behind each text, as a word of its own.
END = 255
#: Kinds of bytes in a plain text.
_SIGN, _LETTER, _DIGIT, _BLANK, _END = range(5)
_KINDS = np.full(256, _SIGN, np.uint8)
_KINDS[[*range(65, 91), *range(97, 123), *range(128, END)]] = _LETTER
_KINDS[48:58] = _DIGIT
_KINDS[[*range(9, 14), 32]] = _BLANK
_KINDS[END] = _END


def width(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary of ids below the number given."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Lowest bit first, no gaps."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    return np.packbits((ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1, bitorder="little").tobytes()


def unpack_bits(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(raw, "<u2", n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flat @ (1 << np.arange(bits, dtype=np.int64))).astype("<u4")


def _open(uri: str):
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri.removeprefix('file:')}")


class ShardWriter:
    def __init__(self, out, bits: int):
        self.out, self.bits, self.left, self.blocks = out, bits, np.empty(0, np.int64), []
        self.doc_ids, self.lens, self.at = [], [], 12
        out.write(MAGIC + np.array([bits, BLOCK_IDS], "<u4").tobytes())

    def add(self, doc_ids, lens, ids: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.lens += lens.tolist()
        ids = np.concatenate([self.left, ids])
        whole = len(ids) // BLOCK_IDS * BLOCK_IDS
        self._put(ids[:whole])
        self.left = ids[whole:]

    def _put(self, ids) -> None:
        if len(ids):
            size = BLOCK_IDS * self.bits // 8
            self.blocks += range(self.at, self.at + -(-len(ids) // BLOCK_IDS) * size, size)
            self.at += self.out.write(pack_bits(ids, self.bits))

    def close(self) -> int:
        self._put(self.left)
        n, ids = len(self.doc_ids), sum(self.lens)
        self.out.write(np.array([0 if i is None else i for i in self.doc_ids], "<i8").tobytes() + np.array([i is None for i in self.doc_ids], np.uint8).tobytes())
        self.out.write(np.concatenate([[0], np.cumsum(self.lens)]).astype("<u8").tobytes() + np.array(self.blocks, "<u8").tobytes())
        self.out.write(np.array([n, ids, self.at], "<u8").tobytes() + MAGIC)
        return ids


class Shard:
    """Random access to one shard."""

    def __init__(self, uri: str):
        system, path = _open(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        foot = self.file.read_at(28, size - 28)
        head = self.file.read_at(12, 0)
        if foot[24:] != MAGIC or head[:4] != MAGIC:
            raise ValueError(f"{uri} is no shard")
        self.bits, self.block_ids = np.frombuffer(head, "<u4", 2, 4).tolist()
        self.docs, self.ids, at = np.frombuffer(foot, "<u8", 3).astype(np.int64).tolist()
        index = self.file.read_at(size - 28 - at, at)
        n = self.docs
        self.doc_ids, self.null = np.frombuffer(index, "<i8", n), np.frombuffer(index, np.uint8, n, 8 * n)
        self.starts = np.frombuffer(index, "<u8", n + 1, 9 * n).astype(np.int64)
        self.blocks = np.frombuffer(index, "<u8", -1, 9 * n + 8 * (n + 1)).astype(np.int64)

    def read(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the shard, read from their blocks only."""
        if a == b:
            return np.empty(0, "<u4")
        first, last = a // self.block_ids, (b - 1) // self.block_ids
        n = min((last + 1) * self.block_ids, self.ids) - first * self.block_ids
        raw = self.file.read_at(-(-n * self.bits // 8), int(self.blocks[first]))
        return unpack_bits(raw, self.bits, n)[a - first * self.block_ids : b - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.starts[i]), int(self.starts[i + 1]))


def starts_of_words(data: np.ndarray) -> np.ndarray:
    """Whether a word starts at each byte, and at the end, of plain texts that END closes: the words of the byte-level pattern.

    Words are runs of one kind; a space before a run belongs to it, another last blank is a word of its own, and so are
    's, 't, 're, 've, 'm, 'll and 'd where a run starts with the quote.
    """
    kind = _KINDS[data]
    end, blank = kind == _END, kind == _BLANK
    first = np.ones(len(data) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=first[1:-1])
    first[:-1] |= end
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~end[1:])
    first[last] = True
    first[last[data[last] == 32] + 1] = False
    quote = np.flatnonzero((data == 39) & first[:-1])
    one = quote[np.isin(data[quote + 1], list(b"stmd"))]
    two = quote[np.isin(data[quote + 1], list(b"rvl"))]
    two = two[np.isin(data[two + 1].astype(int) * 256 + data[two + 2], [int.from_bytes(x) for x in (b"re", b"ve", b"ll")])]
    first[one + 1] = first[two + 1] = False
    first[one + 2] = first[two + 3] = True
    return first


class _Memory:
    """Ids of words seen by this worker."""

    def __init__(self, path: str):
        self.coder = coder(path)
        self.added = [t.encode() for t in self.coder.added]
        self.seen, self.flat, self.lens, self.starts = Numbered({bytes([END]): 0}), np.array([END_ID], np.int32), np.ones(1, np.int64), np.zeros(1, np.int64)
        self.again = np.zeros(1, bool)  # words that a later part had, too

    def forget(self) -> None:
        """Keep the end and words that came again, half of REMEMBERED at most."""
        self.again[0] = True
        kept = np.flatnonzero(self.again)[: max(1, REMEMBERED // 2)]
        words = list(self.seen)
        self.seen = Numbered({words[n]: i for i, n in enumerate(kept.tolist())})
        self.flat, self.lens = ragged(self.flat, self.starts, self.lens, kept), self.lens[kept]
        self.starts, self.again = np.cumsum(self.lens) - self.lens, np.zeros(len(kept), bool)

    def number(self, words: list[bytes]) -> np.ndarray:
        """Numbers of distinct words; new ones are encoded."""
        if len(self.seen) > REMEMBERED:
            self.again[[self.seen[w] for w in words if w in self.seen]] = True
            self.forget()
        known = len(self.seen)
        nums = self.seen.of(words)
        self.again[nums[nums < known]] = True
        if len(self.seen) > known:
            lens, flat = self.coder.encode([w.decode() for w in islice(self.seen, known, None)])
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
            self.lens, self.flat = np.concatenate([self.lens, lens]), np.concatenate([self.flat, flat])
            self.again = np.concatenate([self.again, np.zeros(len(lens), bool)])
        return nums

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids, END_ID after each text."""
        parts, split, at = [], [], 0
        for t in texts:
            if any(a in t for a in self.added) or not (t.isascii() or is_plain(t.decode("utf-8", "replace"))):
                words = [w.encode() for w in self.coder.words(t.decode("utf-8", "replace"))]
                t = b"".join(words)
                split.append((at, at + len(t), np.cumsum([0, *map(len, words)])))
            parts += [t, bytes([END])]
            at += len(t) + 1
        data = np.frombuffer(b"".join(parts), np.uint8)
        first = starts_of_words(data)
        for a, b, cuts in split:
            first[a:b] = False
            first[a + cuts] = True
        starts = np.flatnonzero(first)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        idx = self.number(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        ends = np.flatnonzero(idx == 0)  # number 0 is the end
        return np.diff(np.cumsum(self.lens[idx])[ends], prepend=0), ragged(self.flat, self.starts, self.lens, idx)


_memories: dict[str, _Memory] = {}


def _parts(batches):
    """doc_ids and texts of about PART_BYTES."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size >= PART_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _writer(tokenizer: str, folder: str):
    def run(batches):
        if tokenizer not in _memories:
            _memories[tokenizer] = _Memory(tokenizer)
        memory, shard, name = _memories[tokenizer], None, f"{folder}/{uuid.uuid4().hex}.bits"
        for ids, texts in _parts(batches):
            if shard is None:
                system, path = _open(name)
                shard = ShardWriter(system.open_output_stream(path), width(memory.coder.size))
            shard.add(ids, *memory.encode(texts))
        if shard:
            n = shard.close()
            shard.out.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "part": [_part()], "docs": [len(shard.doc_ids)], "ids": [n]}, schema=pa.schema([("name", pa.string()), ("part", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())]))

    return run


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def write(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> list[dict]:
    """Encode docs into shards below folder, in ascending order of doc_id. Returns the manifest, one entry per shard."""
    if shards is None:
        volume, slots = text_volume(docs, text_col), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shards = max(1, -(-volume // SHARD_BYTES), min(slots, -(-volume // PART_BYTES)))
    rows = text_rows(docs, id_col, text_col, F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("t")]
    rows = rows.repartitionByRange(shards, *order, "row").sortWithinPartitions(*order, "t").select("doc_id", "t")
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    made = sorted(rows.mapInArrow(_writer(tokenizer, folder), "name string, part int, docs long, ids long").collect(), key=lambda r: r["part"])
    manifest, start = [], 0
    for r in made:
        manifest.append({"name": r["name"], "start": start, "docs": r["docs"], "ids": r["ids"]})
        start += r["ids"]
    with system.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def _reader(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        system, path = _open(folder)
        manifest = json.loads(system.open_input_file(f"{path}/manifest.json").read())
        for batch in batches:
            for n in batch.column(0).to_pylist():
                shard, base = Shard(manifest[n]["name"]), manifest[n]["start"]
                for a in range(0, shard.docs, 1024):
                    b = min(a + 1024, shard.docs)
                    starts = shard.starts[a : b + 1]
                    ids = shard.read(int(starts[0]), int(starts[-1]))
                    crc = [zlib.crc32(ids[s - starts[0] : e - starts[0]].tobytes()) for s, e in zip(starts[:-1], starts[1:], strict=True)]
                    own = [None if z else i for i, z in zip(shard.doc_ids[a:b].tolist(), shard.null[a:b].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(base + starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], schema=schema)

    return run


def read_digests(spark: SparkSession, folder: str, shards: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the shards below folder, one task a shard."""
    return spark.range(0, shards, 1, max(1, shards)).mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
