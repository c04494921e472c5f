"""BPE encoding and decoding through a table of distinct words.

Texts are split into words (pre-tokens) in blocks of documents. A block sends its documents as lists of word
numbers, and each of its distinct words once, packed by word bucket. Both go through one exchange. A bucket's
task merges the words of all blocks, encodes each distinct word once with the tokenizers library, and sends its
ids back to the blocks that hold it. Blocks then put the ids in place by position. The number of buckets grows
with the texts, so a bucket holds the same share of words at every size. Decoding joins every id to its piece in
the id-to-piece table of the vocabulary and puts the pieces together by position.

Only byte-level tokenizers without normaliser fit: there, a text's ids are its words' ids in order. Others raise
ValueError.

Defined cases: null text counts as empty and has no ids; ill-formed UTF-8 is replaced by U+FFFD first; a null
doc_id and repeated rows are rows like others; an id that the vocabulary lacks is an empty piece; an empty table
gives an empty result; other columns are never read.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .store import small_batches, text_rows, text_volume

#: Bytes of text after which a block of documents is closed; bytes of text for each bucket of words.
BLOCK_BYTES, BUCKET_BYTES = 4_000_000, 32_000_000
#: Partitions of the exchange, at most; buckets beyond it share partitions.
MOST_PARTITIONS = 20_000
#: Rows decoded at a time.
PART_ROWS = 256
#: Words that the library encodes as one line each of one text.
LINES = 32

# Where a text has only these letters, a plain pattern gives the library's words; elsewhere the library splits.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_OTHER = re.compile("[^\x00-\x7fÀ-ſ]")
_PLAIN = re.compile(f" ?[{_LETTERS}]+")
_UNEVEN = re.compile(f"[^\x00-\x7f{_LETTERS}]")
_WORDS = re.compile(rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\t-\r A-Za-z0-9À-ÖØ-öø-ſ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def is_plain(text: str) -> bool:
    """Whether all that is not ASCII are letters of _LETTERS."""
    return not _UNEVEN.search(text)


class Coder:
    """A byte-level tokenizer, its split into words and its vocabulary pieces."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        made = json.loads(self.lib.to_str())
        pre, added = made["pre_tokenizer"] or {}, made["added_tokens"]
        if made["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("not a byte-level tokenizer without normaliser")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that look beyond themselves")
        self.added = [t["content"] for t in added]
        self._added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.size = max(self.lib.get_vocab(with_added_tokens=True).values()) + 1  # a vocabulary may have gaps
        self.line_break = self.lib.encode("\n", add_special_tokens=False).ids[0]

    def words(self, text: str) -> list[str]:
        if self._added and (parts := self._added.split(text))[1:]:
            return [w for p in parts if p for w in ([p] if p in self.added else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _OTHER.search(text):
            return [text[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(text)]
        return _WORDS.findall(text)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids. Words of letters go as lines of a text: a line break is a word of its own beside them."""
        lens, place = np.zeros(len(words), np.int64), np.fromiter((bool(_PLAIN.fullmatch(w)) for w in words), bool, len(words))
        plain, other = np.flatnonzero(place), np.flatnonzero(~place)
        lined = [words[i] for i in plain.tolist()]
        texts = ["\n".join(lined[i : i + LINES]) + "\n" for i in range(0, len(lined), LINES)]
        flat, ends = self._ids(texts)[1], np.empty(0, np.int64)
        if texts:
            ends = np.flatnonzero(flat == self.line_break)
            if len(ends) != len(lined):
                raise ValueError("a line break is no word of its own")
            lens[plain] = np.diff(ends, prepend=-1) - 1
            flat = flat[flat != self.line_break]
        lens[other], rest = self._ids([words[i] for i in other.tolist()])
        starts, n = np.empty(len(words), np.int64), np.concatenate([lens[plain], lens[other]])
        starts[np.concatenate([plain, other])] = np.cumsum(n) - n
        return lens, ragged(np.concatenate([flat, rest]), starts, lens, np.arange(len(words)))

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), np.int32)

    def pieces(self) -> list[bytes]:
        """Bytes of each id; a vocabulary is bounded, so tasks hold it whole."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        rest = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        out = [b""] * self.size
        for token, i in self.lib.get_vocab(with_added_tokens=True).items():
            plain = token not in self.added and all(c in byte_of for c in token)
            out[i] = bytes(byte_of[c] for c in token) if plain else token.encode()
        return out


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One per worker and file."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


class Numbered(dict):
    """Numbers for words in order of first sight."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def planes(x) -> bytes:
    """Whole numbers below 2**32 as four byte planes, which compress well."""
    return np.ascontiguousarray(np.asarray(x, "<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def pack(*parts: bytes) -> bytes:
    return zstandard.compress(np.asarray([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts), 3)


def unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """flat[starts[i]:starts[i]+lens[i]] for each i of idx, joined."""
    n = lens[idx]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[idx] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


# Rows of the exchange: a block's documents (slot: the block) and its words of a bucket (slot: -1 - bucket).
_SENT = "slot long, block long, payload binary"
_SENT_ARROW = pa.schema([("slot", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())])


def _split(path: str, buckets: int):
    def close(block, ids, nums, seen):
        counts = [len(x) for x in nums]
        idx = np.concatenate(nums)
        by_use = np.argsort(-np.bincount(idx, minlength=len(seen)), kind="stable")
        rank = np.empty(len(seen), np.int32)
        rank[by_use] = np.arange(len(seen), dtype=np.int32)
        null = np.array([i is None for i in ids], np.uint8)
        doc_ids = np.array([0 if i is None else i for i in ids], "<i8")
        slots, payloads = [block], [pack(doc_ids.tobytes(), null.tobytes(), planes(counts), planes(rank[idx]))]
        words = list(seen)
        words = [words[i].encode() for i in by_use.tolist()]
        bucket = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(part):
                own = [words[i] for i in part.tolist()]
                slots.append(-1 - int(bucket[part[0]]))
                payloads.append(pack(planes(np.diff(part, prepend=0)), planes([len(w) for w in own]), b"".join(own)))
        return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array([block] * len(slots), pa.int64()), pa.array(payloads, pa.binary())], schema=_SENT_ARROW)

    def run(batches):
        c, block = coder(path), TaskContext.get().partitionId() << 32
        ids, nums, seen, size = [], [], Numbered(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                ids.append(doc_id.as_py())
                nums.append(seen.of(c.words(text.decode("utf-8", "replace"))))
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield close(block, ids, nums, seen)
                    block, ids, nums, seen, size = block + 1, [], [], Numbered(), 0
        if ids:
            yield close(block, ids, nums, seen)

    return run


def _encode_bucket(path: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, parts = Numbered(), []
        for blob in pdf["payload"]:
            steps, lens, raw = unpack(blob)
            ends = np.cumsum(unplanes(lens), dtype=np.int64)
            words = [raw[a:b].decode() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            parts.append((steps, seen.of(words)))
        lens, flat = coder(path).encode(list(seen))  # each distinct word once
        starts = np.cumsum(lens) - lens
        back = [pack(steps, planes(lens[idx]), planes(ragged(flat, starts, lens, idx))) for steps, idx in parts]
        return pd.DataFrame({"slot": pdf["block"], "block": pdf["block"], "payload": back})

    return run


class _Pieces:
    """The id-to-piece table of a vocabulary, which is bounded."""

    def __init__(self, path: str):
        pieces = coder(path).pieces()
        self.lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.starts, self.flat = np.cumsum(self.lens) - self.lens, np.frombuffer(b"".join(pieces), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        """Pieces of the ids in order."""
        known = ids[ids < len(self.lens)]
        return ragged(self.flat, self.starts, self.lens, known).tobytes()


_pieces: dict[str, _Pieces] = {}


def pieces_of(path: str) -> _Pieces:
    """One per worker and file."""
    if path not in _pieces:
        _pieces[path] = _Pieces(path)
    return _pieces[path]


def _assemble(path: str, decoded: bool):
    def run(docs: pd.DataFrame, coded: pd.DataFrame) -> pd.DataFrame:
        order, lens, flat = [], [], []
        for blob in coded["payload"]:
            steps, n, ids = map(unplanes, unpack(blob))
            order.append(np.cumsum(steps, dtype=np.int64))
            lens.append(n.astype(np.int64))
            flat.append(ids)
        order, n, flat = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (order, lens, flat))
        starts, lens = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        starts[order], lens[order] = np.cumsum(n) - n, n
        out_id, out_ids, out_text = [], [], []
        for blob in docs["payload"]:
            doc_ids, null, counts, idx = unpack(blob)
            doc_ids, null, idx, at = np.frombuffer(doc_ids, "<i8").tolist(), np.frombuffer(null, np.uint8).tolist(), unplanes(idx), 0
            out_id += [None if z else i for i, z in zip(doc_ids, null, strict=True)]
            for c in unplanes(counts).tolist():
                ids = ragged(flat, starts, lens, idx[at : at + c]).astype("<u4")
                out_ids.append(ids.tobytes())
                if decoded:
                    out_text.append(pieces_of(path).join(ids).decode("utf-8", "replace"))
                at += c
        return pd.DataFrame({"doc_id": pd.array(out_id, "Int64"), "ids": out_ids} | ({"decoded": out_text} if decoded else {}))

    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, ids (little-endian unsigned 32-bit integers) and, if wanted, decoded (the text decoded from ids).

    docs come in one order whenever they are read again, as stored tables do.
    """
    buckets = max(8, -(-text_volume(docs, text_col) // BUCKET_BYTES))
    parts = min(buckets, MOST_PARTITIONS)
    sent = text_rows(docs, id_col, text_col).mapInArrow(_split(tokenizer, buckets), _SENT).repartition(parts, "slot")
    # Both branches read the one exchange: a condition that is not deterministic is not pushed below it.
    is_word = F.col("slot") < F.floor(F.rand(0))
    coded = sent.where(is_word).groupBy("slot").applyInPandas(_encode_bucket(tokenizer), _SENT).repartition(parts, "slot")
    return sent.where(~is_word).groupBy("slot").cogroup(coded.groupBy("slot")).applyInPandas(_assemble(tokenizer, decoded), "doc_id long, ids binary" + ", decoded string" * decoded)


def decode(ids: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """ids with their columns and text_col, the text of ids_col (little-endian unsigned 32-bit integers; null: none)."""

    def run(batches):
        join = pieces_of(tokenizer).join
        for whole in batches:
            for at in range(0, whole.num_rows, PART_ROWS):
                batch = whole.slice(at, PART_ROWS)
                texts = [join(np.frombuffer(x.as_py() or b"", "<u4")).decode("utf-8", "replace") for x in batch.column(ids_col)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    small_batches(ids.sparkSession)
    if text_col in ids.columns:
        raise ValueError(f"there is a column {text_col} already")
    return ids.mapInArrow(run, StructType([*ids.schema.fields]).add(text_col, StringType()))
