"""Files of token ids: the library's ids, random access, other widths, and rows without text, id or company."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from runledger.llm import queries, token_pack


def expected(rows):
    lib = Tokenizer.from_file(queries.tokenizer_path())
    lib.no_truncation()
    lib.no_padding()
    return [(i, np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for i, t in rows]


def made():
    rng = random.Random(5)
    words = [f" {w}" for w in "the quick brown fox jumps naïve straße 42 ,, <|endoftext|> 日本 \n".split(" ")] + ["\n", "  ", "\t"]
    rows = [(i, "".join(rng.choices(words, k=rng.choice([0, 1, 5, 50, 3000])))) for i in range(120)]
    return rows + [(None, "no id"), (None, "none either"), (7, "seven again"), (500, None), (501, ""), (502, "é" * 30_000), (9, rows[9][1])]


def test_files_hold_the_library_ids(spark, tmp_path):
    rows = made()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, t string, row int").repartition(4)
    folder = f"file:{tmp_path}/ids"
    manifest = token_pack.write(df, queries.tokenizer_path(), folder, shards=5)
    assert [m["start"] for m in manifest] == np.cumsum([0, *[m["ids"] for m in manifest]])[:-1].tolist() and sum(m["docs"] for m in manifest) == len(rows)
    shards = [token_pack.Shard(m["name"]) for m in manifest]
    stored = [(None if s.null[i] else int(s.doc_ids[i]), s.document(i)) for s in shards for i in range(s.docs)]
    assert [i for i, _ in stored] == sorted((i for i, _ in rows if i is not None)) + [None, None]
    key = lambda r: (str(r[0]), r[1].tobytes())
    assert sorted(map(key, stored)) == sorted(map(key, expected(rows)))
    got = token_pack.read_digests(spark, folder, len(manifest)).orderBy("start").collect()
    at = 0
    for r, (i, ids) in zip(got, stored, strict=True):
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        at += len(ids)


def test_empty_table_has_no_files(spark, tmp_path):
    folder = f"file:{tmp_path}/ids"
    assert token_pack.write(spark.createDataFrame([], "doc_id long, text string"), queries.tokenizer_path(), folder) == []
    assert token_pack.read_digests(spark, folder, 0).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 15, 16, 17, 20, 32])
def test_widths(tmp_path, bits):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 1 << bits, n) for n in (0, 1, 5000, 4096, 3, 20_000)]
    path = f"{tmp_path}/x.bits"
    with open(path, "wb") as out:
        writer = token_pack.ShardWriter(out, bits)
        writer.add([4, None], np.array([len(d) for d in docs[:2]]), np.concatenate(docs[:2]))
        writer.add([6, 7, 8, 9], np.array([len(d) for d in docs[2:]]), np.concatenate(docs[2:]))
        writer.close()
    shard = token_pack.Shard(path)
    for i in (5, 2, 0, 4, 1, 3):
        assert shard.document(i).tolist() == docs[i].tolist()
    assert shard.read(4990, 5010).tolist() == np.concatenate(docs)[4990:5010].tolist()
    assert token_pack.width(1 << bits) == bits
