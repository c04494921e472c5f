"""Sets of shingles: their values, how often they are made, and texts found again by their digests."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard

from runledger.llm import shingle_join
from runledger.llm.shingle_join import jaccard_components, shingle_set

LONG = " ".join(f"w{i % 37}" for i in range(400))


@pytest.mark.parametrize("text", ["", " \t\n", "one", "a b c d", "a b c d e", "A b C d e f a B c D E f", LONG, "x " * 50, "\x00 a \xa0 b\x0bc d e"])
def test_set_against_plain_integers(text):
    words = text.encode().lower().split()
    h = [xxhash.xxh3_64_intdigest(w) for w in words]
    want = set()
    for i in range(max(1, len(h) - 4) if h else 0):
        five = h[i : i + 5]
        x = (len(five) + sum(a * int(b) for a, b in zip(five, shingle_join._ODD))) % 2**64
        x ^= x >> 32
        want.add(x * 0x9E3779B97F4A7C15 % 2**64 >> 1)
    got = shingle_set(text.encode())
    assert got.dtype == np.int64 and got.tolist() == sorted(want)


def test_texts_are_packed_without_a_set(monkeypatch):
    def never(text):
        raise AssertionError("a text's set was made to pack it")

    monkeypatch.setattr(shingle_join, "shingle_set", never)
    texts = [b"", b"One two", LONG.encode()]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, None], pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "t"])
    (got,) = shingle_join._packed([batch])
    assert got.column(0).to_pylist() == [xxhash.xxh3_128_digest(t) for t in texts]
    assert [zstandard.decompress(b) for b in got.column(1).to_pylist()] == texts


def test_equal_sets_of_unlike_texts_and_shared_ids(spark):
    """Rows of one set differ in case and white space; ids are shared by unlike texts, or null: each class still finds a text of its own set."""
    base = [f"v{i}" for i in range(60)]
    near = " ".join([*base[:-3], "n1", "n2", "n3"])
    other = [f"u{i}" for i in range(60)]
    far = " ".join([*other[:-3], "n1", "n2", "n3"])
    rows = [(5, " ".join(base)), (5, far), (7, "\t".join(base).upper()), (7, near), (None, near.upper()), (3, " ".join(other)), (None, "  ".join(other)), (9, " ".join(base[:30])), (8, None), (None, "")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(5, 56, 5), (5, 56, 3), (7, 56, 5), (7, 56, 5), (None, 56, 5), (3, 56, 3), (None, 56, 3), (9, 26, 9), (8, 0, 8), (None, 0, None)]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
