"""The training-data operators against brute force, on rows with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from runledger.llm import bpe, licenses, pii, quality, queries, tool_calls
from runledger.llm.chunk_dedup import exact_dedup
from runledger.llm.components import components
from runledger.llm.mixing import mix
from runledger.llm.shingle_join import jaccard_components
from runledger.llm.vafile import top_k

SCHEMA = "doc_id long, text string, source string, n int, rep string, token int, label string, key int, sig int, w int"


def made(n=60):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(200)]
    base = [" ".join(rng.choices(vocab, k=rng.choice([1, 3, 5, 8, 40, 120]))) for _ in range(n)]
    near = []
    for t in base[:25]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        near.append(" ".join(words))
    line = " ".join(rng.choices(vocab, k=24))
    shared = [line + " " + " ".join(rng.choices(vocab, k=k)) for k in (2, 4, 5, 6, 7, 8, 9, 12) for _ in range(4)]
    texts = [*base, *near, *base[:8], *shared, None, "", "  \n", "é " * 30, "A\u000bB  c d", "a b\tC d e", base[0].upper(), "x y z " * 4000]
    return [(None if i == 7 else 3 if i == 9 else i, t, [None, "a", "b"][i % 3]) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3, 4, 5) for r in made()], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard_components(docs, empty):
    rows = made()
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = sorted(((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)), key=repr)
    got = jaccard_components(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == len({find(i) for i, s in enumerate(sets) if s}) + sum(not s for s in sets)
    assert jaccard_components(empty).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(5, 5)], "a long, b long")
    assert dict(map(tuple, components(links).collect())) == {i: 0 if i <= 20 else 21 for i in range(41)}


def test_components_of_stars_joined_by_new_links(spark):
    """As between two waves: stars with loops at their centres, then links either way round, repeated, between leaves."""
    stars = [(i, i % 3) for i in range(30)] + [(100, 90), (101, 90), (90, 90)]
    new = [(4, 5), (5, 4), (4, 5), (29, 101)]
    for links, want in ((stars, lambda i: i % 3 if i < 30 else 90), (stars + new, lambda i: 0 if i < 30 and i % 3 == 0 else 1), ([], None)):
        got = components(spark.createDataFrame(links, "a long, b long")).collect()
        assert len(got) == len({r.rep for r in got}) and {r.rep: r.grp for r in got} == {i: want(i) for pair in links for i in pair}


def test_exact_dedup(docs, empty):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, _ in made()]
    for width in (16, 1):  # one byte: digests collide, and are not trusted
        got = exact_dedup(docs, digest_width=width).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.text_sha256) for r in got) == sorted((i is None, i or 0, hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)
        groups = {}
        for i, t in norm:
            groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(i)
        for r in got:
            own = groups[r.text_sha256]
            assert r.group_size == len(own) and r.keep_id == min((i for i in own if i is not None), default=None)
        assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup(empty).count() == 0


def test_mix(docs, empty):
    got = mix(docs).collect()
    assert len(got) == len(made())
    for target, size in {(r.target, r.source_size) for r in got}:
        taken = sum(r.taken for r in got if r.target == target and r.source_size == size)
        assert abs(taken - target) <= 1 and target <= 3 * size
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert abs(sum({(r.target, r.source_size): r.target for r in got}.values()) - sum(r.size for r in got)) < 1e-6
    assert sorted(map(repr, mix(docs).collect())) == sorted(map(repr, got))
    assert mix(empty).count() == 0


def library():
    lib = Tokenizer.from_file(queries.tokenizer_path())
    lib.no_truncation()
    lib.no_padding()
    return lib


def test_bpe_matches_the_library(docs, empty, monkeypatch):
    lib, path = library(), queries.tokenizer_path()
    ids = [lib.encode(t or "", add_special_tokens=False).ids for _, t, _ in made()]
    want = sorted((np.array(x, "<u4").tobytes(), lib.decode(x, skip_special_tokens=False)) for x in ids)
    assert sorted((bytes(r["ids"]), r["decoded"]) for r in bpe.encode(docs, path, decoded=True).collect()) == want
    coded = bpe.encode(docs, path)
    assert sorted((bytes(r["ids"]), r["decoded"]) for r in bpe.decode(coded, path).collect()) == want
    assert bpe.encode(empty, path).count() == bpe.decode(empty.selectExpr("doc_id", "cast(text as binary) as ids"), path).count() == 0
    odd = docs.sparkSession.createDataFrame([(1, None), (2, bytearray(np.array([60000, 64], "<u4").tobytes()))], "decoded_ long, ids binary")
    assert [r["decoded"] for r in bpe.decode(odd, path).orderBy("decoded_").collect()] == ["", "a"]


def test_words_encode_as_the_library_does():
    lib, coder = library(), bpe.coder(queries.tokenizer_path())
    rng = random.Random(12)
    words = list(dict.fromkeys("".join(rng.choices(" aeéstßñ", k=rng.randrange(1, 12))) for _ in range(3000)))
    words = [w for t in words for w in coder.words(t)] + ["<|endoftext|>", "\n", " ", "日本", "\n\n", "'s", " 42", "!!"]
    lens, flat = coder.encode(words)
    want = [lib.encode(w, add_special_tokens=False).ids for w in words]
    assert lens.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]
    assert [n.tolist() for n in coder.encode([])] == [[], []]


def test_pii_spans(spark):
    text = "é a.b@c.de 10.0.0.256 10.0.0.255; 4111 1111 1111 1111 +49 (30) 1234567 joe at mail dot org"
    rows = spark.createDataFrame([(1, text), (2, None), (None, "")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_personal_data(rows).collect()}
    assert got[2] == got[None] == []
    assert {(s.kind, text[s.start : s.end]) for s in got[1] if s.base} == {("email", "a.b@c.de"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 1234567")}
    # One leftmost match of digits from the address on, which fails; matches are not retried.
    assert [k for k, *_ in pii.plain_spans("10.0.0.255 4111 1111 1111 1111")] == ["ip"]
    assert [text[s.start : s.end] for s in got[1] if not s.base] == ["joe at mail dot org"]


def test_license_phrases(spark, empty):
    texts = ["The MIT License. mit-license, GNU  General Public License; cc by", "mit", None, "", "MITLicense", next(iter(licenses.NOTICES)), "É apache\nlicense " * 3]
    texts += ["mit license " * 3000, "x " * 200_000, "mit", "mit"]
    rows = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, at int, votes int")
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    for i, t in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(p, label) for phrase, label in licenses.PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == (min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert 0 <= r.score <= 1 and {x for _, x in places} <= set(r.labels.split(",")) | {""}
    assert got[5].labels == "mit" and got[5].n_notices == 1
    assert licenses.scan(empty).count() == 0


def test_license_rows_without_id_or_repeated(spark):
    rows = spark.createDataFrame([(None, "mit license"), (None, "mit license"), (3, "cc by"), (3, "cc by")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_base, r.labels) for r in licenses.scan(rows).collect()), key=repr) == [(3, 1, "cc-by")] * 2 + [(None, 1, "mit")] * 2


@pytest.mark.parametrize("k", [3, 4])
def test_license_paragraphs_with_edits(spark, k):
    """Paragraphs with words replaced, dropped and added among other words: at least nine of ten are found, and no other text."""
    rng = random.Random(4)
    rows, want = [], []
    for text, label in licenses.NOTICES.items():
        for n in range(6):
            w = re.findall("[A-Za-z0-9]+", text)
            for _ in range(len(w) // 20 * (n > 0)):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([["other"], [], [w[at], "new"]])
            around = [f"w{rng.randrange(500)}" for _ in range(80)]
            rows.append((len(rows), " ".join([*around[:40], *w, *around[40:]])))
            want.append(label)
    shared = [w for text in licenses.NOTICES for w in re.findall("[A-Za-z]+", text)]
    rows += [(len(rows) + i, " ".join(rng.choices(shared, k=300))) for i in range(30)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()}
    found = sum(label in got[i].labels.split(",") for i, label in enumerate(want))
    assert found >= 0.9 * len(want)
    assert sum(got[i].n_notices for i in range(len(want), len(rows))) == 0


SCHEMA_OF_F = {
    "type": "object",
    "required": ["x"],
    "additionalProperties": False,
    "properties": {
        "x": {"type": "integer", "minimum": 1},
        "y": {"type": ["string", "null"], "maxLength": 3},
        "z": {"type": "array", "items": {"type": "object", "required": ["k"], "properties": {"k": {"enum": ["a", 2]}}}},
    },
}


@pytest.mark.parametrize(
    ("text", "ok"),
    [
        ('{"x":1}', True), ('{"x":0}', False), ('{"x":"1"}', False), ('{"x":1.5}', False), ("{}", False), ('{"x":1,"w":2}', False), ('{"x":1,"y":"abcd"}', False), ('{"x":1,"y":null}', True),
        ('{"x":1,"y":"1\", \"y\":\"2"}', False), ('{"x":1,"z":[{"k":"a"},{"k":2,"l":0}]}', True), ('{"x":1,"z":[{"k":"b"}]}', False), ('{"x":1,"z":[{}]}', False), ('{"x":1,"z":[]}', True), ("[]", False),
        ('{"x":1', False), ('{"x":1,"x":2}', False), (None, False), ('{"x":true}', False), ('{"x":100000000000000000000}', True),
    ],
)
def test_arguments_against_a_schema(spark, text, ok):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("f", text), ("g", text)], "tool string, arguments string")
    assert [r[0] for r in row.orderBy("tool").select(tool_calls.valid_arguments(F.col("tool"), F.col("arguments"), {"f": SCHEMA_OF_F})).collect()] == [ok, False]


def test_canonical_json(spark):
    import json

    values = [{"b": 1, "a": {"z": [1, {"d": None, "c": "x\"y"}], "é": "/"}}, [], {}, "t", {'x"y': {"b": 1, "a": 2}}, {"n": -5, "f": 0.5, "t": True}]
    rows = spark.createDataFrame([(json.dumps(v, indent=1),) for v in values], "t string")
    got = [r[0] for r in rows.select(tool_calls.canonical("t")).collect()]
    assert got == [json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in values]


def test_tool_calls(spark):
    schema = "conv_id long, turn long, place int, call_id string, tool string, arguments string, needs array<string>, n_rows int"
    rows = [(1, 0, 0, "a", "f", ' {"x" : 1}', None, 9), (1, 2, 0, "b", "f", '{"x":"no"}', ["a", "z", "a"], 9), (1, 4, 0, "a", "f", '{"x":2, "w":3}', ["a"], 9), (1, 6, 0, "c", "g", None, ["c"], 9), (None, 0, 0, "d", "f", "{}", None, 9), (1, None, 0, "e", "f", "{}", ["a"], 9)]
    calls = spark.createDataFrame([*rows, rows[0], rows[1], rows[4], rows[4]], schema)
    results = spark.createDataFrame([(1, 1, "a", 'ok "1"'), (1, 9, "a", "late"), (1, 0, "c", "early"), (1, 1, "a", 'ok "1"'), (2, 5, "a", None), (1, 5, None, "x"), (1, 3, "no", "y")], "conv_id long, turn long, call_id string, content string")
    got = tool_calls.link(calls, results, {"f": SCHEMA_OF_F}).collect()
    one = {(r.call_id, r.turn): r for r in got if r.kind == "call"}
    assert {k: (r.status, r.args_valid, r.n_needs_kept, r.n_needs_cut, r.n_rows) for k, r in one.items()} == {
        ("a", 0): ("linked", True, 0, 0, 2), ("b", 2): ("pending", False, 1, 1, 2), ("a", 4): ("duplicate", False, 1, 0, 1), ("c", 6): ("pending", False, 0, 1, 1), ("d", 0): ("unlinked", False, 0, 0, 3), ("e", None): ("unlinked", False, 0, 0, 1),
    }
    assert one["a", 0].message == '{"arguments":{"x":1},"id":"a","name":"f","result":"ok \\"1\\""}'
    rest = {(r.conv_id, r.call_id, r.turn): (r.status, r.n_rows, r.message) for r in got if r.kind == "result"}
    assert rest == {
        (1, "a", 9): ("repeated", 1, '{"id":"a","result":"late"}'), (1, "c", 0): ("orphan", 1, '{"id":"c","result":"early"}'), (2, "a", 5): ("orphan", 1, '{"id":"a","result":null}'),
        (1, None, 5): ("unlinked", 1, '{"id":null,"result":"x"}'), (1, "no", 3): ("orphan", 1, '{"id":"no","result":"y"}'),
    }
    assert one["a", 0].result_turn == 1
    assert tool_calls.link(calls.limit(0), results.limit(0), {}).count() == 0


def test_quality(spark, empty):
    rows = [(i, f"plain words come here {i} and there again" if i % 2 else f"pl###ain wo&&&rds $$$ {i} %%%") for i in range(200)] + [(None, None), (500, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, None), (None, 1)], "doc_id long, label int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.quality_score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 200 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all((r.quality_score >= 0.3) == r.doc_id % 2 for r in held)
    none = quality.score(docs, quality.train(docs, labels.where("label > 5")))
    assert none.count() == len(rows) and quality.score(empty.select("doc_id", "text"), (np.zeros(quality.BUCKETS), 0.0)).count() == 0


def test_words_across_parts(monkeypatch):
    text = ("alpha beta  gamma\n" * 20).encode()
    whole = np.bincount(np.concatenate(list(quality.buckets(text))), minlength=quality.BUCKETS)
    monkeypatch.setattr(quality, "PART", 37)
    assert (np.bincount(np.concatenate(list(quality.buckets(text))), minlength=quality.BUCKETS) == whole).all()


def brute_top_k(rows, queries, k):
    """In Python's integers."""
    from math import floor, isfinite

    whole = lambda x: int(x) * 256 if abs(x) >= 2**53 else floor(256 * x)
    sound = [(i, [whole(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and isfinite(x) for x in v)]
    asked = {}
    for i, v in sorted((i, v) for i, v in queries if i is not None and v and all(x is not None and isfinite(x) for x in v)):
        asked.setdefault(i, [whole(x) for x in v])
    out = []
    for q, a in asked.items():
        scores = [(min(max(sum(x * y for x, y in zip(a, c)), -(2**63)), 2**63 - 1), i) for i, c in sound if i != q and len(c) == len(a)]
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(sorted(scores, key=lambda r: (-r[0], r[1]))[:k])]
    return sorted(out)


def vectors(case):
    rng = np.random.default_rng(1)
    if case == "plain":
        return [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)] + [(350, None), (400, [float("nan")] * 6), (450, [None] * 6), (None, [1.0] * 6), (500, []), (550, [float("inf")] + [0.0] * 5)]
    if case == "large components":
        return [(i, (rng.normal(size=5) * 1e6).tolist()) for i in range(120)] + [(150, [1e9] * 5), (151, [1e9] * 5), (200, [1e307, 0.0, 0.0, 0.0, 1.0]), (201, [-1e307, 1.0, 0.0, 0.0, 0.0])]
    if case == "repeated rows and lengths":
        return [(i // 2, [float(i // 2 % 7), 1.0] + [2.0] * (i % 3)) for i in range(200)]
    if case == "one":
        return [(0, [1.0])]
    return [(i, [0.25, -0.5]) for i in range(130)]  # ties


@pytest.mark.parametrize("case", ["plain", "large components", "repeated rows and lengths", "one", "ties"])
def test_top_k(spark, case, monkeypatch):
    rows = vectors(case)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, rank int, score string, id int").repartition(3)
    asked = [r for r in rows if r[0] is not None and r[0] % 50 == 0]
    assert sorted(map(tuple, top_k(df, df.where("vec_id % 50 = 0"), 5).collect())) == brute_top_k(rows, asked, 5)


def test_top_k_in_batches_and_blocks(spark, monkeypatch):
    from runledger.llm import vafile

    monkeypatch.setattr(vafile, "BATCH_BYTES", 400)  # on the driver only: several batches
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert sorted(map(tuple, top_k(df, df.where("vec_id % 20 = 0"), 3).collect())) == brute_top_k(rows, [r for r in rows if r[0] % 20 == 0], 3)
    assert top_k(df.limit(0), df.limit(0)).count() == top_k(df, df.limit(0)).count() == top_k(df.limit(0), df).count() == 0


def test_few_exact_vectors_are_read(tmp_path):
    """The cells decide: of 4,000 vectors only a few dozen are read per query."""
    from runledger.llm import vafile

    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 32)) / 8
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "v"])
    block = next(vafile._blocks(next(vafile._build(str(tmp_path))([batch]))))
    read = []
    exact = block.exact
    block.exact = lambda places: read.append(len(places)) or exact(places)
    best = vafile._Best(5)
    vafile._read_calm(block, np.array([7]), x[7:8], {}, best)
    whole = np.floor(256 * x)
    want = sorted(((int(whole[7] @ whole[i]), i) for i in range(4000) if i != 7), key=lambda r: (-r[0], r[1]))[:5]
    assert best.found[7] == want and sum(read) < 200
