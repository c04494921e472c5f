"""op12_window_ranking against a plain version of its formula, over windows, blocks and pieces of every size."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import duckdb

from runledger.llm import queries, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string, held string, tf int, n int, rank string", "item_id long, text string, terms string, score int"


def plain(docs, items, k):
    bags = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(FOLD)))
    out = []
    for item, words in asked.items():
        scored = []
        for doc, bag in bags:
            m = 100 - 90 + (90 * sum(bag.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * bag[w] // (1000 * bag[w] + 8 * m)) for w in words if w in bag)
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, r + 1, doc, -minus) for r, (minus, _, doc) in enumerate(sorted(scored, key=lambda s: (*s[:2], s[2] or 0))[:k])]
    return sorted(out, key=repr)


def made(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)] + ["Été", "naïve", "ÉTÉ", "日本", "a1B2"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 5, 30, 200])))) for i in range(n)]
    docs += [(3, docs[3][1]), (3, "other w1"), (None, docs[5][1]), (None, docs[5][1]), (n, None), (n + 1, ""), (n + 2, "?!"), (-5, docs[7][1]), (1 << 40, docs[7][1])]
    docs += [(1000 + i, docs[9][1]) for i in range(40)] + [(5000, "w1 w2 Été, " * 20_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 25])))) for i in range(25)]
    items += [(2, "w1 w2"), (None, docs[9][1]), (90, None), (91, ""), (92, "unseenword"), (93, docs[9][1])]
    return docs, items


def run(spark, docs, items, k=10, parts=7):
    d = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in docs], DOCS).repartition(parts)
    i = spark.createDataFrame([(*r, "x", 3) for r in items], ITEMS)
    return sorted(map(tuple, ranked_search.rank(d, i, k).collect()), key=repr)


def test_equals_plain_version(spark):
    docs, items = made(1)
    assert run(spark, docs, items) == plain(docs, items, 10)


def test_blocks_of_items_do_not_matter(spark, monkeypatch):
    docs, items = made(2, 150)
    items, asked, ranked_block = items[-8:], [], ranked_search._ranked_block
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 100)
    monkeypatch.setattr(ranked_search, "_ranked_block", lambda docs, block, *more: asked.append(len(block)) or ranked_block(docs, block, *more))
    assert run(spark, docs, items, k=3, parts=2) == plain(docs, items, 3)
    assert len(asked) > 1


def test_pieces_do_not_matter(monkeypatch):
    text = "Ab c9, été日本 " * 50
    for piece in (1, 5, 1 << 20):
        monkeypatch.setattr(ranked_search, "PIECE", piece)
        assert [w for p in ranked_search.terms(text.encode()) for w in p] == [w.encode() for w in TERM.findall(text.translate(FOLD))]


def test_scorer_over_small_windows(monkeypatch):
    """The scorer itself, with windows far smaller than the table, ties at their edges and a heap that is full early."""
    import numpy as np

    monkeypatch.setattr(ranked_search, "WINDOW", 128)
    rng = np.random.default_rng(3)
    n, words, k = 1000, 6, 5
    held = [np.flatnonzero(rng.random(words) < 0.5) for _ in range(n)]
    tf = [rng.integers(1, 4, len(h)) for h in held]
    m, weights = rng.integers(10, 13, n), np.array([0, 5, 7, 7, 3, 1])
    asked = [[0], [1, 2, 5], [0, 1, 2, 3, 4, 5], []]
    scorer = ranked_search.WindowScorer(asked, weights, k)
    for a in range(0, n, 128):
        part = range(a, min(a + 128, n))
        offsets = np.concatenate([[0], np.cumsum([len(held[i]) for i in part])])
        scorer.window(list(part), m[a : a + 128], offsets, np.concatenate([held[i] for i in part]), np.concatenate([tf[i] for i in part]))
    for words_, best in zip(asked, scorer.best, strict=True):
        scores = [(sum(int(weights[h]) * (1_000_000_000 * int(t) // (1000 * int(t) + 8 * int(m[i]))) for h, t in zip(held[i], tf[i], strict=True) if h in words_), -i) for i in range(n)]
        assert sorted(((s, i) for s, _, i in best), reverse=True) == sorted((s for s in scores if s[0] > 0), reverse=True)[:k]


def test_empty_tables(spark):
    docs, items = made(3, 20)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []


def test_query_equals_duckdb(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = db.sql(queries.ORACLES["op12_window_ranking"])
    df = queries.op12_window_ranking(spark, sf)
    assert df.columns == want.columns and df.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
