"""op7 and op9 against plain versions: a mix cut document by document, a score summed gram by gram, a bounded sample."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from runledger.llm import mixing, quality


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1.0, 2.0, 3.0)[i % 3] for i, s in enumerate(names)}
    rest, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        share = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share > 3 * sizes[s]}
        if not over:
            return out | {s: weight[s] * share for s in open_}
        out |= {s: 3.0 * sizes[s] for s in over}
        rest, open_ = rest - sum(3 * sizes[s] for s in over), open_ - over
    return out


def test_mix_equals_a_walk_over_sorted_documents(spark):
    rng = random.Random(4)
    rows = [(rng.choice([i, i, None, 5]), "w " * rng.choice([0, 1, 3, 50, 400]), rng.choices(["a", "b", "c", "d", None, ""], (50, 5, 1, 10, 2, 1))[0], i, "x", 1.0) for i in range(1500)]
    rows += [(7, "same words " * 9, "a", i, "x", 1.0) for i in range(400)] + [(1, None, "nothing", 0, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, slice string, target double").repartition(5)
    keyed = docs.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").alias("key"), "text", "source").collect()
    sources = {}
    for r in keyed:
        sources.setdefault(r.source, []).append((r.key, r.doc_id is None, r.doc_id or 0, len((r.text or "").split())))
    sizes = {s: sum(d[3] for d in found) for s, found in sources.items()}
    targets, want = plain_targets(sizes), Counter()
    for s, found in sources.items():
        budget = math.floor(targets[s] + 0.5)
        epochs, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        for _, no_id, doc_id, size in sorted(found):
            part = min(rest, size)
            rest -= part
            want[(None if no_id else doc_id, size, sizes[s], round(targets[s], 6), epochs * size + part)] += 1
    got = Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(docs).collect())
    assert got == want


def plain_score(text, part_of, bias):
    raw, u32 = text.encode(), lambda x: x & 0xFFFFFFFF
    byte, mult = quality._BYTE.tolist(), int(quality._MULT)

    def fold(h):
        h = u32((h ^ (h >> 15)) * 2246822519)
        return (h ^ (h >> 13)) % quality.BUCKETS

    found = []
    for n in quality.GRAMS:
        for i in range(len(raw) - n + 1):
            h = byte[raw[i]]
            for b in raw[i + 1 : i + n]:
                h = u32(u32(h * mult) + byte[b])
            found.append(fold(u32(h + n)))
    for word in raw.split():
        h = 0
        for place, b in enumerate(word):
            mixed = u32(u32(byte[b] + u32(place * 40503)) * mult)
            h = u32(h + (mixed ^ (mixed >> 16)))
        found.append(fold(h))
    return 1 / (1 + math.exp(-(bias + math.fsum(part_of[f] for f in found) / max(1, len(found)))))


def test_score_equals_a_sum_gram_by_gram(spark):
    model = (np.random.default_rng(5).normal(0, 3, quality.BUCKETS), 0.3)
    texts = ["", None, "a", "one two  three\tfour", "é日本 naïve", " lead and trail ", "word " * 3000, "x" * 5000]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, quality_score double")
    got = {r[0]: r[-1] for r in quality.score(docs, model).collect()}
    assert all(abs(got[i] - plain_score(t or "", *model)) < 1e-9 for i, t in enumerate(texts))


def test_sample_is_bounded_by_ids_whatever_repeats(spark, monkeypatch):
    rows = [(3, f"copy {i}") for i in range(300)] + [(i, f"text {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (3, 1)], "doc_id long, label int")
    seen = []
    monkeypatch.setattr(quality, "sgd", lambda bags, prior: seen.append(list(bags)) or (np.zeros(quality.BUCKETS), 0.0))
    for most in (2, 100):
        quality.train(docs, labels, rows=most)
        quality.train(docs.repartition(7), labels, rows=most)
        assert Counter(b[0] for b in seen[-1]).most_common(1)[0][1] <= most and len(seen[-1]) <= 40
        assert [bytes(b[1]) for b in seen[-1]] == [bytes(b[1]) for b in seen[-2]]
