"""Texts that share a frequent passage and differ in words of their own, against a comparison of all pairs."""

import random

import pytest

from runledger.llm.shingle_join import jaccard_components

PASSAGE = " ".join(f"p{i}" for i in range(84))  # 80 shingles


def components(rows):
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((d, rows[find(i)][0]) for i, (d, _) in enumerate(rows))


OWN = {
    "two sizes": [19] * 150 + [7] * 2,
    "sizes 5 to 20 per cent apart": [random.Random(5).choice((8, 10, 12, 14, 15, 16, 17, 18, 20, 22)) for _ in range(200)],
    "large and few small": [random.Random(6).choice((17, 18, 19, 20, 21)) for _ in range(200)] + [5, 6, 7],
}


@pytest.mark.parametrize("own", OWN)
def test_passage_and_own_words(spark, own):
    rng = random.Random(7)
    rows = [(i, " ".join([f"x{rng.randrange(10**9)}" for _ in range(k)] + [PASSAGE])) for i, k in enumerate(OWN[own])]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == components(rows)
