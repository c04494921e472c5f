"""Stages of the corpus pipeline against brute force, and the chain of them."""

import hashlib
import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from runledger.llm import quality, queries
from runledger.llm.store import free_name, materialise, with_row_key

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality_score double, times int, row_key string, kept boolean"


def rows_of(n=40):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(150)]
    base = [" ".join(rng.choices(vocab, k=rng.choice([3, 8, 40]))) for _ in range(n)]
    near = [t.replace(t.split()[5], "changed", 1) for t in base if len(t.split()) == 40]
    texts = [*base, *near, base[0], base[1] + " ", "\t" + base[2], None, "", " ", base[3].upper()]
    rows = [[i, t] for i, t in enumerate(texts)]
    rows[4][0] = None  # a document without id
    rows[5][0] = rows[6][0]  # two texts of one id
    rows += [list(rows[7]), list(rows[7]), [None, rows[8][1]], [None, "alone " + base[9]]]
    return [(i, t, "en", rng.choice(["a", "b", None]), len(t or ""), 0.5, 3, "k", True) for i, t in rows]


@pytest.fixture(scope="module")
def stored(spark):
    return materialise(spark.createDataFrame(rows_of(), SCHEMA).repartition(3), "documents")


def least(rows):
    """The row of smallest doc_id, null last; ties are equal rows or any of them."""
    return min((r[0] is None, r[0] or 0) for r in rows)


def words(t):
    return (t or "").lower().split()


def test_row_keys_tell_rows_apart(spark, stored):
    keyed, key = with_row_key(stored)
    assert key == "row_key_" and keyed.select(key).distinct().count() == stored.count()
    made, key = with_row_key(spark.range(10).selectExpr("id", "id as _metadata"))
    assert made.select(key).distinct().count() == 10
    assert free_name(["A", "a_"], "a") == "a__"


def test_exact_copies(spark, stored):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    got = [tuple(r) for r in pipeline.drop_copies(spark, stored, "").collect()]
    groups = {}
    for r in rows_of():
        groups.setdefault(norm(r[1]), []).append(r)
    assert sorted((norm(r[1]), r[0] is None, r[0] or 0) for r in got) == sorted((t, *least(g)) for t, g in groups.items())
    assert all(r in rows_of() for r in got)


def test_near_copies(spark, stored):
    rows = rows_of()
    sets = []
    for r in rows:
        w = words(r[1])
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
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i) if sets[i] else -i - 1, []).append(r)
    got = [tuple(r) for r in pipeline.drop_near_copies(spark, stored, "").collect()]
    assert len(got) == len(groups)
    assert sorted((r[0] is None, r[0] or 0) for r in got) == sorted(least(g) for g in groups.values())
    assert all(r in rows for r in got)


def test_mix_of_rows_without_id(spark):
    rows = [(None, f"t{i} " * (1 + i % 5), "en", "ab"[i % 2], 1, 0.1, 2, "k", True) for i in range(60)]
    got = [tuple(r) for r in pipeline.mix_sources(spark, materialise(spark.createDataFrame(rows, SCHEMA), "documents"), "").collect()]
    size = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in "ab"}
    want = {"a": sum(size.values()) / 3, "b": sum(size.values()) * 2 / 3}
    for s in "ab":
        assert abs(sum(len(r[1].split()) for r in got if r[3] == s) - want[s]) <= 5
    assert set(got) <= set(rows)


def test_quality_keeps_clean_rows_and_columns(spark, tmp_path):
    rows = [(i, f"plain words come here {i} and there again" if i % 2 else f"pl###ain wo&&&rds $$$ {i} %%%", "en", "s", 1, 0.1, 2, "k", True) for i in range(200)]
    spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = pipeline.keep_quality(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert {r[0] for r in got.collect()} == {i for i in range(200) if i % 2}


def test_chain(spark, tmp_path):
    """Every row of the result is a document of the table, as often as mixed, with the library's ids."""
    rows = rows_of()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    lib = Tokenizer.from_file(queries.tokenizer_path())
    sha = lambda t: hashlib.sha256(np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert got and {(r.doc_id, r.ids_sha256) for r in got} <= {(r[0], sha(r[1])) for r in rows}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")], name
    assert sorted((str(r.doc_id), sha(r.text)) for r in docs.collect()) == sorted((str(r.doc_id), r.ids_sha256) for r in got)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    assert quality.THRESHOLD == 0.3
