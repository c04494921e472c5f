"""The jobs: growing input, interrupted and repeated runs, defined cases, and their registered queries against DuckDB."""

import datetime as dt
import hashlib
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from test_queries import SF, rows

import __spark_entry__ as entry
from jobs import queries, source_worklist, verdict_ledger
from jobs.common import config

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
WORDS = {"purchase": "verified", "error": "error", "signup": "violated", "click": "unknown", "view": "needs_contract"}


def made(seed, n, days=6, first=0):
    rng = random.Random(seed)
    out = []
    for i in range(first, first + n):
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(days), seconds=rng.randrange(50))
        out.append((i, ts if rng.random() > 0.05 else None, rng.choice([1, 2, 3, 4, None]), rng.choice([*WORDS, None, "other"]), 1.0, rng.choice(['{"k": 4}', '{"k": 16}', "{}", None, "no json"])))
    return [*out, *out[:3]]


def put(spark, data, folder, name):
    spark.createDataFrame(data, EVENTS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")
    for part in Path(f"{folder}/{name}").glob("*.parquet"):
        part.rename(f"{folder}/{name}-{part.name}")


def expected(data):
    groups = {}
    for event_id, ts, unit, kind, _, props in data:
        k = re.search(r'"k": (\d+)', props or "")
        row = ((ts is not None, ts or 0, event_id), WORDS.get(kind), int(k[1]) if k else None)
        groups.setdefault((ts and ts.date(), unit), []).append(row)
    out = []
    for (day, unit), found in groups.items():
        fails = sum(v not in ("verified", "needs_contract") for _, v, _ in found)
        _, verdict, k = max(found, key=lambda r: (r[0], r[1] or "", r[2] or -1))
        out.append((day, unit, len(found), fails, sum(v == "needs_contract" for _, v, _ in found), verdict, k, "block" if fails else "pass", 2 if fails else 0))
    return sorted(out, key=repr)


@pytest.fixture
def place(tmp_path):
    (tmp_path / "events").mkdir()
    return str(tmp_path / "events"), str(tmp_path / "out"), str(tmp_path / "checkpoint")


def standing(spark, out):
    return sorted(map(tuple, verdict_ledger.ledger(spark, out).drop("folded").collect()), key=repr)


def test_ledger_takes_only_new_files_and_touches_only_their_days(spark, place):
    events, out, _ = place
    a, b, late = made(1, 200), made(2, 150, first=200), made(3, 20, days=1, first=400)
    put(spark, a, events, "a")
    put(spark, b, events, "b")
    assert verdict_ledger.run(spark, *place)["read"] == len(a + b)
    assert standing(spark, out) == expected(a + b)
    files = {p.name for p in Path(out, "ledger", "day=2024-01-04").glob("*.parquet")}
    assert verdict_ledger.run(spark, *place) == {"read": 0, "written": 0}
    put(spark, late, events, "c")
    assert verdict_ledger.run(spark, *place)["read"] == len(late)
    assert standing(spark, out) == expected(a + b + late)
    assert files == {p.name for p in Path(out, "ledger", "day=2024-01-04").glob("*.parquet")}


def test_ledger_is_made_good_after_a_run_cut_off_between_its_steps(spark, place, monkeypatch):
    a, b = made(4, 80), made(5, 80, first=100)
    put(spark, a, place[0], "a")
    with monkeypatch.context() as m:
        m.setattr(verdict_ledger, "publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            verdict_ledger.run(spark, *place)
    assert standing(spark, place[1]) == []
    put(spark, b, place[0], "b")
    verdict_ledger.run(spark, *place)
    assert standing(spark, place[1]) == expected(a + b)


def test_a_batch_that_is_tried_again_counts_once(spark, place):
    a, b = made(6, 80), made(7, 60, first=100)
    put(spark, a, place[0], "a")
    verdict_ledger.run(spark, *place)
    put(spark, b, place[0], "b")
    verdict_ledger.run(spark, *place)
    # The batch's output stands but its commit is lost, as if the run had died in between.
    for commit in Path(place[2], "commits").glob("*1*"):
        commit.rename(commit.parent.parent / f"lost{commit.name}")
    verdict_ledger.run(spark, *place)
    assert standing(spark, place[1]) == expected(a + b)


def test_files_may_fall_into_batches_in_any_way(spark, place):
    parts = [made(10 + i, 30, first=100 * i) for i in range(5)]
    for i, part in enumerate(parts):
        put(spark, part, place[0], f"p{i}")
    verdict_ledger.run(spark, *place, config("verdict_ledger") | {"max_files_per_batch": 1})
    assert standing(spark, place[1]) == expected([r for p in parts for r in p])


def test_empty_folder_and_settings_come_back(spark, place):
    before = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    assert verdict_ledger.run(spark, *place) == {"read": 0, "written": 0}
    assert standing(spark, place[1]) == [] and spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled") == before
    put(spark, [], place[0], "none")
    assert verdict_ledger.run(spark, *place) == {"read": 0, "written": 0}


DOCS = [
    (1, "a\nb", "x"), (2, "a\nb", "y"), (3, "a\nb", None), (4, None, "x"), (5, "", "x"), (6, "same", "x"), (7, "same", "x"), (8, "other\r\n", "z"), (8, "other\r\n", "z"), (8, "different", "z"),
    (None, "other\r\n", "z"), (None, "alone ", None), (9, "old text", "x"), (10, "mine " * 50_000, "a/b=c"), (11, "both", "x"), (12, "both", "x"), (13, "both", "x"), (14, "open", "x"), (15, "open", "x"),
]
STAMPS = [(2, 1, 0), (6, None, 1), (11, 1, 0), (11, 0, 0), (12, 1, 1), (14, None, 1), (99, 0, 0), (None, 0, 1), (15, None, None)]


def plain(docs, stamps, baseline):
    digest = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    sources = Counter((i, g, t) for i, t, g in docs)
    own = {}
    for i, quality, toxic in stamps:
        found = own.setdefault(i, [None, False])
        word = {1: "verified", 0: "violated"}.get(quality)
        found[0] = "violated" if "violated" in (found[0], word) else found[0] or word
        found[1] = found[1] or toxic == 1
    own.pop(None, None)
    place = lambda s: (s[0] is None, s[0] or 0, s[1] is None, s[1] or "")
    out = []
    for (i, g, t), n in sources.items():
        same = [s for s in sources if s[2] == t and t is not None]
        verdict, begun = own.get(i, (None, False))
        theirs = {own.get(s[0], (None,))[0] for s in same} - {None}
        shared = "violated" if "violated" in theirs else next(iter(theirs), None)
        lead = min((s for s in same if own.get(s[0], (None,))[0] is None), key=place, default=None)
        if t is None:
            status = "unreadable"
        elif verdict or shared:
            status = verdict or "reused"
        elif t in baseline:
            status = "baseline"
        else:
            status = ("retry" if begun else "verify") if lead == (i, g, t) else "waits"
        work = status in ("retry", "verify")
        lines = None if t is None else len(re.findall("\r\n|[\n\r ]", t)) + (t != "" and not re.search("[\n\r ]$", t[-1:]))
        out.append((i, digest(t), n, lines, t if t is None else len(t), verdict or shared, sum(sources[s] for s in same), lead[0] if work or status == "waits" else None, work, g, status))
    return sorted(out, key=repr)


def test_worklist_against_a_plain_version(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(STAMPS, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/s")
    spark.createDataFrame([(1, "old text"), (2, None), (3, "old text")], "item_id long, text string").write.parquet(f"{tmp_path}/b")
    for _ in range(2):
        told = source_worklist.run(spark, *(f"{tmp_path}/{n}" for n in "dsb"), f"{tmp_path}/out")
        got = sorted(map(tuple, source_worklist.listing(spark, f"{tmp_path}/out").drop("slug").collect()), key=repr)
        assert got == plain(DOCS, STAMPS, {"old text"})
        assert told["read"] == len(DOCS) and told["written"] == len(got)
    counts = spark.read.schema(source_worklist.COUNTS).parquet(f"{tmp_path}/out/counts").collect()
    assert sum(r.n_sources for r in counts) == len(DOCS) and {(r.group, r.status): r.n_contents for r in counts}["x", "verify"] == 1


def test_worklist_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/s")
    spark.createDataFrame([], "text string").write.parquet(f"{tmp_path}/b")
    assert source_worklist.run(spark, *(f"{tmp_path}/{n}" for n in "dsb"), f"{tmp_path}/out") == {"read": 0, "written": 0, "counts": 0}
    assert source_worklist.listing(spark, f"{tmp_path}/out").collect() == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_jobs_match_duckdb(spark, name):
    df = entry.queries()[name](spark, SF)
    db = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(want.columns, want.fetchall())


def test_command_line(tmp_path):
    own = tmp_path / "own.json"
    own.write_text('{"files_per_part": 2}')
    call = [sys.executable, "-m", "jobs.source_worklist", *(x for n, t in (("sources", "documents"), ("stamps", "labels"), ("baseline", "benchmark")) for x in (f"--{n}", f"{SF}/{t}.parquet")), "--out", f"{tmp_path}/out", "--config", str(own)]
    done = subprocess.run(call, capture_output=True, text=True, cwd=Path(entry.__file__).parent, timeout=300)
    assert done.returncode == 0 and "wrote 200 rows" in done.stderr and list(tmp_path.glob("out/sources/group=*/status=*/*.parquet"))
    with pytest.raises(ValueError):
        own.write_text('{"no_such": 2}')
        config("source_worklist", str(own))


def test_ledger_from_the_command_line_twice(tmp_path):
    call = [sys.executable, "-m", "jobs.verdict_ledger", "--events", f"{SF}/events*.parquet", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/checkpoint"]
    for read in (1000, 0):
        done = subprocess.run(call, capture_output=True, text=True, cwd=Path(entry.__file__).parent, timeout=300)
        assert done.returncode == 0 and f"done: {{'read': {read}," in done.stderr
    assert list(tmp_path.glob("out/ledger/day=*/*.parquet"))
