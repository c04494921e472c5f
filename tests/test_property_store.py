"""The property store: interleaved writers, moves in order, restarts; and the stream that tells stale sources."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from runledger import schemas
from runledger.operators import properties
from runledger.schemas import DuplicateProperty, InvalidStatusTransition, PropertyNotFound, PropertyStoreError
from runledger.streaming import state
from runledger.streaming.property_store import PropertyStore


def rows(spark, *ids, unit="u", kind="semantic"):
    return spark.createDataFrame([(i, p, unit, kind, f"result > {i}", [], None, "candidate", None, None, None, None) for i, p in enumerate(ids)], schemas.PROPERTY)


def test_two_writers_of_one_property(spark, tmp_path):
    one, two = PropertyStore(spark, str(tmp_path)), PropertyStore(spark, str(tmp_path))
    # Both write before either is judged: no test of the store could have told them apart.
    first, second = one.submit(rows(spark, "p", "q"), "add", ["ord"]), two.submit(rows(spark, "p", "r", unit="v"), "add", ["ord"])
    one.follow(files_per_batch=1).awaitTermination()
    said = {(r.call == first, r.property_id): r.outcome for r in one.outcomes.collect()}
    assert said == {(True, "p"): "added", (True, "q"): "added", (False, "p"): "duplicate", (False, "r"): "added"} and second != first
    assert {r.property_id: r.unit_id for r in two.properties.collect()} == {"p": "u", "q": "u", "r": "v"}
    with pytest.raises(DuplicateProperty, match="p"):
        two.add(rows(spark, "p"), ["ord"])
    assert two.add_absent(rows(spark, "p", "s", unit="w"), ["ord"]) == 1
    assert [r.property_id for r in one.list_for_unit("u").collect()] == ["p", "q"]
    assert one.list_for_unit("u", ()).count() == 0 and one.get("none") is None and one.get("s").unit_id == "w"


def test_moves_are_judged_in_turn(spark, tmp_path):
    store = PropertyStore(spark, str(tmp_path))
    store.add(rows(spark, "p"), ["ord"])
    moves = spark.createDataFrame([(1, "p", "accepted"), (2, "p", "graded"), (3, "p", "accepted"), (4, "p", "rejected"), (5, "none", "graded")], "o int, property_id string, status string")
    store.submit(moves, "move", ["o"])
    store.follow().awaitTermination()
    assert [r.outcome for r in store.outcomes.where("op = 'move'").orderBy("at").collect()] == ["invalid", "moved", "moved", "invalid", "unknown_id"]
    assert store.get("p").status == "accepted"
    with pytest.raises(InvalidStatusTransition):
        store.update_status("p", "graded")
    with pytest.raises(PropertyNotFound):
        store.update_status("x", "graded")
    with pytest.raises(PropertyStoreError, match="kind"):
        store.add(rows(spark, "z", kind="odd"), ["ord"])


def test_repeated_moves_leave_one_row(spark):
    store = spark.createDataFrame([("p", "candidate"), ("q", "candidate"), ("r", "accepted")], "property_id string, status string")
    wanted = spark.createDataFrame([("p", "graded", 1), ("p", "rejected", 2), ("q", "accepted", 1), ("q", "graded", 2), ("r", "graded", 1)], "property_id string, new_status string, o int")
    got = properties.moved(store, wanted, properties.transitions(spark), ("o",)).collect()
    assert sorted(map(tuple, got)) == [("p", "rejected"), ("q", "graded"), ("r", "accepted")]


def test_edits_without_a_verdict_in_time_come_out_stale_once(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=m)
    steps = [
        ([("a", "1", at(0)), ("b", "1", at(5))], [("a", "1", at(10), "verified"), ("b", "other", at(11), "verified")]),
        ([("c", "1", at(200))], [("b", "1", at(66), "verified"), ("x", "1", at(200), "verified")]),
        ([("d", "1", at(400)), ("late", "1", at(1))], [("x", "1", at(400), "verified"), ("c", "1", at(230), "violated")]),
        ([("e", "1", at(600))], [("x", "1", at(600), "verified")]),
    ]
    edit, verdict = "rel string, digest string, edited_at timestamp", "rel string, digest string, judged_at timestamp, verdict string"
    for i, (edits, verdicts) in enumerate(steps):
        spark.createDataFrame(edits, edit).coalesce(1).write.mode("append").parquet(f"{tmp_path}/edits")
        spark.createDataFrame(verdicts, verdict).coalesce(1).write.mode("append").parquet(f"{tmp_path}/verdicts")
        joined = state.unanswered(spark.readStream.schema(edit).parquet(f"{tmp_path}/edits"), spark.readStream.schema(verdict).parquet(f"{tmp_path}/verdicts"))
        joined.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        assert Path(tmp_path, "checkpoint", "commits").exists() and i < 4
    got = {(r.rel, r.status, r.verdict) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", "judged", "verified"), ("b", "stale", None), ("c", "judged", "violated")} | {g for g in got if g[0] in "d"}
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("rel", F.col("edited_at")).count().where("count > 1").count() == 0
