"""The live ladder: escalation, ends, budgets by time spent and by the clock of the events."""

import datetime as dt

from runledger.sources import settings
from runledger.streaming import live_ladder
from runledger.streaming.gate_state import SESSION


def at(second):
    return dt.datetime(2024, 1, 1, 12) + dt.timedelta(seconds=second)


def ask(unit, second, ladder, budget=None):
    return (unit, at(second), "ask", ladder, budget, None, None, None)


def run(unit, second, k, verdict, took=1.0):
    return (unit, at(second), "run", None, None, k, verdict, took)


BATCHES = [
    [ask("settles", 0, [4, 8, 16]), ask("exhausts", 0, [2, 4]), ask("spends", 0, [1, 2, 3], 5.0), ask("waits", 0, [1, 2], 30.0), ask("falls", 0, [4, 4]), ask("empty", 0, [])],
    [run("settles", 1, 4, "unknown"), run("exhausts", 1, 2, None), run("spends", 2, 1, "unknown", 3.0), run("waits", 2, 1, "unknown"), run("settles", 2, 4, "verified"), run("nobody", 3, 4, "verified")],
    [run("settles", 4, 8, "verified"), run("exhausts", 5, 4, "unknown"), run("spends", 4, 2, "unknown", 2.5), ask("waits", 6, [9]), run("settles", 7, 16, "violated")],
    [ask("clock", 500, [1])],
    [ask("clock", 600, [1]), run("waits", 600, 2, "verified")],
]


def test_replay(spark, tmp_path):
    for i, batch in enumerate(BATCHES):
        spark.createDataFrame(batch, live_ladder.ROW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
        with settings.session(spark, SESSION):
            out = live_ladder.decisions(spark.readStream.schema(live_ladder.ROW).parquet(f"{tmp_path}/rows"))
            query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(100)
        assert i < len(BATCHES)
    rows = spark.read.schema(live_ladder.DECISION).parquet(f"{tmp_path}/out").orderBy("at", "k").collect()
    of = lambda unit: [(r.decision, r.k, r.verdict, r.next_k) for r in rows if r.unit == unit]
    said = of("settles")
    assert said == [("request", None, None, 4), ("request", 4, "unknown", 8), ("ignored", 4, "verified", 8), ("settled", 8, "verified", None), ("ignored", 16, "violated", None)]
    assert of("exhausts") == [("request", None, None, 2), ("request", 2, "unknown", 4), ("exhausted", 4, "unknown", None)]
    assert of("spends") == [("request", None, None, 1), ("request", 1, "unknown", 2), ("deferred", 2, "unknown", 3)]
    assert of("falls") == of("empty") == [("rejected", None, None, None)] and of("nobody") == [("ignored", 4, "verified", None)]
    # The clock of the events passed the unit's thirty seconds; what its run says afterwards is not waited for.
    assert of("waits") == [("request", None, None, 1), ("request", 1, "unknown", 2), ("ignored", None, None, 2), ("deferred", None, None, 2), ("ignored", 2, "verified", None)]
    assert of("clock") == [("request", None, None, 1), ("ignored", None, None, 1)]
