"""The gate's keyed stream against a plain fold of its commands, over restarts, retried batches and growing input."""

import json
import random


from runledger.streaming import gate_state

FIELDS = ("rel", "at", "kind", "digest", "now", "pid", "functions", "function", "verdict", "k", "counterexample", "detail")


def command(rel, at, kind, digest=None, **more):
    return dict.fromkeys(FIELDS) | {"rel": rel, "at": at, "kind": kind, "digest": digest} | more


def put(folder, name, commands):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(c) + "\n" for c in commands))


def follow(spark, tmp_path, **more):
    query = gate_state.follow(spark, str(tmp_path / "commands"), str(tmp_path / "log"), str(tmp_path / "checkpoint"), **more)
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "log")), query


def units(log):
    return sorted(((r.rel, r.function, r.verdict, r.k) for r in gate_state.standing(log).collect()), key=repr)


def plain(commands):
    """A sequential fold: {rel: (stamp, marker, {function: (verdict, k, at)})}."""
    state = {}
    for c in sorted(commands, key=lambda c: (c["at"], gate_state.KINDS.index(c["kind"]))):
        s = state.setdefault(c["rel"], [None, None, {}])
        if c["kind"] == "begin":
            n = s[1][1] + 1 if s[1] and s[1][0] == c["digest"] else 1
            state[c["rel"]] = [c["digest"], (c["digest"], min(n, 3), c["pid"]), {f: ("unknown", c["k"], c["at"]) for f in c["functions"]}]
        elif c["kind"] == "verdict" and s[0] is not None and s[0] == c["digest"]:
            if c["function"] not in s[2] or c["at"] >= s[2][c["function"]][2]:
                s[2][c["function"]] = (c["verdict"], c["k"], c["at"])
        elif c["kind"] == "drift" and s[0] == c["digest"] and s[0] is not None and c["now"] != c["digest"]:
            s[0], s[2] = None, {f: ("unknown", k, c["at"]) for f, (_, k, _) in s[2].items()}
        elif c["kind"] == "clear" and s[1] and (s[1][0], s[1][2]) == (c["digest"], c["pid"]):
            s[1] = None
        elif c["kind"] == "delete":
            state[c["rel"]] = [None, None, {}]
    return state


def made(seed, n, first=0):
    rng = random.Random(seed)
    out = []
    for at in range(first, first + n):
        rel, kind, digest = f"f{rng.randrange(4)}.c", rng.choices(gate_state.KINDS, (3, 8, 1, 2, 0.3))[0], f"d{rng.randrange(2)}"
        c = command(rel, at, kind, digest, pid=rng.randrange(2), k=rng.choice([4, 8]))
        if kind == "begin":
            c["functions"] = rng.sample(["a", "b", "c"], k=rng.randrange(4))
        elif kind == "verdict":
            c |= {"function": rng.choice("abc"), "verdict": rng.choice(["verified", "violated", "needs_contract", "unknown"])}
        elif kind == "drift":
            c["now"] = rng.choice([digest, "other", None])
        out.append(c)
    return out


def expected(commands):
    return sorted(((rel, f, v, k) for rel, (_, _, own) in plain(commands).items() for f, (v, k, _) in own.items()), key=repr)


def test_stream_over_restarts_equals_a_plain_fold(spark, tmp_path):
    commands = made(1, 240)
    for i in range(4):
        put(tmp_path / "commands", f"c{i}", random.Random(i).sample(commands[60 * i : 60 * i + 60], 60))
        log, _ = follow(spark, tmp_path)
        sofar = commands[: 60 * i + 60]
        assert units(log) == expected(sofar)
        open_ = sorted((rel, m[0], m[1]) for rel, (_, m, own) in plain(sofar).items() if m)
        have = sorted((r.rel, r.digest, r.attempts) for r in gate_state.markers(log).collect())
        assert have == open_
    got, want = gate_state.counters(log).first(), [v for _, _, v, _ in expected(commands)]
    assert (got.n_units, got.n_failures, got.n_needs_contract) == (len(want), sum(v not in ("verified", "needs_contract") for v in want), want.count("needs_contract"))
    numbers = [r.n for r in log.where("rel = 'f0.c'").orderBy("n").collect()]
    assert numbers == list(range(len(numbers)))


def test_stale_late_and_foreign_commands(spark, tmp_path):
    begin = command("a.c", 1, "begin", "d1", pid=1, functions=["f", "g"], k=4)
    put(tmp_path / "commands", "0", [command("a.c", 0, "verdict", "d1", function="f", verdict="verified"), begin, command("a.c", 2, "verdict", "d0", function="f", verdict="verified", k=4), command("a.c", 9, "verdict", "d1", function="f", verdict="violated", k=8)])
    follow(spark, tmp_path)
    put(tmp_path / "commands", "1", [command("a.c", 5, "verdict", "d1", function="f", verdict="verified", k=4), command("a.c", 10, "verdict", None, function="g", verdict="verified"), command("a.c", 11, "odd"), command(None, 1, "begin", "x", functions=["h"]), command("a.c", 12, "verdict", "d1", function="g", verdict=None), command("a.c", 13, "clear", "d1", pid=2)])
    log, _ = follow(spark, tmp_path)
    assert [r.outcome for r in log.where("rel = 'a.c'").orderBy("n").collect()] == ["stale", "begun", "recorded", "recorded", "stale", "landed", "late", "stale", "unknown", "landed", "kept"]
    assert units(log) == [("a.c", "f", "violated", 8), ("a.c", "g", "error", None), (None, "h", "unknown", None)]


def test_a_retried_batch_changes_nothing_and_batches_touch_their_own_keys(spark, tmp_path):
    commands = made(2, 100)
    put(tmp_path / "commands", "0", commands[:50])
    follow(spark, tmp_path)
    put(tmp_path / "commands", "1", commands[50:])
    follow(spark, tmp_path)
    lost = tmp_path / "lost"
    lost.mkdir()
    for commit in (tmp_path / "checkpoint" / "commits").glob("*1*"):
        commit.rename(lost / commit.name)
    log, _ = follow(spark, tmp_path)
    assert units(log) == expected(commands)
    assert log.groupBy("rel", "n").count().where("count > 1").count() == 0
    put(tmp_path / "commands", "2", [command("new.c", 1, "begin", "d", pid=1, functions=["f"], k=4)])
    log, query = follow(spark, tmp_path)
    updated = [s["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"] for s in p["stateOperators"]]
    assert sum(updated) <= 4 and ("new.c", "f", "unknown", 4) in units(log)


def test_counters_of_a_stream_of_changes(spark, tmp_path):
    commands = made(3, 120)
    for i in range(2):
        put(tmp_path / "commands", str(i), commands[60 * i : 60 * i + 60])
        log, _ = follow(spark, tmp_path)
        rows = gate_state.counters(spark.readStream.schema(gate_state.CHANGE).parquet(str(tmp_path / "log")), ["rel"])
        kept = []
        query = rows.writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "counts")).foreachBatch(lambda df, n, kept=kept: kept.append(df.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(map(tuple, kept[-1])) == sorted(map(tuple, gate_state.counters(log, ["rel"]).collect()))
        by = {}
        for rel, _, v, _ in expected(commands[: 60 * i + 60]):
            by[rel] = by.get(rel, 0) + (v not in ("verified", "needs_contract"))
        assert {r.rel: r.n_failures for r in kept[-1] if r.n_units} == by


def test_state_that_is_not_written_expires(spark, tmp_path):
    put(tmp_path / "commands", "0", [command("a.c", 1, "begin", "d", pid=1, functions=["f"], k=4)])
    follow(spark, tmp_path, keep_ms=1)
    put(tmp_path / "commands", "1", [command("a.c", 2, "verdict", "d", function="f", verdict="verified", k=4)])
    log, _ = follow(spark, tmp_path, keep_ms=1)
    assert [r.outcome for r in log.orderBy("at", "n").collect()] == ["begun", "recorded", "stale"]
