"""Order of tool calls that depend on calls of the same turn, on later ones and on one another."""

import random

from runledger.llm import tool_calls


def linked(spark, needs, places):
    """needs: call -> calls; places: call -> (turn, place). All calls have a result a turn later."""
    calls = [(1, *places[c], c, "f", "{}", list(n)) for c, n in needs.items()]
    calls = spark.createDataFrame(calls, "conv_id long, turn long, place int, call_id string, tool string, arguments string, needs array<string>")
    results = spark.createDataFrame([(1, t + 1, c, "ok") for c, (t, _) in places.items()], "conv_id long, turn long, call_id string, content string")
    return {r.call_id: r for r in tool_calls.link(calls, results, {"f": {}}).collect() if r.kind == "call"}


def reaches(needs, a, b):
    seen, todo = set(), [a]
    while todo:
        for v in needs[todo.pop()]:
            if v == b:
                return True
            if v not in seen:
                seen.add(v)
                todo.append(v)
    return False


def test_same_turn(spark):
    got = linked(spark, {"a": ["b"], "b": [], "c": ["a"]}, {"a": (0, 0), "b": (0, 1), "c": (0, 2)})
    assert sorted(got, key=lambda c: got[c].order_key) == ["b", "a", "c"]
    assert all(r.n_needs_cut == 0 for r in got.values()) and got["a"].n_needs_kept == 1
    assert got["c"].order_key == "000000000000.000002"


def test_graph_with_cycles(spark):
    rng = random.Random(8)
    names = [f"n{i}" for i in range(24)]
    places = {c: (i // 3, i % 3) for i, c in enumerate(names)}
    needs = {c: rng.sample(names, rng.choice((0, 1, 1, 2))) for c in names}
    got = linked(spark, needs, places)
    kept = {c: [v for v in needs[c] if not (reaches(needs, v, c) or v == c) or places[v] < places[c]] for c in names}
    assert any(len(kept[c]) < len(needs[c]) for c in names)
    for c in names:
        assert (got[c].n_needs_kept, got[c].n_needs_cut) == (len(kept[c]), len(needs[c]) - len(kept[c])), c
        assert all(got[v].order_key < got[c].order_key for v in kept[c]), c
