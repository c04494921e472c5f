"""H4 against a plain search on random graphs, and on long chains; D8 against a plain minimum."""

import random

from runledger.operators import callgraph, reachability, units


def plain(edges):
    out = {}
    for tu, a, b in edges:
        out.setdefault((tu, a), set()).add((tu, b))
    found = set()
    for start in out:
        seen, open_ = set(), list(out[start])
        while open_:
            at = open_.pop()
            if at not in seen:
                seen.add(at)
                open_ += out.get(at, ())
        if start in seen:
            found.add(start)
    return found


def graph(rng, tu):
    n = rng.choice([3, 8, 25])
    edges = [(tu, f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(int(n * rng.choice([0.7, 1.0, 1.4])))]
    for i in range(rng.randrange(4)):  # chains, some of them closed, and chains between nodes of the graph
        k = rng.randrange(1, 30)
        names = [f"c{i}_{j}" for j in range(k)]
        edges += [(tu, a, b) for a, b in zip(names, names[1:], strict=False)]
        edges += rng.choice([[], [(tu, names[-1], names[0])], [(tu, "n0", names[0]), (tu, names[-1], "n1")], [(tu, "n1", names[0]), (tu, names[-1], "n1")]])
    return edges


def test_random_graphs(spark):
    rng = random.Random(8)
    edges = [e for i in range(60) for e in graph(rng, f"g{i}")]
    df = spark.createDataFrame([*edges, (None, "x", "x"), ("g0", None, "x")], "tu string, caller string, callee string")
    for small in (0, 20, reachability.SMALL):  # all in rounds, some, none
        assert {tuple(r) for r in callgraph.self_reachable(df, small=small).collect()} == plain(edges)
    asked = spark.createDataFrame([("g1", "n0"), ("g1", "n1"), ("g2", "no")], "tu string, name string")
    assert {tuple(r) for r in callgraph.self_reachable(df, asked=asked).collect()} == plain(edges) & {("g1", "n0"), ("g1", "n1")}
    assert callgraph.self_reachable(df.limit(0)).collect() == []


def test_a_chain_of_ten_thousand_calls_takes_few_rounds(spark, monkeypatch):
    n, rounds, doubled = 10_000, [], reachability._doubled
    monkeypatch.setattr(reachability, "_doubled", lambda *a: rounds.append(1) or doubled(*a))
    edges = [("open", f"f{i}", f"f{i + 1}") for i in range(n)] + [("ring", f"f{i}", f"f{(i + 1) % 999}") for i in range(999)]
    found = callgraph.self_reachable(spark.createDataFrame(edges, "tu string, caller string, callee string"), small=1000)
    assert found.groupBy("tu").count().collect() == [("ring", 999)] and 10 < len(rounds) < 20
    assert len(reachability._cyclic([(a, b) for _, a, b in edges[n:]])) == 999 and reachability._cyclic([(a, b) for _, a, b in edges[:n]]) == []


def test_nearest_line(spark):
    rng = random.Random(9)
    candidates = [(k, rng.randrange(40), p, f"c{p}") for k in "abc" for p in range(25)]
    wanted = [(k, rng.randrange(-2, 45)) for k in "abcd" for _ in range(20)]
    got = units.nearest(spark.createDataFrame(candidates, "key string, line int, physical int, name string"), spark.createDataFrame(wanted, "key string, def_line int"), "key")
    want = set()
    for key, line in wanted:
        own = [c for c in candidates if c[0] == key]
        if own:
            _, at, physical, name = min(own, key=lambda c: (c[1] < line, abs(c[1] - line), -c[2]))
            want.add((key, line, at, physical, name))
    assert {tuple(r) for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
