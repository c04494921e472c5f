"""H4. Functions that can come back to themselves, in rounds that grow with the logarithm of a chain's length, and without a table of pairs.

The graph of one translation unit is mostly small, and then searched whole in one task. A larger one is mostly chains and trees, so it is
taken down before anything is searched in it. A phase cuts off what has no
way in or no way out, which is on no cycle, and puts one edge in place of each chain: of functions with one caller and
one callee. Chains are found by doubling: each function points at the next of its chain, then at that one's
target, until it points at the last. What is left in the end has a branch at every function; there, colours are carried
forward and answered backward, which gives the strongly connected components. A chain is on a cycle if its two ends
are one function or in one component, so the phases are gone through again, last first, to label their chains.

Rounds: a phase takes one per doubling; the colours take as many as the longest way in the graph that is left. Every round's
table is written to a shared folder, so a lost executor costs its own work only.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.shared import kept

#: Edges of a graph that one task takes whole: some 20 MB.
SMALL = 100_000


def _degrees(step: DataFrame, by: str) -> DataFrame:
    """Functions with the numbers of their callers and callees, and one of each: by, v, n_in, n_out, prev, next."""
    none = F.lit(None).cast("string")
    out = step.select(by, F.col("a").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("b").alias("next"), none.alias("prev"))
    into = step.select(by, F.col("b").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i"), none.alias("next"), F.col("a").alias("prev"))
    whole = out.unionByName(into).groupBy(by, "v")
    return kept(whole.agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.max("prev").alias("prev"), F.max("next").alias("next")), "degrees")


def _without(step: DataFrame, names: DataFrame, by: str) -> DataFrame:
    """Edges that no function of names (by, v) is at either end of."""
    gone = lambda end: names.select(by, F.col("v").alias(end))
    return step.join(gone("a"), [by, "a"], "left_anti").join(gone("b"), [by, "b"], "left_anti").select(by, "a", "b")


def _doubled(to: DataFrame, by: str) -> DataFrame:
    """Pointers (by, v, to, least) that go twice as far, with the least name that they pass; the last of a chain points at itself."""
    far = to.select(by, F.col("v").alias("to"), F.col("to").alias("far"), F.col("least").alias("then"))
    return kept(to.join(far, [by, "to"]).select(by, "v", F.col("far").alias("to"), F.least("least", "then").alias("least")), "pointers")


def _chains(inner: DataFrame, by: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(chain of each inner function: by, v, t, the chain's last; by, v, scc of those on a cycle of inner functions only, which go by its least name)."""
    names = inner.select(by, F.col("v").alias("next"), F.lit(True).alias("on"))
    to = kept(inner.join(names, [by, "next"], "left").select(by, "v", F.when(F.col("on"), F.col("next")).otherwise(F.col("v")).alias("to"), F.col("v").alias("least")), "pointers")
    ends = to.where("v = to").select(by, F.col("v").alias("to"))
    for _ in range(ceil(log2(max(2, n)))):
        if to.join(ends, [by, "to"], "left_anti").isEmpty():
            break
        to = _doubled(to, by)
    closed = to.join(ends, [by, "to"], "left_anti").select(by, "v", F.col("least").alias("scc"))
    return to.join(ends, [by, "to"], "left_semi").select(by, "v", F.col("to").alias("t")), closed


def _spread(seeds: DataFrame, step: DataFrame, by: str) -> DataFrame:
    """Colours (by, v, c) carried along edges to their ends until none is greater than what is there; two edges a round."""
    seeds, ahead = seeds.select(by, "v", "c"), step.select(by, F.col("a").alias("v"), "b")

    def on(colours):
        sent = colours.join(ahead, [by, "v"]).select(by, F.col("b").alias("v"), "c", F.lit(None).cast("string").alias("had"))
        return colours.select(by, "v", "c", "had").unionByName(sent).groupBy(by, "v").agg(F.max("c").alias("c"), F.max("had").alias("had"))

    while True:
        seeds = kept(on(on(seeds.withColumn("had", F.col("c")))), "colours")
        if seeds.where("had is null or c > had").isEmpty():
            return seeds.drop("had")


def _components(step: DataFrame, by: str) -> DataFrame | None:
    """Strongly connected components of more than one function: by, v, scc; None for none."""
    found = None
    while not step.isEmpty():
        nodes = step.select(by, F.col("a").alias("v")).unionByName(step.select(by, F.col("b").alias("v"))).distinct()
        colours = _spread(nodes.withColumn("c", F.col("v")), step, by)
        ends = step.join(colours.select(by, F.col("v").alias("a"), F.col("c").alias("ca")), [by, "a"]).join(colours.select(by, F.col("v").alias("b"), F.col("c").alias("cb")), [by, "b"])
        inside = kept(ends.where("ca = cb").select(by, "a", "b", F.col("ca").alias("c")), "inside")
        back = inside.select(by, F.col("b").alias("a"), F.col("a").alias("b"))
        roots = colours.where("v = c")
        own = kept(_spread(roots, back, by).select(by, "v", F.col("c").alias("scc")), "own")
        many = own.groupBy(by, "scc").count().where("count > 1").select(by, "scc")
        several = own.join(many, [by, "scc"], "left_semi").select(by, "v", "scc")
        found = several if found is None else found.unionByName(several)
        rest = inside.join(own.select(by, F.col("v").alias("a")), [by, "a"], "left_anti").join(own.select(by, F.col("v").alias("b")), [by, "b"], "left_anti")
        step = kept(rest.select(by, "a", "b"), "edges")
    return found


def _cyclic(edges: list[tuple[str, str]]) -> list[str]:
    """Functions on a cycle of one small graph: in a component of several, or calling themselves (depth first, with a stack of its own)."""
    ahead: dict[str, list[str]] = {}
    for a, b in edges:
        ahead.setdefault(a, []).append(b)
    found, place, low, open_, path = {a for a, b in edges if a == b}, {}, {}, set(), []
    for root in ahead:
        work = [(root, iter(ahead[root]))] if root not in place else []
        while work:
            at, rest = work[-1]
            if at not in place:
                place[at] = low[at] = len(place)
                path.append(at)
                open_.add(at)
            for to in rest:
                if to not in place:
                    work.append((to, iter(ahead.get(to, ()))))
                    break
                if to in open_:
                    low[at] = min(low[at], place[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[at])
                if low[at] == place[at]:
                    own = _above(path, at)
                    open_.difference_update(own)
                    if len(own) > 1:
                        found.update(own)
    return sorted(found)


def _above(path: list[str], at: str) -> list[str]:
    """The end of a stack from a function on, taken off."""
    own = [path.pop()]
    while own[-1] != at:
        own.append(path.pop())
    return own


def on_cycles(edges: DataFrame, by: str, small: int = SMALL) -> DataFrame:
    """by, name: functions on a cycle of edges (by, a, b), those that call themselves too. Rows with a null name or key are on none.

    Graphs of `small` edges at most are taken whole, each in one call; only larger ones need rounds. Both give the same.
    """
    whole = kept(edges.select(by, "a", "b").dropna().distinct(), "edges")
    large = kept(whole.groupBy(by).count().where(F.col("count") > small).select(by), "large")
    schema = StructType([whole.schema[by], StructField("name", StringType())])

    def one(key, pdf):
        return pd.DataFrame([(key[0], name) for name in _cyclic(list(zip(pdf["a"], pdf["b"], strict=True)))], columns=[by, "name"])

    found = whole.join(large, by, "left_anti").groupBy(by).applyInPandas(one, schema)
    return found if large.isEmpty() else found.unionByName(_in_rounds(kept(whole.join(large, by, "left_semi").select(by, "a", "b"), "edges"), by))


def _in_rounds(whole: DataFrame, by: str) -> DataFrame:
    found = whole.where("a = b").select(by, F.col("a").alias("name"))
    step, phases, rings = whole.where("a <> b"), [], None
    while True:
        degrees = _degrees(step, by)
        end, chained = (F.col("n_in") == 0) | (F.col("n_out") == 0), (F.col("n_in") == 1) & (F.col("n_out") == 1)
        n_ends, n = degrees.agg(F.count(F.when(end, 1)), F.count(F.when(chained, 1))).first()
        if not n_ends and not n:
            break
        rest = step
        if n:
            inner = degrees.where(chained).select(by, "v", "prev", "next")
            member, closed = _chains(inner, by, n)
            rings = kept(closed, "rings") if rings is None else rings.unionByName(kept(closed, "rings"))
            first = inner.join(inner.select(by, F.col("v").alias("prev")), [by, "prev"], "left_anti").join(member, [by, "v"]).select(by, "t", F.col("prev").alias("u"))
            last = inner.select(by, F.col("v").alias("t"), F.col("next").alias("w"))
            chain = kept(first.join(last, [by, "t"]), "chains")
            phases.append((kept(member, "members"), chain))
            rest = _without(step, inner, by).unionByName(chain.where("u <> w").select(by, F.col("u").alias("a"), F.col("w").alias("b"))).distinct()
        step = kept(_without(rest, degrees.where(end), by), "edges")
    known = [found_ for found_ in (_components(step, by), rings) if found_ is not None]
    labels = reduce(DataFrame.unionByName, known, whole.limit(0).select(by, F.col("a").alias("v"), F.col("a").alias("scc")))
    for member, chain in reversed(phases):
        at = lambda name, scc, known=labels: known.select(by, F.col("v").alias(name), F.col("scc").alias(scc))
        ends = chain.join(at("u", "su"), [by, "u"], "left").join(at("w", "sw"), [by, "w"], "left")
        closing = kept(ends.where("u = w or su = sw").select(by, "t", "u", "w", F.coalesce("su", "u").alias("scc"), F.col("su").isNull().alias("new")), "closing")
        inside = member.join(closing.select(by, "t", "scc"), [by, "t"]).select(by, "v", "scc")
        # A function that several chains lead back to itself gets its label once.
        turned = closing.where("new").select(by, F.col("u").alias("v"), "scc").distinct()
        labels = kept(labels.unionByName(inside).unionByName(turned), "labels")
    return found.unionByName(labels.select(by, F.col("v").alias("name"))).distinct()
