"""Syntax tree dumps as a relation, and the function definitions in them.

A dump is one text per translation unit, bounded by one compilation, so its tree is walked in one call, without a
shuffle; all that follows is relational. Line and file of a node are inherited from the last node before it that
prints them.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clang, ctext
from ..functions.arrow import batched
from ..schemas import PARAM, UnitsUnavailable

NODES = "tu string, ord int, depth int, kind string, rest string, parent int, child_index int, fn int, site string, is_callee boolean, last int"


def _walk(tu: str, dump: str):
    """Rows of one tree: each with its parent, place among its siblings, innermost function, site and last descendant."""
    rows, stack = [], []  # stack: places in rows, root first
    for line in re.split("\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]", dump or ""):
        found = clang.node(line)
        if not found:
            continue
        (depth, kind, rest), n = found, len(rows)
        while stack and rows[stack[-1]]["depth"] >= depth:
            stack.pop()
        up = stack[-1] if stack else None
        fn = next((i for i in reversed(stack) if rows[i]["kind"] == "FunctionDecl"), None)
        named = next((i for i in reversed(stack) if rows[i]["kind"] in ("FunctionDecl", "VarDecl")), None)
        site = clang.name_before_type(rows[named]["rest"]) if named is not None else None
        index = 0
        if up is not None:
            index, rows[up]["children"] = rows[up]["children"], rows[up]["children"] + 1
        row = {"tu": tu, "ord": n, "depth": depth, "kind": kind, "rest": rest, "parent": up, "child_index": index, "fn": fn, "site": site or clang.FILE_SCOPE, "children": 0, "last": n}
        # The callee of a direct call: the first child of a call, or of a wrapper that is a callee's place itself.
        above = rows[up] if up is not None else None
        row["callee_place"] = above is not None and index == 0 and (above["kind"] == "CallExpr" or (above["kind"] in clang.CALLEE_WRAPPERS and above["callee_place"]))
        rows.append(row)
        for i in stack:
            rows[i]["last"] = n
        stack.append(n)
    return rows


def nodes(dumps: DataFrame, tu: str = "tu", dump: str = "dump") -> DataFrame:
    """F9, J29, L10. One row per node: parent and child_index, fn (innermost function around it), site (innermost named declaration), is_callee, last (last descendant)."""

    def run(frames):
        for pdf in frames:
            for t, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True):
                rows = _walk(t, text)
                if rows:
                    out = pd.DataFrame(rows).rename(columns={"callee_place": "is_callee"})[[c.split()[0] for c in NODES.split(", ")]]
                    yield out.astype({"parent": "Int32", "fn": "Int32"})

    return dumps.select(tu, dump).mapInPandas(run, NODES)


def placed(tree: DataFrame) -> DataFrame:
    """F10, J28. tree with file and line: a node's own, else those of the last node that has them; line 0 and no file before the first. Sorts a translation unit's nodes."""
    w = Window.partitionBy("tu").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rest = F.col("rest")
    return tree.withColumns(
        {"file": F.coalesce(F.last(clang.own_file(rest), ignorenulls=True).over(w), F.lit("")), "line": F.coalesce(F.last(clang.own_line(rest), ignorenulls=True).over(w), F.lit(0))}
    )


def definitions(tree: DataFrame) -> DataFrame:
    """N5, E6. Every function definition of a translation unit, headers too: tu, name, file, def_line, internal_linkage, params, calls (functions referred to, each once, in order), closed (order of ending).

    Static on any declaration of a name makes it internal.
    """
    rest = F.col("rest")
    fns = tree.where("kind = 'FunctionDecl'").select("tu", F.col("ord").alias("fn"), "depth", clang.declared_name(rest).alias("name"), "file", F.col("line").alias("def_line"), "last", clang.is_static(rest).alias("static"))
    inner = tree.where("fn is not null").select("tu", "fn", "ord", "parent", "kind", "rest")
    param = (F.col("kind") == "ParmVarDecl") & (F.col("parent") == F.col("fn"))
    no = F.lit(None)
    shape = F.struct(clang.declared_name(rest).alias("name"), clang.canonical_type(rest).alias("type"), no.cast("int").alias("array_extent"), F.lit(False).alias("array_extent_unresolved"), F.lit(False).alias("array_static_min"))
    whole = inner.groupBy("tu", "fn").agg(
        F.bool_or(F.col("kind") == "CompoundStmt").alias("defined"),
        F.transform(F.array_sort(F.collect_list(F.when(param, F.struct("ord", shape.alias("p"))))), lambda x: x["p"]).alias("params"),
    )
    ref = F.when(F.col("kind") == "DeclRefExpr", clang.referenced(rest))
    calls = inner.select("tu", "fn", "ord", ref.alias("callee")).where("callee is not null").groupBy("tu", "fn", "callee").agg(F.min("ord").alias("at"))
    calls = calls.groupBy("tu", "fn").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "callee"))), lambda x: x["callee"]).alias("calls"))
    static = fns.groupBy("tu", "name").agg(F.bool_or("static").alias("internal_linkage"))
    rows = fns.where("name <> ''").join(whole.where("defined"), ["tu", "fn"]).join(calls, ["tu", "fn"], "left").join(static, ["tu", "name"])
    return rows.select(
        "tu", "name", "file", "def_line", "internal_linkage", F.col("params").cast(f"array<{PARAM}>").alias("params"), F.coalesce("calls", F.array().cast("array<string>")).alias("calls"),
        F.struct("last", (-F.col("depth")).alias("outer")).alias("closed"),
    )


def units(found: DataFrame, sources: DataFrame) -> DataFrame:
    """N5, N14. The definitions in the file under test itself (sources: tu, source), the first of each name."""
    same = clang.normal_path(F.col("file")) == clang.normal_path(F.col("source"))
    mine = found.join(sources, "tu").where((F.col("file") != "") & same)
    whole = F.struct(*[c for c in mine.columns if c not in ("tu", "name")])
    return mine.groupBy("tu", "name").agg(F.min_by(whole, "closed").alias("u")).select("tu", "name", "u.*")


def is_pointer(ctype: Column) -> Column:
    return ctype.contains("*") | ctype.contains("[")


def takes_pointer(params: Column) -> Column:
    """E9. Whether any parameter is a pointer; none of no parameters."""
    return F.exists(params, lambda p: is_pointer(p["type"]))


@batched(f"array<{PARAM}>")
def _with_extents(params: pd.Series, source: pd.Series, name: pd.Series, def_line: pd.Series) -> pd.Series:
    out = []
    for ps, text, fn, line in zip(params, source, name, def_line, strict=True):
        listed = None if text is None else ctext.parameter_list(text, fn, None if pd.isna(line) else int(line))
        rows = []
        for p in ps:
            p = dict(p)
            if listed is not None and ("*" in p["type"] or "[" in p["type"]):
                p["array_extent"], p["array_extent_unresolved"], p["array_static_min"] = ctext.array_shape(listed, p["name"])
            rows.append(p)
        out.append(rows)
    return pd.Series(out)


def with_extents(found: DataFrame, texts: DataFrame) -> DataFrame:
    """D8, D9, D10, J14, N17. units with the written array extents of pointer parameters. texts: tu, text; units without text stay as they are.

    The declarator is that of the definition nearest to def_line, in the numbering that line directives set.
    """
    joined = found.join(texts.select("tu", F.col("text").alias("__text")), "tu", "left")
    return joined.withColumn("params", _with_extents("params", "__text", "name", "def_line")).drop("__text")


def nearest(candidates: DataFrame, wanted: DataFrame, key: str, line: str = "line", wanted_line: str = "def_line") -> DataFrame:
    """D8. Per wanted (key, wanted_line) the candidate (key, line, physical and any others) at or behind it that is nearest, else the nearest before it; of two the later in the file.

    Candidates and wanted lines of a key are sorted together, and each wanted line takes the last candidate that was passed, from
    either end: no candidate meets a line that is not beside it. Sorts a key's rows, which spills.
    """
    whole = F.struct(*[c for c in candidates.columns if c != key])
    best = candidates.groupBy(key, F.col(line).alias("__at")).agg(F.max_by(whole, "physical").alias("c"))
    asked = wanted.select(key, F.col(wanted_line).alias("__at")).distinct().withColumn("c", F.lit(None).cast(best.schema["c"].dataType))
    passed = lambda *order: F.last("c", ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    is_asked = F.col("c").isNull()
    rows = best.unionByName(asked).withColumns({"__behind": passed(F.desc("__at"), is_asked), "__before": passed("__at", ~is_asked)})
    found = rows.where(is_asked).select(key, F.col("__at").alias(wanted_line), F.coalesce("__behind", "__before").alias("c"))
    return found.where("c is not null").select(key, wanted_line, "c.*")


def presumed(lines: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """D9. lines (key, physical) with the number that the last mark (key, physical, number: of the line behind it) strictly above sets; without one their own. Sorts a key's rows."""
    rows = lines.select(key, "physical", F.lit(None).cast("long").alias("number"), F.lit(True).alias("asked"))
    rows = rows.unionByName(marks.select(key, "physical", F.col("number").cast("long").alias("number"), F.lit(False).alias("asked")))
    w = Window.partitionBy(key).orderBy("physical").rangeBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(~F.col("asked"), F.struct(F.col("physical").alias("at"), "number")), ignorenulls=True).over(w)
    out = rows.withColumn("m", last).where("asked")
    return out.select(key, "physical", F.coalesce(F.col("m.number") + F.col("physical") - F.col("m.at") - 1, F.col("physical")).cast("long").alias("presumed"))


def plan_subject(found: DataFrame, wanted: DataFrame, failed: DataFrame) -> DataFrame:
    """N6. What stands in the way of a plan for wanted (tu, name): listing failed, main defined, no such unit, unresolved pointer (needs_contract); null where nothing does.

    failed: tu, error. found: units with plan columns resolvable and unresolved_params.
    """
    mains = found.groupBy("tu").agg(F.bool_or(F.col("name") == "main").alias("__main"))
    rows = wanted.join(failed, "tu", "left").join(mains, "tu", "left").join(found.select("tu", "name", "resolvable", "unresolved_params"), ["tu", "name"], "left")
    cases = [
        (F.col("error").isNotNull(), "error", F.col("error")),
        (F.col("__main"), "error", F.concat(F.col("tu"), F.lit(" defines main(); the sidecar #includes the source, which would duplicate main"))),
        (F.col("resolvable").isNull(), "error", F.concat(F.lit("no definition of "), F.col("name"), F.lit("() in "), F.col("tu"))),
        (~F.col("resolvable"), "needs_contract", F.concat(F.lit("unresolved pointer parameter(s): "), F.array_join("unresolved_params", ", "))),
    ]
    first = F.coalesce(*[F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(a).alias("assessment"), d.alias("detail"))) for rule, a, d in cases])
    return rows.withColumn("__c", first).select("tu", "name", "__c.assessment", "__c.detail")


def list_units(dump: str | None, source: str, exit_code: int = 0, error: str = "") -> list[dict]:
    """A7. Definitions of one dump on the driver; a failed listing raises, it is never an empty list."""
    if exit_code or dump is None:
        raise UnitsUnavailable(error or f"exit {exit_code}")
    tree = _walk(source, dump)
    defined = {x["fn"] for x in tree if x["kind"] == "CompoundStmt"}
    return [r for r in tree if r["kind"] == "FunctionDecl" and r["ord"] in defined]
