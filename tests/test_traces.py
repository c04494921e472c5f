"""Traces in the shapes that the checker prints, and texts that are none: nothing raises, and what is found is whole."""

import json

import pytest
from pyspark.sql import functions as F

from runledger.functions import checker
from runledger.operators import traces


def text(*blocks, violated=(), start="[Counterexample]"):
    return "\n".join([start, "", "", *blocks, *violated]) + "\n"


def state(n, line, *assignments, function=" function main"):
    return "\n".join([f"State {n} file src/b.c line {line} column 3{function} thread 0", "-" * 20, *(f"  {a}" for a in assignments), ""])


def violated(line, *details):
    return ["Violated property:", f"  file src/b.c line {line} column 3 function main", *(f"  {d}" for d in details)]


def place(line, function="main"):
    return {"file": "src/b.c", "line": line, "column": 3, "function": function}


BITS = "00000000 00000000 00000000 00000111"
SHAPES = {
    "bounds": (
        text(state(1, 4, f"i = 7 ({BITS})"), state(5, 6), violated=violated(6, "array bounds violated: array `v' upper bound", "CWE: CWE-1, CWE-22", "(signed long int)i < 7")),
        [(1, 4, [("i", "7", BITS)]), (5, 6, [])], ("array bounds violated: array `v' upper bound", "(signed long int)i < 7", ["CWE-1", "CWE-22"]),
    ),
    "no weakness number": (text(state(1, 2, f"x = 7 ({BITS})"), state(2, 3), violated=violated(3, "x must be small", "x < 5")), [(1, 2, [("x", "7", BITS)]), (2, 3, [])], ("x must be small", "x < 5", [])),
    "several steps, no weakness number": (
        text(state(1, 2, "x = -1 (1111)"), state(2, 3, "r.a[0] = -1 (1111)", "s = { .a=1, .b=2 }"), state(3, 4), violated=violated(4, "not negative", "r >= 0")),
        [(1, 2, [("x", "-1", "1111")]), (2, 3, [("r.a[0]", "-1", "1111"), ("s", "{ .a=1, .b=2 }", None)]), (3, 4, [])], ("not negative", "r >= 0", []),
    ),
    "pointer value, no expression": (text(state(1, 2, "p = (signed int *)0"), state(3, 3), violated=violated(3, "dereference failure: NULL pointer", "CWE: CWE-9")), [(1, 2, [("p", "(signed int *)0", None)]), (3, 3, [])], ("dereference failure: NULL pointer", None, ["CWE-9"])),
    "no function, no marker": (text(state(1, 2, "g = 1 (1)", function=""), violated=violated(3, "d"), start="noise"), [(1, 2, [("g", "1", "1")])], ("d", None, [])),
    "no states": (text(violated=violated(3, "d", "e", "CWE:")), [], ("d", "e", [])),
}
NONE = {
    "null": None, "empty": "", "blank": " \n\t\n", "one word": "x", "marker only": "[Counterexample]", "state only": text(state(1, 2, "x = 1")), "several": SHAPES["bounds"][0] + SHAPES["bounds"][0],
    "no place": text(violated=["Violated property:", "  nothing here"]), "property at the end": text(violated=["Violated property:"]), "many equals": "= = =\n" * 50, "brackets": "((([[[\\Q\\E$1" * 20, "long": "State 1 file " * 20_000,
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(n, t) for n, (t, *_) in SHAPES.items()] + [(f"{n} crlf", t.replace("\n", "\r\n")) for n, (t, *_) in SHAPES.items()] + list(NONE.items())
    df = traces.parsed(spark.createDataFrame(rows, "name string, raw_counterexample string"))
    given = {"verdict": F.lit("violated"), "esbmc_version": F.lit("8"), "argv": F.array(), "duration_s": F.lit(1.0), "reason": F.lit(None).cast("string"), "message": F.lit(None).cast("string")}
    return {r["name"]: json.loads(r.json).get("counterexample") for r in df.withColumns(given).select("name", traces.result_json().alias("json")).collect()}


@pytest.mark.parametrize("name", [n + end for n in SHAPES for end in ("", " crlf")])
def test_shapes(parsed, name):
    _, steps, (description, expression, cwe) = SHAPES[name.removesuffix(" crlf")]
    found = parsed[name]
    no_function = name.startswith("no function")
    assert found["steps"] == [
        {"number": n, "loc": place(line, None if no_function else "main"), "assignments": [{"lhs": a, "value": v, "binary": b} for a, v, b in own]} for n, line, own in steps
    ]
    prop = found["violated_property"]
    assert (prop["description"], prop["expression"], prop["cwe"]) == (description, expression, cwe) and prop["loc"]["function"] == "main"


@pytest.mark.parametrize("name", NONE)
def test_what_is_no_trace_is_null_and_raises_nothing(parsed, name):
    assert parsed[name] is None


def test_texts_of_the_given_tables_are_no_traces_and_raise_nothing(spark):
    sf = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("text").alias("raw_counterexample")).unionByName(spark.read.parquet(f"{sf}/pages.parquet").select(F.col("html").alias("raw_counterexample")))
    rows = traces.parsed(texts)
    assert rows.count() == rows.where("counterexample is null").count() > 200
    runs = texts.select(F.col("raw_counterexample").alias("stdout"), F.lit(None).cast("string").alias("stderr"), F.lit(1).alias("exit_code"))
    assert {r.verdict for r in traces.classified(runs).select("verdict").distinct().collect()} == {"error"}


def test_the_parser_runs_once_a_row(spark):
    """Filters and explodes on the trace read it; none of them is put below it with a parser of its own."""
    runs = spark.range(1).select(F.col("id").alias("key"), F.concat(F.lit(SHAPES["bounds"][0]), F.col("id").cast("string")).alias("raw_counterexample"))
    rows = traces.parsed(runs).where("counterexample is not null")
    splits = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("split(")
    for df in (rows, traces.steps(rows, "key"), rows.select("counterexample.violated_property.description")):
        assert splits(df) == splits(traces.parsed(runs)) > 0
    assert traces.parsed(traces.parsed(runs)).columns == ["key", "raw_counterexample", "counterexample"]


def test_blanks_at_the_ends(spark):
    """White space as Unicode has it, with the four separators of ASCII; no other control or format character."""
    blank = [c for c in map(chr, range(0x10000)) if c.isspace()]
    rows = [(i, f"{c}{c} a{c}b {c}") for i, c in enumerate([*blank, "\0", "\x08", "​", "᠎", "﻿"])]
    got = spark.createDataFrame(rows, "i int, t string").select("i", checker.strip(F.col("t")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: t.strip() for i, t in rows}
    assert spark.sql("select cast(null as string) as t").select(checker.strip(F.col("t")).alias("s")).first().s is None
