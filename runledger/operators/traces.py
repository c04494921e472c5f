"""Counterexample traces: text to nested records, and views of them.

A trace is one text, bounded by what one run of the checker prints, so its lines stay together: blocks are cut out
of the array of lines with higher-order functions, and no trace is ever spread over tasks or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checker
from ..schemas import COUNTEREXAMPLE

# How the checker prints states, places, assignments and the violated property.
STATE = r"^State (\d+) file (.+?) line (\d+) column (\d+)(?: function (.+?))? thread (\d+)$"
PLACE = r"^\s*file (.+?) line (\d+) column (\d+)(?: function (.+?))?$"
BITS = r"\s+\(([01]+(?: [01]+)*)\)$"
VIOLATED, CWE = "Violated property:", "CWE:"
BASE_SYMBOL = r"^[^$\[.]+"


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, pattern, n)


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The first n groups of a whole line, by one match; a line holds no line break that could be taken for the one between groups."""
    return F.split(F.regexp_replace(text, pattern, "\n".join(f"${i}" for i in range(1, n + 1))), "\n")


def _loc(groups: Column, first: int) -> Column:
    part = lambda i: F.get(groups, F.lit(first + i))
    return F.struct(part(0).alias("file"), part(1).try_cast("int").alias("line"), part(2).try_cast("int").alias("column"), F.nullif(part(3), F.lit("")).alias("function"))


def _assignment(body: Column) -> Column:
    """lhs = value, split at the first equals sign between spaces; the bits behind a scalar apart."""

    def parts(rhs):
        bits = F.when(rhs.endswith(")"), F.nullif(_group(rhs, BITS, 1), F.lit("")))
        scalar = lambda b: F.rtrim(F.left(rhs, F.length(rhs) - F.length(b) - 2), F.lit(" \t\n\v\f\r"))
        lhs = checker.strip(F.substring_index(body, " = ", 1)).alias("lhs")
        return checker.let(bits, lambda b: F.struct(lhs, F.when(b.isNotNull(), scalar(b)).otherwise(rhs).alias("value"), b.alias("binary")))

    return checker.let(checker.strip(F.substring(body, F.instr(body, " = ") + 3, F.length(body))), parts)


def parse(raw: Column) -> Column:
    """F11, J7, N15. A counterexample (see schemas.COUNTEREXAMPLE) or null: for several traces in one text, for none, and for a property without place."""
    plain = lambda x: checker.strip(x)
    # A plain search first: most lines are no header.
    is_state = lambda x: x.contains("State ") & plain(x).rlike(STATE)
    opens = lambda x: is_state(x) | x.startswith(VIOLATED)

    def blocks_of(every):
        """Blocks run from an opening line to the line before the next."""
        starts = F.filter(F.transform(every, lambda x, i: F.when(opens(x), i + 1)), lambda i: i.isNotNull())
        ends = lambda s: F.concat(F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1))), F.array(F.size(every) + 1))
        return checker.let(starts, lambda s: F.zip_with(s, ends(s), lambda a, b: F.slice(every, a, b - a)))

    def step(block):
        body = F.transform(F.filter(F.slice(block, F.lit(2), F.size(block)), lambda x: x.contains(" = ")), plain)
        found = F.filter(body, lambda x: x.contains(" = "))
        made = lambda head: F.struct(F.get(head, F.lit(0)).try_cast("int").alias("number"), _loc(head, 1).alias("loc"), F.transform(found, _assignment).alias("assignments"))
        return checker.let(_groups(plain(F.get(block, F.lit(0))), STATE, 5), made)

    def violated(block):
        place = F.get(block, F.lit(1))
        rest = F.slice(block, F.lit(3), F.size(block))
        # The details are the indented lines up to the first that is not.
        stop = F.array_position(F.transform(rest, lambda x: x.rlike("^[ \t]").cast("int")), F.lit(0)).cast("int")
        inside = F.transform(F.when(stop > 0, F.slice(rest, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(rest), plain)
        words = F.filter(inside, lambda x: (x != "") & ~x.startswith(CWE))
        numbers = F.try_element_at(F.filter(inside, lambda x: x.startswith(CWE)), F.lit(-1))
        cwe = F.filter(F.transform(F.split(F.substring(numbers, 5, 1 << 30), ","), plain), lambda x: x != "")
        prop = F.struct(
            checker.let(_groups(place, PLACE, 4), lambda at: _loc(at, 0)).alias("loc"), F.coalesce(F.get(words, F.lit(0)), F.lit("")).alias("description"), F.get(words, F.lit(1)).alias("expression"),
            F.coalesce(cwe, F.array().cast("array<string>")).alias("cwe"),
        )
        return F.when(F.coalesce(place.rlike(PLACE), F.lit(False)), prop)

    def whole(blocks):
        # A block opens with the one or the other.
        steps = F.transform(F.filter(blocks, lambda b: ~F.get(b, F.lit(0)).startswith(VIOLATED)), step)
        last = F.try_element_at(F.filter(blocks, lambda b: F.get(b, F.lit(0)).startswith(VIOLATED)), F.lit(-1))
        return F.struct(steps.alias("steps"), checker.let(last, violated).alias("violated_property"))

    one = lambda every: F.when(checker.markers(every) <= 1, checker.let(blocks_of(every), whole))
    return checker.let(checker.let(checker.lines(raw), one), lambda c: F.when(c["violated_property"].isNotNull(), c))


def parsed(runs: DataFrame, raw: str = "raw_counterexample", name: str = "counterexample") -> DataFrame:
    """runs with the parsed trace; a verdict never depends on whether it parses.

    The trace comes out of a generator of one row: of a plain column, each later filter and explode would run the parser anew.
    """
    trace = F.explode(F.array(parse(F.col(raw)))).alias(name)
    return runs.select(*[trace if c == name else F.col(c) for c in runs.columns], *[trace] * (name not in runs.columns))


def steps(traces: DataFrame, key: str, cex: str = "counterexample") -> DataFrame:
    """L10. One row per assignment: key, step (place in the trace), number, file, line, function, ord, lhs, value, binary."""
    s = traces.select(key, F.posexplode(F.col(cex)["steps"]).alias("step", "s")).select(key, "step", "s.number", "s.loc.file", "s.loc.line", "s.loc.function", F.posexplode("s.assignments").alias("ord", "a"))
    return s.select(key, "step", "number", "file", "line", "function", "ord", "a.lhs", "a.value", "a.binary")


def base_symbol(lhs: Column) -> Column:
    """Name before the first $, [ or dot; the whole text where it begins with one."""
    return F.coalesce(F.nullif(F.regexp_extract(lhs, BASE_SYMBOL, 0), F.lit("")), lhs)


def inputs(assignments: DataFrame, key: str) -> DataFrame:
    """E7. The first write of each base symbol: key, symbol, lhs, value, binary, place."""
    at = F.struct("step", "ord")
    first = assignments.groupBy(key, base_symbol(F.col("lhs")).alias("symbol")).agg(F.min_by(F.struct("lhs", "value", "binary"), at).alias("a"), F.min(at).alias("at"))
    return first.select(key, "symbol", "a.lhs", "a.value", "a.binary", F.col("at.step").alias("step"), F.col("at.ord").alias("ord"))


def classified(runs: DataFrame) -> DataFrame:
    """J4, N16. runs with verdict, reason, message, raw_counterexample and version."""
    r = checker.classify(F.col("stdout"), F.col("stderr"), F.col("exit_code"))
    return runs.withColumns({"__r": r, "esbmc_version": checker.version(F.col("stdout"), F.col("stderr"))}).select("*", "__r.*").drop("__r")


def result_json(structured: bool = True) -> Column:
    """B9, N20. A result as JSON: only the fields of its verdict. Inputs are derived and never stored."""
    plain = ["verdict", "esbmc_version", "argv", "duration_s"]
    cex = F.from_json(F.to_json(F.struct("counterexample")), f"counterexample struct<{COUNTEREXAMPLE.replace(', v', ',v').replace('steps array', 'steps:array').replace('violated_property struct', 'violated_property:struct')}>")
    trace = ["raw_counterexample", cex["counterexample"].alias("counterexample")] if structured else [F.col("raw_counterexample").alias("counterexample")]
    keep = {"ignoreNullFields": "false"}
    return (
        F.when(F.col("verdict") == "verified", F.to_json(F.struct(*plain), keep))
        .when(F.col("verdict") == "violated", F.to_json(F.struct(*plain, *trace), keep))
        .when(F.col("verdict") == "unknown", F.to_json(F.struct(*plain, "reason"), keep))
        .otherwise(F.to_json(F.struct(*plain, "message"), keep))
    )


def result_text(source: Column, k: Column) -> Column:
    """B8. A result for people: verdict, source, bound and version, then what the verdict needs."""
    version = F.coalesce(F.nullif(F.col("esbmc_version"), F.lit("")), F.lit("?"))
    head = F.concat(F.upper("verdict"), F.lit("  ("), source, F.lit(", k="), k.cast("string"), F.lit(", esbmc "), version, F.lit(")"))
    tail = F.when(F.col("verdict") == "violated", F.concat(F.lit("\n\n"), "raw_counterexample")).when(F.col("verdict") == "unknown", F.concat(F.lit("\nreason: "), "reason"))
    return F.concat(head, F.coalesce(tail.when(F.col("verdict") == "error", F.concat(F.lit("\nerror: "), "message")), F.lit("")))
