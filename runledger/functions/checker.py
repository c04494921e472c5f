"""Reading the output of a bounded model checker, as column expressions.

The verdict is read off whole lines of the captured text, never off the exit code alone, so that a failed call that
only quotes a verdict is not taken for one. What is not recognised is an error, never a pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the checker prints.
FAILED, SUCCESSFUL, UNKNOWN = "VERIFICATION FAILED", "VERIFICATION SUCCESSFUL", "VERIFICATION UNKNOWN"
TIMED_OUT, OUT_OF_MEMORY = "Timed out", "Out of memory"
PARSING_ERROR, NO_INPUT, PARSE_EXIT = "PARSING ERROR", "failed to open input file", 6
TRACE_START, UNWINDING = "[Counterexample]", "unwinding assertion"
#: Where a text breaks into lines, and what counts as blank at a line's ends.
LINE_BREAK = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0                　"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once a row: a lambda that named the expression itself would compute it once an element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def lines(text: Column) -> Column:
    """Lines without their breaks; a break at the end opens no further line."""
    cut = lambda split: F.when(F.element_at(split, -1) == "", F.slice(split, F.lit(1), F.size(split) - 1)).otherwise(split)
    return let(F.split(text, LINE_BREAK), cut)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def captured(stdout: Column, stderr: Column) -> Column:
    """Both streams as one text; a missing stream is empty, bytes are decoded with replacement."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(text(stdout), F.lit("\n"), text(stderr))


def has_banner(text: Column, banner: str) -> Column:
    """Whether a line holds the banner and nothing else."""
    return F.exists(lines(text), lambda line: strip(line) == banner)


def trace_text(text: Column) -> Column:
    """The trace before the last line that is the banner of failure: from its first marker, or whole if it has none."""

    def before_banner(every):
        last = F.array_max(F.transform(every, lambda line, i: F.when(strip(line) == FAILED, i)))
        return F.array_join(F.when(last.isNull(), every).otherwise(F.slice(every, F.lit(1), F.coalesce(last, F.lit(0)))), "\n")

    body = let(lines(text), before_banner)
    return strip(let(body, lambda b: F.when(F.instr(b, TRACE_START) > 0, F.substring(b, F.instr(b, TRACE_START), F.length(b))).otherwise(b)))


def error_line(text: Column, default: str) -> Column:
    """Text of the first line that begins with ERROR:, else the default."""
    found = F.filter(lines(text), lambda line: line.startswith("ERROR:"))
    return F.when(F.size(found) > 0, strip(F.substring(F.get(found, F.lit(0)), 7, 1 << 30))).otherwise(F.lit(default))


def error_message(text: Column) -> Column:
    return error_line(text, "esbmc reported an error")


def version(stdout: Column, stderr: Column) -> Column:
    """Version that stdout names, else the one of stderr, else empty."""
    named = lambda c: F.nullif(F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"ESBMC version (\S+)", 1), F.lit(""))
    return F.coalesce(named(stdout), named(stderr), F.lit(""))


def classify(stdout: Column, stderr: Column, exit_code: Column) -> Column:
    """struct(verdict, reason, message, raw_counterexample) of a finished run.

    A failed call comes first, whatever else the text holds; then the banners, violated before verified; then the
    words of an unknown result, wherever they stand; anything else is an error.
    """
    text = captured(stdout, stderr)
    broken = F.coalesce(exit_code == PARSE_EXIT, F.lit(False)) | text.contains(PARSING_ERROR) | text.contains(NO_INPUT)
    row = lambda verdict, reason=None, message=None, raw=None: F.struct(
        F.lit(verdict).alias("verdict"),
        F.lit(reason).cast("string").alias("reason"),
        (F.lit(None).cast("string") if message is None else message).alias("message"),
        (F.lit(None).cast("string") if raw is None else raw).alias("raw_counterexample"),
    )
    return (
        F.when(broken, row("error", message=error_message(text)))
        .when(has_banner(text, FAILED), row("violated", raw=trace_text(text)))
        .when(has_banner(text, SUCCESSFUL), row("verified"))
        .when(text.contains(UNKNOWN), row("unknown", "unclassified"))
        .when(text.contains(TIMED_OUT), row("unknown", "timeout"))
        .when(text.contains(OUT_OF_MEMORY), row("unknown", "memout"))
        .otherwise(row("error", message=F.lit("unclassified output")))
    )


def under_unwound(verdict: Column, raw: Column) -> Column:
    """Whether a violation says no more than that the bound is too low."""
    return F.coalesce((verdict == "violated") & raw.contains(UNWINDING), F.lit(False))


def escalating(result: Column) -> Column:
    """The result with an under-unwound violation as unknown, so that the ladder goes on."""
    low = under_unwound(result["verdict"], result["raw_counterexample"])
    unknown = F.struct(
        F.lit("unknown").alias("verdict"), F.lit("under_unwound").alias("reason"), F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("raw_counterexample")
    )
    return F.when(low, unknown).otherwise(result)


def timeout_flag(seconds: Column) -> Column:
    """Whole seconds, rounded up and never below one: zero would mean no limit."""
    return F.concat(F.greatest(F.lit(1), F.ceil(seconds)).cast("string"), F.lit("s"))


def argv(source: Column, unwind: Column, function: Column, timeout_s: Column, extra: Column, binary: str = "esbmc", no_unwinding_assertions: bool = True) -> Column:
    """The command line of a run. Extra flags come before the function and the time limit."""
    fixed = [F.lit(binary), source, F.lit("--unwind"), unwind.cast("string")] + [F.lit("--no-unwinding-assertions")] * no_unwinding_assertions
    none = F.array().cast("array<string>")
    flag = lambda name, value, given: F.when(given.isNotNull(), F.array(F.lit(name), value)).otherwise(none)
    return F.concat(F.array(*fixed), F.coalesce(extra, none), flag("--function", function, function), flag("--timeout", timeout_flag(timeout_s), timeout_s))


def precondition_ladder(max_len: Column, cap: Column) -> Column:
    """max_len + 1, doubled up to cap, which is the last rung; one rung alone where it reaches cap already."""
    first = max_len.cast("long") + 1
    rungs = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.least(first * F.pow(F.lit(2.0), i), cap.cast("double")).cast("long"))
    return F.when(first >= cap, F.array(first)).otherwise(F.array_distinct(rungs))


def parse_ladder(text: Column, above: Column | None = None) -> Column:
    """Rungs of a comma-separated text; empty text has none, a part that is no whole number makes the ladder null. Rungs up to `above` are left out."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    numbers = F.transform(parts, lambda p: F.when(p.rlike(r"^[+-]?[0-9]+$"), p.try_cast("int")))
    rungs = F.when(F.trim(text) == "", F.array().cast("array<int>")).when(F.exists(numbers, lambda n: n.isNull()), F.lit(None)).otherwise(numbers)
    return rungs if above is None else F.filter(rungs, lambda k: k > above)


def valid_ladder(rungs: Column) -> Column:
    """Whether rungs are at least 1 and each above the one before; an empty ladder is not valid."""
    pairs = F.zip_with(F.slice(rungs, F.lit(1), F.greatest(F.size(rungs) - 1, F.lit(0))), F.slice(rungs, F.lit(2), F.greatest(F.size(rungs) - 1, F.lit(0))), lambda a, b: a < b)
    return F.coalesce((F.size(rungs) > 0) & F.forall(rungs, lambda k: k >= 1) & F.forall(pairs, lambda x: x), F.lit(False))


def loop_state(verdict: Column) -> Column:
    """State of the loop after a verdict; anything but the four verdicts gives up."""
    return F.when(verdict == "verified", "done").when(verdict == "violated", "fix").when(verdict == "unknown", "unknown").otherwise("give_up")


def outcome(verdict: Column) -> Column:
    """Outcome of a property after a verdict; anything but the four verdicts is an error."""
    return F.when(verdict == "verified", "held").when(verdict == "violated", "violated").when(verdict == "unknown", "unknown").otherwise("error")


def clip(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def markers(every: Column) -> Column:
    """Number of lines that are a trace marker."""
    return F.size(F.filter(every, lambda line: line.contains(TRACE_START) & (strip(line) == TRACE_START)))


def traces_in(text: Column) -> Column:
    """Number of lines that are a trace marker; a text with two or more is declined."""
    return markers(lines(text))
