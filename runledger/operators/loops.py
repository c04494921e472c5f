"""Replay of write-verify-fix loops from recorded runs, and the reports made of them.

A loop is a number of rounds; a round is a number of runs along a ladder of bounds. Replay cuts each round after its
first verdict that is not unknown, and the loop after its first round that ends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checker


def replay(runs: DataFrame, max_iterations: int = 10, loop: str = "run_id", round_: str = "round", rung: str = "rung") -> DataFrame:
    """F5, F6. The iterations that the loop performs, in order: runs with index, state, ends (the loop stops here) and final_state, give_up_reason there.

    runs: loop, round_ (from 0), rung (from 0), k, verdict and any others. Verified ends as done, an unknown that no
    rung follows as unknown, an error as give_up; a violated round is followed by the next one, up to max_iterations.
    A verdict outside the vocabulary is an error. Sorts a loop's runs.
    """
    if max_iterations < 1:
        raise ValueError(f"max_iterations must be >= 1, got {max_iterations}")
    state = checker.loop_state(F.col("verdict"))
    along = Window.partitionBy(loop, round_).orderBy(rung)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.where(F.col(round_) < max_iterations).withColumns({"state": state, "__last": F.lead(rung).over(along).isNull()})
    rows = rows.withColumn("__cut", F.coalesce(F.max((F.col("state") != "unknown").cast("int")).over(before(along)), F.lit(0)))
    rows = rows.where("__cut = 0")
    final = F.col("state").isin("done", "give_up") | ((F.col("state") == "unknown") & F.col("__last"))
    whole = Window.partitionBy(loop).orderBy(round_, rung)
    rows = rows.withColumn("ends", final).withColumn("__over", F.coalesce(F.max(F.col("ends").cast("int")).over(before(whole)), F.lit(0))).where("__over = 0")
    spent = (F.col("state") == "fix") & F.lead(rung).over(whole).isNull()
    rows = rows.withColumns({"index": F.row_number().over(whole) - 1, "__spent": spent})
    rows = rows.withColumn("ends", F.col("ends") | F.col("__spent"))
    return rows.withColumns(
        {
            "final_state": F.when(F.col("ends"), F.when(F.col("__spent"), "give_up").otherwise(F.col("state"))),
            "give_up_reason": F.when(F.col("__spent"), "max_iterations_exceeded").when(F.col("ends") & (F.col("state") == "give_up"), "esbmc_error"),
            "escalates": (F.col("state") == "unknown") & ~F.col("ends"),
            "fixes": (F.col("state") == "fix") & ~F.col("ends"),
        }
    ).drop("__last", "__cut", "__over", "__spent")


def reports(iterations: DataFrame, loop: str = "run_id", trace: str | None = None) -> DataFrame:
    """R12, C12, E8. One row per loop: final_state, give_up_reason, n_iterations, last_violated (index) and, if named, the trace of that iteration."""
    bad = F.col("verdict") == "violated"
    at = F.when(bad, F.col("index"))
    last = [F.max_by(F.when(bad, F.col(trace)), at).alias("last_counterexample_raw")] if trace else []
    return iterations.groupBy(loop).agg(
        F.max(F.when(F.col("ends"), F.col("final_state"))).alias("final_state"), F.max(F.when(F.col("ends"), F.col("give_up_reason"))).alias("give_up_reason"),
        F.count(F.lit(1)).alias("n_iterations"), F.max(at).alias("last_violated"), *last,
    )


def loop_events(iterations: DataFrame, loop: str = "run_id", base_k: Column | None = None) -> DataFrame:
    """R9, F1. The events of each loop with seq from 0: the trigger, a verdict per iteration, then what followed from it."""
    event = lambda name, index, k, verdict, detail: F.struct(
        F.lit(name).alias("type"), index.cast("int").alias("index"), k.cast("int").alias("k"), verdict.cast("string").alias("verdict"), detail.cast("map<string,string>").alias("detail")
    )
    none, i = F.lit(None), F.col("index")
    words = lambda *pairs: F.create_map(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in pairs])
    w = Window.partitionBy(loop).orderBy("index")
    base = F.col("k") if base_k is None else base_k
    mine = F.array(event("verify.verdict", i, F.col("k"), F.col("verdict"), F.create_map()))
    then = (
        F.when(F.col("escalates"), F.array(event("unknown.policy.decision", i, none, none, words("decision", "escalate", "from_k", F.col("k"), "to_k", F.col("__next_k")))))
        .when(F.col("final_state") == "done", F.array(event("converged", i, none, none, F.create_map())))
        .when(F.col("final_state") == "unknown", F.array(event("unknown.policy.decision", i, none, none, words("decision", "exhausted"))))
        .when(F.col("give_up_reason") == "esbmc_error", F.array(event("give_up", i, none, none, words("reason", "esbmc_error"))))
        .when(F.col("give_up_reason").isNotNull(), F.array(event("give_up", none, none, none, words("reason", "max_iterations_exceeded"))))
        .when(F.col("fixes"), F.array(event("fix.attempt", i, none, none, F.create_map())))
    )
    first = F.when(i == 0, F.array(event("trigger.fired", none, none, none, words("source", F.col("source"), "base_k", base)))).otherwise(F.array().cast("array<struct<type:string,index:int,k:int,verdict:string,detail:map<string,string>>>"))
    steps = iterations.withColumn("__next_k", F.lead("k").over(w))
    rows = steps.select(loop, F.col("index").alias("__at"), F.posexplode(F.concat(first, mine, then)).alias("__n", "e")).select(loop, "__at", "__n", "e.*")
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(loop).orderBy("__at", "__n")) - 1).drop("__at", "__n")


def transcripts(iterations: DataFrame, title: Column, loop: str = "run_id") -> DataFrame:
    """B8. A readable summary of each loop: state, reason, one line per iteration."""
    reason = F.when(F.col("unknown_reason").isNotNull(), F.concat(F.lit("  (unknown: "), F.col("unknown_reason"), F.lit(")"))).otherwise("")
    line = F.concat(F.format_string("  [%d] %-9s k=%d %s", F.col("index").cast("int"), F.upper("verdict"), F.col("k").cast("int"), F.col("source")), reason)
    rows = iterations.groupBy(loop).agg(
        F.max(F.when(F.col("ends"), F.col("final_state"))).alias("s"), F.max(F.when(F.col("ends"), F.col("give_up_reason"))).alias("r"), F.max(title).alias("t"),
        F.array_sort(F.collect_list(F.struct("index", line.alias("line")))).alias("rows"),
    )
    head = F.concat(F.lit("Loop transcript — "), F.col("t"), F.lit("\nOutcome: "), F.upper("s"), F.when(F.col("r").isNotNull(), F.concat(F.lit("\n  reason: "), F.col("r"))).otherwise(""))
    return rows.select(loop, F.concat(head, F.lit("\nIterations:\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("transcript"))


def check_transcripts(verdicts: DataFrame, unit: str, order: list[str]) -> DataFrame:
    """B8. A readable summary of each unit's checked properties, with a word first where nothing was checked.

    verdicts: unit, property_id, kind, outcome, k, skip_reason; a unit without properties has one row of nulls.
    """
    words = ("held", "violated", "unknown", "error", "skipped")
    k = F.coalesce(F.concat(F.lit("k="), F.col("k").cast("string")), F.lit("k=-"))
    why = F.when(F.col("skip_reason").isNotNull(), F.concat(F.lit("  ("), F.col("skip_reason"), F.lit(")"))).otherwise("")
    line = F.concat(F.format_string("  %-9s %-6s %s %s", F.upper("outcome"), k, "property_id", "kind"), why)
    rows = verdicts.groupBy(unit).agg(
        F.array_sort(F.collect_list(F.when(F.col("property_id").isNotNull(), F.struct(*order, line.alias("line"))))).alias("rows"),
        *[F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in words], F.count("property_id").alias("n"),
    )
    deferred = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " stored property for ").otherwise(" stored properties for "), F.col(unit), F.lit(" -- all reachability-kind (deferred); no semantic property was actually checked.\n"))
    alarm = F.when(F.col("n") == 0, F.concat(F.lit("No properties stored for "), F.col(unit), F.lit(" -- nothing was checked.\n"))).when(F.col("n") == F.col("skipped"), deferred).otherwise("")
    counts = F.concat(F.lit("Counts: "), F.concat_ws(", ", *[F.concat(F.lit(f"{o}="), F.col(o).cast("string")) for o in words]))
    body = F.array_join(F.concat(F.array(F.concat(F.lit("Property check — "), F.col(unit)), F.lit("Properties:")), F.transform("rows", lambda r: r["line"]), F.array(counts)), "\n")
    return rows.select(unit, F.concat(alarm, body).alias("transcript"))
