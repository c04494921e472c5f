"""Verdicts of runs: ladders of bounds, latest snapshots, counts and worst outcomes.

A verdict is verified, violated, unknown or error. Null and other values never count as passed. What can be an
aggregate is one, with partial sums before the shuffle; the operators that need the rows of a unit in order (a
running count, a next rung) sort each unit in one task, which spills, and say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checker
from ..schemas import EXIT_CODES, OUTCOMES


def _inconclusive(verdict: str = "verdict") -> Column:
    return F.coalesce(F.col(verdict) == "unknown", F.lit(True))


def settled(runs: DataFrame, unit: str, rung: list[str], keep: tuple[str, ...] = ("verdict", "k")) -> DataFrame:
    """F3, G4. Per unit the first run along rung whose verdict is not unknown, else the last one: unit and the columns kept."""
    at, row = F.struct(*rung), F.struct(*keep)
    open_ = _inconclusive()
    ends = runs.groupBy(unit).agg(F.min_by(row, F.when(~open_, at)).alias("first"), F.count(F.when(~open_, 1)).alias("n"), F.max_by(row, F.when(open_, at)).alias("last"))
    return ends.select(unit, F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("last")).alias("s")).select(unit, "s.*")


def attempts(runs: DataFrame, unit: str, rung: list[str], next_k: Column | None = None) -> DataFrame:
    """F2, K10. The runs up to the first that is not unknown, each with escalate_to: the next bound after an unknown one, null on the run that settles. Sorts a unit's runs."""
    w = Window.partitionBy(unit).orderBy(*rung)
    done = F.coalesce(F.max((~_inconclusive()).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = runs.withColumns({"__done": done, "__next": F.lead("k").over(w) if next_k is None else next_k})
    return steps.where("__done = 0").withColumn("escalate_to", F.when(_inconclusive(), F.col("__next"))).drop("__done", "__next")


def escalations(runs: DataFrame, unit: str, rung: list[str]) -> DataFrame:
    """Unknown runs that have a next rung, up to the first run that is not unknown: unit, from_k, to_k. Sorts a unit's runs."""
    more = runs.withColumn("__more", F.lead(F.lit(1)).over(Window.partitionBy(unit).orderBy(*rung)))
    return attempts(more, unit, rung).where(_inconclusive() & (F.col("__more") == 1)).select(unit, F.col("k").alias("from_k"), F.col("escalate_to").alias("to_k"))


def valid_ladders(rungs: DataFrame, ladder: str, place: str, k: str = "k") -> DataFrame:
    """F4. Per ladder whether its rungs are at least 1 and strictly increasing. A ladder's rungs are few, so they come together as an array."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(place, k))), lambda r: r[k])
    return rungs.groupBy(ladder).agg(checker.valid_ladder(ordered).alias("valid"), F.count(F.lit(1)).alias("n_rungs"))


def outcome_counts(rows: DataFrame, by: list[str] | None = None, outcome: str = "outcome") -> DataFrame:
    """E1. All five outcomes, zero where none, and n_other: rows of no outcome at all."""
    known = [F.count(F.when(F.col(outcome) == o, 1)).alias(f"n_{o}") for o in OUTCOMES]
    return rows.groupBy(*(by or [])).agg(*known, F.count(F.when(~F.coalesce(F.col(outcome).isin(*OUTCOMES), F.lit(False)), 1)).alias("n_other"))


def worst(rows: DataFrame, by: list[str] | None = None, outcome: str = "outcome") -> DataFrame:
    """E2. Worst outcome wins: violated, then unknown, then error, else clean. An outcome that is null or no word of the vocabulary counts as error; no rows at all are clean."""
    word = F.coalesce(F.col(outcome), F.lit(""))
    rank = F.when(word == "violated", 3).when(word == "unknown", 2).when(word.isin("held", "verified", "skipped"), 0).otherwise(1)
    code = F.element_at(F.array(*map(F.lit, ("clean", "error", "unknown", "violated"))), F.coalesce(F.max(rank), F.lit(0)) + 1)
    return rows.groupBy(*(by or [])).agg(code.alias("worst"), F.count(F.when(~word.isin("skipped"), 1)).alias("n_checked"))


def latest(rows: DataFrame, unit: str, order: list[str]) -> DataFrame:
    """E12. Last write of each unit; null sorts first. Of rows equal in order the greatest row wins, so reruns agree."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(F.col(unit).alias("__unit")).agg(F.max(F.struct(F.struct(*order).alias("o"), whole.alias("row"))).alias("m")).select("m.row.*")


def blocking(rows: DataFrame) -> DataFrame:
    """C2. Units that block: neither verified nor waiting for a contract. A null verdict blocks."""
    return rows.where(~F.coalesce(F.col("verdict").isin("verified", "needs_contract"), F.lit(False)))


def needs_contract(rows: DataFrame) -> DataFrame:
    """C2. Units that wait for a contract: reported, never blocking."""
    return rows.where(F.col("verdict") == "needs_contract")


def held(rows: DataFrame, outcome: str = "outcome") -> DataFrame:
    """C2. Properties that held: what a mutation test would start from."""
    return rows.where(F.col(outcome) == "held")


def failures(rows: DataFrame) -> DataFrame:
    """C2. Verdicts that go back to the author: all that block."""
    return blocking(rows)


def stop_attempts(rows: DataFrame, unit: str, order: list[str], block: Column, reset: Column, most: int = 3) -> DataFrame:
    """F7. Attempts since the last reset at each blocking row, and whether they exceed most (residual: no longer blocked). Null neither blocks nor resets. Sorts a unit's rows."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    w = Window.partitionBy(unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    islands = rows.withColumns({"__block": flag(block), "island": F.sum(flag(reset)).over(w)})
    v = Window.partitionBy(unit, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = islands.withColumn("attempt", F.sum("__block").over(v)).where("__block = 1")
    return out.drop("__block").withColumn("residual", F.col("attempt") > most)


def pending_attempts(rows: DataFrame, key: list[str], order: list[str], most: int = 3) -> DataFrame:
    """F8, K5. How often the same content was begun, up to the retry limit, at each row. Sorts a content's rows."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(F.lit(1)).over(w)
    return rows.withColumns({"attempts": F.least(n, F.lit(most)), "retry": n < most})


def last_of(rows: DataFrame, unit: str, order: list[str], verdict: str, value: str) -> DataFrame:
    """E8. Value of the last row of each unit with that verdict, null if there is none."""
    at = F.struct(*order)
    return rows.groupBy(unit).agg(F.max_by(F.when(F.col("verdict") == verdict, F.col(value)), F.when(F.col("verdict") == verdict, at)).alias(value))


def top_with_rest(rows: DataFrame, unit: str, order: list[str], k: int = 3) -> DataFrame:
    """G2. First k rows of each unit along order, with the number of those left out. The count is an aggregate of its own, so that the ranking can drop rows before the shuffle."""
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(unit).orderBy(*order))).where(F.col("place") <= k)
    rest = rows.groupBy(F.col(unit).alias("__unit")).agg(F.greatest(F.count(F.lit(1)) - k, F.lit(0)).alias("deferred"))
    return ranked.join(rest, ranked[unit].eqNullSafe(rest["__unit"])).drop("__unit")


def within_budget(rows: DataFrame, unit: str, order: list[str], cost: str, budget: float, least: float = 0.0) -> DataFrame:
    """G3. Rows that start while the budget left is at least `least`; the others are deferred. A null cost counts as 0. Sorts a unit's rows."""
    w = Window.partitionBy(unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.coalesce(F.col(cost), F.lit(0))).over(w), F.lit(0))
    return rows.withColumn("started", F.lit(budget) - spent >= least)


def numbered(rows: DataFrame, unit: str, order: list[str], name: str = "seq") -> DataFrame:
    """F1. Contiguous sequence from 0. Sorts a unit's rows."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(unit).orderBy(*order)) - 1)


def ordered_distinct(rows: DataFrame, unit: str, order: list[str], value: str, name: str = "values") -> DataFrame:
    """E6. Distinct values of each unit in the order of their first row; nulls do not count. Only distinct values come together."""
    first = rows.where(F.col(value).isNotNull()).groupBy(unit, value).agg(F.min(F.struct(*order)).alias("at"))
    return first.groupBy(unit).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda r: r[value]).alias(name))


def joined_text(rows: DataFrame, unit: str, order: list[str], text: Column, between: str = ", ") -> DataFrame:
    """E10. Texts of each unit in order, joined; a null text is left out."""
    pieces = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), text.alias("t"))))
    return rows.where(text.isNotNull()).groupBy(unit).agg(F.array_join(F.transform(pieces, lambda p: p["t"]), between).alias("text"))


def quantified(rows: DataFrame, by: list[str], holds: Column) -> DataFrame:
    """E9. Whether the rule holds for all rows, for any, and whether there are none of a group at all (n = 0 where a group has only null markers).

    A null rule does not hold. Rows whose every other column is null stand for an empty group: all is then true, any false.
    """
    known = F.coalesce(holds, F.lit(False))
    return rows.groupBy(*by).agg(F.coalesce(F.bool_and(known), F.lit(True)).alias("all_hold"), F.coalesce(F.bool_or(known), F.lit(False)).alias("any_holds"), F.count(F.lit(1)).alias("n"))


def semantic_summary(verdicts: DataFrame, by: list[str], outcome: str = "outcome") -> DataFrame:
    """E4. Per group the numbers of violated, unresolved (unknown and error alike) and skipped verdicts, and whether there is nothing to report."""
    count = lambda *words: F.count(F.when(F.col(outcome).isin(*words), 1))
    out = verdicts.groupBy(*by).agg(count("violated").alias("n_violations"), count("unknown", "error").alias("n_unresolved"), count("skipped").alias("n_skipped"))
    return out.withColumn("empty", (F.col("n_violations") == 0) & (F.col("n_unresolved") == 0) & (F.col("n_skipped") == 0))


def gate_counts(verdict: str = "verdict") -> list[Column]:
    """E5. Aggregates n_failures and n_needs_contract; sums of them are those of the whole."""
    need = F.coalesce(F.col(verdict) == "needs_contract", F.lit(False))
    fail = ~F.coalesce(F.col(verdict).isin("verified", "needs_contract"), F.lit(False))
    return [F.count(F.when(fail, 1)).alias("n_failures"), F.count(F.when(need, 1)).alias("n_needs_contract")]


def gate_said(counts: DataFrame) -> DataFrame:
    """N13. counts (n_failures) with the decision and the process status: 2 with a failure, else 0."""
    return counts.withColumns({"decision": F.when(F.col("n_failures") > 0, "block").otherwise("pass"), "exit_code": F.when(F.col("n_failures") > 0, 2).otherwise(0)})


def gate_counters(rows: DataFrame, by: list[str]) -> DataFrame:
    """E5, N13. Per gate run the failures, the units that wait for a contract, the decision and the process status."""
    return gate_said(rows.groupBy(*by).agg(*gate_counts()))


def with_exit_code(rows: DataFrame, codes: DataFrame, verdict: str = "verdict", otherwise: int = EXIT_CODES["error"]) -> DataFrame:
    """D14. rows with the process status of their verdict (codes: a few rows of verdict, exit_code); a null or foreign verdict has that of an error."""
    known = F.broadcast(codes.select(F.col("verdict").alias(verdict), "exit_code"))
    return rows.join(known, verdict, "left").withColumn("exit_code", F.coalesce("exit_code", F.lit(otherwise)))


def least_by(rows: DataFrame, unit: str, order: list[Column], keep: tuple[str, ...]) -> DataFrame:
    """G4. Per unit the columns kept of the row that is first along several keys."""
    at = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return rows.groupBy(unit).agg(F.min_by(F.struct(*keep), at).alias("m")).select(unit, "m.*")
