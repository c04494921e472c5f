"""The property store as tables: identity, insertion, status moves, and what is left to check.

These are the rules over tables; streaming/property_store.py applies them to a log of commands that many writers append to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import names
from ..schemas import CHECKABLE, KINDS, MOVES, STATUSES


def identified(rows: DataFrame) -> DataFrame:
    """J1. rows (unit_id, kind, expression, domain) with property_id."""
    return rows.withColumn("property_id", names.property_id(F.col("unit_id"), F.col("kind"), F.col("expression"), F.col("domain")))


def checked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C8. (rows that the store may hold, rows that it may not, with reject_reason)."""
    return schemas.reject(
        rows,
        {
            "property_id": F.col("property_id").isNotNull(), "unit_id": F.col("unit_id").isNotNull(), "expression": F.col("expression").isNotNull(),
            "kind": schemas.one_of("kind", KINDS), "status": schemas.one_of("status", STATUSES), "grading": schemas.grading_ok(),
        },
    )


def insert_absent(store: DataFrame, new: DataFrame, order: list[str], key: str = "property_id") -> DataFrame:
    """B2. The rows of new that the store lacks, the first of each id along order."""
    first = new.groupBy(F.col(key).alias("__key")).agg(F.min(F.struct(F.struct(*order).alias("o"), F.struct(*new.columns).alias("row"))).alias("m")).select("m.row.*")
    return first.join(store.select(key), key, "left_anti").select(*new.columns)


def duplicates(store: DataFrame, new: DataFrame, key: str = "property_id") -> DataFrame:
    """B1. Ids of new that the store holds already or that come more than once."""
    known = new.select(key).join(store.select(key), key, "left_semi")
    return known.unionByName(new.groupBy(key).count().where("count > 1").select(key)).distinct()


def for_unit(store: DataFrame, unit_id: str | Column, statuses: tuple[str, ...] | None = None) -> DataFrame:
    """C1. A unit's properties; None is every status, an empty set is no row."""
    rows = store.where(F.col("unit_id") == unit_id)
    if statuses is None:
        return rows
    return rows.where(F.col("status").isin(*statuses)) if statuses else rows.where("false")


def in_order(rows: DataFrame, order: str = "ord") -> DataFrame:
    """G1. Rows as they were inserted."""
    return rows.orderBy(order)


def by_id(store: DataFrame, property_id: str) -> DataFrame:
    """A2. The property of an id: one row or none."""
    return store.where(F.col("property_id") == property_id)


def transitions(spark: SparkSession) -> DataFrame:
    """C9. The allowed moves: status, new_status."""
    return spark.createDataFrame(list(MOVES), "status string, new_status string")


def terminal(statuses: DataFrame, moves: DataFrame) -> DataFrame:
    """C9. Statuses that no move leaves."""
    return statuses.join(moves.select("status"), "status", "left_anti")


def judged_moves(store: DataFrame, wanted: DataFrame, moves: DataFrame) -> DataFrame:
    """B3, D15. wanted (property_id, new_status) with the current status and verdict: ok, unknown_id or invalid. The moves are a handful of rows."""
    now = wanted.join(store.select("property_id", "status"), "property_id", "left")
    allowed = F.broadcast(moves.withColumn("__ok", F.lit(True)))
    verdict = F.when(F.col("status").isNull(), "unknown_id").when(F.col("__ok"), "ok").otherwise("invalid")
    return now.join(allowed, ["status", "new_status"], "left").withColumn("verdict", verdict).drop("__ok")


def moved(store: DataFrame, wanted: DataFrame, moves: DataFrame, order: tuple[str, ...] = ("new_status",)) -> DataFrame:
    """B3. The store after the moves wanted, each property's in order; one that is not allowed when its turn comes changes nothing. The moves are a handful of rows."""
    allowed = F.array(*[F.lit(f"{a} {b}") for a, b in moves.select("status", "new_status").collect()])
    turns = wanted.groupBy("property_id").agg(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.col("new_status").alias("to")))).alias("__turns"))
    step = lambda now, turn: F.when(F.array_contains(allowed, F.concat_ws(" ", now, turn["to"])), turn["to"]).otherwise(now)
    folded = F.when(F.col("__turns").isNull(), F.col("status")).otherwise(F.aggregate("__turns", F.col("status"), step))
    return store.join(turns, "property_id", "left").withColumn("status", folded).select(*store.columns)


def with_candidates(verified: DataFrame, store: DataFrame) -> DataFrame:
    """D1. Verified units (unit_id) that have a candidate, with n_checkable: all their properties whose fate is open."""
    open_ = store.where(F.col("status").isin(*CHECKABLE)).join(verified.select("unit_id"), "unit_id", "left_semi")
    counts = open_.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_checkable"), F.bool_or(F.col("status") == "candidate").alias("__fresh"))
    return counts.where("__fresh").drop("__fresh")


def check_status(runs: DataFrame, timeout_s: float = 20.0, grace_s: float = 5.0, margin_s: float = 10.0) -> DataFrame:
    """N12. Per unit check (n_checkable, budget_s, took_s, payload_ok): its time limit and whether it was checked, failed, or deferred because the turn's budget cut it short."""
    own = F.greatest(F.col("n_checkable"), F.lit(1)) * (timeout_s + grace_s) + margin_s
    limit = F.least(own, F.col("budget_s"))
    late = F.col("took_s") >= limit
    status = F.when(late & (limit < own), "deferred").when(late | ~F.coalesce("payload_ok", F.lit(False)), "failed").otherwise("checked")
    return runs.withColumns({"limit_s": limit, "status": status})


def check_plan(properties: DataFrame) -> DataFrame:
    """N1. What becomes of each property before any run: skipped (with reason) if it is not semantic, error if it cannot be rendered, else to be verified."""
    skip = F.lit("reachability properties are not harnessed yet")
    reason = F.when(F.col("kind") != "semantic", skip).when(F.col("render_error").isNotNull(), F.concat(F.lit("harness render failed: "), "render_error"))
    plan = F.when(F.col("kind") != "semantic", "skipped").when(F.col("render_error").isNotNull(), "error")
    return properties.where(F.col("status").isin(*CHECKABLE)).withColumns({"settled": plan, "skip_reason": reason})
