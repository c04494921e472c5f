"""Mixing sources to target weights.

Every document gets a hash-random key. Keys are dealt into equal slices of the key range, so a source of any
size is sorted and summed by many tasks: a running sum inside each slice, plus the total of the slices before
it (a table of slices, not of documents). Each source is cut at its exact budget; a budget above the source's
size repeats whole epochs first.

Defined cases: null text has size 0; a null source is a source of its own, last in order; null and repeated
doc_ids are rows like others; a source without words gets target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

WEIGHTS, MOST_EPOCHS, SEED = (1.0, 2.0, 3.0), 3, 7
#: Documents a slice of a source holds on average; there are 64 slices of a source at least.
SLICE_ROWS = 50_000

WORD = r"[^\x20\x09-\x0D]+"


def word_count(col: str = "text"):
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """sources: source, source_size, one row each, materialised. Adds target.

    Weights repeat along the sources in code-point order, null last. The excess above most times a source's size
    is shared again by weight among those below, until none is above; only totals come to the driver.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())  # one narrow row per source
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    ranked = materialise(sources.select("*", F.element_at(cycle, (F.row_number().over(w) - 1) % len(weights) + 1).alias("weight")), "weights")
    cap, level = most * F.col("source_size"), None
    total, all_weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, open_weight, rest = total or 0, all_weights or 0.0, float(total or 0)
    while open_weight:
        level = rest / open_weight
        held, below = ranked.agg(F.sum(F.when(F.col("weight") * level > cap, cap)), F.sum(F.when(F.col("weight") * level <= cap, F.col("weight")))).first()
        held, below = held or 0.0, below or 0.0
        if below == open_weight:
            break
        rest, open_weight = total - held, below
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level or 0.0), cap).cast("double"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: float = MOST_EPOCHS, seed: int = SEED, key_col: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), and key_col if named."""
    own = [F.col(key_col).alias("row_key")] if key_col else []
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col))
    sized = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), key.alias("key"), *own), "sized")
    sources = materialise(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    targets = source_targets(sources.drop("n"), weights, most)
    largest = sources.agg(F.max("n")).first()[0] or 0
    slices = max(64, -(-largest // SLICE_ROWS))
    sized = sized.withColumn("slice", F.floor((F.col("key").cast("double") / 2.0**64 + 0.5) * slices).cast("long"))
    order = [F.col("key"), F.col("doc_id").asc_nulls_last(), F.col("size")]
    sums = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # slices, not documents
    sums = sums.withColumn("slice_before", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    facts = materialise(sums.join(targets, sums.source.eqNullSafe(targets.source)).select(sums.source, "slice", "slice_before", "source_size", "target"), "slices")
    inside = Window.partitionBy("source", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d")
    f = facts.alias("f")
    joined = local.join(f, F.expr("d.source <=> f.source and d.slice = f.slice"))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("slice_before") - F.col("inside"), F.lit(0)), F.col("size"))
    named = [F.col("row_key").alias(key_col)] if key_col else []
    return joined.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), *named)
