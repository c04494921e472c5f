"""Freshness of sources and the state of the gate, as joins over keyed tables.

Tables: files (rel, digest: what is on disk now), scanned (rel, digest: what was verified last), pending (rel, hash,
attempts, pid: verifications begun and not ended), units, baseline_blobs (rel, digest). A digest that could not be
read is null; it never counts as fresh, and never as changed either: such a file is left to the next scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names

#: Verifications begun on one content, and stops blocked in a row, before the gate lets go with a residual.
MAX_PENDING, MAX_STOPS = 3, 3


def unfinished(pending: DataFrame) -> DataFrame:
    """pending with its counter made whole: null or negative counts as 0, a retry."""
    return pending.withColumn("attempts", F.greatest(F.coalesce("attempts", F.lit(0)), F.lit(0)))


def stale(files: DataFrame, scanned: DataFrame, pending: DataFrame, most: int = MAX_PENDING) -> DataFrame:
    """D2. Files to verify: changed since or never verified, or with an unfinished verification of this very content that has attempts left."""
    known = scanned.select("rel", F.col("digest").alias("__was"))
    open_ = unfinished(pending).select("rel", F.col("hash").alias("__hash"), F.col("attempts").alias("__n"))
    rows = files.where("digest is not null").join(known, "rel", "left").join(open_, "rel", "left")
    retry = F.coalesce((F.col("__hash") == F.col("digest")) & (F.col("__n") < most), F.lit(False))
    changed = ~F.col("digest").eqNullSafe(F.col("__was"))
    return rows.where(changed | retry).withColumn("reason", F.when(changed, "changed").otherwise("unfinished")).select(*files.columns, "reason")


def pending_retries(files: DataFrame, pending: DataFrame) -> DataFrame:
    """D3. Files whose content on disk is what an unfinished verification began with."""
    return files.join(pending.select("rel", F.col("hash").alias("digest")), ["rel", "digest"], "left_semi")


def discovered(dirty: DataFrame, committed: DataFrame, order: str = "ord", key: str = "rel") -> DataFrame:
    """H1. Changed files, then files committed since, each once at its first place: key, ord."""
    rank = lambda df, n: df.select(key, F.struct(F.lit(n).alias("list"), F.col(order).cast("long").alias("at")).alias("place"))
    first = rank(dirty, 0).unionByName(rank(committed, 1)).groupBy(key).agg(F.min("place").alias("place"))
    return first.select(key, F.col("place.list").alias("list"), F.col("place.at").alias(order))


def sources_needing_verify(files: DataFrame, scanned: DataFrame, pending: DataFrame, found: DataFrame | None) -> DataFrame:
    """H2. Stale files among the discovered ones and those of unfinished verifications; found is None outside a work tree, which leaves the latter."""
    retries = pending_retries(files, pending).select("rel")
    wanted = retries if found is None else found.select("rel").unionByName(retries)
    return stale(files.join(wanted.distinct(), "rel", "left_semi"), scanned, pending)


def divergent_blobs(blobs: DataFrame, scanned: DataFrame, baseline: DataFrame) -> DataFrame:
    """D4, N18. Staged and committed contents that were neither verified nor there at the session's start: rel, reason, once each.

    blobs: rel, reason (committed or staged), digest (null: nothing there, so nothing to gate).
    """
    known = scanned.select("rel", "digest").unionByName(baseline.select("rel", "digest"))
    return blobs.where("digest is not null").join(known, ["rel", "digest"], "left_anti").select("rel", "reason").distinct()


def pruned_missing(units: DataFrame, defined: DataFrame, file: str = "file") -> DataFrame:
    """D11. units without those of the files listed whose function the file defines no more. defined: file, function; a file listed without functions has one row with null."""
    listed = defined.select(file).distinct()
    kept = units.join(listed, file, "left_anti")
    return kept.unionByName(units.join(listed, file, "left_semi").join(defined.where("function is not null").distinct(), [file, "function"], "left_semi").select(*kept.columns))


def prune_deleted(units: DataFrame, files: DataFrame, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """D12. (units whose file exists or is not known, the pruned unit ids, the other tables without the rows of gone files).

    Only a file that a pruned unit names counts as gone; other records stay.
    """
    here = files.select(F.col("rel").alias("file")).distinct()
    gone_units = units.where("file is not null").join(here, "file", "left_anti")
    gone = gone_units.select(F.col("file").alias("rel")).distinct()
    kept = units.join(gone_units.select("unit_id"), "unit_id", "left_anti")
    return kept, gone_units.select("unit_id"), {name: t.join(gone, "rel", "left_anti") for name, t in tables.items()}


def in_scope(rows: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """C3, C4, C5 (what of it is relational), C10. C sources within the project that the patterns let through; an untracked snapshot is left out only where it is known to be untracked."""
    inside = ~F.col("rel").rlike(r"^(\.\.(/|$)|/)")
    snapshot = F.coalesce(F.col("is_snapshot") & ~F.col("tracked"), F.lit(False)) if {"is_snapshot", "tracked"} <= set(rows.columns) else F.lit(False)
    return rows.where(inside & names.is_c_source(F.col("rel")) & names.included(F.col("rel"), include, exclude) & ~snapshot)


def begin(units: DataFrame, pending: DataFrame, run: DataFrame, defined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K4, K5. State after a run has begun: each function of its files recorded as unknown, and the marker of each file with one more attempt.

    run: rel, digest, pid. defined: file, function, k. A marker of other content starts again at 1.
    """
    ids = F.concat_ws("::", "file", "function")
    fresh = defined.select(ids.alias("unit_id"), "file", "function", F.lit("unknown").alias("verdict"), F.col("k").cast("int").alias("k"), F.lit(None).cast("string").alias("counterexample"), F.lit("verification pending").alias("detail"))
    kept = units.join(fresh.select("unit_id"), "unit_id", "left_anti").select(*fresh.columns)
    was = unfinished(pending).select("rel", F.col("hash").alias("digest"), "attempts")
    marks = run.join(was, ["rel", "digest"], "left").select("rel", F.col("digest").alias("hash"), F.least(F.coalesce("attempts", F.lit(0)) + 1, F.lit(MAX_PENDING)).cast("int").alias("attempts"), "pid")
    others = pending.join(run.select("rel"), "rel", "left_anti").select("rel", "hash", "attempts", "pid")
    return kept.unionByName(fresh), others.unionByName(marks)


def landed(units: DataFrame, verdicts: DataFrame, scanned: DataFrame) -> DataFrame:
    """K2, K3. units after verdicts (with rel, digest of their run): one lands only if its content is still the last one scanned; later ones (order) win."""
    current = verdicts.join(scanned.select("rel", "digest"), ["rel", "digest"], "left_semi")
    last = current.groupBy("unit_id").agg(F.max(F.struct("order", *[c for c in units.columns if c != "unit_id"])).alias("m")).select("unit_id", "m.*").select(*units.columns)
    return units.join(last.select("unit_id"), "unit_id", "left_anti").select(*units.columns).unionByName(last)


def withdrawn(units: DataFrame, scanned: DataFrame, files: DataFrame, run: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K6. State after a run whose files changed under it: their verdicts are unknown again and their stamp is gone, so the next scan verifies them.

    run: rel, digest at its start. A file that cannot be read has drifted too.
    """
    now = files.select("rel", F.col("digest").alias("__now"))
    drifted = run.join(now, "rel", "left").where(~F.col("digest").eqNullSafe(F.col("__now"))).select("rel").distinct()
    marked = units.join(drifted.select(F.col("rel").alias("file"), F.lit(True).alias("__d")), "file", "left")
    undone = marked.withColumns({"verdict": F.when(F.col("__d"), "unknown").otherwise(F.col("verdict")), "counterexample": F.when(F.col("__d").isNull(), F.col("counterexample")), "detail": F.when(F.col("__d"), "changed while it was verified").otherwise(F.col("detail"))})
    return undone.select(*units.columns), scanned.join(drifted, "rel", "left_anti")


def cleared(pending: DataFrame, run: DataFrame) -> DataFrame:
    """K7. pending without the markers that the run itself set: same file, content and process. Attempts do not count, they are shared."""
    mine = run.select("rel", F.col("digest").alias("hash"), "pid")
    return pending.join(mine, ["rel", "hash", "pid"], "left_anti").select(*pending.columns)


def baseline(state_empty: Column, files: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K8. scanned and baseline_blobs of a session's start: what is there is not the session's doing. Nothing where the state is not fresh."""
    return files.where("digest is not null").where(state_empty).select("rel", "digest"), blobs.where("digest is not null").where(state_empty).select("rel", "digest").distinct()


def stop_decision(stops: DataFrame, most: int = MAX_STOPS) -> DataFrame:
    """K9. What each stop is told: block, residual (blocked too often, let go with a warning), or allow with or without notes.

    stops: n_unverified, n_oob, n_blob, n_needs_contract, n_notes (semantic findings of any kind), stop_attempts (before). A null count counts as outstanding.
    """
    some = lambda c: F.coalesce(F.col(c) > 0, F.lit(True))
    out = reduce(Column.__or__, map(some, ("n_unverified", "n_oob", "n_blob")))
    n = F.coalesce("stop_attempts", F.lit(0)) + 1
    decision = (
        F.when(out & (n > most), "residual").when(out, "block").when(some("n_needs_contract"), "allow_needs_contract").when(some("n_notes"), "allow_semantic_check").otherwise("allow")
    )
    return stops.withColumns({"decision": decision, "attempt": F.when(out, n).otherwise(0), "n_outstanding": F.coalesce("n_unverified", F.lit(0)) + F.coalesce("n_oob", F.lit(0)) + F.coalesce("n_blob", F.lit(0))})


def status_records(text: Column) -> Column:
    """A8. Records (xy, path) of NUL-separated status text, in order. A rename's or copy's source, the next field, is no record; fields of three characters or less are none."""
    fields = F.split(text, "\x00")
    acc = F.struct(F.lit(False).alias("skip"), F.array().cast("array<struct<xy:string,path:string>>").alias("out"))

    def step(a, field):
        short = F.length(field) < 4
        xy = F.substring(field, 1, 2)
        one = F.struct(xy.alias("xy"), F.substring(field, F.lit(4), F.length(field)).alias("path"))
        return (
            F.when(a["skip"], F.struct(F.lit(False).alias("skip"), a["out"].alias("out")))
            .when(short, F.struct(F.lit(False).alias("skip"), a["out"].alias("out")))
            .otherwise(F.struct(xy.rlike("[RC]").alias("skip"), F.array_append(a["out"], one).alias("out")))
        )

    return F.aggregate(fields, acc, step, lambda a: a["out"])


def changed_paths(records: Column) -> Column:
    """A8, A9. Paths of status records; null stays null: unavailable is not clean."""
    return F.transform(records, lambda r: r["path"])


def staged_paths(records: Column) -> Column:
    """A8, A9. Paths whose index differs from the last commit."""
    return F.transform(F.filter(records, lambda r: ~F.substring(r["xy"], 1, 1).isin(" ", "?")), lambda r: r["path"])


def first_definitions(units: DataFrame, order: list[str], by: tuple[str, ...] = ("tu", "name")) -> DataFrame:
    """N5. The first definition of each name."""
    whole = F.struct(*[c for c in units.columns if c not in by])
    return units.groupBy(*by).agg(F.min_by(whole, F.struct(*order)).alias("u")).select(*by, "u.*")


def listed(units: DataFrame, file: str = "file") -> DataFrame:
    """N14. Units of C sources; a header or another file lists none."""
    return units.where(names.is_c_source(F.col(file)))


def attempts_in_session(stops: DataFrame, session: str, order: str) -> DataFrame:
    """F7 over recorded stops: the counter that each one finds, reset by an edit. Sorts a session's rows."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    edits = F.sum(F.coalesce(F.col("type") == "edit", F.lit(False)).cast("int")).over(w)
    rows = stops.withColumn("__island", edits)
    return rows.withColumn("stop_attempts", F.sum((F.col("type") == "stop").cast("int")).over(Window.partitionBy(session, "__island").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))).drop("__island")


def baselined(entries: Column, rel: str) -> Column:
    """N18. The contents that a baseline document (JSON text: path to list of digests) holds of a path; none where the document or the entry is malformed."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.from_json(entries, "map<string,array<string>>")[rel], none)
