"""K2 to K7 as a keyed stream: the state of the gate per file, kept by Spark's state store, and the log of its changes.

Writers append commands; a command never reads state. One stateful operator applies them, file by file: what the reference
does under a lock is here the order of one key's rows. Each command gives its changes as rows, so that the
gate's present state, its counters and its history are views of one log. State is versioned by the stream's checkpoint: a
batch that is tried again starts from the state before it, and only files that a batch names are touched.

Commands (see COMMAND) of a file, in order of `at`, then of kind as listed, then of their other fields:

- begin: a run of `digest` by `pid` has listed `functions` with bound k. The content is stamped, functions that it defines no
  more are pruned, the others stand as unknown until their verdict comes, and the marker counts one more attempt on
  this content, at most MAX_PENDING; other content starts again at 1.
- verdict: of `function` in `digest`. It lands only while the content is the one stamped last; else it is stale. A
  verdict older than the one that stands is late.
- drift: at the run's end the file's content is `now` (null: it cannot be read). If that is not `digest`, and `digest` is what
  is stamped, all its verdicts are withdrawn and the stamp is gone, so the next scan verifies it anew.
- clear: takes the marker away if it is that of this content and process.
- delete: the file is gone, with all that is kept of it.

Other kinds change nothing and come out as unknown. Rows of one file in one batch are sorted in memory; the stream's limits on
files or rows a batch bound them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.gate import MAX_PENDING
from ..sources import settings

KINDS = ("begin", "verdict", "drift", "clear", "delete")
COMMAND = "rel string, at long, kind string, digest string, now string, pid long, functions array<string>, function string, verdict string, k int, counterexample string, detail string"
#: n counts a file's changes from 0; old and new are a unit's verdicts, null where there is none.
CHANGE = "rel string, n long, at long, kind string, outcome string, function string, old string, new string, k int, counterexample string, detail string, digest string, attempts int"
#: Outcomes that change a unit's verdict, or leave it without one.
EFFECTIVE = ("recorded", "pruned", "landed", "withdrawn", "gone")
#: What the stream's session needs: state in RocksDB, and no batches without rows, as a clock for expiry would ask for them without end.
SESSION = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class FileState(StatefulProcessor):
    """The state of one file: its stamp, its marker, its units and the number of its changes. A batch reads it once, folds the file's commands over it, and writes what is other than before."""

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.file = handle.getValueState("file", "digest string, hash string, attempts int, pid long, n long", self.keep_ms)
        self.units = handle.getMapState("units", "function string", "verdict string, k int, at long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rank = {kind: i for i, kind in enumerate(KINDS)}
        last = lambda r: (r.at is None, r.at or 0, rank.get(r.kind, len(KINDS)), r.function or "", r.digest or "", r.verdict or "", r.k or 0, r.pid or 0)
        stamp, *marker, n = self.file.get() if self.file.exists() else (None, None, 0, None, 0)
        before = {f[0]: tuple(v) for f, v in self.units.iterator()} if n else {}
        fold = _Fold(stamp, tuple(marker), dict(before))
        for row in sorted(rows, key=last):
            for change in getattr(fold, row.kind if row.kind in KINDS else "other")(row):
                c = dict.fromkeys(("outcome", "function", "old", "new", "k", "counterexample", "detail", "attempts")) | change
                yield Row(rel=key[0], n=n, at=row.at, kind=row.kind, outcome=c["outcome"], function=c["function"], old=c["old"], new=c["new"], k=c["k"], counterexample=c["counterexample"], detail=c["detail"], digest=row.digest, attempts=c["attempts"])
                n += 1
        for function in before.keys() - fold.units.keys():
            self.units.removeKey((function,))
        for function, unit in fold.units.items():
            if before.get(function) != unit:
                self.units.updateValue((function,), unit)
        self.file.update((fold.stamp, *fold.marker, n))

    def close(self) -> None:
        pass


NO_MARKER = (None, 0, None)


class _Fold:
    """What each command makes of one file: stamp, marker (content, attempts, process) and units (verdict, k, at)."""

    def __init__(self, stamp: str | None, marker: tuple, units: dict):
        self.stamp, self.marker, self.units = stamp, marker, units

    def _old(self, function):
        return self.units[function][0] if function in self.units else None

    def begin(self, row):
        self.stamp, listed = row.digest, dict.fromkeys(row.functions or [])
        for function in sorted(self.units.keys() - listed.keys(), key=str):
            yield {"outcome": "pruned", "function": function, "old": self.units.pop(function)[0]}
        attempts = min((self.marker[1] if self.marker[0] == row.digest else 0) + 1, MAX_PENDING)
        self.marker = (row.digest, attempts, row.pid)
        yield {"outcome": "begun", "k": row.k, "attempts": attempts}
        for function in listed:
            old, self.units[function] = self._old(function), ("unknown", row.k, row.at)
            yield {"outcome": "recorded", "function": function, "old": old, "new": "unknown", "k": row.k, "detail": "verification pending"}

    def verdict(self, row):
        old = self._old(row.function)
        if row.digest is None or self.stamp != row.digest:
            yield {"outcome": "stale", "function": row.function, "old": old, "new": old}
        elif old is not None and self.units[row.function][2] is not None and (row.at is None or row.at < self.units[row.function][2]):
            yield {"outcome": "late", "function": row.function, "old": old, "new": old}
        else:
            # No word at all is an error; any other word stands as it came, and blocks unless it is a pass.
            new = row.verdict or "error"
            self.units[row.function] = (new, row.k, row.at)
            yield {"outcome": "landed", "function": row.function, "old": old, "new": new, "k": row.k, "counterexample": row.counterexample, "detail": row.detail}

    def drift(self, row):
        if row.digest is None or self.stamp != row.digest or row.now == row.digest:
            yield {"outcome": "steady"}
            return
        self.stamp = None
        for function, (old, k, _) in sorted(self.units.items(), key=lambda u: str(u[0])):
            self.units[function] = ("unknown", k, row.at)
            yield {"outcome": "withdrawn", "function": function, "old": old, "new": "unknown", "k": k, "detail": "changed while it was verified"}

    def clear(self, row):
        content, attempts, process = self.marker
        mine = attempts > 0 and (content, process) == (row.digest, row.pid)
        self.marker = NO_MARKER if mine else self.marker
        yield {"outcome": "cleared" if mine else "kept", "attempts": attempts or None}

    def delete(self, row):
        for function, (old, *_) in sorted(self.units.items(), key=lambda u: str(u[0])):
            yield {"outcome": "gone", "function": function, "old": old}
        self.stamp, self.marker, self.units = None, NO_MARKER, {}
        yield {"outcome": "deleted"}

    def other(self, row):
        yield {"outcome": "unknown", "function": row.function}


def changes(commands: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """The changes that commands make, file by file. keep_ms: how long state lives after its last write; a file not heard of for longer starts anew."""
    return commands.groupBy("rel").transformWithState(FileState(keep_ms), CHANGE, "Append", "None" if keep_ms is None else "ProcessingTime")


def follow(spark: SparkSession, commands: str, log: str, checkpoint: str, keep_ms: int | None = None, files_per_batch: int = 256) -> StreamingQuery:
    """Apply the commands (JSON lines) that have come to a folder to the state behind `checkpoint`; their changes go to `log`, each once. Ends with what is there."""
    with settings.session(spark, SESSION):
        rows = spark.readStream.schema(COMMAND).option("maxFilesPerTrigger", files_per_batch).json(commands)
        return changes(rows, keep_ms).writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standing(log: DataFrame) -> DataFrame:
    """K2. The units as they stand after a log of changes: rel, function, verdict, k, counterexample, detail, digest."""
    own = [c for c in log.columns if c not in ("rel", "function")]
    last = log.where(F.col("outcome").isin(*EFFECTIVE)).groupBy("rel", "function").agg(F.max_by(F.struct(*own), "n").alias("c"))
    return last.where("c.new is not null").select("rel", "function", F.col("c.new").alias("verdict"), "c.k", "c.counterexample", "c.detail", "c.digest")


def markers(log: DataFrame) -> DataFrame:
    """K5, K7. Files whose verification has not ended: rel, digest, attempts."""
    last = log.where(F.col("outcome").isin("begun", "cleared", "deleted")).groupBy("rel").agg(F.max_by(F.struct("outcome", "digest", "attempts"), "n").alias("c"))
    return last.where("c.outcome = 'begun'").select("rel", "c.digest", "c.attempts")


def counters(log: DataFrame, by: list[Column | str] | None = None) -> DataFrame:
    """E5, N13 kept up: each change takes its old verdict away and adds its new one, so a stream of changes needs no state but the sums."""
    fails = lambda c: (~F.coalesce(F.col(c).isin("verified", "needs_contract"), F.lit(False)) & F.col(c).isNotNull()).cast("long")
    waits = lambda c: F.coalesce((F.col(c) == "needs_contract").cast("long"), F.lit(0))
    there = lambda c: F.col(c).isNotNull().cast("long")
    net = lambda f, name: F.sum(f("new") - f("old")).alias(name)
    return log.where(F.col("outcome").isin(*EFFECTIVE)).groupBy(*(by or [])).agg(net(there, "n_units"), net(fails, "n_failures"), net(waits, "n_needs_contract"))
