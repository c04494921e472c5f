"""A1, B1 to B3, L5: the property store as a log of commands that a keyed stream judges.

Writers append commands and never look at the store first, so two that add the same property at once cannot both pass a
test: the stream takes one property's commands one after another, in order of `at` within a batch, and says for each
what became of it. Its state is a property's status; the log of outcomes holds the store's rows, and a batch's outcomes are seen
whole or not at all. One process at a time runs the stream; any number may write.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import schemas
from ..operators import properties
from ..schemas import MOVES, DuplicateProperty, InvalidStatusTransition, PropertyNotFound, PropertyStoreError
from ..sources import settings
from .gate_state import SESSION

FIELDS = [(name, kind) for name, kind in (f.split(" ", 1) for f in schemas.PROPERTY.split(", ")) if name not in ("ord", "property_id", "status")]
PROPERTY_OF = f"struct<{','.join(f'{n}:{t}' for n, t in FIELDS)}>"
#: op: add (an id that is taken is a failure), absent (it is none) or move. at: place in the order of all commands, as far as clocks agree.
COMMAND = f"property_id string, at long, call string, op string, status string, property {PROPERTY_OF}"
#: outcome: added, duplicate, present, moved, invalid or unknown_id. n counts a property's commands from 0.
OUTCOME = f"property_id string, n long, at long, call string, op string, outcome string, old string, status string, property {PROPERTY_OF}"


class OneProperty(StatefulProcessor):
    """The status of one property and the number of its commands."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("property", "status string, n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, n = self.state.get() if self.state.exists() else (None, 0)
        for row in sorted(rows, key=lambda r: (r.at, r.call or "", r.op or "", r.status or "")):
            old, new = status, status
            if row.op in ("add", "absent"):
                outcome = "added" if status is None else "duplicate" if row.op == "add" else "present"
                new = row.status if status is None else status
            elif status is None:
                outcome = "unknown_id"
            else:
                outcome = "moved" if (status, row.status) in MOVES else "invalid"
                new = row.status if outcome == "moved" else status
            yield Row(property_id=key[0], n=n, at=row.at, call=row.call, op=row.op, outcome=outcome, old=old, status=new, property=row.property if outcome == "added" else None)
            status, n = new, n + 1
        self.state.update((status, n))

    def close(self) -> None:
        pass


def judged(commands: DataFrame) -> DataFrame:
    """The outcome of each command, property by property."""
    return commands.groupBy("property_id").transformWithState(OneProperty(), OUTCOME, "Append", "None")


def stored(outcomes: DataFrame) -> DataFrame:
    """The properties that a log of outcomes leaves (schemas.PROPERTY), with their present status; ord is the `at` of their insertion."""
    added = F.col("outcome") == "added"
    rows = outcomes.groupBy("property_id").agg(F.max_by("status", "n").alias("status"), F.max(F.when(added, F.col("at"))).alias("ord"), F.max_by(F.when(added, F.col("property")), F.when(added, F.col("n"))).alias("p"))
    names = [f.split(" ", 1)[0] for f in schemas.PROPERTY.split(", ")]
    return rows.where("ord is not null").select(*[F.col(n) if n in ("ord", "property_id", "status") else F.col(f"p.{n}") for n in names])


class PropertyStore:
    """The store below a folder: `commands`, `outcomes` and the stream's checkpoint."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def submit(self, rows: DataFrame, op: str, order: list[str]) -> str:
        """Append commands; returns the name of the call. rows: schemas.PROPERTY without ord for add and absent, property_id and status for move."""
        call = uuid.uuid4().hex
        if op != "move":
            rows, bad = properties.checked(rows)
            if (first := bad.first()) is not None:
                raise PropertyStoreError(f"malformed property {first['property_id']}: {first['reject_reason']}")
            rows = rows.withColumn("created_at", F.coalesce("created_at", F.current_timestamp())).withColumn("property", F.struct(*[n for n, _ in FIELDS]))
        else:
            rows = rows.withColumn("property", F.lit(None).cast(PROPERTY_OF))
        # A call's commands are few (one reply of a model, one edit); their order is that of the call.
        spot = F.row_number().over(Window.orderBy(*order)) - 1
        commands = rows.select("property_id", (F.unix_micros(F.current_timestamp()) + spot).alias("at"), F.lit(call).alias("call"), F.lit(op).alias("op"), "status", "property")
        commands.write.mode("append").parquet(f"{self.root}/commands")
        return call

    def follow(self, files_per_batch: int = 256) -> StreamingQuery:
        """Judge the commands that have come; ends with what is there."""
        with settings.session(self.spark, SESSION):
            commands = self.spark.readStream.schema(COMMAND).option("maxFilesPerTrigger", files_per_batch).parquet(f"{self.root}/commands")
            return judged(commands).writeStream.format("parquet").option("path", f"{self.root}/outcomes").option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()

    @property
    def outcomes(self) -> DataFrame:
        try:
            return self.spark.read.schema(OUTCOME).parquet(f"{self.root}/outcomes")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], OUTCOME)

    @property
    def properties(self) -> DataFrame:
        return stored(self.outcomes)

    def _settled(self, call: str) -> DataFrame:
        self.follow().awaitTermination()
        return self.outcomes.where(F.col("call") == call)

    def add(self, rows: DataFrame, order: list[str]) -> None:
        """B1. Each row is an insertion of its own; raises for the first id that was taken."""
        taken = self._settled(self.submit(rows, "add", order)).where("outcome = 'duplicate'").orderBy("at").first()
        if taken:
            raise DuplicateProperty(taken["property_id"])

    def add_absent(self, rows: DataFrame, order: list[str]) -> int:
        """B2. Returns how many were new."""
        return self._settled(self.submit(rows, "absent", order)).where("outcome = 'added'").count()

    def get(self, property_id: str) -> Row | None:
        """A2."""
        return properties.by_id(self.properties, property_id).first()

    def list_for_unit(self, unit_id: str, statuses: tuple[str, ...] | None = None) -> DataFrame:
        """C1, G1."""
        return properties.in_order(properties.for_unit(self.properties, unit_id, statuses))

    def update_status(self, property_id: str, status: str) -> Row:
        """B3. The property after the move; raises for an unknown id and for a move that is not allowed."""
        wanted = self.spark.createDataFrame([(property_id, status)], "property_id string, status string")
        told = self._settled(self.submit(wanted, "move", ["property_id"])).first()
        if told["outcome"] == "unknown_id":
            raise PropertyNotFound(property_id)
        if told["outcome"] == "invalid":
            raise InvalidStatusTransition(f"{told['old']} -> {status} is not an allowed status transition")
        return self.get(property_id)
