"""The keyed streams, bound to `events` and `orders`: commands are read off the rows, and the state is that of the stateful operators.

A log of events is written and read by its bytes; edits meet verdicts in time. An event is a command on its user's file, in order of event_id; an order row is a command on a property that up to eight
orders share. Both go through the operators whole, and their changes are written once, below spark.checkpoint.dir, and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import log_source, settings
from ..sources.shared import new_folder
from ..streaming import gate_state, property_store, state
from .base import Relation, query

COMMANDS = Relation(
    "SELECT 'f' || CAST(user_id AS {str}) || '.c' AS rel, event_id AS pos, CASE event_type WHEN 'purchase' THEN 'begin' WHEN 'signup' THEN 'drift' WHEN 'error' THEN 'clear' ELSE 'verdict' END AS kind, 'd' || CAST({k} % 2 AS {str}) AS digest, CASE WHEN event_id % 4 = 0 THEN 'other' ELSE 'd' || CAST({k} % 2 AS {str}) END AS now, "
    "user_id % 3 AS pid, CASE event_id % 3 WHEN 0 THEN {list}('a', 'b') WHEN 1 THEN {list}('c') ELSE {list}('a', 'b', 'c') END AS functions, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS function, "
    "CASE event_id % 5 WHEN 0 THEN 'violated' WHEN 1 THEN 'needs_contract' WHEN 2 THEN 'unknown' ELSE 'verified' END AS verdict, {k} AS k FROM {events}"
)
C = {"commands": COMMANDS}
# From a file's last begin on: the stamp holds until the first drift of its content; verdicts of that content land before it.
_UNITS = """b AS (SELECT rel, max(pos) AS pos FROM commands WHERE kind = 'begin' GROUP BY rel), s AS (SELECT c.* FROM commands c JOIN b USING (rel, pos)),
    x AS (SELECT s.rel, min(c.pos) AS pos FROM s JOIN commands c ON c.rel = s.rel AND c.pos > s.pos AND c.kind = 'drift' AND c.digest = s.digest AND c.now <> c.digest GROUP BY s.rel),
    e AS (SELECT rel, unnest(functions) AS function, 'unknown' AS verdict, k, pos FROM s UNION ALL
          SELECT c.rel, c.function, c.verdict, c.k, c.pos FROM s JOIN commands c ON c.rel = s.rel AND c.pos > s.pos AND c.kind = 'verdict' AND c.digest = s.digest LEFT JOIN x ON x.rel = s.rel WHERE x.pos IS NULL OR c.pos < x.pos),
    u AS (SELECT e.rel, e.function, CASE WHEN x.pos IS NULL THEN e.verdict ELSE 'unknown' END AS verdict, e.k FROM e LEFT JOIN x USING (rel) QUALIFY row_number() OVER (PARTITION BY e.rel, e.function ORDER BY e.pos DESC) = 1)"""


def _written(spark: SparkSession, rows: DataFrame, schema: str) -> DataFrame:
    """The output of a stateful operator over a whole table, computed once."""
    folder = new_folder(spark, "changes")
    _ = spark.streams.active  # starts what hands out state stores, which else a session's first stream does
    with settings.session(spark, gate_state.SESSION):
        rows.write.parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def _changes(commands: DataFrame) -> DataFrame:
    text = F.lit(None).cast("string")
    return _written(commands.sparkSession, gate_state.changes(commands.withColumns({"counterexample": text, "detail": text}).withColumnRenamed("pos", "at")), gate_state.CHANGE)


@query("k3_keyed_units", C, f"WITH {_UNITS} SELECT rel, function, verdict, k FROM u")
def k3_keyed(commands):
    return gate_state.standing(_changes(commands)).select("rel", "function", "verdict", "k")


@query("e5_kept_counters", C, f"WITH {_UNITS} SELECT rel, count(function) AS n_units, count(*) FILTER (WHERE verdict NOT IN ('verified', 'needs_contract')) AS n_failures, count(*) FILTER (WHERE verdict = 'needs_contract') AS n_needs_contract FROM u GROUP BY rel")
def e5_kept(commands):
    return gate_state.counters(_changes(commands), ["rel"]).where("n_units > 0")


@query("k7_open_markers", C, """WITH m AS (SELECT *, lag(kind) OVER w AS was FROM commands WHERE kind = 'begin' WINDOW w AS (PARTITION BY rel ORDER BY pos)),
    b AS (SELECT rel, pos, digest, pid, row_number() OVER (PARTITION BY rel ORDER BY pos DESC) AS back FROM m)
    SELECT rel, digest FROM b WHERE back = 1 AND NOT EXISTS (SELECT 1 FROM commands c WHERE c.kind = 'clear' AND c.rel = b.rel AND c.pos > b.pos AND c.digest = b.digest AND c.pid = b.pid)""")
def k7_open(commands):
    return gate_state.markers(_changes(commands)).select("rel", "digest")


PROPERTY_COMMANDS = Relation("SELECT 'p' || CAST(o_orderkey {div} 8 AS {str}) AS property_id, o_orderkey AS pos, 'u' || CAST(o_custkey % 9 AS {str}) AS unit_id, CASE o_orderkey % 8 WHEN 0 THEN 'move' WHEN 1 THEN 'add' WHEN 2 THEN 'add' WHEN 3 THEN 'absent' ELSE 'move' END AS op, CASE WHEN o_orderkey % 8 IN (1, 2, 3) THEN 'candidate' WHEN o_custkey % 3 = 0 THEN 'graded' WHEN o_custkey % 3 = 1 THEN 'accepted' ELSE 'rejected' END AS status FROM {orders}")


@query("b1_judged_commands", {"commands": PROPERTY_COMMANDS}, """WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY pos) - 1 AS n FROM commands),
    w AS (SELECT property_id, n, pos, op, status AS wanted, CAST(NULL AS VARCHAR) AS old, CASE WHEN op <> 'move' THEN status END AS status, CASE WHEN op <> 'move' THEN 'added' ELSE 'unknown_id' END AS outcome FROM c WHERE n = 0
        UNION ALL SELECT c.property_id, c.n, c.pos, c.op, c.status, w.status, CASE WHEN c.op <> 'move' THEN coalesce(w.status, c.status) WHEN (w.status, c.status) IN (('candidate', 'graded'), ('candidate', 'rejected'), ('graded', 'accepted'), ('graded', 'rejected')) THEN c.status ELSE w.status END,
            CASE WHEN c.op <> 'move' THEN CASE WHEN w.status IS NULL THEN 'added' WHEN c.op = 'add' THEN 'duplicate' ELSE 'present' END WHEN w.status IS NULL THEN 'unknown_id' WHEN (w.status, c.status) IN (('candidate', 'graded'), ('candidate', 'rejected'), ('graded', 'accepted'), ('graded', 'rejected')) THEN 'moved' ELSE 'invalid' END
        FROM w JOIN c ON c.property_id = w.property_id AND c.n = w.n + 1)
    SELECT property_id, n, pos, op, outcome, old, status FROM w""")
def b1_judged(commands):
    prop = F.struct(*[(F.col(n) if n == "unit_id" else F.lit(None)).cast(t).alias(n) for n, t in property_store.FIELDS])
    rows = commands.select("property_id", F.col("pos").cast("long").alias("at"), F.lit("call").alias("call"), "op", "status", prop.alias("property"))
    return _written(commands.sparkSession, property_store.judged(rows), property_store.OUTCOME).select("property_id", "n", F.col("at").alias("pos"), "op", "outcome", "old", "status")


# A trace log: one line an event, some of them blank and some no JSON.
LOGGED = Relation(
    "SELECT CASE event_id % 10 WHEN 0 THEN 'no json ' || CAST(event_id AS {str}) WHEN 1 THEN '  ' ELSE '{{\"ts\":' || CAST(event_id AS {str}) || ',\"type\":\"' || event_type || '\",\"k\":' || CAST(coalesce({k}, 0) AS {str}) || '}}' END AS line, "
    "event_id, event_type, coalesce({k}, 0) AS k FROM {events}"
)


@query("a3_log_events", {"logged": LOGGED}, "SELECT CASE WHEN event_id % 10 > 1 THEN CAST(event_id AS DOUBLE) END AS ts, CASE WHEN event_id % 10 > 1 THEN event_type END AS type, CASE WHEN event_id % 10 > 1 THEN CAST(k AS INTEGER) END AS k, CASE WHEN event_id % 10 = 0 THEN line END AS malformed FROM logged WHERE event_id % 10 <> 1")
def a3(logged):
    spark, folder = logged.sparkSession, new_folder(logged.sparkSession, "log")
    logged.select("line").write.text(folder)
    return log_source.events(log_source.lines(spark, folder)).select("ts", "type", "k", "malformed")


EDITS = Relation("SELECT 'f' || CAST(user_id AS {str}) AS rel, 'd' || CAST(coalesce({k}, 0) % 3 AS {str}) AS digest, ts AS edited_at FROM {events} WHERE event_type IN ('signup', 'purchase')")
JUDGED = Relation("SELECT 'f' || CAST(user_id AS {str}) AS rel, 'd' || CAST(coalesce({k}, 0) % 3 AS {str}) AS digest, ts AS judged_at, 'v' || CAST(event_id AS {str}) AS verdict FROM {events} WHERE event_type IN ('click', 'view')")


@query("d2_unanswered_edits", {"edits": EDITS, "judged": JUDGED}, """SELECT e.rel, e.digest, edited_at, judged_at, verdict, CASE WHEN judged_at IS NULL THEN 'stale' ELSE 'judged' END AS status
    FROM edits e LEFT JOIN judged v ON v.rel = e.rel AND v.digest = e.digest AND judged_at >= edited_at AND judged_at <= edited_at + INTERVAL 1 DAY""")
def d2_unanswered(edits, judged):
    return state.unanswered(edits, judged, within="1 day")
