"""Operators on the property store and the gate's state, bound to `orders`, `lineitem`, `documents` and `labels`.

A unit is an order's customer, a property an order; a file is a document, scanned where it has a label, pending where
its id says so. Digests are those of the texts; the id decides which were another text's.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gate, properties
from ..sources import readers
from .base import Relation, query

STORE = Relation(
    "SELECT o_orderkey AS ord, 'p' || CAST(o_orderkey AS {str}) AS property_id, 'u' || CAST(o_custkey AS {str}) AS unit_id, CASE WHEN o_orderkey % 5 = 0 THEN 'reachability' ELSE 'semantic' END AS kind, 'result > ' || CAST(o_orderkey % 3 AS {str}) AS expression, CASE o_orderkey % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'graded' WHEN 2 THEN 'accepted' ELSE 'rejected' END AS status, "
    "CASE o_orderkey % 11 WHEN 0 THEN 'render failed' END AS render_error FROM {orders} WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0"
)
NEW = Relation("SELECT o_orderkey AS ord, 'p' || CAST(o_orderkey - o_orderkey % 2 AS {str}) AS property_id, 'u' || CAST(o_custkey AS {str}) AS unit_id FROM {orders} WHERE o_orderkey % 7 < 4")
WANTED = Relation("SELECT 'p' || CAST(o_orderkey AS {str}) AS property_id, CASE o_orderkey % 3 WHEN 0 THEN 'graded' WHEN 1 THEN 'accepted' ELSE 'rejected' END AS new_status FROM {orders}")
_MOVES = "(VALUES ('candidate', 'graded'), ('candidate', 'rejected'), ('graded', 'accepted'), ('graded', 'rejected')) m(status, new_status)"


@query("a2_get", {"store": STORE}, "SELECT ord, status FROM store WHERE property_id = 'p12'")
def a2(store):
    return properties.by_id(store, "p12").select("ord", "status")


@query("b1_duplicates", {"store": STORE, "new": NEW}, "SELECT DISTINCT property_id FROM new WHERE property_id IN (SELECT property_id FROM store) OR property_id IN (SELECT property_id FROM new GROUP BY 1 HAVING count(*) > 1)")
def b1(store, new):
    return properties.duplicates(store, new)


@query("b2_insert_absent", {"store": STORE, "new": NEW}, "SELECT property_id, ord, unit_id FROM new WHERE property_id NOT IN (SELECT property_id FROM store) QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY ord) = 1")
def b2(store, new):
    return properties.insert_absent(store, new, ["ord"])


@query("b3_judged_moves", {"store": STORE, "wanted": WANTED}, f"SELECT w.property_id, w.new_status, s.status, CASE WHEN s.status IS NULL THEN 'unknown_id' WHEN (s.status, w.new_status) IN (SELECT (status, new_status) FROM {_MOVES}) THEN 'ok' ELSE 'invalid' END AS verdict FROM wanted w LEFT JOIN store s USING (property_id)")
def b3(store, wanted):
    return properties.judged_moves(store, wanted, properties.transitions(store.sparkSession)).select("property_id", "new_status", "status", "verdict")


@query("d15_moved_store", {"store": STORE, "wanted": WANTED}, f"SELECT property_id, coalesce(m.new_status, s.status) AS status FROM store s LEFT JOIN wanted w USING (property_id) LEFT JOIN {_MOVES} ON m.status = s.status AND m.new_status = w.new_status")
def d15(store, wanted):
    return properties.moved(store, wanted, properties.transitions(store.sparkSession)).select("property_id", "status")


@query("c1_for_unit", {"store": STORE}, "SELECT u.n, ord, property_id, status FROM store, (VALUES (0), (1), (2)) u(n) WHERE unit_id = 'u7' AND (u.n = 0 OR (u.n = 1 AND status IN ('candidate', 'graded')))")
def c1(store):
    from functools import reduce

    parts = [properties.for_unit(store, "u7", s).select(F.lit(n).alias("n"), "ord", "property_id", "status") for n, s in enumerate((None, ("candidate", "graded"), ()))]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("g1_insertion_order", {"store": STORE}, "SELECT unit_id, string_agg(property_id, ',' ORDER BY ord) AS ids FROM store GROUP BY unit_id")
def g1(store):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", "property_id"))), lambda r: r["property_id"])
    return properties.in_order(store).groupBy("unit_id").agg(F.array_join(rows, ",").alias("ids"))


@query("c8_rejected_rows", {"store": STORE}, "SELECT ord, CASE WHEN ord % 13 = 0 THEN 'kind' WHEN ord % 17 = 0 THEN 'status' WHEN ord % 6 = 0 THEN 'grading' WHEN ord % 10 = 0 THEN 'grading' END AS reason FROM store WHERE ord % 13 = 0 OR ord % 17 = 0 OR ord % 6 = 0 OR ord % 10 = 0")
def c8(store):
    g = "struct<verdict:string,kill_rate:double,reason:string>"
    made = lambda v, r: F.struct(F.lit(v).alias("verdict"), F.lit(r).cast("double").alias("kill_rate"), F.lit(None).cast("string").alias("reason")).cast(g)
    grading = F.when(F.col("ord") % 6 == 0, made("held", None)).when(F.col("ord") % 10 == 0, made("held", 1.5)).when(F.col("ord") % 4 == 0, made("held", 0.5))
    rows = store.withColumns({"kind": F.when(F.col("ord") % 13 != 0, F.col("kind")), "status": F.when(F.col("ord") % 17 == 0, "odd").otherwise(F.col("status")), "grading": grading})
    return properties.checked(rows)[1].select("ord", F.col("reject_reason").alias("reason"))


@query("c9_terminal_statuses", {"store": STORE}, "SELECT DISTINCT status FROM store WHERE status IN ('accepted', 'rejected')")
def c9(store):
    return properties.terminal(store.select("status").distinct(), properties.transitions(store.sparkSession))


@query("c11_payload_guards", {"store": STORE}, "SELECT ord, CASE ord % 3 WHEN 1 THEN 'units' WHEN 2 THEN 'name' END AS reason FROM store WHERE ord % 3 > 0")
def c11(store):
    text = F.when(F.col("ord") % 3 == 0, '{"units":[{"name":"f"}]}').when(F.col("ord") % 3 == 1, '{"units":{"name":"f"}}').otherwise('{"units":[{"name":7}]}')
    bad = readers.guarded(store.withColumn("payload", text), "payload", {"units": ("$.units", "ARRAY<"), "name": ("$.units[0].name", "STRING")})[1]
    return bad.select("ord", F.col("reject_reason").alias("reason"))


VERIFIED = Relation("SELECT DISTINCT 'u' || CAST(c_custkey AS {str}) AS unit_id FROM {customer} WHERE c_custkey % 3 < 2")


@query("d1_units_with_candidates", {"verified": VERIFIED, "store": STORE}, "SELECT unit_id, count(*) AS n_checkable FROM store WHERE status IN ('candidate', 'graded') AND unit_id IN (SELECT unit_id FROM verified) GROUP BY unit_id HAVING bool_or(status = 'candidate')")
def d1(verified, store):
    return properties.with_candidates(verified, store)


@query("n1_check_plan", {"store": STORE}, "SELECT ord, CASE WHEN ord % 5 = 0 THEN 'skipped' WHEN ord % 11 = 0 THEN 'error' END AS settled, CASE WHEN ord % 5 = 0 THEN 'reachability properties are not harnessed yet' WHEN ord % 11 = 0 THEN 'harness render failed: render failed' END AS skip_reason FROM store WHERE ord % 4 < 2")
def n1(store):
    return properties.check_plan(store).select("ord", "settled", "skip_reason")


# A property's attempts are an order's lines: ladder and outcome come from them (N1 after its runs, N2 with unwinding assertions on).
ATTEMPTS = Relation(
    "SELECT 'p' || CAST(l_orderkey AS {str}) AS property_id, CAST(4 * min(l_linenumber) AS INT) AS k, l_returnflag AS flag, CASE l_returnflag WHEN 'R' THEN 'violated' WHEN 'A' THEN 'verified' ELSE 'unknown' END AS verdict, min(l_partkey) AS part FROM {lineitem} GROUP BY l_orderkey, l_returnflag"
)


@query("n1_property_verdicts", {"attempts": ATTEMPTS}, """WITH r AS (SELECT *, CASE WHEN flag = 'R' AND part % 2 = 0 THEN 'unknown' ELSE verdict END AS v FROM attempts)
    SELECT property_id, CASE v WHEN 'verified' THEN 'held' ELSE v END AS outcome, k FROM r QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY v = 'unknown', CASE WHEN v = 'unknown' THEN -k ELSE k END, CASE WHEN v = 'unknown' THEN -ascii(flag) ELSE ascii(flag) END) = 1""")
def n1_verdicts(attempts):
    from ..functions import checker
    from ..operators import ladders

    none = F.lit(None).cast("string")
    raw = F.when(F.col("verdict") == "violated", F.when(F.col("part") % 2 == 0, "unwinding assertion loop 1").otherwise("array bounds violated"))
    result = checker.escalating(F.struct("verdict", none.alias("reason"), none.alias("message"), raw.alias("raw_counterexample")))
    settled = ladders.settled(attempts.withColumn("verdict", result["verdict"]), "property_id", ["k", "flag"])
    return settled.select("property_id", checker.outcome(F.col("verdict")).alias("outcome"), "k")


FILES = Relation("SELECT 'f' || CAST(doc_id AS {str}) AS rel, CASE WHEN doc_id % 23 <> 0 THEN {sha}(coalesce(text, ''){bits}) END AS digest, doc_id FROM {documents}")
SCANNED = Relation("SELECT 'f' || CAST(d.doc_id AS {str}) AS rel, {sha}(CASE WHEN d.doc_id % 7 = 0 THEN 'old' ELSE coalesce(d.text, '') END{bits}) AS digest FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id")
PENDING = Relation("SELECT 'f' || CAST(doc_id AS {str}) AS rel, {sha}(CASE WHEN doc_id % 10 = 0 THEN 'other' ELSE coalesce(text, '') END{bits}) AS hash, CASE WHEN doc_id % 25 = 0 THEN NULL ELSE CAST(doc_id % 5 AS INT) END AS attempts, doc_id % 3 AS pid FROM {documents} WHERE doc_id % 5 < 2")
UNITS = Relation(
    "SELECT 'f' || CAST(doc_id AS {str}) || '::g' || CAST(doc_id % 4 AS {str}) AS unit_id, CASE WHEN doc_id % 19 <> 0 THEN 'f' || CAST(doc_id AS {str}) END AS file, 'g' || CAST(doc_id % 4 AS {str}) AS function, CASE doc_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'violated' ELSE 'unknown' END AS verdict, 4 AS k, "
    "CASE WHEN doc_id % 3 = 1 THEN 'trace' END AS counterexample, CAST(NULL AS {str}) AS detail FROM {documents} WHERE doc_id % 2 = 0"
)
G = {"files": FILES, "scanned": SCANNED, "pending": PENDING}
_STALE = """s AS (SELECT f.rel, f.digest, f.doc_id, CASE WHEN sc.digest IS DISTINCT FROM f.digest THEN 'changed' WHEN p.hash = f.digest AND coalesce(p.attempts, 0) < 3 THEN 'unfinished' END AS reason
    FROM files f LEFT JOIN scanned sc USING (rel) LEFT JOIN pending p USING (rel) WHERE f.digest IS NOT NULL)"""


@query("d2_stale_files", G, f"WITH {_STALE} SELECT rel, reason FROM s WHERE reason IS NOT NULL")
def d2(files, scanned, pending):
    return gate.stale(files, scanned, pending).select("rel", "reason")


@query("d3_pending_retries", {"files": FILES, "pending": PENDING}, "SELECT f.rel FROM files f JOIN pending p ON f.rel = p.rel AND f.digest = p.hash")
def d3(files, pending):
    return gate.pending_retries(files, pending).select("rel")


@query("h2_sources_needing_verify", G, f"WITH {_STALE} SELECT rel, reason FROM s WHERE reason IS NOT NULL AND (doc_id % 4 = 0 OR rel IN (SELECT p.rel FROM pending p JOIN files f ON f.rel = p.rel AND f.digest = p.hash))")
def h2(files, scanned, pending):
    found = files.where("doc_id % 4 = 0").select("rel")
    return gate.sources_needing_verify(files, scanned, pending, found.unionByName(found)).select("rel", "reason")


@query("h2_outside_a_work_tree", G, f"WITH {_STALE} SELECT rel, reason FROM s WHERE reason IS NOT NULL AND rel IN (SELECT p.rel FROM pending p JOIN files f ON f.rel = p.rel AND f.digest = p.hash)")
def h2_outside(files, scanned, pending):
    return gate.sources_needing_verify(files, scanned, pending, None).select("rel", "reason")


@query("h1_discovered", {"files": FILES}, "SELECT rel, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS list, doc_id AS ord FROM files WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def h1(files):
    dirty = files.where("doc_id % 2 = 0").select("rel", F.col("doc_id").alias("ord"))
    return gate.discovered(dirty.unionByName(dirty.withColumn("ord", F.col("ord") + 1000)), files.where("doc_id % 3 = 0").select("rel", F.col("doc_id").alias("ord")))


BLOBS = Relation("SELECT 'f' || CAST(doc_id AS {str}) AS rel, CASE WHEN doc_id % 2 = 0 THEN 'staged' ELSE 'committed' END AS reason, CASE WHEN doc_id % 17 <> 0 THEN {sha}(CASE WHEN doc_id % 5 = 0 THEN 'wip' ELSE coalesce(text, '') END{bits}) END AS digest FROM {documents}")
BASELINE = Relation("SELECT 'f' || CAST(doc_id AS {str}) AS rel, {sha}('wip'{bits}) AS digest FROM {documents} WHERE doc_id % 10 = 0")


@query("d4_divergent_blobs", {"blobs": BLOBS, "scanned": SCANNED, "baseline": BASELINE}, "SELECT DISTINCT rel, reason FROM blobs b WHERE digest IS NOT NULL AND (rel, digest) NOT IN (SELECT (rel, digest) FROM scanned) AND (rel, digest) NOT IN (SELECT (rel, digest) FROM baseline)")
def d4(blobs, scanned, baseline):
    return gate.divergent_blobs(blobs.unionByName(blobs), scanned, baseline)


DEFINED = Relation("SELECT 'f' || CAST(doc_id AS {str}) AS file, CASE WHEN doc_id % 8 <> 0 THEN 'g' || CAST(doc_id % 3 AS {str}) END AS function FROM {documents} WHERE doc_id % 4 < 3")


@query("d11_pruned_missing", {"units": UNITS, "defined": DEFINED}, "SELECT unit_id FROM units u WHERE file IS NULL OR file NOT IN (SELECT file FROM defined) OR EXISTS (SELECT 1 FROM defined d WHERE d.file = u.file AND d.function = u.function)")
def d11(units, defined):
    return gate.pruned_missing(units, defined).select("unit_id")


HERE = Relation("SELECT 'f' || CAST(doc_id AS {str}) AS rel FROM {documents} WHERE doc_id % 3 > 0")


@query("d12_pruned_deleted", {"units": UNITS, "here": HERE, "scanned": SCANNED, "pending": PENDING}, """WITH gone AS (SELECT unit_id, file FROM units WHERE file IS NOT NULL AND file NOT IN (SELECT rel FROM here))
    SELECT 'unit' AS what, unit_id AS id FROM units WHERE unit_id NOT IN (SELECT unit_id FROM gone) UNION ALL SELECT 'pruned', unit_id FROM gone UNION ALL SELECT 'scanned', rel FROM scanned WHERE rel NOT IN (SELECT file FROM gone) UNION ALL SELECT 'pending', rel FROM pending WHERE rel NOT IN (SELECT file FROM gone)""")
def d12(units, here, scanned, pending):
    kept, pruned, rest = gate.prune_deleted(units, here, {"scanned": scanned, "pending": pending})
    named = lambda df, what, c: df.select(F.lit(what).alias("what"), F.col(c).alias("id"))
    return named(kept, "unit", "unit_id").unionByName(named(pruned, "pruned", "unit_id")).unionByName(named(rest["scanned"], "scanned", "rel")).unionByName(named(rest["pending"], "pending", "rel"))


RUN = Relation("SELECT 'f' || CAST(doc_id AS {str}) AS rel, {sha}(coalesce(text, ''){bits}) AS digest, doc_id % 2 AS pid FROM {documents} WHERE doc_id % 6 < 2")


@query("k4_begun_state", {"units": UNITS, "pending": PENDING, "run": RUN, "defined": DEFINED}, """WITH d AS (SELECT file || '::' || function AS unit_id FROM defined WHERE function IS NOT NULL), m AS (SELECT r.rel, least(coalesce(greatest(p.attempts, 0), 0) + 1, 3) AS n FROM run r LEFT JOIN pending p ON p.rel = r.rel AND p.hash = r.digest)
    SELECT 'unit' AS what, unit_id AS id, CASE WHEN unit_id IN (SELECT unit_id FROM d) THEN 'unknown' ELSE verdict END AS value FROM units UNION ALL SELECT 'unit', unit_id, 'unknown' FROM d WHERE unit_id NOT IN (SELECT unit_id FROM units)
    UNION ALL SELECT 'pending', rel, CAST(n AS VARCHAR) FROM m UNION ALL SELECT 'pending', rel, CAST(attempts AS VARCHAR) FROM pending WHERE rel NOT IN (SELECT rel FROM run)""")
def k4(units, pending, run, defined):
    u, p = gate.begin(units, pending, run, defined.where("function is not null").withColumn("k", F.lit(1)))
    return u.select(F.lit("unit").alias("what"), F.col("unit_id").alias("id"), F.col("verdict").alias("value")).unionByName(p.select(F.lit("pending").alias("what"), F.col("rel").alias("id"), F.col("attempts").cast("string").alias("value")))


VERDICTS = Relation(
    "SELECT 'f' || CAST(doc_id AS {str}) || '::g' || CAST(doc_id % 4 AS {str}) AS unit_id, 'f' || CAST(doc_id AS {str}) AS rel, {sha}(coalesce(text, ''){bits}) AS digest, 'f' || CAST(doc_id AS {str}) AS file, 'g' || CAST(doc_id % 4 AS {str}) AS function, n AS ord, CASE WHEN (doc_id + n) % 2 = 0 THEN 'error' ELSE 'verified' END AS verdict FROM {documents}, (SELECT 1 AS n UNION ALL SELECT 2) x WHERE doc_id % 3 = 0"
)


@query("k3_landed_verdicts", {"units": UNITS, "verdicts": VERDICTS, "scanned": SCANNED}, """WITH n AS (SELECT v.* FROM verdicts v JOIN scanned s USING (rel, digest) QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY ord DESC) = 1)
    SELECT unit_id, verdict FROM n UNION ALL SELECT unit_id, verdict FROM units WHERE unit_id NOT IN (SELECT unit_id FROM n)""")
def k3(units, verdicts, scanned):
    none = F.lit(None).cast("string")
    rows = verdicts.select("unit_id", "rel", "digest", F.col("ord").alias("order"), "file", "function", "verdict", F.lit(4).alias("k"), none.alias("counterexample"), none.alias("detail"))
    return gate.landed(units, rows, scanned).select("unit_id", "verdict")


@query("k6_withdrawn", {"units": UNITS, "scanned": SCANNED, "files": FILES, "run": RUN}, """WITH d AS (SELECT r.rel FROM run r LEFT JOIN files f USING (rel) WHERE f.digest IS DISTINCT FROM r.digest)
    SELECT 'unit' AS what, unit_id AS id, CASE WHEN file IN (SELECT rel FROM d) THEN 'unknown' ELSE verdict END AS value FROM units UNION ALL SELECT 'scanned', rel, '' FROM scanned WHERE rel NOT IN (SELECT rel FROM d)""")
def k6(units, scanned, files, run):
    u, s = gate.withdrawn(units, scanned, files, run)
    return u.select(F.lit("unit").alias("what"), F.col("unit_id").alias("id"), F.col("verdict").alias("value")).unionByName(s.select(F.lit("scanned").alias("what"), F.col("rel").alias("id"), F.lit("").alias("value")))


@query("k7_cleared_markers", {"pending": PENDING, "run": RUN}, "SELECT rel FROM pending p WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.rel = p.rel AND r.digest = p.hash AND r.pid = p.pid)")
def k7(pending, run):
    return gate.cleared(pending, run).select("rel")


@query("k8_session_baseline", {"files": FILES, "blobs": BLOBS}, "SELECT 'scanned' AS what, rel FROM files WHERE digest IS NOT NULL UNION ALL SELECT DISTINCT 'blob', rel FROM blobs WHERE digest IS NOT NULL")
def k8(files, blobs):
    s, b = gate.baseline(F.lit(True), files, blobs.unionByName(blobs))
    return s.select(F.lit("scanned").alias("what"), "rel").unionByName(b.select(F.lit("blob").alias("what"), "rel"))


@query("n18_baselined_blobs", {"files": FILES}, "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'a,b' ELSE '' END AS digests FROM files")
def n18(files):
    text = F.when(F.col("doc_id") % 4 == 0, '{"f":["a","b"]}').when(F.col("doc_id") % 4 == 1, '{"f":7}').when(F.col("doc_id") % 4 == 2, "[1")
    return files.select("doc_id", F.array_join(gate.baselined(text, "f"), ",").alias("digests"))


@query("n13_gate_report", {"units": UNITS}, "SELECT file, count(*) FILTER (WHERE verdict <> 'verified') AS n_failures, 0 AS n_needs_contract, CASE WHEN n_failures > 0 THEN 'block' ELSE 'pass' END AS decision, CASE WHEN n_failures > 0 THEN 2 ELSE 0 END AS exit_code FROM units GROUP BY file")
def n13(units):
    from ..operators import ladders

    return ladders.gate_counters(units, ["file"])


@query("b8_stop_messages", {"units": UNITS}, "SELECT k, string_agg('- ' || unit_id || ': ' || upper(verdict) || CASE WHEN counterexample IS NOT NULL THEN chr(10) || counterexample ELSE '' END, chr(10) ORDER BY unit_id) AS message FROM units WHERE verdict <> 'verified' GROUP BY k")
def b8(units):
    from ..operators import ladders
    from ..sources import sinks

    return sinks.stop_message(ladders.blocking(units), "k", ["unit_id"])


REPORT = Relation("SELECT o_custkey AS unit_id, o_orderkey AS ord, o_orderkey % 3 > 0 AS accepted, CASE WHEN o_orderkey % 3 = 0 THEN 'duplicate in batch' END AS reason, 'p' || CAST(o_orderkey AS {str}) AS property_id, 'result > 0' AS expression, CASE WHEN o_orderkey % 2 = 0 THEN {list}('x > 0', 'y > 0') ELSE {list}() END AS domain FROM {orders}")


@query("b8_proposal_text", {"report": Relation(REPORT.sql.replace("{list}()", "CAST({list}() AS {strings})"))}, """WITH c AS (SELECT unit_id, count(*) FILTER (WHERE accepted) AS n, count(*) FILTER (WHERE NOT accepted) AS m, string_agg('  + [' || property_id || '] ' || expression || CASE WHEN len(domain) > 0 THEN '  [domain: x > 0, y > 0]' ELSE '' END, chr(10) ORDER BY ord) FILTER (WHERE accepted) AS yes,
    string_agg('  - ' || expression || ': ' || reason, chr(10) ORDER BY ord) FILTER (WHERE NOT accepted) AS no FROM report GROUP BY unit_id)
    SELECT CAST(unit_id AS VARCHAR) AS unit_id, 'Proposed ' || n || CASE WHEN n = 1 THEN ' property for ' ELSE ' properties for ' END || unit_id || coalesce(chr(10) || yes, '') || CASE WHEN m > 0 THEN chr(10) || 'Rejected ' || m || ':' || chr(10) || no ELSE '' END AS text FROM c""")
def b8_proposals(report):
    from ..sources import sinks

    return sinks.proposal_text(report.withColumn("unit_id", F.col("unit_id").cast("string")))
