"""Operators on verdicts and loops, bound to `events`: unit is user_id, order (ts, event_id), bound props.k.

The verdict is read off event_type: purchase verified, error error, signup violated, click unknown. A view is null,
"garbage" or unknown by its id, so that every query meets null and foreign values. Outcomes are read likewise, with
held, skipped, null and foreign ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checker
from ..operators import gate, ladders, loops, precond, properties
from ..schemas import EXIT_CODES, OUTCOMES
from ..sources import sinks
from .base import Relation, query

ORDER, RUNG = ["ts", "event_id"], ["k", "event_id"]

RUNS = Relation(
    "SELECT event_id, ts, user_id, event_type, {k} AS k, value, CASE event_type WHEN 'purchase' THEN 'verified' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'violated' WHEN 'click' THEN 'unknown' "
    "ELSE CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'garbage' ELSE 'unknown' END END AS verdict, CASE event_type WHEN 'purchase' THEN 'held' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'violated' "
    "WHEN 'click' THEN 'unknown' ELSE CASE event_id % 3 WHEN 0 THEN 'skipped' WHEN 1 THEN NULL ELSE 'garbage' END END AS outcome, user_id * 100 + event_id % 37 AS batch, "
    "CASE WHEN event_id % 5 = 0 THEN 'needs_contract' WHEN event_type = 'view' THEN NULL WHEN event_type = 'purchase' THEN 'verified' ELSE 'violated' END AS gate_verdict FROM {events}"
)
R = {"runs": RUNS}
_OPEN = "coalesce(verdict = 'unknown', true)"
_SETTLED = f"""SELECT user_id, verdict, k FROM runs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {_OPEN}, CASE WHEN {_OPEN} THEN -k ELSE k END, CASE WHEN {_OPEN} THEN -event_id ELSE event_id END) = 1"""
_ATTEMPTS = f"""a AS (SELECT *, lead(k) OVER w AS next_k, lead(1) OVER w AS more, coalesce(max(CAST(NOT {_OPEN} AS INT)) OVER (PARTITION BY user_id ORDER BY k, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
    FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY k, event_id))"""
_WORST = """CASE WHEN count(*) FILTER (WHERE outcome = 'violated') > 0 THEN 'violated' WHEN count(*) FILTER (WHERE outcome = 'unknown') > 0 THEN 'unknown'
    WHEN count(*) FILTER (WHERE outcome IN ('held', 'verified', 'skipped')) < count(*) THEN 'error' ELSE 'clean' END AS worst, count(*) FILTER (WHERE coalesce(outcome, '') <> 'skipped') AS n_checked"""
_LATEST = "SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@query("f3_settled_verdicts", R, _SETTLED)
def f3(runs):
    return ladders.settled(runs, "user_id", RUNG)


@query("f2_attempts", R, f"WITH {_ATTEMPTS} SELECT user_id, event_id, k, verdict, CASE WHEN {_OPEN} THEN next_k END AS escalate_to FROM a WHERE done = 0")
def f2(runs):
    return ladders.attempts(runs, "user_id", RUNG).select("user_id", "event_id", "k", "verdict", "escalate_to")


@query("f2_escalations", R, f"WITH {_ATTEMPTS} SELECT user_id, k AS from_k, next_k AS to_k FROM a WHERE {_OPEN} AND done = 0 AND more = 1")
def f2_escalations(runs):
    return ladders.escalations(runs, "user_id", RUNG)


@query("k10_lazy_rungs", R, f"WITH {_ATTEMPTS} SELECT user_id, count(*) AS n_rungs, count(*) FILTER (WHERE {_OPEN} AND more = 1) AS n_escalated FROM a WHERE done = 0 GROUP BY user_id")
def k10(runs):
    steps = ladders.attempts(runs, "user_id", RUNG)
    return steps.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rungs"), F.count("escalate_to").alias("n_escalated"))


@query("f4_valid_ladders", R, "SELECT batch, coalesce(bool_and(k >= 1 AND (prev IS NULL OR k > prev)), false) AS valid, count(*) AS n_rungs FROM (SELECT batch, k, lag(k) OVER (PARTITION BY batch ORDER BY event_id) AS prev FROM runs) GROUP BY batch")
def f4(runs):
    return ladders.valid_ladders(runs, "batch", "event_id")


@query("e1_outcome_counts", R, "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS n_{o}" for o in OUTCOMES) + ", count(*) FILTER (WHERE coalesce(outcome, '') NOT IN " + str(OUTCOMES) + ") AS n_other FROM runs GROUP BY user_id")
def e1(runs):
    return ladders.outcome_counts(runs, ["user_id"])


@query("e2_worst_outcome", R, f"SELECT batch, {_WORST} FROM runs GROUP BY batch")
def e2(runs):
    return ladders.worst(runs, ["batch"])


@query("e2_worst_of_all", R, f"WITH s AS ({_SETTLED}), o AS (SELECT CASE verdict WHEN 'verified' THEN 'held' WHEN 'violated' THEN 'violated' WHEN 'unknown' THEN 'unknown' ELSE 'error' END AS outcome FROM s) SELECT {_WORST} FROM o")
def e2_all(runs):
    return ladders.worst(f3(runs).withColumn("outcome", checker.outcome(F.col("verdict"))))


@query("d14_exit_codes", R, "SELECT event_id, CASE verdict WHEN 'verified' THEN 0 WHEN 'violated' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END AS exit_code FROM runs")
def d14(runs):
    codes = runs.sparkSession.createDataFrame(list(EXIT_CODES.items()), "verdict string, exit_code int")
    return ladders.with_exit_code(runs, codes).select("event_id", "exit_code")


@query("e4_semantic_summary", R, "SELECT batch, count(*) FILTER (WHERE outcome = 'violated') AS n_violations, count(*) FILTER (WHERE outcome IN ('unknown', 'error')) AS n_unresolved, count(*) FILTER (WHERE outcome = 'skipped') AS n_skipped, count(*) FILTER (WHERE outcome IN ('violated', 'unknown', 'error', 'skipped')) = 0 AS empty FROM runs GROUP BY batch")
def e4(runs):
    return ladders.semantic_summary(runs, ["batch"])


@query("e5_gate_counters", R, "SELECT batch, count(*) FILTER (WHERE coalesce(gate_verdict, '') NOT IN ('verified', 'needs_contract')) AS n_failures, count(*) FILTER (WHERE gate_verdict = 'needs_contract') AS n_needs_contract, CASE WHEN n_failures > 0 THEN 'block' ELSE 'pass' END AS decision, CASE WHEN n_failures > 0 THEN 2 ELSE 0 END AS exit_code FROM runs GROUP BY batch")
def e5(runs):
    return ladders.gate_counters(runs.withColumn("verdict", F.col("gate_verdict")), ["batch"])


@query("e6_ordered_distinct", R, "SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS types FROM (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1) GROUP BY user_id")
def e6(runs):
    return ladders.ordered_distinct(runs, "user_id", ORDER, "event_type").select("user_id", F.array_join("values", ",").alias("types"))


@query("e8_last_violation", R, "SELECT user_id, arg_max(event_id, row(ts, event_id)) FILTER (WHERE verdict = 'violated') AS event_id FROM runs GROUP BY user_id")
def e8(runs):
    return ladders.last_of(runs, "user_id", ORDER, "violated", "event_id")


@query("e9_quantifiers", R, "SELECT batch, bool_and(coalesce(verdict = 'verified', false)) AS all_hold, bool_or(coalesce(verdict = 'verified', false)) AS any_holds, count(*) AS n FROM runs GROUP BY batch")
def e9(runs):
    return ladders.quantified(runs, ["batch"], F.col("verdict") == "verified")


@query("e10_joined_names", R, "SELECT batch, string_agg(verdict || '()', ', ' ORDER BY ts, event_id) AS text FROM runs WHERE verdict IS NOT NULL GROUP BY batch")
def e10(runs):
    return ladders.joined_text(runs, "batch", ORDER, F.concat("verdict", F.lit("()")))


@query("e12_latest_snapshot", R, f"SELECT user_id, event_id, verdict, k FROM ({_LATEST})")
def e12(runs):
    return ladders.latest(runs, "user_id", ORDER).select("user_id", "event_id", "verdict", "k")


@query("k2_latest_state", R, "SELECT batch, event_id, gate_verdict FROM runs QUALIFY row_number() OVER (PARTITION BY batch ORDER BY ts DESC, event_id DESC) = 1")
def k2(runs):
    return ladders.latest(runs, "batch", ORDER).select("batch", "event_id", "gate_verdict")


@query("c2_blocking_units", R, f"SELECT user_id, verdict FROM ({_LATEST}) WHERE verdict IS NULL OR verdict NOT IN ('verified', 'needs_contract')")
def c2_blocking(runs):
    return ladders.blocking(ladders.latest(runs, "user_id", ORDER)).select("user_id", "verdict")


@query("c2_needs_contract", R, "SELECT event_id FROM runs WHERE gate_verdict = 'needs_contract'")
def c2_needs(runs):
    return ladders.needs_contract(runs.select("event_id", F.col("gate_verdict").alias("verdict"))).select("event_id")


@query("c2_held", R, "SELECT event_id FROM runs WHERE outcome = 'held'")
def c2_held(runs):
    return ladders.held(runs).select("event_id")


@query("f1_numbered_trace", R, "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS seq FROM runs")
def f1(runs):
    return ladders.numbered(runs, "user_id", ORDER).select("user_id", "event_id", "seq")


@query("f6_states", R, "SELECT event_id, CASE verdict WHEN 'verified' THEN 'done' WHEN 'violated' THEN 'fix' WHEN 'unknown' THEN 'unknown' ELSE 'give_up' END AS state, CASE verdict WHEN 'verified' THEN 'held' WHEN 'violated' THEN 'violated' WHEN 'unknown' THEN 'unknown' ELSE 'error' END AS outcome FROM runs")
def f6(runs):
    return runs.select("event_id", checker.loop_state(F.col("verdict")).alias("state"), checker.outcome(F.col("verdict")).alias("outcome"))


@query("f7_stop_attempts", R, """WITH i AS (SELECT *, sum(CAST(coalesce(verdict = 'verified', false) AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM runs),
    a AS (SELECT *, sum(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS n FROM i)
    SELECT user_id, event_id, CAST(n AS BIGINT) AS attempt, n > 3 AS residual FROM a WHERE event_type = 'error'""")
def f7(runs):
    # the reset is null on rows without verdict
    return ladders.stop_attempts(runs, "user_id", ORDER, F.col("event_type") == "error", F.col("verdict") == "verified").select("user_id", "event_id", "attempt", "residual")


@query("f8_pending_attempts", R, "SELECT event_id, least(count(*) OVER w, 3)::BIGINT AS attempts, count(*) OVER w < 3 AS retry FROM runs WINDOW w AS (PARTITION BY user_id, k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def f8(runs):
    return ladders.pending_attempts(runs, ["user_id", "k"], ORDER).select("event_id", F.col("attempts").cast("long").alias("attempts"), "retry")


@query("k5_retry_cap", R, "SELECT user_id, k, least(count(*), 3)::BIGINT AS attempts, count(*) >= 3 AS exhausted FROM runs GROUP BY user_id, k")
def k5(runs):
    last = ladders.pending_attempts(runs, ["user_id", "k"], ORDER).groupBy("user_id", "k").agg(F.max("attempts").cast("long").alias("attempts"), F.min("retry").alias("r"))
    return last.select("user_id", "k", "attempts", (~F.col("r")).alias("exhausted"))


@query("g2_top_with_rest", R, """SELECT user_id, event_id, CAST(place AS INTEGER) AS place, greatest(n - 3, 0)::BIGINT AS deferred FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM runs) WHERE place <= 3""")
def g2(runs):
    return ladders.top_with_rest(runs, "user_id", ORDER).select("user_id", "event_id", "place", "deferred")


@query("g3_within_budget", R, "SELECT event_id, 100 - coalesce(sum(k) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 10 AS started FROM runs")
def g3(runs):
    return ladders.within_budget(runs, "user_id", ORDER, "k", 100, 10).select("event_id", "started")


@query("g4_arg_min", R, "SELECT user_id, arg_min(event_id, row(k < 10, abs(k - 10), -event_id)) AS event_id FROM runs GROUP BY user_id")
def g4(runs):
    return ladders.least_by(runs, "user_id", [F.col("k") < 10, F.abs(F.col("k") - 10), -F.col("event_id")], ("event_id",))


LOOPS = Relation(
    "SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) {div} 3 AS round, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) % 3 AS rung, "
    "CAST(4 * (1 + CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) % 3) AS INT) AS k, CASE WHEN event_id % 11 = 0 THEN 'verified' WHEN event_id % 13 = 0 THEN 'error' WHEN event_id % 3 = 0 THEN 'violated' ELSE 'unknown' END AS verdict, "
    "'src' || CAST(user_id AS {str}) AS source, 'cex ' || CAST(event_id AS {str}) AS raw FROM {events}"
)
_REPLAY = """s AS (SELECT *, CASE verdict WHEN 'verified' THEN 'done' WHEN 'violated' THEN 'fix' WHEN 'unknown' THEN 'unknown' ELSE 'give_up' END AS state, lead(rung) OVER (PARTITION BY run_id, round ORDER BY rung) IS NULL AS last_rung,
        coalesce(max(CAST(verdict <> 'unknown' AS INT)) OVER (PARTITION BY run_id, round ORDER BY rung ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut FROM rounds WHERE round < 4),
    p AS (SELECT *, state IN ('done', 'give_up') OR (state = 'unknown' AND last_rung) AS fin FROM s WHERE cut = 0),
    q AS (SELECT *, coalesce(max(CAST(fin AS INT)) OVER (PARTITION BY run_id ORDER BY round, rung ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM p),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY round, rung) - 1 AS INTEGER) AS index, state = 'fix' AND lead(rung) OVER (PARTITION BY run_id ORDER BY round, rung) IS NULL AS spent FROM q WHERE over_ = 0),
    it AS (SELECT *, fin OR spent AS ends, CASE WHEN spent THEN 'give_up' WHEN fin THEN state END AS final_state, CASE WHEN spent THEN 'max_iterations_exceeded' WHEN fin AND state = 'give_up' THEN 'esbmc_error' END AS give_up_reason FROM r)"""
L = {"rounds": LOOPS}


@query("f5_loop_replay", L, f"WITH {_REPLAY} SELECT run_id, index, k, verdict, state, ends, final_state, give_up_reason FROM it")
def f5(rounds):
    return _replayed(rounds).select("run_id", "index", "k", "verdict", "state", "ends", "final_state", "give_up_reason")


def _replayed(rows):
    return loops.replay(rows, max_iterations=4)


@query("c12_loop_reports", L, f"WITH {_REPLAY} SELECT run_id, max(final_state) AS final_state, max(give_up_reason) AS give_up_reason, count(*) AS n_iterations, max(index) FILTER (WHERE verdict = 'violated') AS last_violated, arg_max(raw, index) FILTER (WHERE verdict = 'violated') AS last_counterexample_raw FROM it GROUP BY run_id")
def c12(rounds):
    return loops.reports(_replayed(rounds), trace="raw")


@query("r9_loop_events", L, f"""WITH {_REPLAY}, e AS (
    SELECT run_id, index AS pos, 0 AS n, 'trigger.fired' AS type FROM it WHERE index = 0
    UNION ALL SELECT run_id, index, 1, 'verify.verdict' FROM it
    UNION ALL SELECT run_id, index, 2, CASE WHEN NOT ends AND state = 'unknown' THEN 'unknown.policy.decision' WHEN final_state = 'done' THEN 'converged' WHEN final_state = 'unknown' THEN 'unknown.policy.decision' WHEN ends THEN 'give_up' ELSE 'fix.attempt' END FROM it)
    SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY pos, n) - 1 AS INTEGER) AS seq, type FROM e""")
def r9(rounds):
    return loops.loop_events(_replayed(rounds)).select("run_id", "seq", "type")


@query("b8_loop_transcripts", L, f"""WITH {_REPLAY} SELECT run_id, 'Loop transcript — ' || max(source) || chr(10) || 'Outcome: ' || upper(max(final_state)) || coalesce(chr(10) || '  reason: ' || max(give_up_reason), '') || chr(10) || 'Iterations:' || chr(10)
    || string_agg(printf('  [%d] %-9s k=%d %s', index, upper(verdict), k, source), chr(10) ORDER BY index) AS transcript FROM it GROUP BY run_id""")
def b8_loops(rounds):
    return loops.transcripts(_replayed(rounds).withColumn("unknown_reason", F.lit(None).cast("string")), F.col("source"))


CHECKS = Relation(
    "SELECT 'u' || CAST(user_id AS {str}) AS unit, event_id, 'p' || CAST(event_id AS {str}) AS property_id, CASE WHEN event_id % 4 = 0 THEN 'reachability' ELSE 'semantic' END AS kind, CASE WHEN event_id % 4 = 0 THEN 'skipped' WHEN event_type = 'purchase' THEN 'held' WHEN event_type = 'error' THEN 'error' "
    "WHEN event_type = 'signup' THEN 'violated' ELSE 'unknown' END AS outcome, CASE WHEN event_id % 4 <> 0 THEN {k} END AS k, CASE WHEN event_id % 4 = 0 THEN 'deferred' END AS skip_reason FROM {events}"
)


@query("b8_check_transcripts", {"checks": CHECKS}, """SELECT unit, CASE WHEN count(*) = count(*) FILTER (WHERE outcome = 'skipped') THEN count(*) || CASE WHEN count(*) = 1 THEN ' stored property for ' ELSE ' stored properties for ' END || unit || ' -- all reachability-kind (deferred); no semantic property was actually checked.' || chr(10) ELSE '' END
    || 'Property check — ' || unit || chr(10) || 'Properties:' || chr(10) || string_agg(printf('  %-9s %-6s %s %s', upper(outcome), coalesce('k=' || k, 'k=-'), property_id, kind) || coalesce('  (' || skip_reason || ')', ''), chr(10) ORDER BY event_id) || chr(10)
    || printf('Counts: held=%d, violated=%d, unknown=%d, error=%d, skipped=%d', count(*) FILTER (WHERE outcome = 'held')::BIGINT, count(*) FILTER (WHERE outcome = 'violated')::BIGINT, count(*) FILTER (WHERE outcome = 'unknown')::BIGINT, count(*) FILTER (WHERE outcome = 'error')::BIGINT, count(*) FILTER (WHERE outcome = 'skipped')::BIGINT) AS transcript FROM checks GROUP BY unit""")
def b8_checks(checks):
    return loops.check_transcripts(checks, "unit", ["event_id"])


@query("j21_precondition_ladder", R, """WITH n AS (SELECT DISTINCT k, k % 7 * 40 + 20 AS cap FROM runs)
    SELECT k, cap, CASE WHEN k + 1 >= cap THEN CAST(k + 1 AS VARCHAR) ELSE (SELECT string_agg(DISTINCT r, ',' ORDER BY r) FROM (SELECT least((n.k + 1) * CAST(pow(2, i) AS BIGINT), n.cap) AS r FROM range(12) t(i))) END AS ladder FROM n""")
def j21(runs):
    rows = runs.select("k", (F.col("k") % 7 * 40 + 20).alias("cap")).distinct()
    return rows.select("k", "cap", F.array_join(checker.precondition_ladder(F.col("k"), F.col("cap")), ",").alias("ladder"))


@query("j22_parse_ladder", R, """WITH t AS (SELECT event_id, k, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '4, 8,16' WHEN 2 THEN '4,x' ELSE k || ',' || (k + 5) END AS text FROM runs)
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '4,8,16' WHEN 3 THEN text END AS rungs, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN array_to_string(list_filter([4, 8, 16], lambda x: x > k), ',') WHEN 3 THEN CAST(k + 5 AS VARCHAR) END AS above FROM t""")
def j22(runs):
    text = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, "4, 8,16").when(F.col("event_id") % 4 == 2, "4,x").otherwise(F.concat_ws(",", F.col("k").cast("string"), (F.col("k") + 5).cast("string")))
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    return runs.select("event_id", joined(checker.parse_ladder(text)).alias("rungs"), joined(checker.parse_ladder(text, F.col("k"))).alias("above"))


@query("j20_command_line", R, """SELECT event_id, 'esbmc f.c --unwind ' || k || ' --no-unwinding-assertions -DX' || CASE WHEN event_id % 2 = 0 THEN ' --function f' || user_id ELSE '' END || CASE WHEN event_id % 3 > 0 THEN ' --timeout ' || greatest(1, CAST(ceil(k / 4.0) AS BIGINT)) || 's' ELSE '' END AS argv FROM runs""")
def j20(runs):
    fn = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("f"), F.col("user_id").cast("string")))
    limit = F.when(F.col("event_id") % 3 > 0, F.col("k") / 4.0)
    return runs.select("event_id", F.array_join(checker.argv(F.lit("f.c"), F.col("k"), fn, limit, F.array(F.lit("-DX"))), " ").alias("argv"))


@query("j23_escalating", R, "SELECT event_id, CASE WHEN verdict = 'violated' AND event_id % 2 = 0 THEN 'unknown' ELSE verdict END AS verdict, CASE WHEN verdict = 'violated' AND event_id % 2 = 0 THEN 'under_unwound' END AS reason FROM runs")
def j23(runs):
    none = F.lit(None).cast("string")
    raw = F.when(F.col("event_id") % 2 == 0, "x\n  unwinding assertion loop 3\n").otherwise("dereference failure")
    result = F.struct("verdict", none.alias("reason"), none.alias("message"), raw.alias("raw_counterexample"))
    return runs.select("event_id", checker.escalating(result).alias("r")).select("event_id", "r.verdict", "r.reason")


PROBES = Relation(
    "SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'verified' WHEN 'signup' THEN 'violated' WHEN 'error' THEN 'error' WHEN 'click' THEN 'unknown' END AS verdict, {k} AS k, CASE event_id % 4 WHEN 0 THEN 'violated' WHEN 1 THEN 'verified' WHEN 2 THEN 'unknown' END AS probe_verdict, "
    "CASE WHEN event_id % 8 = 0 THEN 'runledger:non-vacuity runledger:obligation-site:f' ELSE 'other' END AS probe_text, CASE WHEN event_id % 3 = 0 THEN 'runledger:obligation:f:p' ELSE 'dereference failure' END AS cex_text, event_id % 5 <> 0 AS resolvable, event_id % 7 = 0 AS weak, "
    "event_id % 2 = 0 AS internal, user_id % 3 = 0 AS reentrant, event_id % 10 < 6 AS anchored FROM {events}"
)
P = {"probes": PROBES}


@query("n7_assessments", P, """SELECT event_id, CASE WHEN verdict = 'violated' THEN 'violated' WHEN verdict = 'unknown' THEN 'unknown' WHEN verdict IS NULL OR verdict <> 'verified' THEN 'error' WHEN probe_verdict = 'violated' AND event_id % 8 = 0 THEN 'assumed_verified' WHEN probe_verdict = 'verified' THEN 'vacuous' ELSE 'unknown' END AS assessment FROM probes""")
def n7(probes):
    return precond.assessed(probes.withColumns({"reason": F.lit("timeout"), "message": F.lit("m")})).select("event_id", "assessment")


_CALLERS = """c AS (SELECT *, CASE WHEN NOT resolvable THEN 'unchecked' WHEN verdict = 'violated' AND event_id % 3 = 0 AND weak THEN 'underdetermined' WHEN verdict = 'violated' AND event_id % 3 = 0 THEN 'obligation_violated' WHEN verdict = 'violated' THEN 'caller_violated'
    WHEN verdict IS NULL OR verdict <> 'verified' THEN 'unchecked' WHEN probe_verdict = 'violated' AND event_id % 8 = 0 THEN 'discharged' WHEN probe_verdict = 'verified' THEN 'unreachable' ELSE 'unchecked' END AS outcome FROM probes),
    h AS (SELECT * EXCLUDE (outcome), CASE WHEN reentrant AND outcome = 'obligation_violated' AND event_id % 9 > 0 THEN 'unattributed' ELSE outcome END AS outcome FROM c)"""


def _checks(probes):
    rows = probes.withColumns(
        {"unresolved_params": F.array(F.lit("p")), "weakest": F.when(F.col("weak"), F.array(F.lit("q"))).otherwise(F.array().cast("array<string>")),
         "callee": F.concat(F.lit("f"), F.col("user_id").cast("string")), "caller": F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("f"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("g"), F.col("event_id").cast("string")))}
    )
    return precond.attributed(precond.caller_checks(rows))


@query("n8_caller_checks", P, f"WITH {_CALLERS} SELECT event_id, outcome FROM c")
def n8(probes):
    rows = probes.withColumns({"unresolved_params": F.array(F.lit("p")), "weakest": F.when(F.col("weak"), F.array(F.lit("q"))).otherwise(F.array().cast("array<string>"))})
    return precond.caller_checks(rows).select("event_id", "outcome")


@query("h6_attributed", P, f"WITH {_CALLERS} SELECT event_id, outcome FROM h")
def h6(probes):
    return _checks(probes).select("event_id", "outcome")


@query("e3_discharge_fold", P, f"""WITH {_CALLERS}, g AS (SELECT *, 'f' || user_id AS callee FROM h WHERE event_id % 8 = 0 OR user_id % 2 = 0)
    SELECT callee, CASE WHEN count(*) FILTER (WHERE outcome = 'obligation_violated') > 0 THEN 'violated' WHEN count(*) FILTER (WHERE outcome <> 'discharged') > 0 OR NOT bool_and(internal) THEN 'assumed_verified' ELSE 'discharged_verified' END AS assessment FROM g GROUP BY callee""")
def e3(probes):
    rows = _checks(probes).where("event_id % 8 = 0 or user_id % 2 = 0").withColumns({"settled_k": F.col("k"), "max_len": F.lit(8)})
    return precond.discharged(rows, ["event_id"]).select("callee", "assessment")


@query("d16_anchored_callers", P, "SELECT user_id, count(*) FILTER (WHERE anchored) AS n_anchored, bool_and(anchored) AS all_anchored FROM probes GROUP BY user_id")
def d16(probes):
    rows = precond.with_anchored(probes, probes.where("anchored"), ["event_id"])
    return rows.groupBy("user_id").agg(F.count(F.when(F.col("anchored"), 1)).alias("n_anchored"), F.bool_and("anchored").alias("all_anchored"))


@query("n12_check_status", R, """WITH c AS (SELECT event_id, k % 4 AS n, CAST(k * 5 AS DOUBLE) AS budget, CAST(event_id % 90 AS DOUBLE) AS took, event_id % 5 > 0 AS ok, greatest(k % 4, 1) * 25.0 + 10.0 AS own FROM runs)
    SELECT event_id, CAST(least(own, budget) AS DOUBLE) AS limit_s, CASE WHEN took >= least(own, budget) AND budget < own THEN 'deferred' WHEN took >= least(own, budget) OR NOT ok THEN 'failed' ELSE 'checked' END AS status FROM c""")
def n12(runs):
    rows = runs.select("event_id", (F.col("k") % 4).alias("n_checkable"), (F.col("k") * 5).cast("double").alias("budget_s"), (F.col("event_id") % 90).cast("double").alias("took_s"), (F.col("event_id") % 5 > 0).alias("payload_ok"))
    return properties.check_status(rows).select("event_id", "limit_s", "status")


STOPS = Relation(
    "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 3 END AS n_unverified, event_id % 2 AS n_oob, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS n_blob, event_id % 4 AS n_needs_contract, event_id % 6 AS n_notes, event_id % 5 AS stop_attempts FROM {events}"
)


@query("k9_stop_decisions", {"stops": STOPS}, """WITH o AS (SELECT *, coalesce(n_unverified > 0, true) OR n_oob > 0 OR n_blob > 0 AS out, stop_attempts + 1 AS n FROM stops)
    SELECT event_id, CASE WHEN out AND n > 3 THEN 'residual' WHEN out THEN 'block' WHEN n_needs_contract > 0 THEN 'allow_needs_contract' WHEN n_notes > 0 THEN 'allow_semantic_check' ELSE 'allow' END AS decision, CASE WHEN out THEN n ELSE 0 END AS attempt FROM o""")
def k9(stops):
    return gate.stop_decision(stops).select("event_id", "decision", "attempt")


TRACE = Relation(
    "SELECT event_id, user_id, ts AS moment, CASE event_id % 5 WHEN 0 THEN 'edit' WHEN 1 THEN 'verify' WHEN 2 THEN 'gate' WHEN 3 THEN 'stop' ELSE 'other' END AS type, 'Edit' AS tool, 'f' || CAST(user_id AS {str}) || '.c' AS file, {list}('a;b', 'c') AS functions, "
    "'f.c::g' AS unit, CASE event_type WHEN 'purchase' THEN 'verified' WHEN 'signup' THEN 'violated' WHEN 'error' THEN 'odd' END AS verdict, {k} AS k, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 100 AS DOUBLE) / 8 END AS duration_s, "
    "CASE event_type WHEN 'purchase' THEN 'pass' WHEN 'signup' THEN 'allow' WHEN 'error' THEN 'residual' ELSE 'block' END AS decision, CAST(event_id % 3 AS INT) AS n_failures, CASE WHEN event_id % 4 = 0 THEN 2 END AS exit_code, CAST(event_id % 6 AS INT) AS n_unverified, CAST(event_id % 4 AS INT) AS attempt FROM {events}"
)


@query("j24_diagram_lines", {"trace": TRACE}, """SELECT event_id, CASE type WHEN 'edit' THEN '    C->>G: Edit ' || file || ' (a,b, c)' WHEN 'verify' THEN '    G->>E: verify f.c::g (k=' || k || ')|    E-->>G: ' || CASE verdict WHEN 'verified' THEN 'VERIFIED' WHEN 'violated' THEN 'VIOLATED' WHEN 'odd' THEN 'ODD' ELSE 'NONE' END || CASE WHEN duration_s IS NULL THEN '' ELSE printf(' (%.2fs)', duration_s) END
    WHEN 'gate' THEN CASE WHEN decision = 'pass' THEN '    G-->>C: pass — VERIFIED up to k' ELSE '    G-->>C: block — ' || n_failures || ' cex fed back (exit ' || coalesce(exit_code, 2) || ')' END
    WHEN 'stop' THEN '    C->>S: end turn?|' || CASE decision WHEN 'allow' THEN '    S-->>C: ALLOW (clean)' WHEN 'residual' THEN '    S-->>C: ALLOW with LOUD residual (' || n_unverified || ' unverified)' ELSE '    S-->>C: BLOCK (attempt ' || attempt || ')' END ELSE '' END AS lines FROM trace WHERE event_id % 100 NOT IN (4, 12, 20, 28, 36, 44, 52, 60, 68, 76, 84, 92) OR event_id % 2 = 1 OR type <> 'verify'""")
def j24(trace):
    odd = "event_id % 100 not in (4, 12, 20, 28, 36, 44, 52, 60, 68, 76, 84, 92) or event_id % 2 = 1 or type <> 'verify'"  # halves round differently in the two engines
    return trace.where(odd).select("event_id", F.array_join(sinks.diagram_lines(), "|").alias("lines"))


@query("k1_trace_order", {"trace": TRACE}, "SELECT user_id, string_agg(type, ',' ORDER BY moment, event_id) AS types FROM trace GROUP BY user_id")
def k1(trace):
    return ladders.joined_text(trace, "user_id", ["moment", "event_id"], F.col("type"), ",").withColumnRenamed("text", "types")


@query("j30_json", R, "SELECT event_id, '{\"k\":' || k || CASE WHEN verdict IS NULL THEN '' ELSE ',\"verdict\":\"' || verdict || '\"' END || '}' AS json, k AS back FROM runs")
def j30(runs):
    rows = runs.select("event_id", F.to_json(F.struct("k", "verdict")).alias("json"))
    return rows.select("event_id", "json", F.from_json("json", "k int").getField("k").alias("back"))
