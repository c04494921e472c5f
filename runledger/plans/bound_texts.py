"""Operators on texts, bound to `documents`, `pages` and `events`: captured output, traces, names, expressions and replies are put together from ids, so that the oracle knows the result without reading the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cexpr, checker, names
from ..operators import candidates, gate, traces, units, verify
from ..sources import readers
from .base import Relation, query

# What a checker printed for a document: thirteen shapes by its id, each with what it should be read as.
OUTPUT = Relation(
    "SELECT doc_id, CASE doc_id % 13 WHEN 0 THEN 'ESBMC version 7.' || CAST(doc_id AS {str}) || {nl} || '  VERIFICATION SUCCESSFUL  ' || {nl} WHEN 1 THEN 'x' || {nl} || '[Counterexample]' || {nl} || 'State ' || CAST(doc_id AS {str}) || {nl} || 'VERIFICATION FAILED' || {nl} || 'tail' "
    "WHEN 2 THEN 'VERIFICATION SUCCESSFUL' || {nl} || 'VERIFICATION FAILED' WHEN 3 THEN 'ERROR: Timed out' WHEN 4 THEN 'Out of memory' WHEN 5 THEN 'x VERIFICATION UNKNOWN y' WHEN 6 THEN 'VERIFICATION SUCCESSFUL' WHEN 7 THEN 'VERIFICATION SUCCESSFUL' || {nl} || 'ERROR: PARSING ERROR' "
    "WHEN 8 THEN 'printed \"VERIFICATION SUCCESSFUL\"' WHEN 9 THEN '' WHEN 10 THEN NULL WHEN 11 THEN '[Counterexample]' || {nl} || 'msg VERIFICATION FAILED msg' || {nl} || ' VERIFICATION FAILED' || {nl} || 'VERIFICATION FAILED' ELSE 'VERIFICATION FAILED' || {nl} || '[Counterexample]' || {nl} || '[Counterexample]' END AS stdout, "
    "CASE WHEN doc_id % 13 = 10 THEN 'ESBMC version 8.1' || {nl} || 'ERROR:  no such file ' || {nl} || 'ERROR: second' WHEN doc_id % 26 = 9 THEN 'failed to open input file' ELSE lang END AS stderr, CASE WHEN doc_id % 13 IN (6, 10) THEN 6 WHEN doc_id % 13 = 12 THEN NULL ELSE 1 END AS exit_code FROM {documents}"
)
O = {"output": OUTPUT}
_VERDICT = "CASE doc_id % 13 WHEN 0 THEN 'verified' WHEN 1 THEN 'violated' WHEN 2 THEN 'violated' WHEN 3 THEN 'unknown' WHEN 4 THEN 'unknown' WHEN 5 THEN 'unknown' WHEN 11 THEN 'violated' WHEN 12 THEN 'violated' ELSE 'error' END"


@query("j4_classify", O, f"SELECT doc_id, {_VERDICT} AS verdict, CASE doc_id % 13 WHEN 3 THEN 'timeout' WHEN 4 THEN 'memout' WHEN 5 THEN 'unclassified' END AS reason, CASE WHEN doc_id % 13 = 7 THEN 'PARSING ERROR' WHEN doc_id % 13 = 10 THEN 'no such file' WHEN doc_id % 13 = 6 OR doc_id % 26 = 9 THEN 'esbmc reported an error' WHEN doc_id % 13 IN (8, 9) THEN 'unclassified output' END AS message FROM output")
def j4(output):
    return traces.classified(output).select("doc_id", "verdict", "reason", "message")


@query("j5_trace_text", O, "SELECT doc_id, CASE doc_id % 13 WHEN 1 THEN '[Counterexample]' || chr(10) || 'State ' || doc_id WHEN 2 THEN 'VERIFICATION SUCCESSFUL' WHEN 11 THEN '[Counterexample]' || chr(10) || 'msg VERIFICATION FAILED msg' || chr(10) || ' VERIFICATION FAILED' WHEN 12 THEN '' END AS raw FROM output WHERE doc_id % 13 IN (1, 2, 11, 12)")
def j5(output):
    return traces.classified(output).where("verdict = 'violated'").select("doc_id", F.col("raw_counterexample").alias("raw"))


@query("j6_error_and_version", O, "SELECT doc_id, CASE doc_id % 13 WHEN 3 THEN 'Timed out' WHEN 7 THEN 'PARSING ERROR' WHEN 10 THEN 'no such file' ELSE '' END AS error, CASE doc_id % 13 WHEN 0 THEN '7.' || doc_id WHEN 10 THEN '8.1' ELSE '' END AS version FROM output")
def j6(output):
    text = checker.captured(F.col("stdout"), F.col("stderr"))
    return output.select("doc_id", checker.error_line(text, "").alias("error"), checker.version(F.col("stdout"), F.col("stderr")).alias("version"))


@query("n16_banners", O, "SELECT doc_id, doc_id % 13 IN (0, 2, 6, 7) AS passed, doc_id % 13 IN (1, 2, 11, 12) AS failed FROM output")
def n16(output):
    text = checker.captured(F.col("stdout"), F.col("stderr"))
    return output.select("doc_id", checker.has_banner(text, checker.SUCCESSFUL).alias("passed"), checker.has_banner(text, checker.FAILED).alias("failed"))


@query("e11_trace_markers", O, "SELECT doc_id, CASE doc_id % 13 WHEN 1 THEN 1 WHEN 11 THEN 1 WHEN 12 THEN 2 ELSE 0 END AS n FROM output WHERE doc_id % 13 <> 10")
def e11(output):
    return output.where("stdout is not null").select("doc_id", checker.traces_in(F.col("stdout")).alias("n"))


@query("r4_result_rows", O, f"SELECT doc_id, {_VERDICT} AS verdict, CASE doc_id % 13 WHEN 3 THEN 'timeout' WHEN 4 THEN 'memout' WHEN 5 THEN 'unclassified' END AS reason, {_VERDICT} = 'error' AS has_message, {_VERDICT} = 'violated' AS has_trace, true AS ok FROM output")
def r4(output):
    from ..schemas import payload_ok

    return traces.classified(output).select("doc_id", "verdict", "reason", F.col("message").isNotNull().alias("has_message"), F.col("raw_counterexample").isNotNull().alias("has_trace"), payload_ok().alias("ok"))


@query("n4_verified_sources", O, f"""SELECT doc_id AS run_id, CASE WHEN doc_id % 4 = 0 THEN '/else/f.c' ELSE 'src/f.c' END || '::f' || doc_id % 3 AS unit_id, 'esbmc f.c --unwind 4 --force-malloc-success -I. --function f' || doc_id % 3 || ' --timeout 30s' AS argv,
    CASE WHEN doc_id % 17 = 0 THEN 'error' ELSE {_VERDICT} END AS verdict FROM output""")
def n4(output):
    path = F.when(F.col("doc_id") % 4 == 0, "/else/f.c").when(F.col("doc_id") % 4 == 1, "src/../src/./f.c").otherwise("/home/p/src/f.c")
    function = F.concat(F.lit("f"), (F.col("doc_id") % 3).cast("string"))
    rows = output.select(F.col("doc_id").alias("run_id"), verify.unit_id(F.lit("/home/p/"), path, function).alias("unit_id"), F.lit("f.c").alias("source"), function.alias("function"), F.lit(4).alias("k"), F.array(F.lit("-I.")).alias("extra"))
    captured = output.where("doc_id % 17 <> 0").select(F.col("doc_id").alias("run_id"), "stdout", "stderr", "exit_code")
    found = verify.verified(rows, lambda asked: readers.recorded(asked, captured, ["run_id"]), sidecar=True)
    return found.select("run_id", "unit_id", F.array_join("argv", " ").alias("argv"), "verdict")


@query("b9_result_json", O, f"""SELECT doc_id, '{{"verdict":"' || {_VERDICT} || '","esbmc_version":"' || CASE doc_id % 13 WHEN 0 THEN '7.' || doc_id WHEN 10 THEN '8.1' ELSE '' END || '","argv":["esbmc"],"duration_s":0.5' || CASE doc_id % 13 WHEN 0 THEN '' WHEN 3 THEN ',"reason":"timeout"' WHEN 4 THEN ',"reason":"memout"' WHEN 5 THEN ',"reason":"unclassified"'
    WHEN 1 THEN ',"counterexample":"[Counterexample]\\nState ' || doc_id || '"' WHEN 2 THEN ',"counterexample":"VERIFICATION SUCCESSFUL"' ELSE ',"message":"' || CASE WHEN doc_id % 13 = 7 THEN 'PARSING ERROR' WHEN doc_id % 13 = 10 THEN 'no such file' WHEN doc_id % 13 = 6 OR doc_id % 26 = 9 THEN 'esbmc reported an error' ELSE 'unclassified output' END || '"' END || '}}' AS json FROM output WHERE doc_id % 13 NOT IN (11, 12)""")
def b9(output):
    rows = traces.classified(output).where("doc_id % 13 not in (11, 12)").withColumns({"argv": F.array(F.lit("esbmc")), "duration_s": F.lit(0.5)})
    return rows.select("doc_id", traces.result_json(structured=False).alias("json"))


@query("b8_result_text", O, f"""SELECT doc_id, upper({_VERDICT}) || '  (f.c, k=4, esbmc ' || CASE doc_id % 13 WHEN 0 THEN '7.' || doc_id WHEN 10 THEN '8.1' ELSE '?' END || ')' || CASE doc_id % 13 WHEN 0 THEN '' WHEN 3 THEN chr(10) || 'reason: timeout' WHEN 4 THEN chr(10) || 'reason: memout' WHEN 5 THEN chr(10) || 'reason: unclassified'
    WHEN 1 THEN chr(10) || chr(10) || '[Counterexample]' || chr(10) || 'State ' || doc_id WHEN 2 THEN chr(10) || chr(10) || 'VERIFICATION SUCCESSFUL' ELSE chr(10) || 'error: ' || CASE WHEN doc_id % 13 = 7 THEN 'PARSING ERROR' WHEN doc_id % 13 = 10 THEN 'no such file' WHEN doc_id % 13 = 6 OR doc_id % 26 = 9 THEN 'esbmc reported an error' ELSE 'unclassified output' END END AS text
    FROM output WHERE doc_id % 13 NOT IN (11, 12)""")
def b8(output):
    return traces.classified(output).where("doc_id % 13 not in (11, 12)").select("doc_id", traces.result_text(F.lit("f.c"), F.lit(4)).alias("text"))


# Traces: the events of a user are states of one trace; k is written, with its bits where the id is even.
STATES = Relation(
    "SELECT user_id, event_id, {k} AS k, 'State ' || CAST(event_id AS {str}) || ' file dir/f ' || CAST(user_id AS {str}) || '.c line ' || CAST(event_id % 90 AS {str}) || ' column ' || CAST(event_id % 7 AS {str}) || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' function g' || CAST(event_id % 3 AS {str}) END || ' thread 0' || {nl} || "
    "'----------' || {nl} || '  v' || CAST(event_id % 5 AS {str}) || '$' || CAST(event_id AS {str}) || '[1].x = ' || CAST({k} AS {str}) || CASE WHEN event_id % 2 = 0 THEN ' (0101 1010)' ELSE '' END || {nl} || 'noise' || {nl} || '  w = (char *)0 = q' AS text FROM {events}"
)
S = {"states": STATES}


def _traces(states):
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "text"))), lambda s: s["text"]), "\n\n")
    tail = F.concat(F.lit("\n\nViolated property:\n  file a.c line 3 column 4 function h\n  text of it\n  CWE: CWE-1, CWE-"), F.col("user_id").cast("string"), F.lit("\n"), F.when(F.col("user_id") % 2 == 0, "  x > 0\n").otherwise(""), F.lit("end\n  not this"))
    rows = states.groupBy("user_id").agg(body.alias("body"))
    more = F.when(F.col("user_id") % 10 == 3, "\n[Counterexample]\n").otherwise("\n")
    none = F.col("user_id") % 10 == 7
    return traces.parsed(rows.select("user_id", F.when(none, F.col("body")).otherwise(F.concat(F.lit("[Counterexample]"), more, F.lit("\n"), "body", tail)).alias("raw_counterexample")))


_GOOD = "user_id % 10 NOT IN (3, 7)"


@query("f11_trace_steps", S, f"""WITH n AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS step FROM states) SELECT user_id, event_id AS number, step, 'dir/f ' || user_id || '.c' AS file, CAST(event_id % 90 AS INTEGER) AS line, CASE WHEN event_id % 3 > 0 THEN 'g' || event_id % 3 END AS function, ord, CASE ord WHEN 0 THEN 'v' || event_id % 5 || '$' || event_id || '[1].x' ELSE 'w' END AS lhs,
    CASE ord WHEN 0 THEN CAST(k AS VARCHAR) ELSE '(char *)0 = q' END AS value, CASE WHEN ord = 0 AND event_id % 2 = 0 THEN '0101 1010' END AS binary FROM n, (VALUES (0), (1)) o(ord) WHERE {_GOOD}""")
def f11(states):
    return traces.steps(_traces(states), "user_id").withColumn("number", F.col("number").cast("long"))


@query("n15_unparsed_traces", S, f"SELECT DISTINCT user_id, {_GOOD} AS parsed FROM states")
def n15(states):
    return _traces(states).select("user_id", F.col("counterexample").isNotNull().alias("parsed"))


@query("j7_violated_property", S, f"SELECT DISTINCT user_id, 'a.c' AS file, 3 AS line, 4 AS col, 'h' AS function, 'text of it' AS description, CASE WHEN user_id % 2 = 0 THEN 'x > 0' END AS expression, 'CWE-1,CWE-' || user_id AS cwe FROM states WHERE {_GOOD}")
def j7(states):
    p = "counterexample.violated_property"
    rows = _traces(states).where("counterexample is not null")
    return rows.select("user_id", f"{p}.loc.file", f"{p}.loc.line", F.col(f"{p}.loc.column").alias("col"), f"{p}.loc.function", f"{p}.description", f"{p}.expression", F.array_join(f"{p}.cwe", ",").alias("cwe"))


@query("e7_inputs", S, f"""WITH a AS (SELECT user_id, event_id, 'v' || event_id % 5 AS symbol, CAST(k AS VARCHAR) AS value FROM states WHERE {_GOOD} UNION ALL SELECT user_id, event_id, 'w', '(char *)0 = q' FROM states WHERE {_GOOD})
    SELECT user_id, symbol, arg_min(value, event_id) AS value FROM a GROUP BY user_id, symbol""")
def e7(states):
    return traces.inputs(traces.steps(_traces(states), "user_id"), "user_id").select("user_id", "symbol", "value")


_CEX = """to_json({'steps': list({'number': CAST(event_id AS INT), 'loc': {'file': 'dir/f ' || user_id || '.c', 'line': event_id % 90, 'column': event_id % 7, 'function': CASE WHEN event_id % 3 > 0 THEN 'g' || event_id % 3 END},
    'assignments': [{'lhs': 'v' || event_id % 5 || '$' || event_id || '[1].x', 'value': CAST(k AS VARCHAR), 'binary': CASE WHEN event_id % 2 = 0 THEN '0101 1010' END}, {'lhs': 'w', 'value': '(char *)0 = q', 'binary': NULL}]} ORDER BY event_id),
    'violated_property': {'loc': {'file': 'a.c', 'line': 3, 'column': 4, 'function': 'h'}, 'description': 'text of it', 'expression': CASE WHEN user_id % 2 = 0 THEN 'x > 0' END, 'cwe': ['CWE-1', 'CWE-' || user_id]}})"""


@query("n20_counterexample_json", S, f"SELECT user_id, CAST({_CEX} AS VARCHAR) AS json FROM states WHERE {_GOOD} GROUP BY user_id")
def n20(states):
    rows = _traces(states).where("counterexample is not null").withColumns({"verdict": F.lit("violated"), "esbmc_version": F.lit("8"), "argv": F.array(F.lit("e")), "duration_s": F.lit(1.0), "reason": F.lit(None).cast("string"), "message": F.lit(None).cast("string")})
    return rows.select("user_id", F.get_json_object(traces.result_json(), "$.counterexample").alias("json"))


DOCS = Relation("SELECT doc_id, lang, source, 'src/' || coalesce(source, 'none') || '/f' || CAST(doc_id % 50 AS {str}) || CASE doc_id % 6 WHEN 0 THEN '.c' WHEN 1 THEN '.C' WHEN 2 THEN '.h' WHEN 3 THEN '.py' WHEN 4 THEN '.txt' ELSE '' END AS path, 'src/' || coalesce(source, 'none') || '.c::fn' || CAST(doc_id % 50 AS {str}) AS unit_id, coalesce(text, '') AS text FROM {documents}")
D = {"docs": DOCS}


@query("j1_property_ids", D, "SELECT doc_id, substr(sha256(unit_id || chr(0) || 'semantic' || chr(0) || 'result > ' || doc_id % 9 || CASE WHEN doc_id % 2 = 0 THEN chr(0) || 'x > 0' || chr(0) || lang ELSE '' END), 1, 16) AS property_id FROM docs")
def j1(docs):
    domain = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("x > 0"), F.col("lang"))).otherwise(F.array().cast("array<string>"))
    return docs.select("doc_id", names.property_id(F.col("unit_id"), F.lit("semantic"), F.concat(F.lit("result > "), (F.col("doc_id") % 9).cast("string")), domain).alias("property_id"))


@query("j2_unit_slugs", D, "SELECT doc_id, replace(replace(unit_id, '::', '__'), '/', '_') || '-' || substr(sha256(unit_id), 1, 12) AS slug FROM docs")
def j2(docs):
    return docs.select("doc_id", names.unit_slug(F.col("unit_id")).alias("slug"))


@query("j3_file_names", D, "SELECT doc_id, regexp_replace(unit_id, '[^A-Za-z0-9_.-]', '_', 'g') || '__p' || doc_id || '.c' AS harness, CASE doc_id % 3 WHEN 0 THEN 'nondet_unsigned_char__' WHEN 1 THEN 'nondet_int64_t' ELSE 'nondet___x' END AS nondet, CASE doc_id % 3 WHEN 0 THEN 'nondet_unsigned_char' WHEN 1 THEN 'nondet_int64_t' ELSE 'nondet_x' END AS slug FROM docs")
def j3(docs):
    ctype = F.when(F.col("doc_id") % 3 == 0, "unsigned char *").when(F.col("doc_id") % 3 == 1, " int64_t ").otherwise("__x")
    return docs.select("doc_id", names.harness_file(F.col("unit_id"), F.concat(F.lit("p"), F.col("doc_id").cast("string"))).alias("harness"), names.nondet_name(ctype).alias("nondet"), names.nondet_slug(ctype).alias("slug"))


@query("j25_labels", D, """SELECT doc_id, regexp_extract(unit_id, '^.*?::(.*)$', 1) AS symbol, CASE doc_id % 7 WHEN 0 THEN 'VERIFIED (assuming valid caller pointers — undischarged; up to k=9, len<=8)' WHEN 1 THEN 'VIOLATED (real counterexample under the synthesised precondition, k=9)' WHEN 2 THEN 'VACUOUS (synthesised precondition makes the call unreachable — not a pass)'
    WHEN 3 THEN 'NEEDS_CONTRACT (' || lang || ')' WHEN 4 THEN 'UNKNOWN (' || lang || ')' WHEN 5 THEN 'ERROR (' || lang || ')' ELSE 'ERROR (' || lang || ')' END AS label FROM docs""")
def j25(docs):
    words = F.array(*map(F.lit, ("assumed_verified", "violated", "vacuous", "needs_contract", "unknown", "error", "discharged_verified")))
    a = F.element_at(words, (F.col("doc_id") % 7 + 1).cast("int"))
    return docs.select("doc_id", names.symbol(F.col("unit_id")).alias("symbol"), names.assessment_label(a, F.col("lang"), F.lit(9), F.lit(8)).alias("label"))


@query("j27_versions", D, "SELECT doc_id, (doc_id % 3, doc_id % 12, doc_id % 5) > (1, 9, 2) AS newer, doc_id % 50 <= 44 AND doc_id % 50 >= 1 AS fresh FROM docs")
def j27(docs):
    part = lambda n: (F.col("doc_id") % n).cast("string")
    v = F.concat_ws(".", part(3), part(12), part(5))
    return docs.select("doc_id", names.newer(v, F.lit("1.9.2")).alias("newer"), names.fresh((1 - F.col("doc_id") % 50) * 1000.0, F.lit(0.0)).alias("fresh"))


@query("g6_clipped", D, "SELECT doc_id, substr(text, 1, 400) AS head FROM docs")
def g6(docs):
    return docs.select("doc_id", checker.clip(F.col("text"), 400).alias("head"))


@query("c3_path_filters", D, "SELECT doc_id, NOT (list_contains(string_split(path, '/'), 'vendor') OR regexp_matches(path, '^src/[a-k].*/f[0-9]*\\.c$')) AND regexp_matches(path, '^src/.*') AS included, NOT list_contains(string_split(path, '/'), 'vendor') AS usual FROM docs")
def c3(docs):
    rel = F.col("path")
    return docs.select("doc_id", names.included(rel, ["src/*"], ["vendor", "src/[a-k]*/f*.c"]).alias("included"), names.included(rel).alias("usual")).withColumn("included", F.col("included"))


@query("c4_suffixes", D, "SELECT doc_id, doc_id % 6 IN (0, 1) AS is_c, doc_id % 6 IN (0, 2, 3) AS is_edited FROM docs")
def c4(docs):
    return docs.select("doc_id", names.is_c_source(F.col("path")).alias("is_c"), names.is_edited_source(F.col("path")).alias("is_edited"))


@query("n14_listed_sources", D, "SELECT doc_id FROM docs WHERE doc_id % 6 IN (0, 1)")
def n14(docs):
    return gate.listed(docs, "path").select("doc_id")


@query("c5_in_scope", D, "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '../' ELSE '' END || path AS rel FROM docs WHERE doc_id % 4 <> 0 AND doc_id % 6 IN (0, 1) AND NOT list_contains(string_split(path, '/'), 'vendor') AND NOT (doc_id % 5 = 0 AND doc_id % 3 = 0)")
def c5(docs):
    # trackedness is null, that is unknown, for a third of the rows: an unknown one never exempts
    rel = F.concat(F.when(F.col("doc_id") % 4 == 0, "../").otherwise(""), F.col("path"))
    tracked = F.when(F.col("doc_id") % 3 == 0, False).when(F.col("doc_id") % 3 == 1, True)
    return gate.in_scope(docs.select("doc_id", rel.alias("rel"), (F.col("doc_id") % 5 == 0).alias("is_snapshot"), tracked.alias("tracked"))).select("doc_id", "rel")


@query("a10_digests", D, "SELECT doc_id, sha256(text) AS digest FROM docs")
def a10(docs):
    return docs.select("doc_id", readers.digest(F.col("text")).alias("digest"))


EXPRS = Relation(
    "SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN 'result >= 0' WHEN 1 THEN 'x = 1' WHEN 2 THEN 'f(x) > 0' WHEN 3 THEN 'x++ > 0' WHEN 4 THEN 'x <<= 2' WHEN 5 THEN '(x > 0' WHEN 6 THEN 'x > 0; y' WHEN 7 THEN 'x == 0x1F && n != 10u' WHEN 8 THEN 'a' || CAST(doc_id AS {str}) || ' <= INT_MAX' WHEN 9 THEN '1 == 1' ELSE '`x`' END AS expression, "
    "CASE doc_id % 4 WHEN 0 THEN {list}('x > 0') WHEN 1 THEN {list}('result > 0') WHEN 2 THEN {list}('1 > 0', 'x > 0') ELSE {list}('x > 0', 'z > INT_MIN') END AS domain, CASE WHEN doc_id % 5 = 0 THEN 'reachability' WHEN doc_id % 5 = 1 THEN 'semantic' END AS kind, lang FROM {documents}"
)
X = {"exprs": EXPRS}
_UNSAFE = "CASE doc_id % 11 WHEN 1 THEN 'contains an assignment' WHEN 2 THEN 'contains a function call' WHEN 3 THEN 'contains an increment/decrement operator' WHEN 4 THEN 'contains a compound assignment operator' WHEN 5 THEN 'unbalanced parentheses' WHEN 6 THEN 'contains '';''' WHEN 10 THEN 'contains a backtick' END"


@query("j8_identifiers", X, "SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN 'result' WHEN 2 THEN 'f,x' WHEN 6 THEN 'x,y' WHEN 7 THEN 'x,n' WHEN 8 THEN 'a' || doc_id || ',INT_MAX' WHEN 9 THEN '' ELSE 'x' END AS names, doc_id % 11 NOT IN (0, 8, 9) AS has_x FROM exprs")
def j8(exprs):
    return exprs.select("doc_id", F.array_join(cexpr.identifiers(F.col("expression")), ",").alias("names"), cexpr.references(F.col("expression"), "x").alias("has_x"))


@query("j9_unsafe_reasons", X, f"SELECT doc_id, {_UNSAFE} AS reason FROM exprs")
def j9(exprs):
    return exprs.select("doc_id", cexpr.unsafe_reason(F.col("expression")).alias("reason"))


_INVALID = f"""CASE WHEN doc_id % 5 = 0 THEN 'non-semantic kind ''reachability'' (only semantic ones are proposed)' WHEN {_UNSAFE} IS NOT NULL THEN 'unsafe expression: ' || {_UNSAFE} WHEN doc_id % 11 = 9 THEN 'vacuous expression: references neither a parameter nor the result'
    WHEN doc_id % 4 = 1 THEN 'domain expr ''result > 0'' references the result (unavailable pre-call)' WHEN doc_id % 4 = 2 THEN 'vacuous domain expr ''1 > 0'': references no parameter'"""


@query("c6_candidate_reasons", X, f"SELECT doc_id, {_INVALID} END AS plain, {_INVALID} WHEN doc_id % 11 = 8 THEN 'expression references unknown identifier ''a' || doc_id || '''' WHEN doc_id % 4 = 3 THEN 'domain expr ''z > INT_MIN'' references unknown ident ''z''' WHEN lang = 'fr' THEN 'referenced_params includes non-parameter ''fr''' END AS signed FROM exprs")
def c6(exprs):
    rows = exprs.withColumns({"params": F.array(*map(F.lit, ("x", "n", "out"))), "inputs": F.array(*map(F.lit, ("x", "n"))), "referenced_params": F.array(F.lit("x"), F.when(F.col("lang") == "fr", F.col("lang")).otherwise("n"))})
    return rows.select("doc_id", candidates.invalid_reason(signed=False).alias("plain"), candidates.invalid_reason().alias("signed"))


@query("f14_accepted", X, f"""WITH r AS (SELECT *, doc_id // 10 AS unit, doc_id // 10 || '' AS unit_id, {_INVALID} END AS why FROM exprs), v AS (SELECT *, why IS NULL AND row_number() OVER (PARTITION BY unit, why IS NULL, expression, domain ORDER BY doc_id) = 1 AS good FROM r),
    b AS (SELECT *, coalesce(sum(CAST(good AS INT)) OVER (PARTITION BY unit ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v)
    SELECT doc_id, CASE WHEN before >= 2 THEN 'over max_candidates' WHEN why IS NOT NULL THEN why WHEN NOT good THEN 'duplicate in batch' END AS reason, before < 2 AND good AS accepted FROM b""")
def f14(exprs):
    rows = exprs.withColumns({"unit_id": F.expr("cast(doc_id div 10 as string)"), "reason": candidates.invalid_reason(signed=False)})
    return candidates.accepted(rows, order="doc_id", most=2).select("doc_id", "reason", "accepted")


REPLIES = Relation(
    "SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN '{{\"candidates\":[{{\"expression\":\" result > ' || CAST(doc_id AS {str}) || ' \",\"domain\":[\"x > 0\",\" \"]}},{{\"expression\":\"result < 9\",\"rationale\":\"r\",\"kind\":\"semantic\"}}]}}' "
    "WHEN 1 THEN '```json' || {nl} || '[{{\"expression\":\"result > ' || CAST(doc_id AS {str}) || '\"}}]' || {nl} || '```' WHEN 2 THEN '[]' WHEN 3 THEN 'no json' WHEN 4 THEN '{{\"other\":1}}' WHEN 5 THEN '7' WHEN 6 THEN '{{\"candidates\":{{}}}}' WHEN 7 THEN '[{{\"expression\":\"a\"}},{{\"expression\":\" \"}}]' ELSE '[{{\"expression\":\"a\",\"domain\":[1]}}]' END AS reply FROM {documents}"
)


@query("a13_candidates", {"replies": REPLIES}, "SELECT doc_id, ord, CASE WHEN ord = 1 THEN 'result < 9' ELSE 'result > ' || doc_id END AS expression, CASE WHEN doc_id % 9 = 0 AND ord = 0 THEN 'x > 0' ELSE '' END AS domain, CASE WHEN ord = 1 THEN 'semantic' END AS kind FROM replies, (VALUES (0), (1)) o(ord) WHERE doc_id % 9 = 0 OR (doc_id % 9 = 1 AND ord = 0)")
def a13(replies):
    return candidates.parsed(replies)[0].select("doc_id", "ord", "expression", F.array_join("domain", ",").alias("domain"), "kind")


@query("a13_refused_replies", {"replies": REPLIES}, "SELECT doc_id, CASE doc_id % 9 WHEN 3 THEN 'model output is not JSON' WHEN 4 THEN 'model JSON object lacks a \"candidates\" key' WHEN 5 THEN 'model JSON is neither an object nor a list' WHEN 6 THEN '\"candidates\" is not a list' WHEN 7 THEN 'candidate 1 is malformed' ELSE 'candidate 0 is malformed' END AS error FROM replies WHERE doc_id % 9 > 2")
def a13_refused(replies):
    return candidates.parsed(replies)[1].select("doc_id", "error")


@query("n3_proposals", {"replies": REPLIES}, "SELECT doc_id, substr(sha256('u' || chr(0) || 'semantic' || chr(0) || CASE WHEN ord = 1 THEN 'result < 9' ELSE 'result > ' || doc_id END || CASE WHEN doc_id % 9 = 0 AND ord = 0 THEN chr(0) || 'x > 0' ELSE '' END), 1, 16) AS property_id FROM replies, (VALUES (0), (1)) o(ord) WHERE doc_id % 9 = 0 OR (doc_id % 9 = 1 AND ord = 0)")
def n3(replies):
    rows = candidates.parsed(replies)[0].withColumns({"unit_id": F.lit("u"), "run": F.col("doc_id")})
    rows = rows.withColumn("reason", candidates.invalid_reason(signed=False))
    return candidates.accepted(rows.withColumn("unit_id", F.col("run").cast("string"))).where("accepted").select("doc_id", names.property_id(F.lit("u"), F.lit("semantic"), F.col("expression"), F.col("domain")).alias("property_id"))


@query("j19_prompts", D, "SELECT doc_id, 'Unit ' || unit_id || ' fn ' || regexp_extract(unit_id, '^.*?::(.*)$', 1) || ' result 6: ' || left(text, 20) || ' <<MAX>>' AS prompt, '[' || doc_id || ']' AS bare FROM docs")
def j19(docs):
    template = F.lit("Unit <<UNIT_ID>> fn <<SYMBOL>> <<RESULT>> <<MAX>>: <<SOURCE>>")
    prompt = candidates.render_prompt(template, F.col("unit_id"), F.concat(F.substring("text", 1, 20), F.lit(" <<MAX>>")))
    fenced = F.concat(F.lit(" ```json\n["), F.col("doc_id").cast("string"), F.lit("]\n```\n"))
    return docs.select("doc_id", prompt.alias("prompt"), candidates.strip_fences(fenced).alias("bare"))


@query("l7_prompt_registry", D, "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'semantic/v1' WHEN doc_id % 3 = 1 THEN 'semantic/v2' END AS ref FROM docs")
def l7(docs):
    prompts = docs.sparkSession.createDataFrame(list(candidates.PROMPTS), "prompt_id string, version string")
    wanted = docs.withColumns({"prompt_id": F.lit("semantic"), "version": (F.col("doc_id") % 3 + 1).cast("string")})
    return candidates.prompt_refs(wanted, prompts).select("doc_id", "ref")


@query("a12_patched_sources", D, "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'm.py,' || path WHEN 2 THEN 'm.py,' || path WHEN 3 THEN 'm.py,' || path ELSE 'm.py' END AS paths FROM docs")
def a12(docs):
    lines = F.concat(F.lit("*** Begin Patch\n*** Delete File: z.c\n*** Update File: old.txt\n*** Move to:  m.py \n*** Add File: "), F.col("path"), F.lit("\n+x\n*** Update File: m.py\n *** Add File: no.c"))
    return docs.select("doc_id", F.array_join(readers.edited_sources(lines), ",").alias("paths"))


@query("a11_hook_payloads", D, "SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN path END AS file, doc_id % 3 = 2 AS broken FROM docs")
def a11(docs):
    text = F.when(F.col("doc_id") % 3 == 0, " ").when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(F.struct(F.col("path").alias("file_path")).alias("tool_input")))).otherwise("[1, ")
    p = readers.hook_payload(text)
    return docs.select("doc_id", p["tool_input"]["file_path"].alias("file"), (p.isNull() | ((F.col("doc_id") % 3 == 2) & p["tool_input"].isNull())).alias("broken"))


@query("a14_model_replies", D, "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN lang END AS text, CASE doc_id % 5 WHEN 1 THEN 'exit 2' WHEN 2 THEN 'envelope is not JSON' WHEN 3 THEN 'model error: overloaded' WHEN 4 THEN 'empty reply' END AS error FROM docs")
def a14(docs):
    n = F.col("doc_id") % 5
    envelope = F.when(n == 2, "{").when(n == 3, '{"is_error": true, "subtype": "overloaded", "result": "x"}').when(n == 4, '{"result": " "}').otherwise(F.to_json(F.struct(F.col("lang").alias("result"))))
    return docs.select("doc_id", readers.model_reply(envelope, F.when(n == 1, 2).otherwise(0)).alias("r")).select("doc_id", "r.*")


STATUS = Relation("SELECT CAST(floor(doc_id / 20) AS BIGINT) AS snapshot, doc_id, CASE doc_id % 5 WHEN 0 THEN 'M ' WHEN 1 THEN ' M' WHEN 2 THEN '??' WHEN 3 THEN 'R ' ELSE 'MM' END AS xy, 'Rename' || CAST(doc_id AS {str}) || '.c' AS path FROM {documents}")
A = {"status": STATUS}


def _records(status):
    source = F.when(F.col("doc_id") % 5 == 3, F.concat(F.lit("\x00Copy of "), "path")).otherwise("")
    field = F.concat("xy", F.lit(" "), "path", source, F.lit("\x00"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", field.alias("f")))), lambda r: r["f"]), "")
    return status.groupBy("snapshot").agg(gate.status_records(text).alias("records"))


@query("a8_status_records", A, "SELECT snapshot, xy, path FROM status")
def a8(status):
    return _records(status).select("snapshot", F.explode("records").alias("r")).select("snapshot", "r.*")


@query("a9_staged_paths", A, "SELECT snapshot, path FROM status WHERE doc_id % 5 IN (0, 3, 4)")
def a9(status):
    return _records(status).select("snapshot", F.explode(gate.staged_paths(F.col("records"))).alias("path"))


MARKS = Relation("SELECT user_id, CAST(event_id % 400 AS INT) AS physical, {k} * 10 AS number FROM {events} WHERE event_id % 9 = 0")
LINES = Relation("SELECT DISTINCT user_id, CAST(event_id % 400 AS INT) AS physical FROM {events} WHERE event_id % 4 = 1")


@query("d9_presumed_lines", {"marks": MARKS, "lines": LINES}, """WITH m AS (SELECT user_id, physical, max(number) AS number FROM marks GROUP BY user_id, physical)
    SELECT l.user_id, l.physical, CAST(coalesce(m.number + l.physical - m.physical - 1, l.physical) AS BIGINT) AS presumed FROM lines l ASOF LEFT JOIN m ON l.user_id = m.user_id AND l.physical > m.physical""")
def d9(marks, lines):
    return units.presumed(lines, marks.groupBy("user_id", "physical").agg(F.max("number").alias("number")), "user_id")


@query("d8_nearest_definitions", {"marks": MARKS, "lines": LINES}, """WITH m AS (SELECT DISTINCT user_id, physical, physical * 7 % 150 AS line FROM marks), w AS (SELECT DISTINCT user_id, physical % 120 AS def_line FROM lines WHERE physical % 3 = 0)
    SELECT w.user_id, def_line, m.physical FROM w JOIN m USING (user_id) QUALIFY row_number() OVER (PARTITION BY w.user_id, def_line ORDER BY line < def_line, abs(line - def_line), -m.physical) = 1""")
def d8(marks, lines):
    found = marks.select("user_id", "physical", (F.col("physical") * 7 % 150).alias("line")).distinct()
    return units.nearest(found, lines.where("physical % 3 = 0").select("user_id", (F.col("physical") % 120).alias("def_line")).distinct(), "user_id").select("user_id", "def_line", "physical")
