"""Syntax trees, C text, sidecars, file sources and sinks, and streams on small inputs."""

import pytest
from pyspark.sql import functions as F

from runledger.functions import ctext, harness
from runledger.operators import callgraph, precond, units
from runledger.schemas import HarnessError
from runledger.sources import readers, sinks

DUMP = """TranslationUnitDecl 0x0 <<invalid sloc>> <invalid sloc>
|-FunctionDecl 0x1 <a.c:1:1, line:3:1> line:1:5 f 'int (int *)' static
| |-ParmVarDecl 0x2 <col:7, col:12> col:12 p 'int *'
| `-CompoundStmt 0x3 <col:15, line:3:1>
|   `-CallExpr 0x4 <line:2:3, col:9> 'int'
|     |-ImplicitCastExpr 0x5 <col:3> 'int (*)(int *)' <FunctionToPointerDecay>
|     | `-DeclRefExpr 0x6 <col:3> 'int (int *)' Function 0x9 'g' 'int (int *)'
|     `-DeclRefExpr 0x7 <col:5> 'int (int *)' Function 0x9 'h' 'int (int *)'
|-FunctionDecl 0x8 <line:5:1, col:20> col:5 h 'int (int *)'
`-FunctionDecl 0x9 <b.h:7:1, line:9:1> line:7:5 g 'int (int *)'
  `-CompoundStmt 0xa <col:15, line:9:1>
    `-DeclRefExpr 0xb <line:8:3> 'int (int *)' Function 0x1 'f' 'int (int *)'
"""


@pytest.fixture(scope="module")
def tree(spark):
    return units.placed(units.nodes(spark.createDataFrame([("a.c", DUMP), ("empty.c", ""), ("none.c", None)], "tu string, dump string"))).cache()


def test_nodes_know_parent_place_and_callee(tree):
    rows = {r.ord: r for r in tree.collect()}
    # A dump's first line has no drawing and is no node of the relation.
    names = [rows[i].kind for i in range(len(rows))]
    assert names.count("FunctionDecl") == 3
    f = names.index("FunctionDecl")
    assert [rows[i].parent for i in range(f, f + 7)] == [rows[f].parent, f, f, f + 2, f + 3, f + 4, f + 3]
    assert [rows[i].is_callee for i in range(f + 4, f + 7)] == [True, True, False]
    assert [(rows[i].file, rows[i].line) for i in (f, f + 3, f + 6, f + 7, f + 8, f + 10)] == [("a.c", 1), ("a.c", 2), ("a.c", 2), ("a.c", 5), ("b.h", 7), ("b.h", 8)]


def test_definitions_and_callers(spark, tree):
    found = units.definitions(tree)
    assert {(r["name"], r.file, r.def_line, r.internal_linkage, tuple(r.calls), len(r.params)) for r in found.collect()} == {("f", "a.c", 1, True, ("g", "h"), 1), ("g", "b.h", 7, False, ("f",), 0)}
    sources = spark.createDataFrame([("a.c", "./a.c")], "tu string, source string")
    own = units.units(found, sources)
    assert [r["name"] for r in own.collect()] == ["f"]
    assert [(r.callee, r.caller) for r in callgraph.external_callers(found, sources).collect()] == [("f", "g")]
    assert {(r.callee, r.site) for r in callgraph.address_escapes(tree).collect()} == {("h", "f"), ("f", "g")}
    assert {r["name"] for r in callgraph.self_reachable(callgraph.edges(found)).collect()} == {"f", "g"}
    texts = spark.createDataFrame([("a.c", "static int f(int p[static 4]) {\n}\n")], "tu string, text string")
    (unit,) = units.with_extents(own, texts).collect()
    assert (unit.params[0].array_extent, unit.params[0].array_extent_unresolved, unit.params[0].array_static_min) == (4, False, True)


def test_linker_aliases_attributes_and_assembly_open_a_function(spark):
    dump = "\n".join(
        [
            "|-FunctionDecl 0x1 <a.c:1:1> col:5 f 'void (void)'", '| `-AsmLabelAttr 0x2 <col:9> "sym"', "|-FunctionDecl 0x3 <line:2:1> col:5 other 'void (void)'", '| `-AsmLabelAttr 0x4 <col:9> "sym"',
            "|-FunctionDecl 0x5 <line:3:1> col:5 init 'void (void)'", "| `-ConstructorAttr 0x6 <col:9>", "|-FileScopeAsmDecl 0x7 <line:4:1>", "| `-StringLiteral 0x8 <col:5> 'char[9]' lvalue \"call f\"",
        ]
    )
    tree = units.nodes(spark.createDataFrame([("t", dump)], "tu string, dump string"))
    assert {(r.callee, r.site) for r in callgraph.symbol_aliases(tree).collect()} == {("f", "other"), ("other", "f")}
    assert [(r.callee, r.site) for r in callgraph.implicit_invocations(tree).collect()] == [("init", "constructor")]
    asked = spark.createDataFrame([("t", "f"), ("t", "init")], "tu string, callee string")
    assert [(r.callee, r.site) for r in callgraph.asm_sites(tree, asked).collect()] == [("f", "<file scope>")]
    none = spark.createDataFrame([], "tu string, callee string, caller string")
    found = callgraph.openings(none, callgraph.address_escapes(tree), callgraph.symbol_aliases(tree), callgraph.implicit_invocations(tree), callgraph.asm_sites(tree, asked))
    checks = callgraph.open_caller_checks(found, F.lit("a.c")).where("callee <> 'other'").orderBy("rank").collect()
    assert [(r.callee, r.caller, r.outcome, r["rank"]) for r in checks] == [("f", "other", "unresolved", 2), ("init", "<constructor>", "unresolved", 3), ("f", "<file scope>", "unresolved", 4)]


def test_subject_of_a_plan(spark):
    found = spark.createDataFrame([("a", "f", True, []), ("a", "g", False, ["v"]), ("b", "main", True, [])], "tu string, name string, resolvable boolean, unresolved_params array<string>")
    wanted = spark.createDataFrame([("a", "f"), ("a", "g"), ("a", "x"), ("b", "main"), ("c", "f")], "tu string, name string")
    got = units.plan_subject(found, wanted, spark.createDataFrame([("c", "exit 1")], "tu string, error string")).collect()
    assert {(r.tu, r["name"]): r.assessment for r in got} == {("a", "f"): None, ("a", "g"): "needs_contract", ("a", "x"): "error", ("b", "main"): "error", ("c", "f"): "error"}


def test_masks_keep_places():
    text = 'int a; // x\n/* y\n z */ char *s = "/* no */";\n'
    clean = ctext.masked(text)
    assert len(clean) == len(text) and clean.count("\n") == text.count("\n")
    assert "x" not in clean and "no" not in clean and "int a;" in clean
    assert ctext.peel(" ((a)(b)) ") == "(a)(b)" and ctext.peel("((1))") == "1"
    assert ctext.strip_subscripts("a[b[i]] + c", ["a", "b"]) == "a + c"
    assert ctext.split_top_level("int a, int (*f)(int, int), char b") == ["int a", "int (*f)(int, int)", "char b"]


def test_rename_leaves_members_comments_and_literals():
    text = 'int main(void) { x.main(); p->main(); puts("main()"); /* main() */ return main(); }'
    assert ctext.rename_function(text, "main", "m") == 'int m(void) { x.main(); p->main(); puts("main()"); /* main() */ return m(); }'
    assert ctext.splice("abc", [(0, 1, "xx"), (2, 3, "y")]) == "xxby"


@pytest.mark.parametrize(
    "text, marks",
    [
        ("#line 10\nx", [(1, 10)]), ("# 7 \"f\"\n", [(1, 7)]), ("#if 0\n#line 5\n#else\n#line 6\n#endif\n", [(4, 6)]), ("#if 1\n#line 5\n#else\n#line 6\n#endif\n", [(2, 5)]),
        ("#define N 40\n#line N\n", [(2, 40)]), ("#define N 40\n#undef N\n#line N\n", []), ("#if X\n#define N 4\n#endif\n#line N\n", []), ("#if 0\n#if 1\n#line 3\n#endif\n#endif\n", []),
    ],
)
def test_line_directives_by_branch(text, marks):
    assert ctext.line_breakpoints(text) == marks


@pytest.mark.parametrize(
    "declared, shape",
    [("int a[4]", (4, False, False)), ("int a[static 4]", (4, False, True)), ("int a[]", (None, False, False)), ("int a[N]", (None, True, False)), ("int a[2][3]", (None, True, False)), ("int *a", (None, False, False)), ("int a[const 4]", (4, False, False))],
)
def test_array_shapes(declared, shape):
    assert ctext.array_shape(declared, "a") == shape


def test_signatures_and_harness():
    source = "static int sum(const int *a, int n, int *out) { return 0; }"
    found = ctext.extract_signature(source, "sum")
    assert found.return_ctype == "int"
    assert [(p.ctype, p.name, p.length, p.const, p.out) for p in found.params] == [("int", "a", "n", True, False), ("int", "n", None, False, False), ("int", "out", "1", False, True)]
    text = harness.render(source, found, "result >= 0", ["n > 0", "a[0] > 0"])
    order = ["int n = nondet_int();", "__ESBMC_assume((n > 0));", "int a[n];", "__ESBMC_assume((a[0] > 0));", "int result = sum(a, n, &out);", "__ESBMC_assert((result >= 0)"]
    assert [text.index(x) for x in order] == sorted(text.index(x) for x in order)
    assert "dereferences" in harness.reason_against(found, "*out > 0", [])
    assert "output parameter" in harness.reason_against(found, "result > 0", ["out > 0"])
    assert "domain entry of its own" in harness.reason_against(found, "result > 0", ["a[0] > 0 && n > 0"])
    assert harness.reason_against(found, " ", []) == "semantic property has an empty postcondition"
    with pytest.raises(HarnessError):
        ctext.extract_signature("int f(int *a, int *b) { return 0; }", "f")
    with pytest.raises(HarnessError):
        ctext.extract_signature("int f(int a);", "f")


def _param(name, ctype, extent=None, unresolved=False, least=False):
    return (name, ctype, extent, unresolved, least)


def test_sidecar_and_obligations(spark):
    from runledger.schemas import PARAM

    rows = [(1, [_param("buf", "char *"), _param("len", "int")]), (2, [_param("v", "void *")]), (3, []), (4, [_param("", "int *")])]
    plans = precond.planned(spark.createDataFrame(rows, f"unit int, params array<{PARAM}>"))
    got = {r.unit: r for r in plans.select("unit", precond.sidecar(F.col("plan"), F.lit("f"), F.lit("a.c"), non_vacuity=True).alias("text"), precond.obligation_problem(F.col("plan"), F.lit("f")).alias("problem"), precond.obligation_checks(F.col("plan"), F.lit("f")).alias("checks")).collect()}
    lines = got[1].text.split("\n")
    assert lines[0] == '#include "a.c"' and "extern int nondet_int(void);" in lines
    assert lines[lines.index("int main(void) {") + 1 :][:4] == ["    int len = nondet_int();", "    __ESBMC_assume(len >= 0 && len <= 8);", "    char * buf = malloc((size_t)len);", "    f(buf, len);"]
    assert precond.NON_VACUITY in got[1].text and got[2].text is None and got[3].checks == ""
    assert got[1].problem is None and "unresolved" in got[2].problem and "unnamed" in got[4].problem
    assert got[1].checks.count("__ESBMC_assert(") == 1 and f'"{precond.OBLIGATION}f:buf"' in got[1].checks


def test_discharge_changes_assumed_units_only(spark):
    rows = [("a", "assumed_verified", "x", 1), ("b", "violated", "x", 1), ("c", "assumed_verified", "x", 0), ("d", "assumed_verified", "x", 2), ("e", "assumed_verified", "x", 2)]
    all_units = spark.createDataFrame(rows, "name string, assessment string, detail string, n_pointers int")
    folded = spark.createDataFrame([("a", "discharged_verified", "done"), ("b", "discharged_verified", "done")], "callee string, assessment string, detail string")
    found = spark.createDataFrame([("a",), ("a",), ("b",), ("e",)], "callee string")
    got = {r["name"]: r.assessment for r in precond.discharge(all_units, folded, found).collect()}
    assert got == {"a": "discharged_verified", "b": "violated", "c": "discharged_verified", "d": "assumed_verified", "e": "assumed_verified"}


def test_trace_log_in_file_order(spark, tmp_path):
    path = tmp_path / "events.jsonl"
    path.write_text('{"ts": 2, "type": "edit"}\n\nnot json\n[1]\n{"ts": 1, "type": "gate", "more": 1}\n')
    good, bad = readers.trace_events(spark, str(path))
    assert [r.ts for r in good.orderBy("file", "ord").collect()] == [2.0, 1.0]
    assert [r.value for r in bad.orderBy("ord").collect()] == ["not json", "[1]"]
    assert readers.trace_events(spark, str(tmp_path / "none"))[0].count() == 0


def test_state_document_round_trip(spark, tmp_path):
    path = tmp_path / "state.json"
    doc = {"units": {"a.c::f": {"unit_id": "a.c::f", "file": "a.c", "function": "f", "verdict": "verified", "k": 4, "counterexample": None, "detail": None}}, "scanned": {"a.c": "d"}, "pending": {"b.c": {"hash": "h", "attempts": 2, "pid": 7}}, "baseline_blobs": {"a.c": ["x", "y"]}, "stop_attempts": 3, "baseline_head": "abc"}
    sinks.write_document(str(path), doc)
    path.chmod(0o640)
    sinks.write_document(str(path), doc)
    assert path.stat().st_mode & 0o777 == 0o640 and [p.name for p in tmp_path.iterdir()] == ["state.json"]
    assert sinks.state_document(readers.state(spark, str(path))) == doc
    path.write_text("{broken")
    for where in (path, tmp_path / "none.json"):
        fresh = readers.state(spark, str(where))
        assert fresh["units"].count() == 0 and tuple(fresh["scalars"].first()) == (0, None)


def test_texts_records_and_ports(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.c").write_text("int main(void) { return 0; }\n")
    (text,) = readers.unit_texts(spark, str(tmp_path / "src")).collect()
    assert text.text == "int unit_main(void) { return 0; }\n"
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("a.c", "one"), ("b.c", "two")], "name string, text string")
    sinks.write_texts(rows, out, exclusive=True)
    sinks.write_texts(rows, out, exclusive=True)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.c", "b.c"]
    with pytest.raises(Exception, match="FileExistsError"):
        sinks.write_texts(rows.withColumn("text", F.lit("other")), out, exclusive=True)
    remote = f"file://{tmp_path}/remote"
    assert sinks.write_texts(rows.repartition(2), remote) == 2 and sinks.write_texts(rows.limit(0), remote) == 0
    assert {p.name: p.read_text() for p in (tmp_path / "remote").iterdir()} == {"a.c": "one", "b.c": "two"}
    sinks.write_document(f"{remote}/doc.json", {"a": 1})
    assert (tmp_path / "remote" / "doc.json").read_text() == '{\n  "a": 1\n}'
    records = spark.createDataFrame([("a.c::f", 1), ("a.c::f", 2), ("b.c::g", 3)], "unit string, n int")
    sinks.append_records(records, str(tmp_path / "runs"))
    sinks.append_records(records, str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).groupBy("unit").count().orderBy("unit").collect() == [("a.c::f", 4), ("b.c::g", 2)]
    assert sinks.log_events(records, "/proc/none/log") is False
    requests = spark.createDataFrame([(1, "u", 4, ["x"], 1.0)], "run_id long, unit_id string, k int, argv array<string>, timeout_s double")

    def broken(pdf):
        raise OSError("no checker")

    def late(pdf):
        return pdf.assign(exit_code=None, duration_s=1.0, stdout="", stderr="")[["exit_code", "duration_s", "stdout", "stderr"]]

    assert "no checker" in readers.runs(requests, broken).first().stderr
    assert "Timed out" in readers.runs(requests, late).first().stderr
