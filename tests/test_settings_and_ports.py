"""Settings of the environment, single replies and listings on the driver, sinks that keep or drop rows, typed failures and vocabularies, and verification through ports."""

import pytest
from pyspark.sql import functions as F

from runledger import schemas
from runledger.operators import units, verify
from runledger.sources import readers, sinks
from runledger.sources.settings import Settings, session
from runledger.streaming import state


def test_numbers_globs_and_flags_of_an_environment():
    s = Settings({"A": "7", "B": " ", "C": "x", "D": "nan", "E": "0", "F": "2.5", "G": " src/*, ,lib ", "H": "-DX='a b' -I.", "I": "'open"})
    assert [s.number("A", 1), s.number("B", 2), s.number("none", 3), s.number("F", 1.0, float)] == [7, 2, 3, 2.5] and not s.blocks
    assert [s.number("C", 4), s.number("D", 5.0, float), s.number("E", 6, least=1)] == [4, 5.0, 6] and s.blocks and len(s.errors) == 3
    assert s.globs("G") == ["src/*", "lib"] and s.globs("none") == [] and s.flags("H") == ["-DX=a b", "-I."] and s.flags("none") == []
    with pytest.raises(schemas.ConfigError, match="I"):
        s.flags("I")


def test_budget_that_no_attempt_fits_is_an_error():
    s = Settings({})
    s.check_budget(20, 60)
    assert not s.blocks
    s.check_budget(61, 60)
    assert s.blocks and "61" in s.errors[0]


def test_session_settings_come_back_after_an_error(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), session(spark, {key: "3", "runledger.none": "x"}):
        assert spark.conf.get(key) == "3"
        1 / 0
    assert spark.conf.get(key) == before and spark.conf.get("runledger.none", None) is None


@pytest.mark.parametrize("reply, code", [("{", 0), ("[]", 0), ('{"result": " "}', 0), ('{"result": "x"}', 1), ('{"result": "x", "is_error": true}', 0), ("null", 0)])
def test_a_reply_that_failed_raises(reply, code):
    with pytest.raises(schemas.ModelReplyError):
        readers.complete(reply, code)
    assert readers.complete('{"result": "text"}') == "text"


def test_listing_that_failed_is_not_an_empty_list():
    dump = "|-FunctionDecl 0x1 <a.c:1:1> col:5 f 'void (void)'\n| `-CompoundStmt 0x2 <col:9>\n|-FunctionDecl 0x3 <line:2:1> col:5 g 'void (void)'\n"
    assert [r["rest"].split()[3] for r in units.list_units(dump, "a.c")] == ["f"] and units.list_units("", "a.c") == []
    for arguments in ((None, "a.c"), (dump, "a.c", 1)):
        with pytest.raises(schemas.UnitsUnavailable):
            units.list_units(*arguments)


def test_kept_and_dropped_rows(spark):
    rows = spark.range(3)
    assert sinks.collected(rows, "kept_rows").count() == spark.table("kept_rows").count() == 3
    sinks.discarded(rows)


def test_failures_are_of_one_family_and_vocabularies_agree():
    kinds = (schemas.UnitsUnavailable, schemas.DuplicateProperty, schemas.PropertyNotFound, schemas.InvalidStatusTransition, schemas.HarnessError, schemas.ConfigError, schemas.ModelReplyError)
    assert all(issubclass(k, schemas.EngineError) for k in kinds)
    assert schemas.TERMINAL == ("accepted", "rejected") and schemas.CHECKABLE == ("candidate", "graded")
    assert set(schemas.EXIT_CODES) == set(schemas.VERDICTS) and set(schemas.ASSESSMENT_EXIT_CODES) == set(schemas.ASSESSMENTS)


def test_carriers_hold_rows(spark):
    carriers = (schemas.RUN, schemas.RESULT, schemas.PROPERTY, schemas.UNIT, schemas.TRACE_EVENT, schemas.LOOP_EVENT, schemas.ITERATION, schemas.CALLER_CHECK, *schemas.STATE_TABLES.values())
    for ddl in carriers:
        assert spark.createDataFrame([], ddl).withColumn("x", F.lit(1)).count() == 0


def test_verification_through_a_live_port(spark):
    rows = spark.createDataFrame([(1, "u", "a.c", "f", 4, None, "c"), (2, "u", "a.c", None, 8, ["-I."], "c"), (3, "u", "b.x", "f", 4, None, "other"), (4, "u", "slow.c", "f", 4, None, "c")], "run_id long, unit_id string, source string, function string, k int, extra array<string>, frontend string")
    trace = "[Counterexample]\n\nViolated property:\n  file a.c line 1 column 2 function f\n  d\n\nVERIFICATION FAILED\n"

    def port(pdf):
        late = pdf["argv"].map(lambda a: "slow.c" in a)
        out = pdf["k"].map({4: trace, 8: "VERIFICATION SUCCESSFUL\n"})
        return pdf.assign(exit_code=[None if x else 0 for x in late], duration_s=0.1, stdout=out.where(~late, ""), stderr="")[["exit_code", "duration_s", "stdout", "stderr"]]

    def answer(asked):
        return asked.join(readers.runs(asked, port).select("run_id", "exit_code", "stdout", "stderr"), "run_id")

    got = {r.run_id: r for r in verify.verified(rows, answer).collect()}
    assert [got[i].verdict for i in (1, 2, 3, 4)] == ["violated", "verified", "violated", "unknown"] and got[4].reason == "timeout"
    assert got[1].counterexample.violated_property.description == "d" and got[3].counterexample is None and got[3].raw_counterexample
    assert got[2].argv == ["esbmc", "a.c", "--unwind", "8", "--no-unwinding-assertions", "-I.", "--timeout", "30s"]


def test_counters_of_a_stream_by_time(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "0.json").write_text("".join(f'{{"ts": {t}, "type": "gate", "decision": "{d}"}}\n' for t, d in ((10, "block"), (20, "pass"), (30, "block"), (1000, "pass"))))
    out = state.counters(state.trace_stream(spark, str(folder)))
    kept = []
    out.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, n: kept.extend(df.collect())).trigger(availableNow=True).start().awaitTermination(100)
    assert [(r.n_blocks, r.n_passes) for r in kept] == [(2, 1)]
