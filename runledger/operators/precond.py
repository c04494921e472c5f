"""Memory preconditions: how parameters are materialised, the C text of it, and what runs under it establish.

A unit's parameters are one array, so its plan is an expression over that array; outcomes per caller and the fold over
callers are ordered cases and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..schemas import POINTER_ROLES

# Names that read as a length in bytes or as a number of elements, and what an integer type holds.
BYTE_LENGTHS = ("len", "length", "size", "nbytes", "n_bytes", "buflen")
ELEMENT_COUNTS = ("n", "count", "nmemb", "num", "nelem")
INTEGER_WORDS = ("int", "long", "short", "char", "size_t", "unsigned", "signed")
DEFAULT_MAX_LEN, DEFAULT_CAP = 8, 256
#: Labels of injected assertions; a run's trace names the one that failed.
NON_VACUITY, OBLIGATION, OBLIGATION_SITE = "runledger:non-vacuity", "runledger:obligation:", "runledger:obligation-site:"


def is_pointer(ctype: Column) -> Column:
    return ctype.contains("*") | ctype.contains("[")


def is_integer(ctype: Column) -> Column:
    """By substring: any type whose name holds an integer word counts."""
    return ctype.rlike("|".join(INTEGER_WORDS))


def length_kind(param: Column) -> Column:
    """J16. ptr_byte_len or ptr_elem_count for a parameter that reads as a length, else null."""
    name = F.lower(param["name"])
    kind = F.when(name.isin(*BYTE_LENGTHS), "ptr_byte_len").when(name.isin(*ELEMENT_COUNTS), "ptr_elem_count")
    return F.when(~is_pointer(param["type"]) & is_integer(param["type"]), kind)


def is_materialisable(ctype: Column) -> Column:
    """J16. A pointer of one level to something of known size: no function, array or void behind it."""
    plain = F.regexp_replace(F.trim(ctype), r"\b_Atomic\s*\(([^()]*)\)", "$1")
    stars = F.length(plain) - F.length(F.replace(plain, F.lit("*"), F.lit("")))
    pointee = F.regexp_replace(plain, r"\b(?:const|volatile|__restrict__|__restrict|restrict|_Atomic)\b|\*|\s", "")
    return ~plain.contains("(*") & (stars == 1) & ~pointee.isin("void", "")


def var_name(param: Column, index: Column) -> Column:
    return F.coalesce(F.nullif(param["name"], F.lit("")), F.concat(F.lit("arg"), index.cast("string")))


def plan(params: Column) -> Column:
    """F13. Per parameter struct(var, type, role, length_var, extent, static_min): the first of five rules decides for a pointer, and only the next parameter can be its length."""

    def of(p, i):
        behind = F.get(params, i + 1)
        kind = length_kind(behind)
        declined = ~is_materialisable(p["type"]) | (p["array_extent_unresolved"] & p["array_static_min"])
        paired = ~declined & kind.isNotNull()
        pointer = F.when(declined, "unresolved").when(kind.isNotNull(), kind).when(p["array_extent"].isNotNull(), "fixed_array").when(p["array_extent_unresolved"], "unresolved").otherwise("scalar_ptr")
        before = F.get(params, i - 1)
        consumed = (i > 0) & is_pointer(before["type"]) & is_materialisable(before["type"]) & ~(before["array_extent_unresolved"] & before["array_static_min"]) & length_kind(p).isNotNull()
        role = F.when(is_pointer(p["type"]), pointer).when(F.coalesce(consumed, F.lit(False)), "length").otherwise("scalar")
        ptr = is_pointer(p["type"])
        return F.struct(
            var_name(p, i).alias("var"), p["name"].alias("name"), p["type"].alias("type"), role.alias("role"), F.when(ptr & paired, var_name(behind, i + 1)).alias("length_var"),
            F.when(ptr & (role == "fixed_array"), p["array_extent"]).alias("extent"), F.when(ptr & paired & p["array_static_min"], p["array_extent"]).alias("static_min"),
        )

    return F.transform(params, of)


def planned(units: DataFrame) -> DataFrame:
    """F13, E9. units with plan, resolvable (all parameters; true without any), unresolved_params and n_pointers."""
    rows = units.withColumn("plan", plan(F.col("params")))
    bad = F.transform(F.filter("plan", lambda p: p["role"] == "unresolved"), lambda p: p["var"])
    return rows.withColumns({"resolvable": F.forall("plan", lambda p: p["role"] != "unresolved"), "unresolved_params": bad, "n_pointers": F.size(pointers(F.col("plan")))})


def pointers(plan_: Column) -> Column:
    return F.filter(plan_, lambda p: p["role"].isin(*POINTER_ROLES))


def weakest_pointers(plan_: Column) -> Column:
    """N8. Pointers that no extent sizes."""
    return F.transform(F.filter(plan_, lambda p: p["role"] == "scalar_ptr"), lambda p: p["var"])


def at_least(size: Column, floor: Column) -> Column:
    return F.concat(F.lit("("), size, F.lit(" > "), floor, F.lit(" ? "), size, F.lit(" : "), floor, F.lit(")"))


def element_count(p: Column) -> Column:
    """J17. The number that an allocation multiplies, for a pointer with an element count; else null."""
    count = F.concat(F.lit("(size_t)"), p["length_var"])
    floored = at_least(count, F.concat(F.lit("(size_t)"), p["static_min"].cast("string")))
    return F.when(p["role"] == "ptr_elem_count", F.when(p["static_min"].isNull(), count).otherwise(floored))


def allocation(p: Column) -> Column:
    """J17. The size of a pointer's object in C; null for other parameters."""
    one = F.concat(F.lit("sizeof(*"), p["var"], F.lit(")"))
    bytes_ = F.concat(F.lit("(size_t)"), p["length_var"])
    floor = F.concat(F.lit("(size_t)"), p["static_min"].cast("string"), F.lit(" * "), one)
    return (
        F.when(p["role"] == "scalar_ptr", one)
        .when(p["role"] == "ptr_byte_len", F.when(p["static_min"].isNull(), bytes_).otherwise(at_least(bytes_, floor)))
        .when(p["role"] == "ptr_elem_count", F.concat(element_count(p), F.lit(" * "), one))
        .when(p["role"] == "fixed_array", F.concat(F.lit("(size_t)"), p["extent"].cast("string"), F.lit(" * "), one))
    )


def length_bound(p: Column, max_len: int = DEFAULT_MAX_LEN) -> Column:
    """J17. The assumption on a length; a signed one is not negative."""
    low = F.when(p["type"].contains("unsigned"), "").otherwise(F.concat(p["var"], F.lit(" >= 0 && ")))
    return F.concat(F.lit("__ESBMC_assume("), low, p["var"], F.lit(f" <= {max_len});"))


def obligation(p: Column) -> Column:
    """J17. What a caller owes for one pointer: the size that is allocated, checked from the object's start, against wrapping."""
    var = p["var"]
    offset = F.concat(F.lit("__ESBMC_POINTER_OFFSET((const void *)"), var, F.lit(")"))
    size = F.concat(F.lit("(__SIZE_TYPE__)("), allocation(p), F.lit(")"))
    span = F.concat(F.lit("((__SIZE_TYPE__)"), offset, F.lit(" + "), size, F.lit(")"))
    base = F.concat(F.lit("(void *)((const char *)"), var, F.lit(" - "), offset, F.lit(")"))
    count = element_count(p)
    guard = F.when(count.isNull(), "").otherwise(F.concat(F.lit("("), count, F.lit(") <= (__SIZE_TYPE__)-1 / sizeof(*"), var, F.lit(") && ")))
    return F.concat(F.lit("("), guard, offset, F.lit(" >= 0 && "), span, F.lit(" >= "), size, F.lit(" && __ESBMC_r_ok("), base, F.lit(", "), span, F.lit("))"))


def sidecar(plan_: Column, function: Column, source: Column, max_len: int = DEFAULT_MAX_LEN, non_vacuity: bool = False, includes: tuple[str, ...] = ("stdlib.h",)) -> Column:
    """J18, N11. The harness of a plan in C; null where a parameter is unresolved, never a wrong object."""
    scalars = F.filter(plan_, lambda p: p["role"].isin("scalar", "length"))
    types = F.array_distinct(F.transform(scalars, lambda p: p["type"]))
    lit = lambda *words: F.array(*map(F.lit, words))
    head = F.concat(F.array(F.concat(F.lit('#include "'), source, F.lit('"'))), lit(*[f"#include <{h}>" for h in includes], ""))
    prototypes = F.transform(types, lambda t: F.concat(F.lit("extern "), t, F.lit(" "), names.nondet_slug(t), F.lit("(void);")))
    drawn = lambda p: F.concat(F.lit("    "), p["type"], F.lit(" "), p["var"], F.lit(" = "), names.nondet_slug(p["type"]), F.lit("();"))
    bound = lambda p: F.when(p["role"] == "length", F.concat(F.lit("    "), length_bound(p, max_len)))
    scalar_lines = F.filter(F.flatten(F.transform(scalars, lambda p: F.array(drawn(p), bound(p)))), lambda x: x.isNotNull())
    objects = F.transform(pointers(plan_), lambda p: F.concat(F.lit("    "), p["type"], F.lit(" "), p["var"], F.lit(" = malloc("), allocation(p), F.lit(");")))
    call = F.array(F.concat(F.lit("    "), function, F.lit("("), F.array_join(F.transform(plan_, lambda p: p["var"]), ", "), F.lit(");")))
    tail = lit(*([f'    __ESBMC_assert(0, "{NON_VACUITY}");'] if non_vacuity else []), "    return 0;", "}", "")
    text = F.array_join(F.concat(head, prototypes, lit("", "int main(void) {"), scalar_lines, objects, call, tail), "\n")
    return F.when(F.forall(plan_, lambda p: p["role"] != "unresolved"), text)


def obligation_problem(plan_: Column, function: Column) -> Column:
    """N11. Why obligations cannot be injected, null if they can."""
    listed = lambda ps: F.concat(F.lit("("), F.array_join(F.transform(ps, lambda p: F.concat(F.lit("'"), p["var"], F.lit("'"))), ", "), F.lit(")"))
    bad, unnamed = F.filter(plan_, lambda p: p["role"] == "unresolved"), F.filter(pointers(plan_), lambda p: F.coalesce(p["name"], F.lit("")) == "")
    return F.when(F.size(bad) > 0, F.concat(function, F.lit(": unresolved parameters "), listed(bad))).when(
        F.size(unnamed) > 0, F.concat(function, F.lit(": cannot inject an obligation naming unnamed parameter(s) "), listed(unnamed))
    )


def obligation_checks(plan_: Column, function: Column, site_probe: bool = False) -> Column:
    """J18. The text that goes behind a definition's opening brace."""
    if site_probe:
        return F.concat(F.lit(f' __ESBMC_assert(0, "{OBLIGATION_SITE}'), function, F.lit('");'))
    one = lambda p: F.concat(F.lit(" __ESBMC_assert("), obligation(p), F.lit(f', "{OBLIGATION}'), function, F.lit(":"), p["var"], F.lit('");'))
    return F.array_join(F.transform(pointers(plan_), one), "")


def line_directive(path: Column) -> Column:
    return F.concat(F.lit('#line 1 "'), F.replace(F.replace(path, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"\n'))


def assessed(settled: DataFrame) -> DataFrame:
    """N7. settled (verdict, k, reason, message, probe_verdict, probe_text) with assessment and detail: a verified run counts only if the probe shows that the call is reached."""
    v, probe = F.col("verdict"), F.col("probe_verdict")
    reached = F.coalesce((probe == "violated") & F.col("probe_text").contains(NON_VACUITY), F.lit(False))
    case = lambda a, d: F.struct(F.lit(a).alias("assessment"), (d if isinstance(d, Column) else F.lit(d)).alias("detail"))
    k = F.col("k").cast("string")
    out = (
        F.when(v == "violated", case("violated", "a pointer access is out of bounds under the synthesised precondition"))
        .when(v == "unknown", case("unknown", F.concat(F.lit("inconclusive up to k="), k, F.lit(" (reason: "), F.col("reason"), F.lit(")"))))
        .when(~F.coalesce(v == "verified", F.lit(False)), case("error", F.coalesce(F.col("message"), F.lit("no verdict"))))
        .when(reached, case("assumed_verified", "verified up to k assuming valid caller pointers; call site reachable"))
        .when(probe == "verified", case("vacuous", "the assert-at-call-site was unreachable: the synthesised precondition is contradictory (a vacuous proof)"))
        .otherwise(case("unknown", F.concat(F.lit("could not confirm call-site reachability (non-vacuity probe: "), F.coalesce(probe, F.lit("none")), F.lit(")"))))
    )
    return settled.withColumn("__o", out).select("*", "__o.*").drop("__o")


def caller_checks(callers: DataFrame) -> DataFrame:
    """N8. callers (resolvable, unresolved_params, weakest (array), verdict, k, cex_text, probe_verdict, probe_text) with outcome and detail. The label of the obligation tells a caller's fault from its callee's."""
    v, probe, k = F.col("verdict"), F.col("probe_verdict"), F.col("k").cast("string")
    blamed = F.coalesce(F.col("cex_text").contains(OBLIGATION), F.lit(False))
    reached = F.coalesce((probe == "violated") & F.col("probe_text").contains(OBLIGATION_SITE), F.lit(False))
    case = lambda o, d: F.struct(F.lit(o).alias("outcome"), (d if isinstance(d, Column) else F.lit(d)).alias("detail"))
    weak = F.concat(F.lit("L0 reads no extent for its own pointer(s) ("), F.array_join("weakest", ", "), F.lit("), so it cannot supply what the callee needs and the failure is not attributable to it"))
    out = (
        F.when(~F.coalesce("resolvable", F.lit(False)), case("unchecked", F.concat(F.lit("L0 cannot materialise the caller's parameter(s): "), F.array_join("unresolved_params", ", "))))
        .when((v == "violated") & blamed & (F.size("weakest") > 0), case("underdetermined", weak))
        .when((v == "violated") & blamed, case("obligation_violated", "passes a pointer that does not satisfy the callee's precondition"))
        .when(v == "violated", case("caller_violated", "violates a memory property of its own, so the obligation was never reached"))
        .when(~F.coalesce(v == "verified", F.lit(False)), case("unchecked", F.concat(F.lit("inconclusive up to k="), k, F.lit(" ("), F.coalesce(v, F.lit("none")), F.lit(")"))))
        .when(reached, case("discharged", "reaches the call and satisfies the callee's precondition"))
        .when(probe == "verified", case("unreachable", "never reaches the call, so its pass discharges nothing"))
        .otherwise(case("unchecked", F.concat(F.lit("could not confirm the call is reached ("), F.coalesce(probe, F.lit("none")), F.lit(")"))))
    )
    return callers.withColumn("__o", out).select("*", "__o.*").drop("__o")


def attributed(checks: DataFrame) -> DataFrame:
    """H6. checks (callee, caller, outcome, detail, reentrant) with a broken obligation of a re-entrant callee taken off its callers."""
    off = F.coalesce(F.col("reentrant"), F.lit(False)) & (F.col("caller") != F.col("callee")) & (F.col("outcome") == "obligation_violated")
    why = F.concat(
        F.col("callee"), F.lit("() can re-enter itself and the obligation is checked at every entry from whatever ambient state the caller left the translation unit in, which the callee's own "
        "self-check explores only from this translation unit's initial state, so this failure cannot be attributed to this caller")
    )
    return checks.withColumns({"detail": F.when(off, why).otherwise(F.col("detail")), "outcome": F.when(off, "unattributed").otherwise(F.col("outcome"))})


def discharged(checks: DataFrame, order: list[str]) -> DataFrame:
    """E3, E10, D16. Per callee the fold over its checks: assessment and detail.

    checks: callee, caller, outcome, detail, anchored (the caller has no pointer of its own), internal, settled_k,
    max_len. Any broken obligation is a violation; any check that is not a discharge, or a callee that other units can
    name, leaves it assumed. The texts of a callee's checks come together in one row.
    """
    f = F.col("callee")
    broken, clean = F.col("outcome") == "obligation_violated", F.coalesce(F.col("outcome") == "discharged", F.lit(False))
    at = F.struct(*order)
    texts = lambda keep, text: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(at.alias("at"), text.alias("t"))))), lambda x: x["t"])
    rows = checks.groupBy("callee").agg(
        texts(broken, F.concat(F.col("caller"), F.lit("()"))).alias("names"), texts(~clean, F.concat(F.col("caller"), F.lit("(): "), F.col("detail"))).alias("why"),
        F.bool_and(F.coalesce("internal", F.lit(False))).alias("internal"), F.bool_and(F.coalesce("anchored", F.lit(False))).alias("anchored"),
        F.max("settled_k").alias("k"), F.max("max_len").alias("n"),
    )
    violated = F.concat(F.array_join("names", ", "), F.lit(" passes "), f, F.lit("() a pointer that does not satisfy its synthesised memory precondition"))
    withheld = F.concat(F.lit("discharge incomplete — "), F.array_join("why", "; "))
    exported = F.concat(
        F.lit("discharge incomplete — every caller of "), f, F.lit("() in this translation unit satisfies its memory precondition, but the function is externally visible, so a client in another "
        "translation unit can call it with anything; the obligation is exported there, and closing it needs "), f, F.lit("() to be static or discharged in that TU too")
    )
    relative = F.when(F.col("anchored"), "").otherwise(" — relative to each caller's own synthesised precondition, which stays assumed until that caller is itself discharged")
    done = F.concat(
        F.lit("every caller of "), f, F.lit("() in this translation unit is verified to satisfy its memory precondition up to k="), F.coalesce(F.col("k").cast("string"), F.lit("None")), F.lit(", len<="),
        F.coalesce(F.col("n").cast("string"), F.lit("None")), F.lit(", for one invocation of each caller from this translation unit's initial state"), relative,
    )
    a = F.when(F.size("names") > 0, "violated").when((F.size("why") > 0) | ~F.col("internal"), "assumed_verified").otherwise("discharged_verified")
    d = F.when(F.size("names") > 0, violated).when(F.size("why") > 0, withheld).when(~F.col("internal"), exported).otherwise(done)
    return rows.select("callee", a.alias("assessment"), d.alias("detail"))


def discharge(units: DataFrame, folded: DataFrame, found: DataFrame) -> DataFrame:
    """N9. Per unit (name, assessment, detail, n_pointers) its final assessment: only an assumed one can change; without pointers nothing was assumed; without callers and openings the obligation is exported.

    folded: callee, assessment, detail (of `discharged`). found: callee with a caller or opening.
    """
    has = found.select(F.col("callee").alias("name")).distinct().withColumn("__any", F.lit(True))
    rows = units.join(has, "name", "left").join(folded.select(F.col("callee").alias("name"), F.col("assessment").alias("__a"), F.col("detail").alias("__d")), "name", "left")
    assumed = F.coalesce(F.col("assessment") == "assumed_verified", F.lit(False))
    alone = F.concat(F.lit("discharge incomplete — no caller of "), F.col("name"), F.lit("() in this translation unit, so the obligation is exported to its clients rather than discharged here"))
    none = F.lit("no pointer parameter, so the memory precondition is empty and nothing was assumed of a caller")
    a = F.when(~assumed, F.col("assessment")).when(F.col("n_pointers") == 0, "discharged_verified").when(F.col("__any").isNull(), "assumed_verified").otherwise(F.coalesce("__a", F.lit("assumed_verified")))
    d = F.when(~assumed, F.col("detail")).when(F.col("n_pointers") == 0, none).when(F.col("__any").isNull(), alone).otherwise(F.coalesce("__d", F.lit("discharge incomplete — no check of a caller")))
    return rows.select("name", a.alias("assessment"), d.alias("detail"))


def with_anchored(callers: DataFrame, anchored: DataFrame, key: list[str]) -> DataFrame:
    """D16. callers, each with whether its own precondition holds unconditionally (anchored: their keys)."""
    known = anchored.select(*key).distinct().withColumn("anchored", F.lit(True))
    return callers.drop("anchored").join(known, key, "left").withColumn("anchored", F.coalesce("anchored", F.lit(False)))
