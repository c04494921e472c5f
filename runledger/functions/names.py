"""Identifiers, file names, labels and filters over paths, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"
#: Characters of the readable digests behind names.
PROPERTY_DIGITS, SLUG_DIGITS = 16, 12
# Folders that the gate leaves out unless told otherwise.
DEFAULT_EXCLUDED = ("third_party", "vendor", "node_modules")
# Suffixes of the sources that a patch may touch.
EDITED_SUFFIXES = (".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hh", ".py")


def property_id(unit_id: Column, kind: Column, expression: Column, domain: Column) -> Column:
    """Content id: who proposed a property does not count."""
    whole = F.array_join(F.concat(F.array(unit_id, kind, expression), F.coalesce(domain, F.array().cast("array<string>"))), NUL)
    return F.substring(F.sha2(whole, 256), 1, PROPERTY_DIGITS)


def unit_slug(unit_id: Column) -> Column:
    """Readable file name of a unit; the digest of the whole id tells units apart whose names read alike."""
    return F.concat(F.replace(F.replace(unit_id, F.lit("::"), F.lit("__")), F.lit("/"), F.lit("_")), F.lit("-"), F.substring(F.sha2(unit_id, 256), 1, SLUG_DIGITS))


def harness_file(unit_id: Column, property_id: Column) -> Column:
    safe = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_.-]", "_")
    return F.concat(safe(unit_id), F.lit("__"), safe(property_id), F.lit(".c"))


def nondet_name(ctype: Column) -> Column:
    """Generator of a property harness: one underscore per odd character."""
    return F.concat(F.lit("nondet_"), F.regexp_replace(F.trim(ctype), "[^A-Za-z0-9_]", "_"))


def nondet_slug(ctype: Column) -> Column:
    """Generator of a sidecar: odd characters fall together, none at the ends."""
    return F.concat(F.lit("nondet_"), F.regexp_replace(F.regexp_replace(F.trim(ctype), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def symbol(unit_id: Column) -> Column:
    """What stands behind the first ::, or all of it where there is none."""
    at = F.instr(unit_id, "::")
    return F.when(at > 0, F.substring(unit_id, at + 2, F.length(unit_id))).otherwise(unit_id)


def is_c_source(path: Column) -> Column:
    """Whatever the case of the suffix."""
    return F.lower(path).rlike(r"[^/]\.c$")


def is_edited_source(path: Column) -> Column:
    """As a patch tool names it: the suffix counts as written."""
    return F.concat(F.lit("."), F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)).isin(*EDITED_SUFFIXES)


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression; a star crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        shut = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif shut > 0:
            inner = pattern[i + 1 : shut]
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]")
            i = shut
        else:
            out.append("\\" + c if not (c.isalnum() or c in "_/ ") else c)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches(rel: Column, patterns: list[str]) -> Column:
    """Whether a path follows one of the patterns: a shell pattern where it has / * ? or [, else the name of a part of the path."""
    rules = [rel.rlike(glob_regex(p)) if any(c in p for c in "/*?[") else F.array_contains(F.split(rel, "/"), p) for p in patterns]
    return F.coalesce(reduce(Column.__or__, rules, F.lit(False)), F.lit(False))


def included(rel: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Exclusion beats inclusion; no include list means all, no exclude list means the usual folders. A list replaces, it does not add."""
    return ~matches(rel, exclude or list(DEFAULT_EXCLUDED)) & (matches(rel, include) if include else F.lit(True))


def newer(candidate: Column, current: Column) -> Column:
    """Whether version a.b.c is above another, by number; false where one is no such version."""
    triple = lambda v: F.when(v.rlike(r"^v?\d+\.\d+\.\d+$"), F.transform(F.split(F.regexp_replace(v, "^v", ""), r"\."), lambda p: p.try_cast("long")))
    return F.coalesce(triple(candidate) > triple(current), F.lit(False))


def fresh(checked_at: Column, now: Column, ttl_s: float = 12 * 3600) -> Column:
    """Whether a cache entry is from the last hours and not from the future."""
    age = now - checked_at
    return F.coalesce((age >= 0) & (age < ttl_s), F.lit(False))


def assessment_label(assessment: Column, detail: Column, settled_k: Column, max_len: Column) -> Column:
    """One line for a precondition's assessment."""
    k, n = F.coalesce(settled_k.cast("string"), F.lit("None")), F.coalesce(max_len.cast("string"), F.lit("None"))
    return (
        F.when(assessment == "assumed_verified", F.concat(F.lit("VERIFIED (assuming valid caller pointers — undischarged; up to k="), k, F.lit(", len<="), n, F.lit(")")))
        .when(assessment == "violated", F.concat(F.lit("VIOLATED (real counterexample under the synthesised precondition, k="), k, F.lit(")")))
        .when(assessment == "vacuous", "VACUOUS (synthesised precondition makes the call unreachable — not a pass)")
        .when(assessment == "needs_contract", F.concat(F.lit("NEEDS_CONTRACT ("), detail, F.lit(")")))
        .when(assessment == "unknown", F.concat(F.lit("UNKNOWN ("), detail, F.lit(")")))
        .otherwise(F.concat(F.lit("ERROR ("), detail, F.lit(")")))
    )


def discharge_label(assessment: Column, detail: Column, unit_assessment: Column, unit_label: Column, n_callers: Column) -> Column:
    """One line for a discharge; the unit's own label stands only where its own assessment does."""
    return (
        F.when(assessment == "discharged_verified", F.concat(F.lit("VERIFIED (discharged — "), detail, F.lit(")")))
        .when(assessment == "assumed_verified", F.concat(unit_label, F.lit(" ["), detail, F.lit("]")))
        .when(n_callers > 0, F.concat(F.lit("VIOLATED at the call site ("), detail, F.lit(")")))
        .when(assessment == unit_assessment, unit_label)
        .otherwise(F.concat(F.upper(assessment), F.lit(" ("), detail, F.lit(")")))
    )
