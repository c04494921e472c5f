"""Records, closed vocabularies and typed failures of the engine.

Every vocabulary is a tuple of lower-case strings; `reject` splits rows by the checks below, so that a malformed row
comes out with its reason and is never dropped or read as a pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vocabularies.
VERDICTS = ("verified", "violated", "unknown", "error")
UNKNOWN_REASONS = ("timeout", "memout", "unclassified", "under_unwound")
OUTCOMES = ("held", "violated", "unknown", "error", "skipped")
LOOP_STATES = ("write", "verify", "fix", "unknown", "done", "give_up")
GIVE_UP_REASONS = ("max_iterations_exceeded", "esbmc_error")
KINDS = ("semantic", "reachability")
STATUSES = ("candidate", "graded", "accepted", "rejected")
GRADINGS = ("held", "violated", "unknown")
#: Allowed moves of a property's status; a status that no move leaves is terminal.
MOVES = (("candidate", "graded"), ("candidate", "rejected"), ("graded", "accepted"), ("graded", "rejected"))
TERMINAL = tuple(s for s in STATUSES if s not in {a for a, _ in MOVES})
CHECKABLE = tuple(s for s in STATUSES if s not in TERMINAL)
ROLES = ("scalar", "length", "scalar_ptr", "ptr_byte_len", "ptr_elem_count", "fixed_array", "unresolved")
POINTER_ROLES = ("scalar_ptr", "ptr_byte_len", "ptr_elem_count", "fixed_array")
ASSESSMENTS = ("assumed_verified", "discharged_verified", "violated", "vacuous", "unknown", "needs_contract", "error")
CALLER_OUTCOMES = ("discharged", "obligation_violated", "caller_violated", "underdetermined", "unreachable", "unchecked", "unresolved", "unattributed")
GATE_VERDICTS = ("verified", "violated", "unknown", "error", "needs_contract")
TRACE_TYPES = ("edit", "verify", "gate", "stop", "session")
#: Process statuses of verdicts and of assessments.
EXIT_CODES = {"verified": 0, "violated": 1, "unknown": 2, "error": 3}
ASSESSMENT_EXIT_CODES = {"assumed_verified": 0, "discharged_verified": 0, "violated": 1, "unknown": 2, "error": 3, "vacuous": 4, "needs_contract": 5}

_LOC = "struct<file:string,line:int,column:int,function:string>"
_ASSIGNMENT = "struct<lhs:string,value:string,binary:string>"
COUNTEREXAMPLE = f"steps array<struct<number:int,loc:{_LOC},assignments:array<{_ASSIGNMENT}>>>, violated_property struct<loc:{_LOC},description:string,expression:string,cwe:array<string>>"
RUN = "run_id long, unit_id string, k int, esbmc_version string, argv array<string>, exit_code int, duration_s double, stdout string, stderr string"
RESULT = f"verdict string, reason string, message string, raw_counterexample string, counterexample struct<{COUNTEREXAMPLE.replace(' array', ':array').replace(' struct', ':struct').replace(', ', ',')}>"
GRADING = "struct<verdict:string,kill_rate:double,reason:string>"
PROPERTY = f"ord long, property_id string, unit_id string, kind string, expression string, domain array<string>, description string, status string, prompt_id string, prompt_version string, grading {GRADING}, created_at timestamp"
PARAM = "struct<name:string,type:string,array_extent:int,array_extent_unresolved:boolean,array_static_min:boolean>"
UNIT = f"tu string, name string, def_line int, internal_linkage boolean, params array<{PARAM}>, calls array<string>"
TRACE_EVENT = (
    "ts double, type string, tool string, file string, functions array<string>, unit string, verdict string, k int, duration_s double, argv array<string>, decision string, reason string, "
    "n_failures int, n_needs_contract int, exit_code int, n_unverified int, n_oob int, n_blob int, attempt int, n_semantic_violations int, n_semantic_unresolved int, n_semantic_failed int, "
    "n_semantic_skipped int, pruned array<string>, n_baselined int, source string"
)
LOOP_EVENT = "seq int, type string, index int, k int, verdict string, detail map<string,string>"
ITERATION = "run_id string, index int, source string, verdict string, state string, k int, unknown_reason string"
CALLER_CHECK = "caller string, outcome string, detail string, settled_k int"
CANDIDATE = "struct<expression:string,domain:array<string>,referenced_params:array<string>,rationale:string,kind:string>"
SIGNATURE_PARAM = "struct<ctype:string,name:string,length:string,const:boolean,out:boolean>"
STATE_TABLES = {
    "units": "unit_id string, file string, function string, verdict string, k int, counterexample string, detail string",
    "scanned": "rel string, digest string",
    "pending": "rel string, hash string, attempts int, pid long",
    "baseline_blobs": "rel string, digest string",
    "scalars": "stop_attempts int, baseline_head string",
}


class EngineError(Exception):
    """A failure that a caller can tell from an empty result."""


class UnitsUnavailable(EngineError):
    """The definitions of a source could not be listed: not the same as none."""


class PropertyStoreError(EngineError):
    pass


class DuplicateProperty(PropertyStoreError):
    pass


class PropertyNotFound(PropertyStoreError):
    pass


class InvalidStatusTransition(PropertyStoreError):
    pass


class HarnessError(EngineError):
    """A unit or property that cannot be rendered as a harness."""


class ConfigError(EngineError):
    pass


class ModelReplyError(EngineError):
    """A model call that failed: never an empty reply."""


def one_of(column: str, values: tuple[str, ...], required: bool = True) -> Column:
    """True where the column holds a word of the vocabulary."""
    return F.coalesce(F.col(column).isin(*values), F.lit(not required) & F.col(column).isNull())


def grading_ok(grading: str = "grading") -> Column:
    """All or nothing: absent, or a verdict of the vocabulary with a kill rate from 0 to 1."""
    g = F.col(grading)
    whole = F.coalesce(g["verdict"].isin(*GRADINGS), F.lit(False)) & F.coalesce(g["kill_rate"].between(0.0, 1.0), F.lit(False))
    return g.isNull() | (g["verdict"].isNull() & g["kill_rate"].isNull() & g["reason"].isNull()) | whole


def payload_ok() -> Column:
    """Payload of a result against its tag: a reason only of unknown, a message only of error, a trace only of violated."""
    tag = F.col("verdict")
    at = lambda name, column: F.col(column).isNotNull() == F.coalesce(tag == name, F.lit(False))
    return one_of("verdict", VERDICTS) & at("unknown", "reason") & at("error", "message") & at("violated", "raw_counterexample")


def first_reason(rules: list[tuple[Column, Column | str]]) -> Column:
    """Reason of the first rule that holds, null if none does. A rule that is null does not hold."""
    return F.coalesce(*[F.when(F.coalesce(rule, F.lit(False)), why if isinstance(why, Column) else F.lit(why)) for rule, why in rules], F.lit(None).cast("string"))


def reject(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass every check, rows that fail one with reject_reason: the first failed check's name). A null check fails."""
    failed = reduce(lambda a, b: F.coalesce(a, b), [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    marked = rows.withColumn("reject_reason", failed)
    return marked.where("reject_reason is null").drop("reject_reason"), marked.where("reject_reason is not null")
