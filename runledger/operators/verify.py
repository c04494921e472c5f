"""N4, N19, J26, L8: a verification from request to typed result, whatever answers the requests.

A request names a run, its source, function and bound. It becomes a command line, is answered by a port (live, or from captured
records), and the answer is classified and its trace parsed. A port that has no answer gives an error, never a pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checker, clang
from . import traces

# Source languages whose traces are read, and what a sidecar's run adds to the command line.
FRONTENDS = ("c",)
SIDECAR_FLAGS = ("--force-malloc-success",)

Answer = Callable[[DataFrame], DataFrame]


def unit_id(project: Column, path: Column, function: Column | None = None) -> Column:
    """J26. The path below the project (elsewhere the whole path), and the function behind ::."""
    whole = clang.normal_path(F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", project, path)))
    root = F.concat(clang.normal_path(project), F.lit("/"))
    rel = F.when(whole.startswith(root), F.substring(whole, F.length(root) + 1, F.length(whole))).otherwise(whole)
    return rel if function is None else F.concat_ws("::", rel, function)


def requests(rows: DataFrame, sidecar: bool = False, timeout_s: float = 30.0) -> DataFrame:
    """N4, N19. rows (run_id, unit_id, source, function, k, extra) with argv and timeout_s. A sidecar has its unwinding assertions on, and allocations that do not fail."""
    extra = F.coalesce("extra", F.array().cast("array<string>"))
    if sidecar:
        extra = F.concat(F.array(*map(F.lit, SIDECAR_FLAGS)), extra)
    argv = checker.argv(F.col("source"), F.col("k"), F.col("function"), F.lit(timeout_s), extra, no_unwinding_assertions=not sidecar)
    return rows.withColumns({"argv": argv, "timeout_s": F.lit(timeout_s)})


def verified(rows: DataFrame, answer: Answer, sidecar: bool = False, timeout_s: float = 30.0, frontend: str = "frontend") -> DataFrame:
    """N4. The requests of rows with verdict, reason, message, raw_counterexample, esbmc_version and counterexample. A trace of a language that is not read stays text; its verdict stands."""
    asked = requests(rows, sidecar, timeout_s)
    known = F.col(frontend).isin(*FRONTENDS) if frontend in rows.columns else F.lit(True)
    found = traces.parsed(traces.classified(answer(asked)))
    return found.withColumn("counterexample", F.when(known & (F.col("verdict") == "violated"), F.col("counterexample")))
