"""Sinks: appended JSON lines, whole documents, generated texts, and lines for people."""

from __future__ import annotations

import json
import os
import shutil
import uuid

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names


def append_records(rows: DataFrame, folder: str, unit: str = "unit") -> None:
    """B4. One JSON line per row, in the folder of its unit; earlier lines stay as they are."""
    rows.withColumn("unit_slug", names.unit_slug(F.col(unit))).write.mode("append").partitionBy("unit_slug").json(folder)


def log_events(rows: DataFrame, folder: str) -> bool:
    """B4. Append trace events; a log that cannot be written never stops the work."""
    try:
        rows.write.mode("append").option("ignoreNullFields", "true").json(folder)
        return True
    except Exception:  # noqa: BLE001
        return False


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, local or of a store that pyarrow knows, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _put(system: fs.FileSystem, path: str, content: bytes) -> None:
    """A whole file or none: written beside its place under a name of its own, then moved there."""
    folder, _, name = path.rpartition("/")
    spare = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(spare) as out:
            out.write(content)
        if isinstance(system, fs.LocalFileSystem) and os.path.exists(path):
            shutil.copymode(path, spare)
        system.move(spare, path)
    except BaseException:
        if system.get_file_info(spare).type != fs.FileType.NotFound:
            system.delete_file(spare)
        raise


def write_document(path: str, value: dict) -> None:
    """B5. One JSON document, whole or not at all; a local file that is there keeps its mode."""
    system, place = _store(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    _put(system, place, json.dumps(value, indent=2, sort_keys=True).encode())


def state_document(tables: dict[str, DataFrame]) -> dict:
    """B5. The state's tables as one document; they are those of one project, and come to the driver."""
    keyed = lambda name, key: {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in tables[name].collect()}
    blobs: dict[str, list[str]] = {}
    for r in tables["baseline_blobs"].collect():
        blobs.setdefault(r["rel"], []).append(r["digest"])
    scalars = tables["scalars"].first()
    units = {k: {"unit_id": k, **v} for k, v in keyed("units", "unit_id").items()}
    return {"units": units, "scanned": {k: v["digest"] for k, v in keyed("scanned", "rel").items()}, "pending": keyed("pending", "rel"), "baseline_blobs": blobs, **scalars.asDict()}


def write_texts(rows: DataFrame, folder: str, name: str = "name", text: str = "text", exclusive: bool = False) -> int:
    """B6. One file per row in a folder that driver and executors share; returns how many. With exclusive, a file of other content is an error.

    A task that is tried again writes the same bytes in the same place, so each name ends with one whole file.
    """
    system, root = _store(folder)
    system.create_dir(root, recursive=True)

    def put(frames):
        own, top = _store(folder)
        for pdf in frames:
            for n, t in zip(pdf[name], pdf[text], strict=True):
                path, content = f"{top.rstrip('/')}/{n}", t.encode()
                if exclusive and own.get_file_info(path).type == fs.FileType.File:
                    with own.open_input_file(path) as there:
                        if there.read() != content:
                            raise FileExistsError(path)
                _put(own, path, content)
            yield pd.DataFrame({"n": [len(pdf)]})

    return rows.select(name, text).mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def fix_names(rows: DataFrame, stem: str, order: list[str], first: int = 1) -> DataFrame:
    """B6. Names <stem>.fixN along order within each stem."""
    place = F.row_number().over(Window.partitionBy(stem).orderBy(*order)) - 1 + first
    return rows.withColumn("name", F.concat(F.col(stem), F.lit(".fix"), place.cast("string")))


def collected(rows: DataFrame, name: str) -> DataFrame:
    """B7. Rows kept in memory under a name, for tests and small results."""
    rows.cache().createOrReplaceTempView(name)
    return rows.sparkSession.table(name)


def discarded(rows: DataFrame) -> None:
    """B7. Everything is computed and nothing kept."""
    rows.write.format("noop").mode("overwrite").save()


# What the sequence diagram calls verdicts and who takes part.
LABELS = {"verified": "VERIFIED", "violated": "VIOLATED", "unknown": "UNKNOWN", "error": "ERROR"}


def sanitize(text: Column) -> Column:
    return F.trim(F.replace(F.replace(text.cast("string"), F.lit("\n"), F.lit(" ")), F.lit(";"), F.lit(",")))


def diagram_lines(event: str = "") -> Column:
    """J24, B8. The lines of one trace event in a sequence diagram; none for an unknown type. Columns are those of schemas.TRACE_EVENT, below `event` if named."""
    c = lambda n: F.col(f"{event}.{n}" if event else n)
    text = lambda n, default="None": F.coalesce(sanitize(c(n)), F.lit(default))
    fns = F.coalesce(F.nullif(sanitize(F.array_join(c("functions"), ", ")), F.lit("")), F.lit("no functions"))
    verdict = F.coalesce(*[F.when(c("verdict") == v, label) for v, label in LABELS.items()], F.upper(F.coalesce(c("verdict"), F.lit("None"))))
    took = F.coalesce(F.format_string(" (%.2fs)", c("duration_s")), F.lit(""))
    number = lambda n, default: F.coalesce(c(n).cast("string"), F.lit(default))
    took = F.when(c("duration_s").isNull(), "").otherwise(took)
    ask = F.lit("    C->>S: end turn?")
    return (
        F.when(c("type") == "edit", F.array(F.concat(F.lit("    C->>G: "), text("tool", "?"), F.lit(" "), text("file"), F.lit(" ("), fns, F.lit(")"))))
        .when(c("type") == "verify", F.array(F.concat(F.lit("    G->>E: verify "), text("unit"), F.lit(" (k="), number("k", "None"), F.lit(")")), F.concat(F.lit("    E-->>G: "), verdict, took)))
        .when((c("type") == "gate") & (c("decision") == "pass"), F.array(F.lit("    G-->>C: pass — VERIFIED up to k")))
        .when(c("type") == "gate", F.array(F.concat(F.lit("    G-->>C: block — "), number("n_failures", "?"), F.lit(" cex fed back (exit "), number("exit_code", "2"), F.lit(")"))))
        .when((c("type") == "stop") & (c("decision") == "allow"), F.array(ask, F.lit("    S-->>C: ALLOW (clean)")))
        .when((c("type") == "stop") & (c("decision") == "residual"), F.array(ask, F.concat(F.lit("    S-->>C: ALLOW with LOUD residual ("), number("n_unverified", "?"), F.lit(" unverified)"))))
        .when(c("type") == "stop", F.array(ask, F.concat(F.lit("    S-->>C: BLOCK (attempt "), number("attempt", "?"), F.lit(")"))))
        .otherwise(F.array().cast("array<string>"))
    )


def diagram(events: DataFrame, session: str, order: list[str], title: str = "Verify-gate loop") -> DataFrame:
    """B8. One sequence diagram per session."""
    head = ["sequenceDiagram", f"    title {title}", "    participant C as Author", "    participant G as Gate", "    participant E as Checker", "    participant S as Stop gate"]
    rows = events.select(session, F.struct(*order).alias("at"), diagram_lines().alias("l")).groupBy(session).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "l"))), lambda r: r["l"])).alias("body"))
    body = F.when(F.size("body") > 0, F.col("body")).otherwise(F.array(F.lit("    note over C,S: (no events recorded yet)")))
    return rows.select(session, F.array_join(F.concat(F.array(*map(F.lit, head)), body), "\n").alias("diagram"))


def stop_message(units: DataFrame, by: str, order: list[str], clip: int = 800) -> DataFrame:
    """B8, G6. Per project the residual as text: one line per blocking unit, with its trace clipped."""
    line = F.concat(F.lit("- "), "unit_id", F.lit(": "), F.upper(F.coalesce("verdict", F.lit("none"))), F.when(F.col("counterexample").isNotNull(), F.concat(F.lit("\n"), F.substring("counterexample", 1, clip))).otherwise(""))
    rows = units.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("l"))
    return rows.select(by, F.array_join(F.transform("l", lambda r: r["line"]), "\n").alias("message"))


def proposal_text(accepted: DataFrame, by: str = "unit_id") -> DataFrame:
    """B8. Per unit the accepted and refused candidates (ord, accepted, reason, property_id, expression, domain) as text."""
    dom = F.when(F.size("domain") > 0, F.concat(F.lit("  [domain: "), F.array_join("domain", ", "), F.lit("]"))).otherwise("")
    yes, no = F.concat(F.lit("  + ["), "property_id", F.lit("] "), "expression", dom), F.concat(F.lit("  - "), "expression", F.lit(": "), "reason")
    some = lambda keep, line: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("ord", line.alias("l"))))), lambda r: r["l"])
    rows = accepted.groupBy(by).agg(some(F.col("accepted"), yes).alias("yes"), some(~F.col("accepted"), no).alias("no"))
    head = F.concat(F.lit("Proposed "), F.size("yes").cast("string"), F.when(F.size("yes") == 1, " property for ").otherwise(" properties for "), F.col(by))
    refused = F.when(F.size("no") > 0, F.concat(F.array(F.concat(F.lit("Rejected "), F.size("no").cast("string"), F.lit(":"))), F.col("no"))).otherwise(F.array().cast("array<string>"))
    return rows.select(by, F.array_join(F.concat(F.array(head), F.col("yes"), refused), "\n").alias("text"))
