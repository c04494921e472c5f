"""What the jobs share: their configuration, log and counted writes."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, DataFrameWriter, Observation
from pyspark.sql import functions as F

LOG = logging.getLogger("jobs")


def config(name: str, path: str | None = None) -> dict:
    """Settings of a job: those that lie beside it, with those of the user's own file over them."""
    found = json.loads((Path(__file__).parent / f"{name}.json").read_text())
    own = json.loads(Path(path).read_text()) if path else {}
    if strange := set(own) - set(found):
        raise ValueError(f"unknown settings {sorted(strange)}; {name} has {sorted(found)}")
    return found | own


def counted(rows: DataFrame) -> tuple[DataFrame, Callable[[], int]]:
    """rows, and their number once something has run over them: counted on the way, without a pass of its own."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")

    def n() -> int:
        try:
            return int(seen.get["n"])
        except Py4JJavaError:  # no rows at all: the plan was found to be empty as it ran, and nothing was observed
            return 0

    return rows.observe(seen, F.count(F.lit(1)).alias("n")), n


def write(rows: DataFrame, path: str, how: Callable[[DataFrameWriter], DataFrameWriter]) -> int:
    """Write Parquet as told, and say how many rows."""
    rows, n = counted(rows)
    how(rows.write).parquet(path)
    LOG.info("wrote %d rows to %s", n(), path)
    return n()
