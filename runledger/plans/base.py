"""Relations that play the engine's records, built on the driver's tables, and the registry of queries.

A relation is one SELECT in the SQL that Spark and DuckDB share; the few spellings that differ are named in braces. The
operators run on it in Spark; the oracle says the expected result in SQL of its own, on the same relation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# Spellings: (Spark, DuckDB).
WORDS = {
    "k": ("CAST(get_json_object(props, '$.k') AS INT)", "CAST(json_extract_string(props, '$.k') AS INTEGER)"),
    "sha": ("sha2", "sha256"),
    "bits": (", 256", ""),
    "list": ("array", "list_value"),
    "div": ("div", "//"),
    "nl": ("'\\n'", "chr(10)"),
    "nul": ("char(0)", "chr(0)"),
    "str": ("STRING", "VARCHAR"),
    "strings": ("ARRAY<STRING>", "VARCHAR[]"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@dataclass(frozen=True)
class Relation:
    sql: str

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in self.sql}
        text = self.sql.format(**{w: s for w, (s, _) in WORDS.items()}, **{t: f"\0{t}\1" for t in TABLES})
        return spark.sql(text.replace("{", "{{").replace("}", "}}").replace("\0", "{").replace("\1", "}"), **used)

    @property
    def duck(self) -> str:
        return self.sql.format(**{w: d for w, (_, d) in WORDS.items()}, **{t: t for t in TABLES})


def query(name: str, relations: dict[str, Relation], oracle: str | None = None):
    """Register a query: a function of its relations' DataFrames, and the SQL of its result over views of the same names."""

    def register(plan: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(**{n: r(spark, sf_dir) for n, r in relations.items()})

        QUERIES[name] = run
        if oracle is not None:
            views = ", ".join(f"{n} AS ({r.duck})" for n, r in relations.items())
            text = oracle.lstrip()
            word = next((w for w in ("WITH RECURSIVE ", "WITH ") if text.startswith(w)), "")
            ORACLES[name] = f"{word or 'WITH '}{views}{',' * bool(word)} {text[len(word):]}"
        return plan

    return register
