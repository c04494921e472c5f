"""Who can call a function: edges, closures and the openings that keep "every caller" from being a claim.

Edges are a table (tu, caller, callee).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clang
from . import reachability


def edges(units: DataFrame) -> DataFrame:
    """R8. tu, caller, callee, ord, self-calls too."""
    return units.select("tu", F.col("name").alias("caller"), F.posexplode("calls").alias("ord", "callee"))


def referrers(units: DataFrame) -> DataFrame:
    """D5. tu, callee, caller: the other units that refer to a unit."""
    return edges(units).where("caller <> callee").select("tu", "callee", "caller")


def external_callers(definitions: DataFrame, sources: DataFrame) -> DataFrame:
    """D7. tu, callee, caller: definitions outside the source itself that refer to a function, each once."""
    outside = (F.col("file") == "") | (clang.normal_path(F.col("file")) != clang.normal_path(F.col("source")))
    rows = definitions.join(sources, "tu").where(outside)
    return edges(rows).where("caller <> callee").select("tu", "callee", "caller").distinct()


def self_reachable(edge: DataFrame, by: str = "tu", asked: DataFrame | None = None, small: int = reachability.SMALL) -> DataFrame:
    """H4. by, name: functions that can come back to themselves, through others too. asked (by, name) narrows the answer."""
    found = reachability.on_cycles(edge.select(by, F.col("caller").alias("a"), F.col("callee").alias("b")), by, small)
    return found if asked is None else found.join(asked.select(by, "name").distinct(), [by, "name"], "left_semi")


def address_escapes(tree: DataFrame) -> DataFrame:
    """H7. tu, callee, site: places that name a function outside a direct call, in order of first sight (ord)."""
    ref = tree.select("tu", "ord", "site", "is_callee", clang.referenced(F.col("rest")).alias("callee")).where("callee is not null and not is_callee")
    return ref.groupBy("tu", "callee", "site").agg(F.min("ord").alias("ord"))


def implicit_invocations(tree: DataFrame) -> DataFrame:
    """H7. tu, callee, site: constructor and destructor attributes, by the function that carries them."""
    kind = F.coalesce(*[F.when(F.col("kind") == k, label) for k, label in clang.IMPLICIT.items()])
    rows = tree.select("tu", "ord", F.col("site").alias("callee"), kind.alias("site")).where("site is not null")
    return rows.groupBy("tu", "callee", "site").agg(F.min("ord").alias("ord"))


def linker_symbols(tree: DataFrame) -> DataFrame:
    """D6. tu, name, symbol: what the linker joins a declaration by, its labels or else its own name."""
    declared = tree.where("kind = 'FunctionDecl'").select("tu", clang.declared_name(F.col("rest")).alias("name")).where("name <> ''").distinct()
    labels = tree.where("kind = 'AsmLabelAttr'").select("tu", F.col("site").alias("name"), F.explode(clang.linker_names(F.col("rest"))).alias("symbol")).distinct()
    bare = declared.join(labels, ["tu", "name"], "left_anti").withColumn("symbol", F.col("name"))
    return bare.unionByName(labels)


def symbol_aliases(tree: DataFrame) -> DataFrame:
    """D6, H7. tu, callee, site: declarations that are another name of a function: one linker symbol, or an alias of its symbol or name."""
    symbols = linker_symbols(tree)
    same = symbols.join(symbols.withColumnsRenamed({"name": "site"}), ["tu", "symbol"]).where("name <> site").select("tu", F.col("name").alias("callee"), "site")
    targets = tree.where("kind = 'AliasAttr'").select("tu", F.col("site"), F.explode(clang.linker_names(F.col("rest"))).alias("symbol"))
    known = symbols.unionByName(symbols.select("tu", "name", F.col("name").alias("symbol"))).distinct()
    named = targets.join(known, ["tu", "symbol"]).select("tu", F.col("name").alias("callee"), "site")
    return same.unionByName(named).distinct()


def asm_sites(tree: DataFrame, names: DataFrame) -> DataFrame:
    """H7. tu, callee, site: inline assembly anywhere opens every function asked (names: tu, callee); assembly at file scope only those its text names."""
    inline = tree.where("kind = 'GCCAsmStmt'").groupBy("tu", "site").agg(F.min("ord").alias("ord"))
    parents = tree.where("kind = 'FileScopeAsmDecl'").select("tu", F.col("ord").alias("parent"))
    texts = tree.where("kind = 'StringLiteral'").join(parents, ["tu", "parent"], "left_semi").select("tu", "ord", "site", F.get(clang.linker_names(F.col("rest")), F.lit(0)).alias("text"))
    mentions = texts.select("tu", "ord", "site", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))).alias("callee"))
    found = names.join(inline, "tu").unionByName(names.join(mentions, ["tu", "callee"]).select("tu", "callee", "site", "ord"))
    return found.groupBy("tu", "callee", "site").agg(F.min("ord").alias("ord"))


def openings(foreign: DataFrame, escaped: DataFrame, aliased: DataFrame, implicit: DataFrame, asm: DataFrame) -> DataFrame:
    """R18, N10. The five listings as one table: tu, callee, kind, site."""
    parts = [("foreign", foreign.withColumnRenamed("caller", "site")), ("escaped", escaped), ("aliased", aliased), ("implicit", implicit), ("asm", asm)]
    return reduce(DataFrame.unionByName, [df.select("tu", "callee", F.lit(kind).alias("kind"), "site") for kind, df in parts])


def open_caller_checks(found: DataFrame, source: Column) -> DataFrame:
    """H3. Checks of openings (callee, kind, site): caller, outcome, detail, rank (their fixed order)."""
    f = F.col("callee")
    words = {
        "foreign": ("unchecked", F.concat(F.lit("calls it from a file other than "), source, F.lit(", where no unit is listed and no harness is built"))),
        "escaped": ("unresolved", F.concat(F.lit("takes "), f, F.lit("() as a value, so it may be called from any place that value reaches"))),
        "aliased": ("unresolved", F.concat(F.lit("is a second name of "), f, F.lit("(); whoever calls that name was not asked"))),
        "implicit": ("unresolved", F.concat(F.lit("is a "), F.col("site"), F.lit(": "), f, F.lit("() runs before or after main with no arguments from here"))),
        "asm": ("unresolved", F.concat(F.lit("holds assembly that may jump to "), f, F.lit("(), which leaves no trace in the tree"))),
    }
    pick = lambda i: F.coalesce(*[F.when(F.col("kind") == k, F.lit(v[i]) if i == 0 else v[i]) for k, v in words.items()])
    rank = F.coalesce(*[F.when(F.col("kind") == k, n) for n, k in enumerate(words)])
    caller = F.when(F.col("kind") == "implicit", F.concat(F.lit("<"), F.col("site"), F.lit(">"))).otherwise(F.col("site"))
    return found.select("*", caller.alias("caller"), pick(0).alias("outcome"), pick(1).alias("detail"), rank.alias("rank"))
