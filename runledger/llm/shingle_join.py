"""N-gram Jaccard join by a token-group matrix.

1. Each text becomes its set of 64-bit shingle hashes. Texts of one set are one class from here on.
2. Tokens are put in one order for all: tokens that a sample of documents finds often come last. Two sets of
   similarity 0.75 or more share a token among the first n - ceil(3n/4) + 1 of each, so only those prefixes are
   indexed, and tokens of one class alone are dropped. The sample changes speed, never results.
3. Grouping: each class is compared with one class that shares many prefix tokens, if possible the one with the
   fewest rare tokens of its own, and linked classes form the groups. A cluster of thousands of near copies costs
   one comparison a member, not one a pair.
4. Token-group matrix: for tokens that cross groups, each group's union of its members' index tokens is stored with
   the range of their sizes. The overlap of a larger class with a group of smaller ones is bounded from the tokens
   they share; groups whose bound is too low stay shut.
5. Only members of open groups are compared, whole text against whole text. First one member a class and group;
   groups that fall together need no further comparison; then all that is left. No pair of classes found in a group
   of one class is compared again.

Step 5 ends with every pair of different groups that could be linked compared, so no link is lost.

Sets are kept and compared as 63-bit hashes of their shingles; two shingles of one hash count as one, which a
document of a million shingles meets with a chance below 1e-7.

Defined cases: null, empty and blank texts have an empty set and link with nothing; rows of equal sets share a
component whatever their doc_id; a null doc_id has the smallest doc_id of its component, null if there is none;
an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .store import drop, materialise, narrow_side, text_rows

SHINGLE = 5
#: One document in SAMPLE tells which tokens are frequent: those seen SEEN times there, the HOT_TOKENS most frequent at most.
SAMPLE, SEEN, HOT_TOKENS = 16, 4, 500_000
#: Share of a prefix that two classes share to be taken for one group without looking for a better match.
ALIKE = 0.6
#: Input partitions whose holders of a frequent token look for a hub together.
DEALT = 64
#: Classes whose sizes differ by less than this factor may share a hub.
NEAR_SIZE = 1.15

_ODD = np.random.default_rng(5).integers(1 << 62, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 63-bit hashes of a text's shingles."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.int64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, min(len(h), SHINGLE), np.uint64)
    for i in range(min(SHINGLE, len(h))):
        out += h[i : i + n] * _ODD[i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out >>= np.uint64(1)
    out.sort()  # np.unique takes several times as long: it hashes first
    return out[np.append(True, out[1:] != out[:-1])].view(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= 75 * (len(a) + len(b) - both)


def _tokens(batches):
    for batch in batches:
        sets = [shingle_set(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else [], pa.int64())], names=["token"])


def _rows(hot: bytes):
    """Batches of doc_id, text and, if wanted, a row's key, which follows the other columns."""
    schema = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("same", pa.binary()), ("prefix", pa.list_(pa.int64()))])
    often = np.frombuffer(hot, np.int64)

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1)), strict=True):
                s = shingle_set(text)
                n = len(s)
                at = np.searchsorted(often, s) if len(often) else np.zeros(n, np.int64)
                is_hot = often[np.minimum(at, len(often) - 1)] == s if len(often) else np.zeros(n, bool)
                ranked = np.where(is_hot, s, s - (1 << 62) - (1 << 62))  # often seen ones last
                p = n - (3 * n + 3) // 4 + 1 if n else 0
                ranked = np.sort(np.partition(ranked, p - 1)[:p]) if n else ranked
                out.append((row, doc_id, n, xxhash.xxh3_128_digest(s.tobytes()), xxhash.xxh3_128_digest(text), ranked))
                row += 1
            if out:
                own = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, *batch.columns[2:]], names=[*schema.names, *batch.schema.names[2:]])

    return run


def _packed(batches):
    """Texts compressed, each with its own digest: they move once a comparison, and are smaller than their hashes."""
    compress = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = batch.column(1).to_pylist()
        digests, blobs = map(xxhash.xxh3_128_digest, texts), map(compress, texts)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())], names=["same", "blob"])


def _compare(batches):
    last, mine = None, None
    text = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x = x.as_py()
            if x != last:
                last, mine = x, shingle_set(text(x))
            keep.append(linked(mine, shingle_set(text(y.as_py()))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that are linked; pairs is materialised."""
    rows = pairs.count()
    pairs, asked = narrow_side(pairs, rows), narrow_side(pairs.select("a"), rows)
    left = blobs.select(F.col("rep").alias("a"), F.col("blob").alias("x")).join(asked, "a", "left_semi")
    right = blobs.select(F.col("rep").alias("b"), F.col("blob").alias("y"))
    return right.join(pairs, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(_compare, "a long, b long")


def _enough(hits, n, low, high):
    """Whether sets of sizes n and low to high (at most n) may be linked if the prefix of the one and the index of the other share hits.

    Common tokens lie in both or behind the end of the prefix that ends first: at most hits + ceil(6m/7) - 1 or
    hits + ceil(3n/4) - 1 are shared, and 3(n + m)/7 must be.
    """
    return 28 * hits >= F.least(12 * (n - high) + 4, 12 * low - 9 * n + 7)


def _sizes_fit(a, b):
    return (4 * a >= 3 * b) & (4 * b >= 3 * a)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept (one row of each component: that of smallest doc_id,
    null last), and key_col (two longs, see store.with_row_key) if named."""
    spark = docs.sparkSession
    own_key = [F.col(key_col).alias("row_key")] if key_col else []
    key, key_type = ["row_key"] * len(own_key), ", row_key struct<file:bigint,row:bigint>" * len(own_key)
    texts = text_rows(docs, id_col, text_col, *own_key)
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("t").mapInArrow(_tokens, "token long")
    often = sample.groupBy("token").count().where(F.col("count") >= SEEN).orderBy(F.col("count").desc(), "token").limit(HOT_TOKENS)
    hot = np.sort(np.array([r[0] for r in often.select("token").collect()], np.int64)).tobytes()
    rows = materialise(texts.mapInArrow(_rows(hot), "row_id long, doc_id long, n long, sig binary, same binary, prefix array<long>" + key_type), "rows")

    classes = rows.where("n > 0").groupBy("sig").agg(F.min(F.struct("row_id", "doc_id", "same")).alias("r"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("least"))
    classes = materialise(classes.select("sig", F.col("r.row_id").alias("rep"), F.col("r.doc_id").alias("rep_doc"), F.col("r.same").alias("same"), "least"), "classes")
    own = rows.join(narrow_side(classes.select(F.col("rep").alias("row_id"))), "row_id", "left_semi")
    # Any number of texts may hold a frequent token: its holders are dealt by input partitions, and meet in the waves below.
    deal = F.when(F.col("token") >= 0, F.expr(f"shiftright(rep, 33) div {DEALT}")).otherwise(0).cast("int")
    index = own.select(F.col("row_id").alias("rep"), F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "token")).withColumn("deal", deal).repartition("token", "deal")
    index = index.withColumns({"n": F.col("n").cast("long"), "p": F.expr("cast(n - (3L * n + 3) div 4 + 1 as int)"), "left": F.expr("cast(n - at as long)"), "near_n": F.floor(F.log("n") / np.log(NEAR_SIZE)).cast("int")})
    # Rare tokens come first, so a common token stands foremost in the class with the fewest tokens of its own: the
    # class nearest to the text that a cluster's members were made from. It serves as the hub of its sizes.
    along, hub = Window.partitionBy("token", "deal").orderBy("near_n", "at", "rep"), Window.partitionBy("token", "deal", "near_n").orderBy("at", "rep")
    beside = index.withColumns({"prev": F.lag(F.struct("rep", "n", "at")).over(along), "next": F.lead("rep").over(along), "first": F.first(F.struct("rep", "n", "at")).over(hub)})
    shared = materialise(beside.where("prev is not null or next is not null or token >= 0").drop("next", "at", "near_n", "deal"), "shared")

    # Grouping: one comparison a class, with the foremost hub that is much alike, else with the class most alike.
    maybe = shared.where("prev is not null").select("rep", "n", "p", F.explode(F.array_distinct(F.array("prev", "first"))).alias("to"))
    maybe = maybe.where(_sizes_fit(F.col("n"), F.col("to.n")) & (F.col("to.rep") != F.col("rep"))).groupBy("rep", "p", F.col("to.rep").alias("other")).agg(F.count(F.lit(1)).alias("count"), F.min("to.at").alias("at"))
    alike = F.col("count") >= ALIKE * F.col("p")
    best = F.max_by("other", F.struct(alike, F.when(alike, -F.col("at")).otherwise(F.col("count")), -F.col("other")))
    pairs = materialise(maybe.groupBy("rep").agg(best.alias("b")).select(F.col("rep").alias("a"), "b"), "pairs")
    wanted = shared.select("rep").distinct().join(classes, "rep").select("rep", "same", "rep_doc")
    wanted = materialise(wanted, "wanted")
    n_wanted = wanted.count()
    ids = narrow_side(wanted.select("rep_doc"), n_wanted)
    blobs = texts.select("doc_id", "t").join(ids, F.col("doc_id").eqNullSafe(F.col("rep_doc")), "left_semi").mapInArrow(_packed, "same binary, blob binary")
    blobs = materialise(blobs.join(narrow_side(wanted.select("rep", "same"), n_wanted), "same").dropDuplicates(["rep"]).select("rep", "blob"), "texts", "uncompressed")
    groups = components(materialise(_verified(pairs, blobs), "links-0"))

    done = [pairs]  # pairs of classes that were compared
    for wave in (1, 2):
        met_tables = []
        placed = shared.select("token", "rep", "n", "left").join(groups, "rep", "left").withColumns({"alone": F.col("grp").isNull(), "grp": F.coalesce("grp", "rep")})
        crossing = placed.groupBy("token").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).where("x < y").select("token")
        cross = materialise(placed.join(crossing, "token"), f"cross-{wave}")
        if cross.isEmpty():
            break
        # The smaller of two sets is looked up by the larger. As more than 6n/7 of the smaller are shared, its
        # index needs a shorter prefix: a frequent passage is indexed only where it is most of a text.
        small = cross.where("7 * left >= 6 * n").select("token", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("left").alias("m_left"), F.col("grp").alias("g"), F.col("alone").alias("g_alone"))
        matrix = small.groupBy("token", "g").agg(F.min("m").alias("low"), F.max("m").alias("high"), F.max("m_left").alias("most"), F.min_by("b", F.struct("m", "b")).alias("b"), F.bool_and("g_alone").alias("g_alone"))
        floor = F.greatest(F.col("low"), F.ceil(3 * F.col("n") / 4))
        may = (F.col("grp") != F.col("g")) & (F.col("low") <= F.col("n")) & (4 * F.col("high") >= 3 * F.col("n"))
        # Behind the first common token of a linked pair as many tokens are left as it shares, but not behind the
        # later ones: all common tokens are hits, and one of them must stand early enough.
        early = 7 * F.least("left", "most") >= 3 * (F.col("n") + floor)
        met = cross.join(matrix, "token").where(may)
        # Pairs without an early hit are out before hits are counted, and so are classes compared before; a group of one
        # class has its number. The first wave compares with the member that holds the rarest common token.
        asked = met.where(early).select(F.col("rep").alias("a"), "g", "g_alone").distinct()
        both_ways = [d.select(F.col(x).alias("a"), F.col(y).alias("g")).withColumn("g_alone", F.lit(True)) for d in done for x, y in (("a", "b"), ("b", "a"))]
        first = narrow_side(materialise(asked.join(reduce(DataFrame.unionByName, both_ways), ["a", "g", "g_alone"], "left_anti").select("a", "g"), f"early-{wave}"))
        hits = met.withColumnRenamed("rep", "a").join(first, ["a", "g"], "left_semi").groupBy("a", "g")
        member = [F.max(F.struct("left", "b")).alias("rarest")] if wave == 1 else []
        probe = hits.agg(F.count(F.lit(1)).alias("hits"), F.first("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), *member)
        enough = _enough(F.col("hits"), F.col("n"), floor, F.least("high", "n"))
        open_ = materialise(probe.where(enough).select("a", "g", *["rarest.b"] * (wave == 1)), f"open-{wave}")
        if wave == 1:
            found = open_
        else:
            # Pairs with an early hit are few; all their hits are counted from the two prefixes, without a join by token.
            fit = (F.col("grp") != F.col("g")) & (F.col("m") <= F.col("n")) & (4 * F.col("m") >= 3 * F.col("n")) & (7 * F.least("left", "m_left") >= 3 * (F.col("n") + F.col("m")))
            asked = cross.join(open_.select(F.col("a").alias("rep")).distinct(), "rep", "left_semi")
            met = asked.join(small, "token").where(fit).groupBy(F.col("rep").alias("a"), "n", "g", "b", "m").count()
            met_tables = [materialise(met.join(open_, ["a", "g"], "left_semi").select("a", "b", "n", "m"), f"met-{wave}")]
            met = narrow_side(met_tables[0])
            mine = rows.select(F.col("row_id").alias("a"), "prefix").join(met, "a")
            index_b = rows.select(F.col("row_id").alias("b"), F.expr("slice(prefix, 1, cast(n div 7 + 1 as int))").alias("index")).join(narrow_side(met.select("b").distinct()), "b", "left_semi")
            both = mine.join(index_b, "b").withColumn("count", F.size(F.array_intersect("prefix", "index")))
            found = both.where(_enough(F.col("count"), F.col("n"), F.col("m"), F.col("m")))
        pairs = materialise(found.select("a", "b"), f"pairs-{wave}")
        done.append(pairs)
        new = materialise(_verified(pairs, blobs), f"links-{wave}")
        drop(cross, open_, *met_tables)
        if not new.isEmpty():  # groups so far are stars: they stand for all links before
            groups = components(groups.select(F.col("rep").alias("a"), F.col("grp").alias("b")).unionByName(new))

    named = classes.join(groups, "rep", "left").select("sig", "least", F.coalesce("grp", "rep").alias("grp"), F.col("grp").isNotNull().alias("several"))
    # One row per group of several classes; the others are their own group.
    several = materialise(named.where("several").groupBy("grp").agg(F.min("least").alias("first")), "firsts")
    first = F.coalesce("first", "least").alias("first")
    of_class = materialise(named.join(narrow_side(several), "grp", "left").select("sig", first), "class-components")
    drop(shared, blobs, wanted, several, *done)
    named_key = [F.col(k).alias(key_col) for k in key]
    facts = ["doc_id", F.col("n").alias("n_shingles")]
    empty = rows.where("n = 0").select(*facts, F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), *named_key)
    full = rows.where("n > 0").join(of_class, "sig").select(*facts, F.col("first.doc_id").alias("component_id"), (F.col("row_id") == F.col("first.row_id")).alias("kept"), *named_key)
    return full.unionByName(empty)
