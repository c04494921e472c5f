"""The queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, licenses, pii, quality, ranked_search, secret_scan, token_pack, tool_calls
from .chunk_dedup import exact_dedup
from .mixing import mix
from .shingle_join import jaccard_components
from .store import documents, new_path
from .vafile import top_k


def tokenizer_path() -> str:
    """File of the tokenizer: $RUNLEDGER_TOKENIZER, else the 50k byte-level vocabulary of public_tokenizers."""
    if path := os.environ.get("RUNLEDGER_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "ids")
    return token_pack.read_digests(spark, folder, len(token_pack.write(documents(spark, sf_dir), tokenizer_path(), folder)))


def op2_traced_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    of_kind = [F.size(F.filter(base, lambda s: s["kind"] == F.lit(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *of_kind, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return tool_calls.link(*tool_calls.turns_as_calls(rows), tool_calls.REPLY)


def op5_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op6_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op8_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(documents(spark, sf_dir), tokenizer_path(), decoded=True)
    n = (F.length("ids") / 4).cast("long").alias("n_tokens")
    return coded.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs, labels)
    scored = quality.score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", quality.held_out().alias("held_out"), F.col("quality_score").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op10_vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    of_kind = [F.size(F.filter(base, lambda s: s["kind"] == F.lit(k))).cast("long").alias(f"n_{k}") for k in secret_scan.BASE]
    return found.select("doc_id", *of_kind, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op12_window_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


QUERIES = {f.__name__: f for f in (op1_token_pack, op2_traced_pii, op3_chunk_dedup, op4_tool_calls, op5_token_groups, op6_license_diagonals, op7_source_mix, op8_word_bpe, op9_subword_quality, op10_vector_top_k, op11_secret_scan, op12_window_ranking)}

ORACLES = {
    "op3_chunk_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op4_tool_calls": rf"""
        WITH c AS (SELECT conv_id, turn, text, count(*) AS n_rows FROM conversations WHERE role = 'user' GROUP BY ALL),
        r AS (SELECT conv_id, turn, text, count(*) AS n_rows FROM conversations WHERE role <> 'user' OR role IS NULL GROUP BY ALL),
        o AS (SELECT conv_id, turn, min(text) AS text FROM c WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
        a AS (SELECT o.*, (SELECT min(r.text) FROM r WHERE r.conv_id = o.conv_id AND r.turn = o.turn + 1) AS answer,
                     EXISTS (SELECT 1 FROM r WHERE r.conv_id = o.conv_id AND r.turn = o.turn + 1) AS answered FROM o),
        n AS (SELECT c.*, coalesce(a.answered, false) AND a.text IS NOT DISTINCT FROM c.text AS linked, a.answer, a.answered, a.text IS NOT DISTINCT FROM c.text AS first,
                     CASE WHEN c.turn % 4 = 0 THEN 2 WHEN c.turn % 8 = 2 THEN -2 END AS step, coalesce(other.answered, false) AS other
              FROM c LEFT JOIN a ON a.conv_id = c.conv_id AND a.turn = c.turn
              LEFT JOIN a other ON other.conv_id = c.conv_id AND other.turn = c.turn + CASE WHEN c.turn % 4 = 0 THEN 2 WHEN c.turn % 8 = 2 THEN -2 END),
        k AS (SELECT *, step IS NOT NULL AND other AND NOT (c_turn_cycle AND answered) AS kept FROM (SELECT *, turn % 8 = 0 AS c_turn_cycle FROM n))
        SELECT 'call' AS kind, conv_id, 'call-' || turn AS call_id, turn, 0::BIGINT AS place,
               CASE WHEN kept AND step = 2 THEN printf('%012d.%06d.%06d', turn + 2, 0, 1) ELSE printf('%012d.%06d', turn, 0) END AS order_key,
               CASE WHEN linked THEN turn + 1 END AS result_turn,
               CASE WHEN NOT first THEN 'duplicate' WHEN linked THEN 'linked' ELSE 'pending' END AS status,
               coalesce(length(text) BETWEEN 1 AND {tool_calls.MOST_LETTERS} AND turn >= 0, false) AS args_valid,
               kept::BIGINT AS n_needs_kept, (step IS NOT NULL AND NOT kept)::BIGINT AS n_needs_cut, n_rows,
               '{{"arguments":{{' || CASE WHEN text IS NULL THEN '' ELSE '"text":' || to_json(text) || ',' END || '"turn":' || turn || '}},"id":"call-' || turn
                 || '","name":"reply","result":' || CASE WHEN linked AND answer IS NOT NULL THEN to_json(answer)::VARCHAR ELSE 'null' END || '}}' AS message
        FROM k
        UNION ALL
        SELECT 'result', r.conv_id, 'call-' || (r.turn - 1), r.turn, NULL, NULL, r.turn,
               CASE WHEN o.turn IS NULL THEN 'orphan' ELSE 'repeated' END, NULL, NULL, NULL, r.n_rows,
               '{{"id":"call-' || (r.turn - 1) || '","result":' || coalesce(to_json(r.text)::VARCHAR, 'null') || '}}'
        FROM r LEFT JOIN a o ON o.conv_id = r.conv_id AND o.turn = r.turn - 1
        WHERE o.turn IS NULL OR r.text IS DISTINCT FROM o.answer""",
    "op10_vector_top_k": """
        WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s)
        SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM r WHERE rk <= 5""",
    "op12_window_ranking": r"""
        WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, text FROM documents),
        t AS (SELECT row_no, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        n AS (SELECT row_no, doc_id, count(*) AS n FROM t GROUP BY ALL),
        g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
        p AS (SELECT row_no, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY term, docs),
        m AS (SELECT row_no, doc_id, 100 - 90 + (90 * n * docs) // terms AS m FROM n, g),
        s AS (SELECT item_id, row_no, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
              FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (row_no) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rk FROM s WHERE score > 0)
        SELECT item_id, rk::INTEGER AS rank, doc_id, score FROM r WHERE rk <= 10""",
}
