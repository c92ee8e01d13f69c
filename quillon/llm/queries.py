"""Queries over the ten operators, each with production parameters on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, langid, minhash, packing, ppm, secrets, sharding, token_counts

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op4_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_table(spark, sf_dir, "documents"))


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_table(spark, sf_dir, "documents"))


def op9_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sharding.place(docs, "doc_id", SHARDS).select("doc_id", "source", "n_chars", "slot", "shard")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_minhash, op3_secret_scan, op4_byte_gru, op5_ppm, op6_vector_packing, op7_permutation_index, op8_exact_dedup, op9_shard_table, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    table = ",".join(map(str, sharding.fill(SHARDS)))
    return {
        "op2_minhash": r"""
            WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
            s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
            n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s), u AS (SELECT doc_id, unnest(sh) AS h FROM s),
            pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
            lk AS (SELECT x, y FROM pr JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
            ed AS (SELECT x, y FROM lk UNION ALL SELECT y, x FROM lk),
            rc AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT rc.a, ed.y FROM rc JOIN ed ON ed.x = rc.b),
            m AS (SELECT a AS doc_id, min(b) AS component_id FROM rc GROUP BY a)
            SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN m USING (doc_id)""",
        "op8_exact_dedup": r"""
            WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
            g AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g""",
        "op9_shard_table": f"""
            WITH t AS (SELECT string_split('{table}', ',') AS shards),
            s AS (SELECT doc_id, source, n_chars, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % {sharding.TABLE_SIZE} AS INTEGER) AS slot FROM documents)
            SELECT doc_id, source, n_chars, slot, CAST(shards[slot + 1] AS INTEGER) AS shard FROM s, t""",
    }
