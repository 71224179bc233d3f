"""Corpora (path, content) from the tables of a folder, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables under this size are dealt over all cores; larger ones have enough row groups of their own.
SMALL_BYTES = 256 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table often is one row group, which one task would read and search alone."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").alias("content")))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return spread(read(spark, sf_dir, "conversations").select(at.alias("path"), F.col("text").alias("content")))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.col("text").alias("content"))


def _planted(k: Column, h: Column) -> list[Column]:
    def cut(a: int, n: int) -> Column:
        return F.substring(h, a, n)

    def text(*parts: str | Column) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    def b64(c: Column) -> Column:
        return F.base64(c.cast("binary"))

    return [
        text('const k = "AKIA', F.upper(cut(1, 16)), '";'),
        text('aws_secret_access_key = "', cut(1, 40), '"'),
        text("GH=ghp_", cut(1, 36)),
        text("stripe.key = sk_live_", cut(1, 24)),
        text("stripe.pub = pk_test_", cut(1, 24)),
        text("sid AC", cut(1, 32)),
        text('twilio_auth_token = "', cut(1, 32), '"'),
        text("AIza", cut(1, 35)),
        text("slack xoxb-", cut(1, 20)),
        text("postgres://u", k, ":", cut(1, 10), "@db.example.com:5432/app"),
        text("hash $2b$12$", F.substring(F.concat(h, h), 1, 53)),
        text("Authorization: Bearer ", cut(1, 40)),
        text("Authorization: Basic ", cut(1, 20)),
        text('export API_KEY="', cut(1, 32), '"'),
        text("blob ", b64(text('token = "', cut(1, 40), '"'))),
        text("blob ", F.lower(F.hex(text('secret = "', cut(1, 24), '"').cast("binary")))),
        text("ñAKIA", F.upper(cut(1, 16))),
        text('fetch("https://api.example.com/v1/users/', k, '")'),
        text("-----BEGIN RSA PRIVATE KEY-----\n", h, "\n-----END RSA PRIVATE KEY-----"),
        text('var a = "', cut(1, 24), '", b = ["', cut(25, 10), '","', cut(35, 12), '"].join("-");'),
    ]


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A secret of one of twenty kinds for each order; (k, path, content).  A path has the entries of a part of a
    thousand keys, so files stay small however many there are."""
    key = F.col("o_orderkey")
    k = key.cast("string")
    h = F.sha2(k, 256)
    path = F.concat(
        F.lit("src/"), (key % 7).cast("string"), F.when(key % 3 == 0, "/test/").otherwise("/app/"), F.lit("f"),
        F.floor(key / 1000).cast("string"), F.lit(".js"),
    )
    kind = F.array(*_planted(k, h))
    return spread(read(spark, sf_dir, "orders").select("o_orderkey")).select(key.alias("k"), path.alias("path"), F.get(kind, (key % 20).cast("int")).alias("content"))


SQL = {
    "documents": "SELECT concat_ws('/', source, doc_id::VARCHAR) AS path, text AS content FROM documents",
    "pages": "SELECT url AS path, html AS content FROM pages",
    "conversations": "SELECT concat_ws('/', conv_id::VARCHAR, turn::VARCHAR) AS path, text AS content FROM conversations",
    "benchmark": "SELECT item_id::VARCHAR AS path, text AS content FROM benchmark",
    "derived": r"""
SELECT key AS k, 'src/' || (key % 7)::VARCHAR || CASE WHEN key % 3 = 0 THEN '/test/' ELSE '/app/' END || 'f' || (key // 1000)::VARCHAR || '.js' AS path,
 CASE key % 20
  WHEN 0 THEN 'const k = "AKIA' || upper(h[1:16]) || '";'
  WHEN 1 THEN 'aws_secret_access_key = "' || h[1:40] || '"'
  WHEN 2 THEN 'GH=ghp_' || h[1:36]
  WHEN 3 THEN 'stripe.key = sk_live_' || h[1:24]
  WHEN 4 THEN 'stripe.pub = pk_test_' || h[1:24]
  WHEN 5 THEN 'sid AC' || h[1:32]
  WHEN 6 THEN 'twilio_auth_token = "' || h[1:32] || '"'
  WHEN 7 THEN 'AIza' || h[1:35]
  WHEN 8 THEN 'slack xoxb-' || h[1:20]
  WHEN 9 THEN 'postgres://u' || key::VARCHAR || ':' || h[1:10] || '@db.example.com:5432/app'
  WHEN 10 THEN 'hash $2b$12$' || (h || h)[1:53]
  WHEN 11 THEN 'Authorization: Bearer ' || h[1:40]
  WHEN 12 THEN 'Authorization: Basic ' || h[1:20]
  WHEN 13 THEN 'export API_KEY="' || h[1:32] || '"'
  WHEN 14 THEN 'blob ' || to_base64(encode('token = "' || h[1:40] || '"'))
  WHEN 15 THEN 'blob ' || lower(hex('secret = "' || h[1:24] || '"'))
  WHEN 16 THEN 'ñAKIA' || upper(h[1:16])
  WHEN 17 THEN 'fetch("https://api.example.com/v1/users/' || key::VARCHAR || '")'
  WHEN 18 THEN '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || h || chr(10) || '-----END RSA PRIVATE KEY-----'
  ELSE 'var a = "' || h[1:24] || '", b = ["' || h[25:34] || '","' || h[35:46] || '"].join("-");'
 END AS content
FROM (SELECT o_orderkey AS key, sha256(o_orderkey::VARCHAR) AS h FROM orders)""",
}
