"""The library's tables derived from the given ones, for the registered queries.

Atoms are chunks of documents; the turns of conversations give Q&A pairs; labels stand for tags that some documents lack;
orders, line items, customers and events stand for tasks, ledger, users and logs.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOW = 1706745600.0  # 2024-02-01T00:00:00Z


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir; in local mode without one, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared or tempfile.mkdtemp(prefix='spark-')}/{uuid.uuid4().hex}"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as an atom."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("k", "content"))
    return docs.select(
        "doc_id", (F.col("k") + 1).alias("chunk_no"), F.format_string("P1-C%03d", F.col("k") + 1).alias("chunk_id"), F.concat(F.lit("【"), "source", F.lit("】- "), F.substring("content", 1, 12)).alias("title"),
        "content", F.col("lang").alias("doc_type"), F.when(F.col("k") % 5 == 0, "拆分颗粒度异常").otherwise("").alias("remark"),
    )


LINES = """
lines AS (
  SELECT doc_id, k AS chunk_no, format('P1-C{:03d}', k) AS chunk_id, '【' || source || '】- ' || substr(content, 1, 12) AS title, content, lang AS doc_type,
         CASE WHEN (k - 1) % 5 = 0 THEN '拆分颗粒度异常' ELSE '' END AS remark
  FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)
)"""


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the next assistant turn of a conversation: a pair of document conv_id, its chunk by turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumns({"_next": F.lead("text").over(w), "_role": F.lead("role").over(w)})
    pairs = turns.filter("role = 'user' AND _role = 'assistant'")
    return pairs.select(
        F.col("conv_id").alias("doc_id"), F.format_string("P1-C%03d", F.col("turn") % 3 + 1).alias("chunk_id"), F.col("turn").cast("int").alias("qa_no"), F.col("text").alias("question"),
        F.col("_next").alias("answer"), ((F.col("conv_id") * 7 + F.col("turn") * 13) % 61 + 45).cast("int").alias("confidence_score"),
        F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, "【低置信-人工复核】").otherwise("").alias("remark"),
    )


QA = """
qa AS (
  SELECT conv_id AS doc_id, format('P1-C{:03d}', turn % 3 + 1) AS chunk_id, CAST(turn AS INT) AS qa_no, text AS question, n AS answer,
         CAST((conv_id * 7 + turn * 13) % 61 + 45 AS INT) AS confidence_score, CASE WHEN (conv_id + turn) % 4 = 0 THEN '【低置信-人工复核】' ELSE '' END AS remark
  FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS n, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
  WHERE role = 'user' AND r = 'assistant'
)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tasks: views have no file, and errors have failed."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("task_id"), F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string")).alias("user_id"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("created_at"), F.when(F.col("event_type") == "view", 0).otherwise(F.col("event_id") % 1000 + 1).cast("long").alias("file_size"),
        (F.col("event_id") % 97).cast("long").alias("token_consumed"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "signup", "pausing").otherwise("completed").alias("status"),
        F.lit(None).cast("string").alias("error"), F.concat(F.lit("doc \""), F.col("event_id").cast("string"), F.lit("\".md")).alias("filename"),
    )


TASKS = """
tasks AS (
  SELECT CAST(event_id AS VARCHAR) AS task_id, CASE WHEN user_id % 10 <> 0 THEN CAST(user_id AS VARCHAR) END AS user_id, CAST(floor(epoch(ts)) AS DOUBLE) AS created_at,
         CASE WHEN event_type = 'view' THEN 0 ELSE event_id % 1000 + 1 END AS file_size, event_id % 97 AS token_consumed,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'processing' WHEN 'signup' THEN 'pausing' ELSE 'completed' END AS status,
         CAST(NULL AS VARCHAR) AS error, 'doc "' || event_id || '".md' AS filename
  FROM events
)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records for each task with a file, the second a day later; tasks of views have none."""
    t = tasks(spark, sf_dir).filter("file_size > 0")
    return t.select("task_id", "user_id", F.explode(F.array(F.lit(0), F.lit(86400))).alias("d"), "created_at", "token_consumed").select(
        "task_id", "user_id", (F.col("created_at") + F.col("d")).alias("consumed_at"), (F.col("token_consumed") % 40).cast("long").alias("tokens")
    )


LEDGER = """
ledger AS (
  SELECT task_id, user_id, created_at + d AS consumed_at, token_consumed % 40 AS tokens FROM tasks, (VALUES (0), (86400)) AS v(d) WHERE file_size > 0
)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("username"), F.lower(F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@"), F.col("c_mktsegment"), F.lit(".example"))).alias("email"),
        F.when(F.col("c_custkey") % 50 == 0, "super_admin").when(F.col("c_custkey") % 7 == 0, "admin").otherwise("user").alias("role"), F.when(F.col("c_acctbal") < 0, "disabled").otherwise("active").alias("status"),
    )


USERS = """
users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS username, lower('u' || c_custkey || '@' || c_mktsegment || '.example') AS email,
         CASE WHEN c_custkey % 50 = 0 THEN 'super_admin' WHEN c_custkey % 7 = 0 THEN 'admin' ELSE 'user' END AS role, CASE WHEN c_acctbal < 0 THEN 'disabled' ELSE 'active' END AS status
  FROM customer
)"""


def exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size anomalies of every other chunk and low scores of pairs, as entries."""
    sizes = lines(spark, sf_dir).filter("chunk_no % 2 = 1 AND NOT length(content) BETWEEN 300 AND 800").select(
        "doc_id", F.lit(2).alias("stage"), F.lit("chunk_anomalies").alias("field"), F.col("chunk_no").alias("pos"), F.concat("chunk_id", F.lit(": 拆分颗粒度异常-内容"), F.length("content").cast("string"), F.lit("字")).alias("item")
    )
    low = qa(spark, sf_dir).filter("confidence_score < 80").select(
        "doc_id", F.lit(3).alias("stage"), F.lit("low_confidence_qa").alias("field"), F.col("qa_no").alias("pos"),
        F.concat("chunk_id", F.lit("-Q"), F.col("qa_no").cast("string"), F.lit(": 置信分"), F.col("confidence_score").cast("string"), F.lit("-【低置信】")).alias("item"),
    )
    return sizes.unionByName(low)


EXCEPTIONS = """
exceptions AS (
  SELECT doc_id, 2 AS stage, 'chunk_anomalies' AS field, chunk_no AS pos, chunk_id || ': 拆分颗粒度异常-内容' || length(content) || '字' AS item
  FROM lines WHERE chunk_no % 2 = 1 AND NOT length(content) BETWEEN 300 AND 800
  UNION ALL
  SELECT doc_id, 3, 'low_confidence_qa', qa_no, chunk_id || '-Q' || qa_no || ': 置信分' || confidence_score || '-【低置信】' FROM qa WHERE confidence_score < 80
)"""
