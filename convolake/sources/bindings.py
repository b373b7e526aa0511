"""The driver's tables as the engine's own: messages, conversations, vectors, inventory, media. Each has its DuckDB twin in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Common table expressions by name, for DuckDB.
SQL = {
    "messages": """messages AS (SELECT CASE conv_id % 6 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'claude' WHEN 2 THEN 'gemini' WHEN 3 THEN 'grok' WHEN 4 THEN 'mistral' ELSE 'perplexity' END AS platform,
        'c' || lpad(CAST(conv_id AS VARCHAR), 6, '0') AS conversation_id, conv_id, CAST(turn AS INTEGER) AS pos, conv_id * 1000 + turn AS msg_seq, 'm' || CAST(conv_id * 1000 + turn AS VARCHAR) AS message_id, role,
        CASE WHEN role = 'assistant' THEN 'model-' || CAST(conv_id % 5 AS VARCHAR) END AS model, make_timestamp((1719792000 + (conv_id * 7 % 180) * 86400 + turn * 90) * 1000000) AS ts, text AS texte FROM conversations)""",
    "vectors": """vectors AS (SELECT m.msg_seq, e.embedding FROM (SELECT msg_seq, (7 * conv_id + pos) % (SELECT count(*) FROM embeddings) AS k FROM messages) m JOIN embeddings e ON e.vec_id = m.k)""",
    "conv": """conv AS (SELECT platform, conversation_id, conv_id, 'Title ' || CAST(conv_id % 7 AS VARCHAR) AS title, min(ts) AS started_at, max(ts) AS last_message_at, count(*) AS message_count, conv_id % 3 <> 0 AS scraped, conv_id % 11 = 0 AS unavailable FROM messages GROUP BY ALL)""",
    "media": """media AS (SELECT doc_id AS media_id, lang AS platform, 'c' || CAST(doc_id % 50 AS VARCHAR) AS conversation_id, CASE doc_id % 4 WHEN 0 THEN NULL ELSE 'm' || CAST(doc_id % 90 AS VARCHAR) END AS message_id, CASE doc_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' ELSE 'video' END AS kind, 'f' || CAST(doc_id % 40 AS VARCHAR) AS content_key FROM documents)""",
}


def cte(*names: str) -> str:
    """WITH clause of the named tables and of those that they need."""
    need = {"vectors": ["messages"], "conv": ["messages"]}
    order = list(dict.fromkeys(x for n in names for x in [*need.get(n, []), n]))
    return "WITH " + ",\n".join(SQL[n] for n in order) + "\n"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    names = F.array(*map(F.lit, ("chatgpt", "claude", "gemini", "grok", "mistral", "perplexity")))
    seq = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(
        F.get(names, (F.col("conv_id") % 6).cast("int")).alias("platform"),
        F.concat(F.lit("c"), F.lpad(F.col("conv_id").cast("string"), 6, "0")).alias("conversation_id"),
        "conv_id",
        F.col("turn").cast("int").alias("pos"),
        seq.alias("msg_seq"),
        F.concat(F.lit("m"), seq.cast("string")).alias("message_id"),
        "role",
        F.when(F.col("role") == "assistant", F.concat(F.lit("model-"), (F.col("conv_id") % 5).cast("string"))).alias("model"),
        F.timestamp_seconds(1719792000 + (F.col("conv_id") * 7 % 180) * 86400 + F.col("turn") * 90).alias("ts"),
        F.col("text").alias("texte"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for each message, dealt by the numbers of conversation and turn."""
    m = messages(spark, sf_dir).select("msg_seq", "conv_id", "pos")
    e = read(spark, sf_dir, "embeddings")
    n = e.count()
    return m.select("msg_seq", ((7 * F.col("conv_id") + F.col("pos")) % max(n, 1)).alias("vec_id")).join(e.select("vec_id", "embedding"), "vec_id").select("msg_seq", "embedding")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        messages(spark, sf_dir)
        .groupBy("platform", "conversation_id", "conv_id")
        .agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_message_at"), F.count(F.lit(1)).alias("message_count"))
        .withColumns({"title": F.concat(F.lit("Title "), (F.col("conv_id") % 7).cast("string")), "scraped": F.col("conv_id") % 3 != 0, "unavailable": F.col("conv_id") % 11 == 0})
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("media_id"),
        F.col("lang").alias("platform"),
        F.concat(F.lit("c"), (F.col("doc_id") % 50).cast("string")).alias("conversation_id"),
        F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("m"), (F.col("doc_id") % 90).cast("string"))).alias("message_id"),
        F.get(F.array(F.lit("image"), F.lit("audio"), F.lit("video")), (F.col("doc_id") % 3).cast("int")).alias("kind"),
        F.concat(F.lit("f"), (F.col("doc_id") % 40).cast("string")).alias("content_key"),
    )


TABLES = {"messages": messages, "vectors": vectors, "conv": conversations, "media": media}
