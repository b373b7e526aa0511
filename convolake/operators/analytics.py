"""Counts over messages and conversations: statistics, time series, day views, facets, audits, run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.operators.base import sql_operator

#: Verdicts from the best to the worst. Fixed values.
VERDICTS = ("ok", "attention", "critique")

#: Totals and counts by platform of the index.
stats = sql_operator("SELECT platform, count(*) AS n_messages, count(DISTINCT conversation_id) AS n_conversations, (SELECT count(*) FROM {messages}) AS total FROM {messages} GROUP BY platform", "messages")
#: The eight most used models, ties by name.
top_models = sql_operator("SELECT model, count(*) AS n FROM {messages} WHERE model IS NOT NULL AND model <> '' GROUP BY model ORDER BY n DESC, model LIMIT 8", "messages")
distinct_models = sql_operator("SELECT DISTINCT model FROM {messages} WHERE model <> '' ORDER BY model", "messages")
date_bounds = sql_operator("SELECT CAST(min(ts) AS VARCHAR(40)) AS first_ts, CAST(max(ts) AS VARCHAR(40)) AS last_ts FROM {messages}", "messages")
#: What a search form offers.
facets = sql_operator("SELECT 'platform' AS facet, platform AS value, count(*) AS n FROM {messages} GROUP BY platform UNION ALL SELECT 'model', model, count(*) FROM {messages} WHERE model <> '' GROUP BY model", "messages")
#: First conversation month of each platform or model; the two-level counts behind the timeline.
FIRSTS = "SELECT {key}, substr(CAST(min(ts) AS VARCHAR(40)), 1, 7) AS month FROM {{messages}} WHERE ts IS NOT NULL AND {key} IS NOT NULL GROUP BY {key}, conversation_id"


def _timeline(key: str):
    """Conversations by the month of their first message, dense over the axis, with the trend of the last complete month."""
    firsts = FIRSTS.format(key=key).replace(f"SELECT {key}", f"SELECT {key} AS series")
    return sql_operator(
        f"""WITH firsts AS ({firsts}), series AS (SELECT DISTINCT series FROM firsts),
        counts AS (SELECT series, month, count(*) AS n FROM firsts GROUP BY series, month),
        dense AS (SELECT s.series, a.month, coalesce(c.n, 0) AS n FROM series s CROSS JOIN {{axis}} a LEFT JOIN counts c ON c.series = s.series AND c.month = a.month),
        moved AS (SELECT series, month, n, lag(n, 1) OVER (PARTITION BY series ORDER BY month) AS last, lag(n, 2) OVER (PARTITION BY series ORDER BY month) AS previous, row_number() OVER (PARTITION BY series ORDER BY month DESC) AS back FROM dense)
        SELECT series, month, CAST(n AS BIGINT) AS n, CASE WHEN back = 1 AND previous > 0 THEN round(CAST((last - previous) * 100.0 / previous AS DOUBLE), 1) END AS trend_pct FROM moved""",
        "messages",
        "axis",
    )


timeline_platform, timeline_model = _timeline("platform"), _timeline("model")
#: Messages a day, days without any too; days is a calendar.
daily = sql_operator("SELECT CAST(d.day AS VARCHAR(10)) AS day, coalesce(c.n, 0) AS n, max(coalesce(c.n, 0)) OVER () AS most FROM {days} d LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM {messages} GROUP BY CAST(ts AS DATE)) c ON c.day = d.day", "messages", "days")
#: Levels 0 to 4 of a day, by quartiles of the active days at the nearest rank.
heat_levels = sql_operator(
    """WITH active AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS days FROM {daily} WHERE n > 0),
    cuts AS (SELECT max(CASE WHEN k = CAST(floor(0.25 * days) AS INT) THEN n END) AS q1, max(CASE WHEN k = CAST(floor(0.5 * days) AS INT) THEN n END) AS q2, max(CASE WHEN k = CAST(floor(0.75 * days) AS INT) THEN n END) AS q3 FROM active)
    SELECT day, n, CASE WHEN n = 0 THEN 0 WHEN n <= q1 THEN 1 WHEN n <= q2 THEN 2 WHEN n <= q3 THEN 3 ELSE 4 END AS level FROM {daily} CROSS JOIN cuts""",
    "daily",
)
bars = sql_operator("SELECT platform, n, round(CAST(n AS DOUBLE) / max(n) OVER (), 4) AS share FROM (SELECT platform, count(*) AS n FROM {messages} GROUP BY platform) t", "messages")
tool_stats = sql_operator(
    """SELECT c.platform, c.listed, c.scraped, c.unavailable, coalesce(m.n_messages, 0) AS n_messages, coalesce(m.n_conversations, 0) AS n_indexed
    FROM (SELECT platform, count(*) AS listed, count(CASE WHEN scraped THEN 1 END) AS scraped, count(CASE WHEN unavailable THEN 1 END) AS unavailable FROM {conv} GROUP BY platform) c
    LEFT JOIN (SELECT platform, count(*) AS n_messages, count(DISTINCT conversation_id) AS n_conversations FROM {messages} GROUP BY platform) m ON m.platform = c.platform""",
    "conv",
    "messages",
)
inventory_counters = sql_operator("SELECT platform, scraped, unavailable, count(*) AS n, CAST(sum(message_count) AS BIGINT) AS messages FROM {conv} GROUP BY platform, scraped, unavailable", "conv")
majority = sql_operator("SELECT platform, value AS model FROM (SELECT platform, model AS value, row_number() OVER (PARTITION BY platform ORDER BY count(*) DESC, model) AS k FROM {messages} WHERE model <> '' GROUP BY platform, model) t WHERE k = 1", "messages")
media_stats = sql_operator("SELECT kind, count(*) AS n, (SELECT count(*) FROM {media}) AS total FROM {media} GROUP BY kind", "media")
event_days = sql_operator("SELECT CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM {events} GROUP BY CAST(ts AS DATE), event_type", "events")


def day_view(messages: DataFrame, day: str) -> DataFrame:
    """Messages of a date (yyyy-MM-dd) by conversation, conversations in the order of their first message that day (place, from 1), with the total of the day. One row for each conversation of one day is what the order is taken over."""
    rows = messages.where(F.col("ts").cast("date") == F.lit(day).cast("date"))
    by = rows.groupBy("platform", "conversation_id").agg(F.count(F.lit(1)).alias("n"), F.min("msg_seq").alias("first_seq"), F.min("ts").alias("first_ts"))
    told = by.agg(F.sort_array(F.collect_list(F.struct("first_ts", "first_seq", "platform", "conversation_id", "n"))).alias("c"), F.sum("n").alias("message_count"))
    return told.select(F.posexplode("c").alias("k", "c"), "message_count").select("c.platform", "c.conversation_id", "c.n", "c.first_seq", (F.col("k") + 1).alias("place"), "message_count")


def status(inventory: DataFrame, reports: DataFrame) -> DataFrame:
    """Counts of the inventory by platform, with the worst verdict of its reports (platform, verdict); inconnu without any that is known."""
    ranks = F.create_map(*(x for k, v in enumerate(VERDICTS) for x in (F.lit(v), F.lit(k))))
    worst = reports.groupBy("platform").agg(F.max(F.element_at(ranks, F.col("verdict"))).alias("rank"))
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c)
    counts = inventory.groupBy("platform").agg(F.count(F.lit(1)).alias("listed"), flag("scraped"), flag("unavailable"), F.max("last_message_at").alias("last_message_at"))
    return counts.join(worst, "platform", "left").withColumn("verdict", F.coalesce(F.get(F.array(*map(F.lit, VERDICTS)), F.col("rank")), F.lit("inconnu"))).drop("rank")


def bench_summary(fetches: DataFrame) -> DataFrame:
    """Fetches (service, seconds, bytes, messages, score; a null seconds is a failure) by service: n, fetched, failed, sums, and mean, least and greatest seconds of those fetched, to 3 decimals."""
    ok = F.col("seconds").isNotNull()
    of = lambda f, c: F.round(f(F.col(c)), 3)
    return fetches.groupBy("service").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("fetched"), F.count_if(~ok).alias("failed"), F.sum("bytes").alias("bytes"), F.sum("messages").alias("messages"),
        of(F.avg, "seconds").alias("mean_s"), of(F.min, "seconds").alias("min_s"), of(F.max, "seconds").alias("max_s"), F.round(F.avg("score"), 1).alias("mean_score"),
    )


def month_axis(spark: SparkSession, last: str, n: int) -> DataFrame:
    """The n months (month, yyyy-MM) that end with that of a day."""
    return spark.range(n).select(F.date_format(F.add_months(F.trunc(F.lit(last).cast("date"), "month"), F.col("id").cast("int") - (n - 1)), "yyyy-MM").alias("month"))


def api_health(reports: DataFrame) -> DataFrame:
    """Health reports (service, n, matches, and more) with rate, the share of matches in percent to 1 decimal; null without any reading."""
    return reports.withColumn("rate", F.when(F.col("n") > 0, F.round(F.col("matches") / F.col("n") * 100, 1)))


def first_months(events: DataFrame, key: str, time: str = "ts") -> DataFrame:
    """Of each key its first and last time and its number of rows, and the month of the first."""
    return events.groupBy(key).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count(F.lit(1)).alias("n")).withColumn("month", F.date_format("first_seen", "yyyy-MM"))
