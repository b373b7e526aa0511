"""Reports of rechecks and health as tables: reading what may be broken, compacting, failures and their kinds, canaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.operators.analytics import VERDICTS
from convolake.operators.quality import verdicts

#: A report as JSON; counts may be anything, so they are read as text.
RECHECK = "verdict string, checked string, compared string, ignored string, ok string, degraded string, failed string, retention string, checked_at string, seed string, conversations array<struct<conversation_id:string,title:string,status:string,error:string,lost:array<string>,retention:string,old_messages:string,new_messages:string>>"
#: What becomes of a conversation whose export ends with an error: (kind of error, status, whether the service stops, whether it is marked as unavailable). Fixed values.
OUTCOMES = (
    ("blocked", "blocked", True, False), ("unavailable", "skipped", False, True), ("empty", "skipped", False, False), ("not_logged_in", "failed", True, False), ("rate_limited", "skipped", True, False),
    ("shape_break", "skipped", True, False), ("parse", "failed", False, False), ("schema", "failed", False, False),
)


def whole(c: Column, default: int | None = 0) -> Column:
    """A number read from text, cut to a whole one; anything else is the default."""
    number = c.try_cast("double")
    cut = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("long")
    return F.coalesce(F.when(~F.isnan(number) & (F.abs(number) < 9e18), cut), F.lit(default).cast("long"))


def finite(c: Column) -> Column:
    """A finite number read from text, else null."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def reason(error: Column, lost: Column) -> Column:
    """Why a conversation failed: its error, or else what it lost."""
    return F.coalesce(F.nullif(error, F.lit("")), F.nullif(F.array_join(lost, ", "), F.lit("")))


def read_recheck(reports: DataFrame) -> DataFrame:
    """Reports (platform, report as JSON) with all fields coerced, issues being the conversations that aren't ok; a verdict that isn't known is inconnu. Reports that aren't an object are left out."""
    rows = reports.where(F.call_function("try_parse_json", F.col("report")).isNotNull() & F.ltrim("report").startswith("{")).select("platform", F.from_json("report", RECHECK).alias("r"))
    issue = lambda x: F.struct(
        F.coalesce(F.nullif(x["title"], F.lit("")), x["conversation_id"]).alias("title"), x["conversation_id"].alias("conversation_id"), x["status"].alias("status"), reason(x["error"], x["lost"]).alias("reason"), finite(x["retention"]).alias("retention"),
        whole(x["old_messages"], None).alias("old_messages"), whole(x["new_messages"], None).alias("new_messages"),
    )
    bad = F.filter(F.coalesce("r.conversations", F.array().cast("array<struct<conversation_id:string,title:string,status:string,error:string,lost:array<string>,retention:string,old_messages:string,new_messages:string>>")), lambda x: x.isNotNull() & F.coalesce(x["status"] != "ok", F.lit(True)))
    return rows.select(
        "platform", F.when(F.col("r.verdict").isin(*VERDICTS), F.col("r.verdict")).otherwise("inconnu").alias("verdict"), whole(F.col("r.checked")).alias("checked"), whole(F.coalesce("r.compared", "r.checked")).alias("compared"),
        *(whole(F.col(f"r.{c}")).alias(c) for c in ("ignored", "ok", "degraded", "failed")), finite(F.col("r.retention")).alias("retention"), "r.checked_at", "r.seed", F.transform(bad, issue).alias("issues"),
    )


def failures(targets: DataFrame, status: str, error: str) -> DataFrame:
    """Rows of a report for conversations (conversation_id, title, message_count) that could not be compared."""
    return targets.select("conversation_id", F.coalesce("title", F.lit("")).alias("title"), F.lit(status).alias("status"), F.lit(error).alias("error"), F.col("message_count").alias("old_messages"), F.lit(0).cast("long").alias("new_messages"), F.lit(None).cast("double").alias("retention"), F.expr("CAST(array() AS array<string>)").alias("lost"))


def write_recheck(conversations: DataFrame) -> DataFrame:
    """Reports (platform, report as JSON) from rows (platform, conversation_id, title, status, error, old_messages, new_messages, retention, lost)."""
    entry = F.struct("conversation_id", "title", "status", "error", "lost", "retention", "old_messages", "new_messages")
    rows = conversations.groupBy("platform").agg(F.sort_array(F.collect_list(entry)).alias("conversations"), F.count(F.lit(1)).alias("checked")).join(verdicts(conversations), "platform")
    return rows.select("platform", F.to_json(F.struct("verdict", "checked", "compared", "ignored", "ok", "degraded", "failed", "retention", "conversations")).alias("report"))


def flag(c: Column) -> Column:
    """A boolean read from text; anything but true, 1 and yes is false."""
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes"), F.lit(False))


def write_health(monitor: DataFrame) -> DataFrame:
    """Health reports (service, report as JSON) from a monitor's counts (service, n, matches, drifts, breaks, least)."""
    return monitor.select("service", F.to_json(F.struct("service", "n", "matches", "drifts", "breaks", F.col("least").alias("min_score"))).alias("report"))


def outcomes(errors: DataFrame) -> DataFrame:
    """Exports (conversation_id, error kind, or null for success) with status, stop and unavailable; an error of another kind is a failure."""
    known = errors.sparkSession.createDataFrame(OUTCOMES, "error string, status string, stop boolean, unavailable boolean")
    told = errors.join(F.broadcast(known), "error", "left")  # eight rows
    return told.withColumns({"status": F.when(F.col("error").isNull(), "exported").otherwise(F.coalesce("status", F.lit("failed"))), "stop": F.coalesce("stop", F.lit(False)), "unavailable": F.coalesce("unavailable", F.lit(False))})


def read_canaries(configs: DataFrame) -> DataFrame:
    """Canaries from configurations (config as JSON, a map by platform): (platform, conversation_id, title, expected). Entries without an id are left out."""
    kind = "map<string,struct<conversation_id:string,title:string,expected:array<string>>>"
    rows = configs.select(F.explode(F.from_json("config", kind)).alias("platform", "e"))
    return rows.select("platform", "e.conversation_id", "e.title", F.coalesce("e.expected", F.array().cast("array<string>")).alias("expected")).where("conversation_id <> ''")


def apply_supplements(payload: DataFrame, supplements: DataFrame) -> DataFrame:
    """Covered capabilities (capability, prompt) with supplements for those that are not covered; of several supplements of one capability the first prompt by name counts."""
    one = supplements.groupBy("capability").agg(F.min("prompt").alias("prompt")).join(payload.select("capability").distinct(), "capability", "left_anti")
    return payload.select("capability", "prompt").withColumn("origin", F.lit("suite")).unionByName(one.withColumn("origin", F.lit("supplement")))
