"""An archive parsed anew from what it was made of: payloads first, else pages, else the cleaned texts of the archive itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.functions import text as T
from convolake.operators import archive, normalize, pages, parsers
from convolake.scratch import saved
from convolake.streaming.incremental import merged_messages

KEYS = ["platform", "conversation_id"]
#: What is filled from the archive where a new parse lacks it.
FILLED = ("ts", "model", "message_id")


def parse(payloads: DataFrame, page_rows: DataFrame) -> DataFrame:
    """Messages of payloads (platform, conversation_id, payload) and of the pages (platform, conversation_id, html) of conversations without one, with the origin remapped or reparsed. Of artefacts of one conversation the first by text counts."""
    one = lambda rows, c: rows.groupBy(*KEYS).agg(F.min(c).alias(c))
    raw, shown = saved(one(payloads, "payload"), "reparse-payloads"), saved(one(page_rows, "html").join(payloads.select(*KEYS).distinct(), KEYS, "left_anti"), "reparse-pages")  # each is read once for each vendor
    made = [parsers.MAPPERS[p](raw.where(F.col("platform") == p)).withColumns({"platform": F.lit(p), "origin": F.lit("remapped")}) for p in parsers.MAPPERS]
    made += [pages.read_pages(shown.where(F.col("platform") == p), p).withColumns({"platform": F.lit(p), "origin": F.lit("reparsed")}) for p in pages.PAGES]
    return reduce(DataFrame.unionByName, made)


def cleaned(messages: DataFrame) -> DataFrame:
    """The archive's own messages with their texts cleaned: what is left for a conversation without any artefact."""
    return messages.withColumn("texte", T.clean_text(F.col("texte"), F.col("platform")))


def reparse(messages: DataFrame, payloads: DataFrame, page_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, conversations) of an archive after all is parsed anew.

    messages: platform, conversation_id, pos, message_id, role, model, ts, texte; so is the result. conversations: origin (remapped, reparsed, cleaned, or failed if an artefact gave no message), kept (the new
    parse had fewer messages, so that the archive stays), status of the merge and messages. Conversations that the archive doesn't have are left out.
    """
    have = messages.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_old"))
    parsed = saved(parse(payloads.join(have.select(*KEYS), KEYS, "left_semi"), page_rows.join(have.select(*KEYS), KEYS, "left_semi")), "parsed")  # it is read several times
    named = payloads.select(*KEYS).unionByName(page_rows.select(*KEYS)).distinct().withColumn("artefact", F.lit(True))
    counts = parsed.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_new"), F.first("origin").alias("origin"))
    told = have.join(counts, KEYS, "left").join(named, KEYS, "left")
    origin = F.when(F.col("origin").isNotNull(), F.col("origin")).when(F.col("artefact"), "failed").otherwise("cleaned")
    told = saved(told.select(*KEYS, "n_old", F.coalesce("n_new", "n_old").alias("n_new"), origin.alias("origin")).withColumn("kept", F.col("n_new") < F.col("n_old")), "reparse-plan")
    columns = messages.columns
    again = parsed.join(told.where("NOT kept").select(*KEYS), KEYS, "left_semi").select(*columns)
    again = archive.metadata_fallback(again, messages, FILLED).drop("matched")
    own = messages.join(told.where("origin = 'cleaned'").select(*KEYS), KEYS, "left_semi")
    new = saved(again.unionByName(cleaned(own).select(*columns)), "reparse-new")
    merged = archive.merge_status(messages, new).select(*KEYS, "status")
    final = merged_messages(messages, new)
    return final, told.join(merged, KEYS, "left").select(*KEYS, "origin", "kept", "status", F.when(F.col("kept"), F.col("n_old")).otherwise(F.col("n_new")).alias("messages"))


def counters(conversations: DataFrame) -> DataFrame:
    """How many conversations were remapped, reparsed, cleaned, failed and kept; kept ones count twice, as the report of a run does."""
    each = conversations.select("platform", F.explode(F.when(F.col("kept"), F.array("origin", F.lit("kept"))).otherwise(F.array("origin"))).alias("what"))
    return each.groupBy("platform", "what").agg(F.count(F.lit(1)).alias("n"))


def derive_times(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with started_at and last_message_at from their messages where they have none."""
    times = messages.groupBy(*KEYS).agg(F.min("ts").alias("__first"), F.max("ts").alias("__last"))
    rows = conversations.join(times, KEYS, "left")
    return rows.withColumns({"started_at": F.coalesce("started_at", "__first"), "last_message_at": F.coalesce("last_message_at", "__last")}).drop("__first", "__last")


def checked(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What every parse ends with: (messages of alternating roles, conversations with their times and whether they are valid: a message at least, and known roles only)."""
    folded = normalize.fold_runs(messages)
    known = F.col("role").isin("user", "assistant", "system")
    of = folded.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("messages"), F.min("ts").alias("started_at"), F.max("ts").alias("last_message_at"), F.bool_and(F.coalesce(known, F.lit(False))).alias("valid"))
    return folded, of
