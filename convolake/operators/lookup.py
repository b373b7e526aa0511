"""Finding conversations: by id, the start of an id, or a title; guards of arguments; the whole view of one."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.functions import text as T

#: What an identifier and a bare date look like. Fixed values.
ID, DATE = r"[A-Za-z0-9._-]+", r"\d{4}-\d{2}-\d{2}"


class NotFound(ValueError):
    """No conversation is meant by an argument, or several are."""


def checked_id(value: str) -> str:
    """An identifier, or an error."""
    if not re.fullmatch(ID, value or ""):
        raise ValueError(f"not an identifier: {value!r}")
    return value


def checked_date(value: str | None, end_of_day: bool = False) -> str | None:
    """An ISO time as its UTC second, or an error; a bare date that ends a range is the end of that day. Nothing is no bound."""
    text = (value or "").strip()
    if not text:
        return None
    try:
        at = datetime.datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as e:
        raise ValueError(f"not an ISO date: {value!r}") from e
    if end_of_day and re.fullmatch(DATE, text):
        at = at.replace(hour=23, minute=59, second=59)
    at = at.replace(tzinfo=datetime.timezone.utc) if at.tzinfo is None else at.astimezone(datetime.timezone.utc)
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


def checked_range(value: int, low: int, high: int) -> int:
    """A number within bounds, or an error."""
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"not between {low} and {high}: {value!r}")
    return value


def candidates(conversations: DataFrame, conversation_id: str) -> DataFrame:
    """Conversations that an id may mean: of an exact one that alone, else those that begin with it, with exact."""
    wanted = (conversation_id or "").strip()
    rows = conversations.where(F.col("conversation_id").startswith(wanted) & F.lit(bool(wanted))).withColumn("exact", F.col("conversation_id") == wanted)
    some = rows.agg(F.coalesce(F.bool_or("exact"), F.lit(False)).alias("some"))  # one row
    return rows.crossJoin(F.broadcast(some)).where("exact OR NOT some").drop("some")


def locate(conversations: DataFrame, platform: str, conversation_id: str) -> DataFrame:
    """The conversation of a platform that an id, or the start of one, means. None or several are an error, which names five of them; of files with one id the first by name counts."""
    rows = candidates(conversations.where(F.col("platform") == platform), conversation_id)
    found = [r.conversation_id for r in rows.select("conversation_id").distinct().orderBy("conversation_id").limit(6).collect()]
    if len(found) != 1:
        raise NotFound(f"{conversation_id!r} on {platform}: " + (f"ambiguous, {', '.join(found[:5])}" if found else "not found"))
    one = rows.where(F.col("conversation_id") == found[0]).drop("exact")
    return (one.orderBy("file") if "file" in one.columns else one).limit(1)


def by_title(conversations: DataFrame, query: str) -> DataFrame:
    """Conversations whose folded title holds the folded query, or whose id does."""
    said = T.plain(query)
    return conversations.where(F.contains(T.fold(F.col("title")), F.lit(said)) | F.contains(F.lower("conversation_id"), F.lit(said)))


def indexed_file(messages: DataFrame) -> DataFrame:
    """The file of each indexed conversation: the first that is known, by place."""
    return messages.where(F.coalesce("file", F.lit("")) != "").groupBy("platform", "conversation_id").agg(F.min_by("file", "pos").alias("file"))


def view(messages: DataFrame, conversations: DataFrame, platform: str, conversation_id: str) -> DataFrame:
    """One conversation whole: a row for each message, nulls as empty, with title, address and number of messages."""
    meta = locate(conversations, platform, conversation_id).select(F.col("platform").alias("p"), F.col("conversation_id").alias("c"), F.coalesce("title", F.lit("")).alias("title"), T.conversation_url(F.col("platform"), F.col("conversation_id")).alias("url"))
    rows = messages.join(F.broadcast(meta), (F.col("platform") == F.col("p")) & (F.col("conversation_id") == F.col("c"))).drop("p", "c")  # one row
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("texte", "role", "message_id")}).orderBy("pos")
