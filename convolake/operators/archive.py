"""The archive: merging a new reading with the old one, inventories, upserts, purges, media upkeep and selections."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.functions import text as T
from convolake.operators.base import sql_operator

#: What names a conversation.
ID = ["platform", "conversation_id"]

#: Identity of a message: its id, else its role and text.
KEY = "CASE WHEN message_id <> '' THEN 'id:' || message_id ELSE 'text:' || role || ':' || texte END"
#: Keys of old and new by place, and whether they agree from the start or from the end. A side that lacks a conversation has no rows.
_ALIGNED = f"""o AS (SELECT platform, conversation_id, {KEY} AS k, texte, row_number() OVER (PARTITION BY platform, conversation_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY platform, conversation_id) AS n FROM {{old}}),
    w AS (SELECT platform, conversation_id, {KEY} AS k, texte, row_number() OVER (PARTITION BY platform, conversation_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY platform, conversation_id) AS n FROM {{new}}),
    front AS (SELECT coalesce(o.platform, w.platform) AS platform, coalesce(o.conversation_id, w.conversation_id) AS conversation_id, max(o.n) AS old_n, max(w.n) AS new_n,
        count(CASE WHEN o.k = w.k THEN 1 END) AS same, count(CASE WHEN o.k = w.k AND o.texte = w.texte THEN 1 END) AS equal FROM o FULL OUTER JOIN w ON o.platform = w.platform AND o.conversation_id = w.conversation_id AND o.i = w.i
        GROUP BY coalesce(o.platform, w.platform), coalesce(o.conversation_id, w.conversation_id)),
    back AS (SELECT o.platform, o.conversation_id, count(CASE WHEN o.k = w.k THEN 1 END) AS same FROM o JOIN w ON o.platform = w.platform AND o.conversation_id = w.conversation_id AND o.n - o.i = w.n - w.i GROUP BY o.platform, o.conversation_id),
    told AS (SELECT f.platform, f.conversation_id, coalesce(f.old_n, 0) AS old_n, coalesce(f.new_n, 0) AS new_n,
        CASE WHEN f.old_n IS NULL THEN 'written' WHEN f.new_n IS NULL THEN 'absent' WHEN f.old_n = f.new_n AND f.equal = f.old_n THEN 'unchanged' WHEN f.new_n > f.old_n AND f.same = f.old_n THEN 'patched'
        WHEN f.new_n < f.old_n AND (f.same = f.new_n OR b.same = f.new_n) THEN 'kept' ELSE 'rewritten' END AS status FROM front f LEFT JOIN back b ON b.platform = f.platform AND b.conversation_id = f.conversation_id)"""
#: How each conversation merges, and how many messages it gains.
merge_status = sql_operator(f"WITH {_ALIGNED} SELECT platform, conversation_id, old_n, new_n, status, CASE status WHEN 'written' THEN new_n WHEN 'rewritten' THEN new_n WHEN 'patched' THEN new_n - old_n ELSE 0 END AS appended FROM told", "old", "new")
#: The merged messages: an archive never shrinks by a partial reading, and a continued one keeps its archived start.
merge_payload = sql_operator(
    f"""WITH {_ALIGNED} SELECT t.platform, t.conversation_id, t.status, o.i AS pos, o.k AS identity FROM told t JOIN o ON o.platform = t.platform AND o.conversation_id = t.conversation_id WHERE t.status IN ('unchanged', 'kept', 'absent', 'patched')
    UNION ALL SELECT t.platform, t.conversation_id, t.status, w.i, w.k FROM told t JOIN w ON w.platform = t.platform AND w.conversation_id = t.conversation_id WHERE t.status IN ('written', 'rewritten') OR t.status = 'patched' AND w.i > t.old_n""",
    "old",
    "new",
)
content_equal = sql_operator(f"WITH {_ALIGNED} SELECT platform, conversation_id, status = 'unchanged' AS equal FROM told", "old", "new")
#: Inventory after an ingest; where the archive was kept the counts are the archive's.
inventory_upsert = sql_operator(f"WITH {_ALIGNED} SELECT platform, conversation_id, CASE WHEN status IN ('kept', 'unchanged', 'absent') THEN old_n ELSE new_n END AS message_count, status <> 'absent' AS scraped FROM told", "old", "new")
#: Inventory in its written order.
inventory_order = sql_operator("SELECT platform, conversation_id, title, row_number() OVER (PARTITION BY platform ORDER BY last_message_at DESC, title DESC, conversation_id) AS place, count(*) OVER (PARTITION BY platform) AS n FROM {conv}", "conv")
#: Of entries with one id the last wins.
inventory_load = sql_operator("SELECT conversation_id, title, ord FROM (SELECT conversation_id, title, ord, row_number() OVER (PARTITION BY conversation_id ORDER BY ord DESC) AS k FROM {entries} WHERE conversation_id IS NOT NULL AND conversation_id <> '') t WHERE k = 1", "entries")
#: Conversations of an index are replaced whole; others stay, and an address is never lost.
replace_conversations = sql_operator(
    """SELECT platform, conversation_id, message_id, 'old' AS origin FROM {old} o WHERE NOT EXISTS (SELECT 1 FROM {new} n WHERE n.platform = o.platform AND n.conversation_id = o.conversation_id)
    UNION ALL SELECT platform, conversation_id, message_id, 'new' FROM {new}""",
    "old",
    "new",
)
#: Media without a message: linked to the message of a twin by content, of the same platform first, or deleted.
media_prune = sql_operator(
    """WITH linked AS (SELECT content_key, platform, message_id, media_id FROM {media} WHERE message_id IS NOT NULL),
    same AS (SELECT content_key, platform, min(media_id) AS twin FROM linked GROUP BY content_key, platform), anywhere AS (SELECT content_key, min(media_id) AS twin FROM linked GROUP BY content_key)
    SELECT m.media_id, CASE WHEN coalesce(s.twin, a.twin) IS NULL THEN 'delete' ELSE 'relink' END AS action, coalesce(s.twin, a.twin) AS twin
    FROM {media} m LEFT JOIN same s ON s.content_key = m.content_key AND s.platform = m.platform LEFT JOIN anywhere a ON a.content_key = m.content_key WHERE m.message_id IS NULL""",
    "media",
)
file_referenced = sql_operator("SELECT content_key, max(CASE WHEN message_id IS NOT NULL THEN 1 ELSE 0 END) = 1 AS referenced, count(*) AS n FROM {media} GROUP BY content_key", "media")
platforms = sql_operator("SELECT DISTINCT platform FROM {conv} ORDER BY platform", "conv")


def _first(rows: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__k = 1").drop("__k")


def inventory_refresh(inventory: DataFrame, refs: DataFrame) -> DataFrame:
    """Inventory (platform, conversation_id, title, last_message_at, scraped) after a listing refs (platform, conversation_id, title, last_message_at): unknown conversations come in (added); title and date change only while never scraped, and never to nothing."""
    i, r = inventory.alias("i"), refs.alias("r")
    own = lambda c: F.when(F.coalesce(F.col("i.scraped"), F.lit(False)), F.col(f"i.{c}")).otherwise(F.coalesce(F.nullif(F.col(f"r.{c}"), F.lit("")) if c == "title" else F.col(f"r.{c}"), F.col(f"i.{c}"))).alias(c)
    rows = i.join(r, [F.col(f"i.{c}") == F.col(f"r.{c}") for c in ID], "full")
    return rows.select(*(F.coalesce(f"i.{c}", f"r.{c}").alias(c) for c in ID), own("title"), own("last_message_at"), F.coalesce("i.scraped", F.lit(False)).alias("scraped"), F.col("i.conversation_id").isNull().alias("added"))


def delete_conversations(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """An index (messages, vectors or media) without the conversations gone (platform, conversation_id)."""
    return rows.join(gone.select(*ID), ID, "left_anti")


def purge_cascade(messages: DataFrame, media: DataFrame, gone: DataFrame) -> DataFrame:
    """What a purge of the conversations gone does: (what, action, n). Media whose content another conversation has as well are detached, others deleted."""
    gone = gone.select(*ID).distinct()
    both = media.join(gone.withColumn("__gone", F.lit(True)), ID, "left").withColumn("__gone", F.coalesce("__gone", F.lit(False)))
    stays = both.where(~F.col("__gone") & F.col("content_key").isNotNull()).select("content_key").distinct().withColumn("__stays", F.lit(True))
    told = both.where("__gone").join(stays, "content_key", "left").groupBy(F.when(F.col("__stays"), "detach").otherwise("delete").alias("action")).agg(F.count(F.lit(1)).alias("n"))
    counted = lambda rows, what: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), F.lit("delete").alias("action"), "n")
    return counted(messages.join(gone, ID, "left_semi"), "messages").unionByName(counted(gone, "conversations")).unionByName(told.select(F.lit("media").alias("what"), "action", "n"))


def media_dedupe(media: DataFrame, key: Column | str = "content_key", rank: Column | str = "media_id") -> DataFrame:
    """Ranked media once for each content, the first of them; media whose content can't be read (a null key) all stay."""
    keyed = media.withColumn("__key", F.col(key) if isinstance(key, str) else key)
    return keyed.withColumn("__k", F.row_number().over(Window.partitionBy("__key").orderBy(rank))).where("__k = 1 OR __key IS NULL").drop("__k", "__key")


def media_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Media after an ingest: one row for each media_id, the new one if there is any."""
    return old.join(new, "media_id", "left_anti").unionByName(new).dropDuplicates(["media_id"])


def gallery_page(media: DataFrame, kinds: list[str], offset: int, limit: int) -> DataFrame:
    """A page of the media of some kinds, newest first, with the total; a page beyond the end is empty."""
    rows = media.where(F.col("kind").isin(*kinds))
    return rows.orderBy(F.col("media_id").desc()).offset(offset).limit(limit).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))  # one row


def retention(files: DataFrame, keep: int) -> DataFrame:
    """Backups (stem, name) to remove: all but the newest keep of each stem, by name; one stays at least."""
    return files.withColumn("__k", F.row_number().over(Window.partitionBy("stem").orderBy(F.col("name").desc()))).where(F.col("__k") > max(1, keep)).drop("__k")


def daily_targets(inventory: DataFrame, recent: int) -> DataFrame:
    """What a daily run reads: never scraped, or among the recent newest of its platform; not what is unavailable."""
    at = F.row_number().over(Window.partitionBy("platform").orderBy(F.col("last_message_at").desc_nulls_last(), "conversation_id"))
    return inventory.withColumn("place", at).where((F.col("place") <= recent) | ~F.col("scraped")).where(~F.col("unavailable"))


def incremental_skip(conversations: DataFrame, indexed: DataFrame, stamp: str = "exported_at") -> DataFrame:
    """The conversations that an index must take in: those that it lacks, or has with another stamp."""
    return conversations.join(indexed.select(*ID, stamp), [*ID, stamp], "left_anti")


def seeded_sample(inventory: DataFrame, least: int, per_platform: int, seed: int) -> DataFrame:
    """Some conversations of each platform with at least so many messages, the same for the same seed."""
    told = F.md5(F.concat(F.col("conversation_id"), F.lit(f"-{seed}")))
    return inventory.where(F.col("message_count") >= least).withColumn("__k", F.row_number().over(Window.partitionBy("platform").orderBy(told, "conversation_id"))).where(F.col("__k") <= per_platform).drop("__k")


def union_first_wins(*passes: DataFrame) -> DataFrame:
    """Conversations of several passes of discovery, each as the first pass saw it, with that pass (from 1). A pass whose conversations are all known ends the discovery: later ones don't count."""
    every = reduce(DataFrame.unionByName, [p.withColumn("pass", F.lit(k)) for k, p in enumerate(passes, 1)])
    first = _first(every, ID, "pass")
    new = [r["pass"] for r in first.select("pass").distinct().collect()]  # at most one row for each pass
    last = next((k for k in range(1, len(passes) + 1) if k not in new), len(passes) + 1)
    return first.where(F.col("pass") < last)


def unknown_or_recent(inventory: DataFrame, since: str) -> DataFrame:
    """Conversations never scraped, or with a message since a time."""
    return inventory.where(~F.col("scraped") | (F.col("last_message_at") >= F.to_timestamp(F.lit(since))))


def lost(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of before that are not in after, once each."""
    return before.subtract(after.select(*before.columns))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, once each."""
    return a.intersect(b.select(*a.columns))


def url_backfill(conversations: DataFrame, known: str = "url") -> DataFrame:
    """Addresses that are missing or empty, from the template of the platform; known ones in their current form."""
    return conversations.withColumn("url", F.coalesce(T.current_url(F.nullif(F.col(known), F.lit(""))), T.conversation_url(F.col("platform"), F.col("conversation_id"))))


def legacy(old: DataFrame) -> DataFrame:
    """Messages of the old form (service, id, content, role, model) in the new: other names, and a model for assistants only."""
    return old.select(F.col("service").alias("platform"), F.col("id").alias("conversation_id"), F.coalesce("content", F.lit("")).alias("texte"), "role", F.when(F.col("role") == "assistant", F.col("model")).alias("model"))


def legacy_union(disk: DataFrame, state: DataFrame) -> DataFrame:
    """Conversations of the files and of the state, each once; what is on disk wins."""
    return _first(disk.withColumns({"origin": F.lit("disk"), "__rank": F.lit(1)}).unionByName(state.withColumns({"origin": F.lit("state"), "__rank": F.lit(2)})), ID, "__rank").drop("__rank")


def metadata_fallback(new: DataFrame, old: DataFrame, fields: tuple[str, ...] = ("ts", "model", "message_id")) -> DataFrame:
    """A new parse with what it lacks of the archived one: of the archived message of the same message_id, or else of the one at the same place. matched says which: id, place or none.

    Of archived messages that repeat an id the last one counts. Fields that are null or empty in the new parse are filled, others stay.
    """
    empty = lambda c: c.isNull() | (c.cast("string") == "")
    ids = old.where(~empty(F.col("message_id"))).groupBy(*ID, "message_id").agg(F.max_by(F.struct(*fields), "pos").alias("by_id"))
    places = old.groupBy(*ID, "pos").agg(F.first(F.struct(*fields)).alias("by_place"))
    rows = new.join(ids, [*ID, "message_id"], "left").join(places, [*ID, "pos"], "left")
    ref = F.coalesce("by_id", "by_place")
    filled = {c: F.when(empty(F.col(c)), F.coalesce(ref.getField(c), F.col(c))).otherwise(F.col(c)) for c in fields}
    matched = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_place").isNotNull(), "place").otherwise("none")
    return rows.withColumn("matched", matched).withColumns(filled).select(*new.columns, "matched")


def list_conversations(inventory: DataFrame, limit: int) -> DataFrame:
    """The newest conversations; a limit of 0 is none."""
    rows = inventory.orderBy(F.col("last_message_at").desc_nulls_last(), "conversation_id")
    return rows.limit(limit) if limit else rows


def list_by_messages(inventory: DataFrame, limit: int) -> DataFrame:
    """The conversations of most messages, and whether there are more than the limit; a limit of 0 is none."""
    rows = inventory.orderBy(F.col("message_count").desc_nulls_last(), "conversation_id")
    rows = rows.limit(limit) if limit else rows
    return rows.crossJoin(F.broadcast(inventory.agg((F.count(F.lit(1)) > (limit or float("inf"))).alias("truncated"))))  # one row


def unique_names(inventory: DataFrame) -> DataFrame:
    """Names of files by title: the slug, for others of the same slug with the first 8 characters of the id, and for others of that with the place among them."""
    rows = inventory.withColumn("__base", T.slug(F.col("title")))
    rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy("platform", "__base").orderBy("conversation_id")))
    rows = rows.withColumn("__name", F.when(F.col("__k") == 1, F.col("__base")).otherwise(F.concat("__base", F.lit("-"), T.safe_id(F.substring("conversation_id", 1, 8)))))
    rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy("platform", "__name").orderBy("conversation_id")))
    return rows.withColumn("name", F.when(F.col("__k") == 1, F.col("__name")).otherwise(F.concat_ws("-", "__name", F.col("__k").cast("string")))).drop("__base", "__k", "__name")


def retry_unavailable(inventory: DataFrame) -> DataFrame:
    """Inventory in which nothing is unavailable any more; reset says what was."""
    return inventory.withColumn("reset", F.coalesce("unavailable", F.lit(False))).withColumn("unavailable", F.lit(False))


def backups(files: DataFrame, prefix: str) -> DataFrame:
    """Backups (name) of a stem, the newest first by name."""
    return files.where(F.col("name").startswith(prefix)).orderBy(F.col("name").desc())


def frozen(messages: DataFrame, canaries: DataFrame, make: Callable[[Column], Column]) -> DataFrame:
    """A copy of the canaries' messages for fixtures, with their texts as make makes them: what is personal replaced."""
    return messages.join(canaries.select(*ID).distinct(), ID, "left_semi").withColumn("texte", make(F.col("texte")))
