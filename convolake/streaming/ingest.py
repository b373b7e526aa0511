"""What one reading of conversations leaves behind: the merged messages, their artefacts, the inventory and a summary, all of one batch or none.

Each is a table of store, and they share a log, so a batch that broke off between two of them is as if it had not been; it runs again from the state before it. Messages merge as archives do: a partial reading never shrinks a
conversation. Artefacts (the page as shown, or the payload as sent, which are told apart by which is there) replace those of before, but for a conversation whose archive was kept, as they are what it is parsed from again; a
reading with a payload and no page takes an older page away. The inventory has the archive's counts, and the last title that isn't empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from convolake.operators import archive
from convolake.streaming.incremental import merged_messages
from convolake.streaming.store import KEYS, Log, Store

MESSAGE = "platform string, conversation_id string, pos int, message_id string, role string, texte string"


class Ingest:
    """The outputs under path."""

    def __init__(self, spark: SparkSession, path: str, **settings):
        self.log = Log(spark, f"{path}/log")
        self.messages, self.artefacts, self.inventory = (Store(f"{path}/{name}", self.log, **settings) for name in ("messages", "artefacts", "inventory"))

    def step(self, readings: DataFrame, number: int) -> dict[str, int]:
        """One batch of readings (platform, conversation_id, title, exported_at, html, payload, messages: array of pos, message_id, role, texte), of a conversation the last by exported_at. Returns how many conversations had which status."""
        spark = readings.sparkSession
        last = readings.groupBy(*KEYS).agg(F.max_by(F.struct("title", "exported_at", "html", "payload", "messages"), F.coalesce("exported_at", F.lit(""))).alias("x")).select(*KEYS, "x.*").cache()
        try:
            new = last.select(*KEYS, F.explode("messages").alias("m")).select(*KEYS, *(F.col(f"m.{c}").alias(c) for c in ("pos", "message_id", "role", "texte")))
            old = self.messages.write(new, number, lambda a, b: merged_messages(a, b).select(*new.columns))
            status = archive.merge_status(old if old is not None else spark.createDataFrame([], MESSAGE), new).where("status <> 'absent'").select(*KEYS, "status", F.when(F.col("status").isin("kept", "unchanged"), F.col("old_n")).otherwise(F.col("new_n")).alias("message_count"), "appended").cache()
            told = last.join(status, KEYS)
            shown = told.where("status <> 'kept' AND (html IS NOT NULL OR payload IS NOT NULL)")
            made = shown.select(*KEYS, F.when(F.col("html").isNotNull(), "html").otherwise("raw").alias("kind"), F.coalesce("html", "payload").alias("content"), "exported_at")
            self.artefacts.write(made, number, _replaced)
            listed = told.select(*KEYS, "title", "message_count", "status", F.when(F.col("status").isin("kept", "unchanged"), F.lit(None).cast("string")).otherwise(F.col("exported_at")).alias("written_at"))
            self.inventory.write(listed, number, _listed)
            counts = {r.status: r["count"] for r in status.groupBy("status").count().collect()}  # at most five
            status.unpersist()
        finally:
            last.unpersist()
        self.log.commit(number, counts)
        return counts

    def follow(self, readings: DataFrame, checkpoint: str) -> StreamingQuery:
        """Takes each micro-batch of a stream of readings."""
        return readings.writeStream.foreachBatch(lambda batch, number: self.step(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def ordered_inventory(self) -> DataFrame | None:
        """The inventory with each entry's place in its platform's list."""
        rows = self.inventory.read()
        return None if rows is None else rows.join(archive.inventory_order(rows.withColumn("last_message_at", F.col("written_at"))).select("platform", "conversation_id", "place", "n"), KEYS)


def _replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """New artefacts in place of those of their conversations."""
    return old.join(new.select(*KEYS), KEYS, "left_anti").unionByName(new)


def _listed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with what the batch says of them; a title or a time that it doesn't have stays."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in KEYS], "full_outer")
    title = F.coalesce(F.nullif(F.col("b.title"), F.lit("")), F.nullif(F.col("a.title"), F.lit("")), F.lit(""))
    return both.select(*(F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in KEYS), title.alias("title"), F.coalesce("b.message_count", "a.message_count").alias("message_count"), F.coalesce("b.status", "a.status").alias("status"), F.coalesce("b.written_at", "a.written_at").alias("written_at"))


def run_summary(discovered: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per platform of a run: discovered, targets, exported, patched, unchanged, failed, skipped. discovered: (platform, conversation_id, unavailable); outcomes: (platform, conversation_id, status of the merge, or failed or skipped) of those that were tried."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    met = discovered.join(outcomes.select(*KEYS, "status"), KEYS, "left")
    return met.groupBy("platform").agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("status").isNotNull() & (F.col("status") != "skipped")).alias("targets"), of("written", "patched", "rewritten").alias("exported"), of("patched").alias("patched"),
        of("unchanged", "kept").alias("unchanged"), of("failed").alias("failed"), (of("skipped") + F.count_if(F.col("status").isNull() & F.coalesce("unavailable", F.lit(False)))).alias("skipped"),
    )
