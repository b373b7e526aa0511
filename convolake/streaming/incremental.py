"""Archives and indexes that grow by micro-batches, and health counts over a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from convolake.functions import text as T
from convolake.operators import archive
from convolake.streaming.store import Log, Store

KEYS = ["platform", "conversation_id"]


def merged_messages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Messages of the archive after a reading: per conversation the old ones, the new ones, or the old ones and those that the new reading adds. A partial reading never shrinks a conversation."""
    status = archive.merge_status(old, new).select(*KEYS, "status", "old_n")
    keep = old.join(status.where("status IN ('unchanged', 'kept', 'absent', 'patched')").select(*KEYS), KEYS, "left_semi")
    come = new.join(status.where("status IN ('written', 'rewritten', 'patched')"), KEYS).where("status <> 'patched' OR pos >= old_n").select(*old.columns)
    return keep.unionByName(come)


def archive_store(spark: SparkSession, path: str, **settings) -> Store:
    """The table that follow_archive() writes."""
    return Store(f"{path}/messages", Log(spark, f"{path}/log"), **settings)


def read_archive(spark: SparkSession, path: str, schema: StructType | None = None, before: int | None = None) -> DataFrame:
    """The archive that follow_archive() has written (before a batch); empty if there is none yet and a schema is given."""
    rows = archive_store(spark, path).read(before)
    if rows is None and schema is None:
        raise ValueError(f"no archive at {path}")
    return spark.createDataFrame([], schema) if rows is None else rows


def follow_archive(readings: DataFrame, path: str, checkpoint: str, **settings) -> StreamingQuery:
    """Merges each micro-batch of messages into the table at path: only buckets of conversations that the batch touches are read and written. A batch that is run again starts from what was there before it."""

    def step(batch: DataFrame, number: int) -> None:
        store = archive_store(batch.sparkSession, path, **settings)
        store.write(batch, number, merged_messages)
        store.log.commit(number)

    return readings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_step(messages: DataFrame, state: DataFrame, index: DataFrame, encode: Callable[[DataFrame], DataFrame], model: str) -> tuple[DataFrame, DataFrame]:
    """(index, encoded) after new exports: conversations of an unchanged exported_at are skipped, empty texts dropped, known texts take their vector from the index, and only the others are encoded.

    messages have exported_at and texte; index has KEYS, message_id, fingerprint and embedding; encode adds embedding to (fingerprint, texte)."""
    changed = messages.where("exported_at <> ''").join(state.select(*KEYS, "exported_at"), [*KEYS, "exported_at"], "left_anti").unionByName(messages.where("coalesce(exported_at, '') = ''"))
    rows = changed.where(T.strip(F.col("texte")) != "").withColumn("fingerprint", T.fingerprint(model, F.col("texte")))
    cache = index.groupBy("fingerprint").agg(F.min_by("embedding", "message_id").alias("embedding"))
    known = rows.join(cache, "fingerprint")
    fresh = encode(rows.join(cache, "fingerprint", "left_anti").select("fingerprint", "texte").dropDuplicates(["fingerprint"])).select("fingerprint", "embedding")
    made = known.unionByName(rows.join(fresh, "fingerprint"), allowMissingColumns=True).select(*index.columns)
    return index.join(made.select(*KEYS).distinct(), KEYS, "left_anti").unionByName(made), fresh


def hashing_encoder(rows: DataFrame, size: int = 64) -> DataFrame:
    """Vectors of unit length from hashed words: a stand-in for a model, in Spark's own functions."""
    words = F.transform(T.tokens(F.col("texte"), 1), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter("words", lambda w: w == i)).cast("float"))
    rows = rows.withColumn("words", words).withColumn("raw", counts)
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return rows.withColumn("embedding", F.transform("raw", lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)).cast("float"))).drop("words", "raw")


def follow_health(scores: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Counts of matches, drifts and breaks by service over a stream of scores, in a memory table."""
    level = lambda low, high: F.count_if((F.col("score") >= low) & (F.col("score") < high))
    rows = scores.groupBy("service").agg(F.count(F.lit(1)).alias("n"), level(95, 1e9).alias("matches"), level(80, 95).alias("drifts"), level(-1e9, 80).alias("breaks"), F.min("score").alias("least"))
    return rows.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_days(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by day and kind, closed once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of a folder as they come, one a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
