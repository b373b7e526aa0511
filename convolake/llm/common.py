"""What the corpus operators share: written intermediate tables, column choice, word splitting."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.scratch import released, saved, scratch

__all__ = ["released", "saved", "scratch"]

#: White space of the contracts: space and the bytes 9 to 13. A fixed value.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a character class for Java's expressions.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: A key with more than this share of the rows is hot; there are at most 1 / HOT_SHARE hot keys, so that they can be broadcast.
HOT_SHARE = 1 / 2000
#: Bits of one bitmap_construct_agg bucket. A fixed value of Spark's function.
BUCKET_BITS = 32768

def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session has them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Most bytes of texts that Spark hands to a Python worker at once; a longer text is handed over alone.
BATCH_BYTES = 8 << 20


#: What a session has if nobody has set the bytes of an Arrow batch: no bound. A fixed value of Spark.
_UNSET = ("9223372036854775807b", str((1 << 63) - 1), None)


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES, as ten thousand texts may be any size. Plans read the setting when they run, after the operator has returned, so it stays; one that the user has made is left as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in _UNSET:
        spark.conf.set(key, str(BATCH_BYTES))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): no other column of the input can clash with those of an operator. A null text becomes empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def mixed(*cols: Column | str) -> Column:
    """A 64-bit hash by which rows are dealt out or ordered."""
    return F.xxhash64(*cols)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_join(many: DataFrame, one: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """many joined to one, which has a row for each key and, in count, how many rows of many have it. Hot keys join by broadcast, so that none lands in one task."""
    hot = F.broadcast(one.where(F.col(count) > max(1000, int(total * HOT_SHARE))))
    rest = many.join(hot.select(key), key, "left_anti").join(one, key, how)
    return many.join(hot, key).select(*rest.columns).unionByName(rest)


class KeyFilter:
    """Which keys may be in a table: a bitmap of 16 bits or more for each key, up to max_bits, which is what is broadcast. No key of the table is missed; others may be taken for one, more of them if the bound is met. keep: it is written, to be read more than once."""

    def __init__(self, keys: DataFrame, key: str, max_bits: int = 1 << 28, keep: bool = False):
        self.bits = min(max_bits, max(1 << 20, 1 << (16 * keys.count()).bit_length()))
        bucket, bit = self._place(key)
        self.table = keys.select(bucket, bit).groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
        if keep:
            self.table = saved(self.table, "key-filter")

    def _place(self, key: str) -> tuple[Column, Column]:
        slot = F.pmod(F.xxhash64(key), F.lit(self.bits)) + F.lit(1)
        return F.bitmap_bucket_number(slot).alias("__bucket"), F.bitmap_bit_position(slot).alias("__bit")

    def flag(self, rows: DataFrame, key: str, flag: str) -> DataFrame:
        """rows with whether their key may be in the table."""
        bucket, bit = self._place(key)
        rows = rows.withColumns({"__bucket": bucket, "__bit": bit}).join(F.broadcast(self.table), "__bucket", "left")
        byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return rows.withColumn(flag, F.coalesce(F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1, F.lit(False))).drop("__bucket", "__bit", "__bits")


def bitmap_flag(rows: DataFrame, keys: DataFrame, key: str, flag: str, max_bits: int = 1 << 28) -> DataFrame:
    """rows with whether their key may be in keys, by a KeyFilter."""
    return KeyFilter(keys, key, max_bits).flag(rows, key, flag)


def bitmap_filter(rows: DataFrame, keys: DataFrame, key: str, max_bits: int = 1 << 28) -> DataFrame:
    """The rows whose key may be in keys."""
    return bitmap_flag(rows, keys, key, "__may", max_bits).where("__may").drop("__may")


def row_key(id_col: Column | str, text_col: Column | str) -> Column:
    """Tells rows apart that repeat a doc_id with another text: 128 bits, as rows are dropped by it."""
    return F.struct(F.xxhash64(id_col, text_col).alias("a"), F.xxhash64(F.lit(1), text_col, id_col).alias("b"))


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs by decided (row_key, kept), one row for each of docs. Of rows that are the same in both columns as many as kept says, one, stay. Only rows that may be dropped are shuffled."""
    odd = decided.groupBy("row_key").agg(F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__n")).where("NOT __kept OR __n > 1")
    odd = saved(odd.withColumnRenamed("row_key", "__key"), "dropped")
    keyed = docs.withColumn("__key", row_key(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    told = bitmap_flag(keyed, odd.select("__key"), "__key", "__may")
    rest = told.where("__may").join(odd, "__key", "left_anti")
    one = told.where("__may").join(odd.where("__kept").select("__key"), "__key", "left_semi").dropDuplicates(["__key"])
    return told.where("NOT __may").select(*docs.columns).unionByName(rest.select(*docs.columns)).unionByName(one.select(*docs.columns))


def blocks(values: list[str], size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Stretches (begin, end) of a batch of about so many characters; a longer text is one by itself."""
    begin, n = 0, 0
    for k, t in enumerate(values):
        n += len(t)
        if n >= size:
            yield begin, k + 1
            begin, n = k + 1, 0
    if begin < len(values):
        yield begin, len(values)


def without_collector(run):
    """A batch function whose large tables hold no cycles: the collector would walk them again and again. It is on again for the worker's next task."""

    def quiet(batches):
        import gc

        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return quiet
