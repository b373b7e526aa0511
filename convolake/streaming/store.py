"""Tables of conversations that grow by batches, several of which may become visible at once.

A table's rows lie in buckets of conversations: a bucket has the rows whose hash ends in its prefix of depth bits. A batch reads and writes the buckets that it touches and no others, each to a folder
that has never been written before; a bucket that has become too large is parted by one or more further bits, so that buckets stay of one size however the table grows. What a batch has done to the buckets
is a small table of its own, of one file; the batches that count are named by files in a log that tables share. So nothing of a batch is seen before its file is there: a batch that broke off between two tables, or runs again, starts from what
was there before it, and takes the place of its first run. Files that no batch within reach refers to are removed by vacuum().

Rows with a null key are a conversation of their own. An empty batch writes nothing. Extra columns of a batch are kept as they are, as a table has the columns of its first batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.scratch import released, saved

KEYS = ["platform", "conversation_id"]
#: Most bits of a bucket's prefix.
DEEPEST = 40
_CHANGES = "depth int, prefix long, folder string, rows long, size long, gone boolean"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder; nothing if there is none."""
    fs, at = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def _remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def _power(bits: Column) -> Column:
    """2 to the power of bits."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits)


class Log:
    """The batches that count, each with what it did as counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def batches(self) -> list[int]:
        return sorted(int(n) for n in _names(self.spark, self.path) if n.isdigit())

    def commit(self, batch: int, counts: dict[str, int] | None = None) -> None:
        """Makes a batch count: its file comes to be whole or not at all."""
        fs, to = _fs(self.spark, f"{self.path}/{batch}")
        _, draft = _fs(self.spark, f"{self.path}/_{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(counts or {}).encode()))
        out.close()
        if fs.exists(to):
            fs.delete(to, False)
        fs.rename(draft, to)

    def counts(self, batch: int) -> dict[str, int]:
        return json.loads(self.spark.read.text(f"{self.path}/{batch}", wholetext=True).first()[0])


class Store:
    """A table under path, which counts by a log. size: bytes of a bucket's rows, as text, above which it is parted."""

    def __init__(self, path: str, log: Log, size: int = 64 << 20, keys: list[str] | None = None):
        self.path, self.log, self.spark, self.size, self.keys = path.rstrip("/"), log, log.spark, size, keys or KEYS

    def _hash(self) -> Column:
        return F.xxhash64(*self.keys)

    def buckets(self, before: int | None = None) -> DataFrame:
        """The buckets that hold the table (before a batch): depth, prefix, folder, rows, size. A bucket without rows has no folder."""
        known = {int(n.removeprefix("batch=")) for n in _names(self.spark, f"{self.path}/changes") if n.startswith("batch=")}
        counts = sorted(b for b in self.log.batches() if b in known and (before is None or b < before))
        if not counts:
            return self.spark.createDataFrame([], _CHANGES).drop("gone")
        rows = self.spark.read.schema(_CHANGES).parquet(*(f"{self.path}/changes/batch={b}" for b in counts)).withColumn("batch", F.regexp_extract(F.input_file_name(), r"/batch=(\d+)/", 1).cast("long"))
        last = rows.groupBy("depth", "prefix").agg(F.max_by(F.struct("folder", "rows", "size", "gone"), "batch").alias("x"))
        return last.where("NOT x.gone").select("depth", "prefix", "x.folder", "x.rows", "x.size")

    def _placed(self, rows: DataFrame, buckets: DataFrame) -> DataFrame:
        """rows with the bucket (depth, prefix) that is theirs: one try for each depth that there is."""
        depths = [r.depth for r in buckets.select("depth").distinct().collect()] or [0]  # at most DEEPEST
        tried = rows.withColumn("depth", F.explode(F.array(*(F.lit(d) for d in depths)))).withColumn("prefix", F.pmod(self._hash(), _power(F.col("depth"))))
        return tried.join(buckets.select("depth", "prefix"), ["depth", "prefix"], "left_semi") if depths != [0] else tried

    def read(self, before: int | None = None) -> DataFrame | None:
        """The table (before a batch), or None if no batch has made it yet."""
        live = self.buckets(before).where("folder IS NOT NULL")
        if not _names(self.spark, f"{self.path}/rows") or live.isEmpty():
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        return rows.join(live.select(F.col("folder").alias("run"), F.concat_ws("-", "depth", "prefix").alias("bucket")), ["run", "bucket"], "left_semi").drop("run", "bucket")

    def write(self, batch: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame | None:
        """Writes the buckets that a batch touches anew, as merge(their rows, the batch) has them; it counts when the log has number. Returns the rows of those buckets from before; None if there were none or the batch is empty."""
        if batch.isEmpty():
            _remove(self.spark, f"{self.path}/changes/batch={number}")
            return None
        with released(self.spark):
            return self._write(batch, number, merge)

    def _write(self, batch: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame | None:
        before = self.buckets(number).cache()
        try:
            keys = batch.select(*self.keys).distinct()
            touched = self._placed(keys, before).select("depth", "prefix").distinct()
            touched = touched.join(before, ["depth", "prefix"], "left").select("depth", "prefix", "folder").collect()  # as many as the batch has conversations at most
        finally:
            before.unpersist()
        folders = [f"{self.path}/rows/run={r.folder}/bucket={r.depth}-{r.prefix}" for r in touched if r.folder]
        old = self.spark.read.parquet(*folders) if folders else None
        rows = merge(old if old is not None else batch.limit(0), batch)
        run, columns = uuid.uuid4().hex, rows.columns
        had = self.spark.createDataFrame([(r.depth, r.prefix) for r in touched], "depth int, prefix long")
        at = F.broadcast(had)  # rows of the touched buckets only, which are as many as the batch touches
        placed = self._placed(rows, had) if any(r.depth for r in touched) else rows.withColumns({"depth": F.lit(0), "prefix": F.lit(0).cast("long")})
        placed = saved(placed, "store-rows")  # it is read for the sizes, and again for the rows
        own = placed.groupBy("depth", "prefix", *self.keys).agg(F.sum(F.length(F.to_json(F.struct(*columns)))).alias("size"), F.count(F.lit(1)).alias("rows")).withColumn("h", self._hash())
        sizes = own.groupBy("depth", "prefix").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        bits = F.ceil(F.log2(F.least(F.col("size") / self.size, F.col("n").cast("double")))).cast("int")
        deeper = sizes.select("depth", "prefix", F.least(F.col("depth") + F.greatest(bits, F.lit(0)), F.lit(DEEPEST)).alias("to")).join(at, ["depth", "prefix"], "right").select("depth", "prefix", F.coalesce("to", "depth").alias("to"))
        deeper = self.spark.createDataFrame(deeper.collect(), "depth int, prefix long, to int")  # a row for each touched bucket
        final = placed.join(F.broadcast(deeper), ["depth", "prefix"]).withColumn("prefix", F.pmod(self._hash(), _power(F.col("to")))).withColumn("bucket", F.concat_ws("-", "to", "prefix"))
        final.select(*columns, "bucket").repartition(F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/rows/run={run}")
        told = own.join(F.broadcast(deeper), ["depth", "prefix"]).groupBy(F.col("to").alias("depth"), F.pmod("h", _power(F.col("to"))).alias("prefix")).agg(F.sum("rows").alias("rows"), F.sum("size").alias("size"))
        children = F.transform(F.sequence(F.lit(0).cast("long"), _power(F.col("to") - F.col("depth")) - 1), lambda k: F.col("prefix") + k * _power(F.col("depth")))
        every = deeper.select("to", F.explode(children).alias("child")).select(F.col("to").alias("depth"), F.col("child").alias("prefix"))
        changes = every.join(told, ["depth", "prefix"], "left").select("depth", "prefix", F.when(F.col("rows").isNotNull(), F.lit(run)).alias("folder"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("size", F.lit(0)).alias("size"), F.lit(False).alias("gone"))
        parted = deeper.where("to > depth").select("depth", "prefix", F.lit(None).cast("string").alias("folder"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("gone"))
        changes.unionByName(parted).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/changes/batch={number}")
        return old

    def vacuum(self, keep: int = 1) -> int:
        """Makes one table of changes of all but the last keep batches, and removes what no reading from there on can refer to, files of broken batches too. Returns how many folders of buckets went. It must not run beside a batch."""
        counts = self.log.batches()
        if not counts:
            return 0
        cut = counts[-keep] if keep <= len(counts) else counts[0]
        merged = self.buckets(cut + 1).withColumn("gone", F.lit(False))
        rows = merged.collect() if cut != counts[0] or len(counts) == 1 else None  # a row for each bucket
        later = [b for b in counts if b > cut]
        held = {(r.folder, f"bucket={r.depth}-{r.prefix}") for b in (None, *later) for r in self.buckets(b).where("folder IS NOT NULL").collect()} | {(r.folder, f"bucket={r.depth}-{r.prefix}") for r in (rows or merged.collect()) if r.folder}
        if rows is not None:
            self.spark.createDataFrame(rows, _CHANGES).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/changes/batch={cut}")
        for n in _names(self.spark, f"{self.path}/changes"):
            if n.startswith("batch=") and (int(n[6:]) < cut or int(n[6:]) not in counts):
                _remove(self.spark, f"{self.path}/changes/{n}")
        gone = 0
        for run in _names(self.spark, f"{self.path}/rows"):
            own = [n for n in _names(self.spark, f"{self.path}/rows/{run}") if n.startswith("bucket=")]
            dead = [n for n in own if (run.removeprefix("run="), n) not in held]
            for n in dead:
                _remove(self.spark, f"{self.path}/rows/{run}/{n}")
            gone += len(dead)
            if len(dead) == len(own):
                _remove(self.spark, f"{self.path}/rows/{run}")
        return gone
