"""Exact duplicates by a log-structured merge index of text digests, in DataFrame operations only.

Level 0: each task is a memtable. It holds the digests of its documents, sorts them and flushes sorted runs as Parquet files. Compaction merges the runs of level 0 into level 1,
one row for each digest with the smallest identifier. A later batch that meets a level 1 has a filter of its digests: what of level 1 the filter excludes is passed on as
it is, and only the rest is shuffled and merged. A digest of two or more documents is a hit; hits are then compared byte by byte. The comparison reads the texts once more and keeps only those whose digest passes a bitmap filter of the hits,
so that texts without a copy are never shuffled; copies meet in the map-side aggregation, so that a large group sends one text from each task.

Null texts count as empty, and all empty texts are one group. Rows that repeat a doc_id are rows of their own; of several with the smallest doc_id one
stays. A null doc_id stays only if its group has no other. An empty table gives an empty result. Columns but the two named are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.llm.common import SPACE_CLASS, KeyFilter, bitmap_filter, row_key, saved, spread_join, texts


def normalised(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, SPACE_CLASS + "+", " ")


class DigestIndex:
    """Sorted digest runs over (doc_id, text) tables.

    memtable_rows: most rows of one run. digest_bytes: bytes of the SHA-256 that the index compares; fewer than 32 only to test collisions.
    max_filter_bits: bound of a filter that is broadcast; beyond it the filter lets more rows through, and the result stays the same.
    """

    def __init__(self, memtable_rows: int = 1_000_000, digest_bytes: int = 32, max_filter_bits: int = 1 << 28):
        self.memtable_rows, self.digest_bytes, self.max_filter_bits = memtable_rows, digest_bytes, max_filter_bits
        self.runs: list[DataFrame] = []  # of all batches
        self.level0: list[DataFrame] = []  # those that are not yet in level 1
        self.merged: DataFrame | None = None

    def _digest(self, sha: Column) -> Column:
        return F.substring(sha, 1, self.digest_bytes)

    def _options(self) -> dict[str, str]:
        return {"maxRecordsPerFile": str(self.memtable_rows)}

    def flush(self, docs: DataFrame) -> None:
        """Writes the digests of docs as sorted runs of level 0; (run, seq) tells rows of one doc_id apart."""
        rows = docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("sha"), F.lit(len(self.runs)).alias("run"), row_key("doc_id", "text").alias("row_key"), F.monotonically_increasing_id().alias("seq"))
        rows = rows.withColumn("digest", self._digest(F.col("sha"))).sortWithinPartitions("digest")
        self.runs.append(saved(rows, "dedup-run", **self._options()))
        self.level0.append(self.runs[-1])

    def compact(self) -> None:
        """Merges level 0 into level 1: of each digest the smallest identifier and the number of rows."""
        if not self.level0:
            return
        rows = reduce(DataFrame.unionByName, self.level0).select("digest", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "run", "seq").alias("first"), F.lit(1).cast("long").alias("n"))
        apart = None
        if self.merged is not None:
            told = KeyFilter(rows, "digest", self.max_filter_bits, keep=True).flag(self.merged, "digest", "__may")
            apart = told.where("NOT __may").drop("__may")
            rows = rows.unionByName(told.where("__may").drop("__may"))
        merged = rows.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n")).sortWithinPartitions("digest")
        self.merged = saved(merged if apart is None else merged.unionByName(apart), "dedup-level1", **self._options())
        self.level0 = []

    def all_runs(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.runs)

    def hits(self) -> DataFrame:
        return self.merged.where("n > 1")

    def _passing(self, docs: DataFrame) -> DataFrame:
        """(digest, text as normalised, doc_id, row_key) of all documents that may be hits."""
        rows = docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), normalised(F.col("text")).alias("norm")).withColumn("digest", self._digest(F.unhex(F.sha2("norm", 256))))
        return bitmap_filter(rows, self.hits(), "digest", self.max_filter_bits)

    def collisions(self, docs: DataFrame) -> DataFrame:
        """The byte verification: digests under which different texts meet."""
        distinct = self._passing(docs).groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))
        return distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")

    def resolve(self, docs: DataFrame) -> DataFrame:
        """One row for each row of docs, which must be what was flushed: doc_id, keep_id, group_size, kept, text_sha256, row_key."""
        rows, total = self.all_runs(), self.all_runs().count()
        collided = saved(self.collisions(docs), "dedup-collisions")
        some = not collided.isEmpty()
        if some:
            rows = rows.join(collided, "digest", "left_anti")
        met = spread_join(rows, self.hits().select("digest", "first", "n"), "digest", "n", total, "left")
        out = met.select(
            "doc_id",
            F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce((F.col("first.seq") == F.col("seq")) & (F.col("first.run") == F.col("run")), F.lit(True)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
            "row_key",
        )
        return out.unionByName(self._by_text(docs, collided)) if some else out

    def _by_text(self, docs: DataFrame, collided: DataFrame) -> DataFrame:
        """The rows of digests that collide, grouped by the text itself."""
        rows = self._passing(docs).join(collided, "digest", "left_semi")
        same = Window.partitionBy("norm")
        first = F.row_number().over(same.orderBy(F.col("doc_id").asc_nulls_last()))
        return rows.select("doc_id", F.min("doc_id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size"), (first == 1).alias("kept"), F.sha2("norm", 256).alias("text_sha256"), "row_key")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """For each document the one that stays of its group of equal texts: doc_id, keep_id, group_size, kept, text_sha256, row_key."""
    rows = texts(docs, id_col, text_col)
    index = DigestIndex(**settings)
    index.flush(rows)
    index.compact()
    return index.resolve(rows)
