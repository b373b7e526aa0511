"""Benchmark items inside documents, by a containment search over size-partitioned MinHash sketches.

Containment of an item is the share of its distinct shingles that a document has anywhere. Items are parted by size, in powers of two. A part's sketches hold so many of an
item's smallest hash values that an item above the threshold meets a document: under threshold t, n - ceil(t n) shingles may be missing, so one more than
these is sure to meet, and for larger items so few values as miss all with a probability of at most miss. A document is not sketched, as a short item in a
long text would vanish: its shingles are looked up in the sketches of those parts whose items it is large enough to hold. Items that meet a document are verified by their
whole shingle sets, and those by the words themselves.

A benchmark of at most held_shingles is held by each task, and documents are read once. A larger one is never held: one reading of the documents gives the values that pass a
bitmap of all sketches, a join by value with the sketches gives the pairs that meet, and only texts of such pairs are read again and verified.
Items or documents without words match nothing; an item of fewer words than a shingle has one shingle of all its words. Null texts count as empty. Rows that
repeat, of either table, give rows that repeat. Null identifiers stay null; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from convolake.llm.common import BUCKET_BITS, bitmap_filter, bitmap_flag, row_key, saved, small_batches, texts
from convolake.llm.shingles import shingle_numbers, shingle_set, word_numbers, words


def sketch_size(n: int, threshold: float, miss: float) -> int:
    """Values of the sketch of an item of n shingles."""
    sure = n - math.ceil(threshold * n - 1e-9) + 1
    return min(sure, math.ceil(math.log(miss) / math.log(1 - threshold))) if threshold < 1 else 1


def part_of(n: int) -> int:
    """The part of items of n shingles."""
    return n.bit_length()


def least_size(part: int, threshold: float) -> int:
    """Distinct shingles that a document must have to hold an item of the part."""
    return math.ceil(threshold * (1 << (part - 1)) - 1e-9)


class Items:
    """Items by part: their sketches, to be met by shingles of documents, and their sets."""

    def __init__(self, items: list[str], size: int, threshold: float, miss: float):
        self.size, self.threshold = size, threshold
        self.words = [words(t) for t in items]
        self.sets = [shingle_set(word_numbers(w), size) for w in self.words]
        parts: dict[int, dict[int, list[int]]] = {}  # by words of a shingle and by part
        for k, (w, s) in enumerate(zip(self.words, self.sets, strict=True)):
            if len(s):
                parts.setdefault(min(size, len(w)), {}).setdefault(part_of(len(s)), []).append(k)
        self.tables: dict[int, tuple[np.ndarray, list]] = {}  # by words of a shingle: a coarse bitmap of all parts; of each its least size, the values, their items
        for length, by_part in parts.items():
            coarse, tables = np.zeros(1 << 20, bool), []
            for part, of in sorted(by_part.items()):
                pairs = sorted((v, k) for k in of for v in self.sets[k][: sketch_size(len(self.sets[k]), threshold, miss)].tolist())
                values = np.array([v for v, _ in pairs], np.uint64)
                coarse[values & np.uint64(0xFFFFF)] = True
                tables.append((least_size(part, threshold), values, np.array([k for _, k in pairs])))
            self.tables[length] = coarse, tables

    def found(self, text: str) -> list[tuple[int, int, int]]:
        """(item, its shingles, those of them in the text) of the items above the threshold."""
        said = words(text)
        numbers = word_numbers(said)
        out = []
        for length, (coarse, parts) in self.tables.items():
            met = shingle_numbers(numbers, length)
            near = met[coarse[met & np.uint64(0xFFFFF)]] if len(met) else met
            if not len(near):
                continue
            items: set[int] = set()
            own = None
            for least, values, of in parts:
                if len(met) < least:
                    break
                low, high = np.searchsorted(values, near), np.searchsorted(values, near, "right")
                items.update(k for a, b in {*zip(low.tolist(), high.tolist(), strict=True)} for k in of[a:b].tolist())
            for k in sorted(items):
                own = np.unique(met) if own is None else own
                if np.isin(self.sets[k], own, assume_unique=True).sum() >= self.threshold * len(self.sets[k]) - 1e-9:
                    if shared := verified(self.words[k], said, length, self.threshold):
                        out.append((k, *shared))
        return out


def verified(item: list[bytes], said: list[bytes], length: int, threshold: float) -> tuple[int, int] | None:
    """Distinct shingles of the item and those of them in the text, if they reach the threshold."""
    mine = {tuple(item[i : i + length]) for i in range(len(item) - length + 1)}
    shared = len(mine & {tuple(said[i : i + length]) for i in range(len(said) - length + 1)})
    return (len(mine), shared) if shared >= threshold * len(mine) - 1e-9 else None


def _items(items: DataFrame, item_col: str, item_text: str) -> tuple[DataFrame, int]:
    """(item_id, text) of the items, and a bound of their shingles: one for each two characters."""
    every = saved(texts(items, item_col, item_text).select(F.col("doc_id").alias("item_id"), "text"), "benchmark")
    return every, (every.agg(F.sum(F.length("text") + 1)).first()[0] or 0) // 2


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8, miss: float = 1e-9, held_shingles: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that it contains: doc_id, item_id, n_shingles and n_shared of the item, containment."""
    rows = texts(docs, id_col, text_col)
    every, cost = _items(items, item_col, item_text)
    if cost > held_shingles:
        return _met(rows, every, shingle, threshold, miss)
    kind, item_kind = rows.schema["doc_id"].dataType.simpleString(), every.schema["item_id"].dataType
    return rows.mapInArrow(_search(every, shingle, threshold, miss), f"doc_id {kind}, item_id {item_kind.simpleString()}, n_shingles long, n_shared long, containment double")


def _search(every: DataFrame, shingle: int, threshold: float, miss: float):
    held = every.collect()  # of at most held_shingles
    ids, said, item_type = [r.item_id for r in held], [r.text for r in held], to_arrow_type(every.schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Items(said, shingle, threshold, miss)
        for batch in batches:
            got = [(d, ids[k], n, m, m / n) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, n, m in known.found(t)]
            if got:
                yield _answers(got, batch.schema.field(0).type, item_type)

    return run


def _answers(got: list[tuple], id_type: pa.DataType, item_type: pa.DataType) -> pa.RecordBatch:
    kinds = (id_type, item_type, pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], ["doc_id", "item_id", "n_shingles", "n_shared", "containment"])


def _met(rows: DataFrame, every: DataFrame, shingle: int, threshold: float, miss: float) -> DataFrame:
    """contaminated() for items that no task holds."""
    every = saved(every.withColumn("item", F.monotonically_increasing_id()), "items")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(t)
                own = shingle_set(word_numbers(w), shingle)
                if len(own):
                    values = own[: sketch_size(len(own), threshold, miss)].view(np.int64)
                    n = len(values)
                    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array([min(shingle, len(w))] * n, pa.int32()), pa.array([least_size(part_of(len(own)), threshold)] * n, pa.int64()), pa.array([item] * n, pa.int64())], ["value", "length", "least", "item"])

    sketches = saved(every.select("item", "text").mapInArrow(sketch, "value long, length int, least long, item long"), "sketches")
    lengths = sorted(r.length for r in sketches.select("length").distinct().collect())  # at most as many as a shingle has words
    bits = min(1 << 28, max(1 << 20, 1 << (16 * sketches.count()).bit_length()))
    slot = F.pmod("value", F.lit(bits)) + F.lit(1)
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in sketches.select(F.bitmap_bucket_number(slot).alias("at"), F.bitmap_bit_position(slot).alias("bit")).groupBy("at").agg(F.bitmap_construct_agg("bit").alias("said")).collect():  # 32 MB at most
        bitmap[(r["at"] - 1) * BUCKET_BITS // 8 : r["at"] * BUCKET_BITS // 8] = np.frombuffer(r["said"], np.uint8)
    passes = rows.sparkSession.sparkContext.broadcast(bitmap)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = passes.value
        for batch in batches:
            at, values, sizes, counts = [], [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                numbers = word_numbers(words(t))
                for length in lengths:
                    met = shingle_numbers(numbers, length)
                    place = met & np.uint64(bits - 1)
                    near = np.unique(met[known[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1])
                    at += [k] * len(near)
                    values.append(near.view(np.int64))
                    sizes += [length] * len(near)
                    counts += [len(met)] * len(near)
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(at)), pa.array(np.concatenate(values)), pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())], ["key", "value", "length", "n"])

    keyed = rows.withColumn("key", row_key("doc_id", "text"))
    kind, item_kind = rows.schema["doc_id"].dataType.simpleString(), every.schema["item_id"].dataType
    looked = keyed.mapInArrow(look, "key struct<a:long,b:long>, value long, length int, n long")
    pairs = saved(looked.join(sketches, ["value", "length"]).where("n >= least").select("key", "item").distinct(), "pairs")
    said = bitmap_filter(keyed, pairs.select("key"), "key")
    both = said.join(pairs, "key").join(every.select("item", "item_id", F.col("text").alias("item_text")), "item").select("doc_id", "text", "item_id", "item_text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for d, t, i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = words(x)
                if told := verified(w, words(t), min(shingle, len(w)), threshold):
                    got.append((d, i, *told, told[1] / told[0]))
            if got:
                yield _answers(got, batch.schema.field(0).type, batch.schema.field(2).type)

    return both.mapInArrow(verify, f"doc_id {kind}, item_id {item_kind.simpleString()}, n_shingles long, n_shared long, containment double")


def without_items(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8, miss: float = 1e-9, held_shingles: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that contain no item; they are filtered where they are read, or by an anti-join on the few that do if no task holds the items."""
    every, cost = _items(items, item_col, item_text)
    if cost > held_shingles:
        key = row_key(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
        keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
        named = keyed.select("key", F.col("row").getField(text_col).alias("text"))
        leaks = _met(texts(named, "key"), every, shingle, threshold, miss).select(F.col("doc_id").alias("key")).distinct()
        leaks = saved(leaks, "leaks")
        told = bitmap_flag(keyed, leaks, "key", "may")
        return told.where("NOT may").select("row.*").unionByName(told.where("may").join(leaks, "key", "left_anti").select("row.*"))
    at, schema, said = docs.columns.index(text_col), docs.schema, [r.text for r in every.select("text").collect()]  # of at most held_shingles
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Items(said, shingle, threshold, miss)
        for batch in batches:
            yield batch.filter(pa.array([not known.found(t or "") for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)
