"""Documents of similar word n-grams: MinHash bands propose, whole n-gram sets decide.

Texts with the same set of shingles are one representative with a number of copies. Bands and rows follow from the threshold and the recall asked for. A shuffle
on band hashes ties the representatives of each bucket to the least of them, so a bucket of k gives k - 1 rows; connected components of these ties are what can
hold links. Every pair inside a component is then compared on the whole sets: components of more than block members, or block_shingles shingles, are dealt into blocks, and each pair
of blocks is one group, so that no task holds more than about two blocks. Groups return counts of links and a forest of them, never the pairs. Components of the forests
are the classes.

Null and empty texts have no shingle and no link; a text of fewer words than a shingle has one of all its words. Rows that repeat, with one doc_id or several,
are copies of each other. A class is named by its least doc_id, null only if all are; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import bitmap_filter, parts, row_key, saved, spread_join, texts
from convolake.llm.components import components
from convolake.llm.shingles import mix, shingle_set, word_numbers, words


def bands_for(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): of the settings with at most so many hash values that find a pair at the threshold with the recall asked for, the one with the most rows."""
    found = [(b, r) for r in range(1, most + 1) if (b := max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**r))))) * r <= most]
    return max(found, key=lambda x: x[1]) if found else (most, 1)


def set_key(found: np.ndarray) -> bytes:
    """128 bits that name a set of shingles."""
    if not len(found):
        return b""
    with np.errstate(over="ignore"):
        return np.array([mix(found).sum(), mix(mix(found) ^ np.uint64(0x5851F42D4C957F2D)).sum() ^ np.uint64(len(found))], np.uint64).tobytes()


def signature(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number for each band of the MinHash signature; bands differ in their numbers."""
    k = np.arange(bands * rows, dtype=np.uint64)
    times, plus = mix(k * np.uint64(2) + np.uint64(1)) | np.uint64(1), mix(k + np.uint64(0x1234567))
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 2048):  # so that a long text needs no large table
        x = found[start : start + 2048, None] * times + plus
        x ^= x >> np.uint64(32)
        np.minimum(least, x.min(axis=0), out=least)
    least = mix(least).reshape(bands, rows)
    return mix((least * (np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1))).sum(axis=1) + np.arange(bands, dtype=np.uint64))


#: Shingles of one stripe of a product.
STRIPE = 4096


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of left with each of right; only shingles of both sides take part in the product."""
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate(sets)
        at = np.searchsorted(both, every)
        met = np.flatnonzero((at < len(both)) & (both[np.minimum(at, len(both) - 1)] == every)) if len(both) else np.empty(0, np.int64)
        row, col = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[met], at[met]
        order = np.argsort(col, kind="stable")
        return row[order], col[order]

    def table(of: tuple[np.ndarray, np.ndarray], start: int, n: int) -> np.ndarray:
        a, b = np.searchsorted(of[1], [start, start + STRIPE])
        out = np.zeros((n, min(STRIPE, len(both) - start)), np.float32)
        out[of[0][a:b], of[1][a:b] - start] = 1
        return out

    out = np.zeros((len(left), len(right)), np.float32)
    mine = places(left)
    theirs = mine if right is left else places(right)
    for start in range(0, len(both), STRIPE):
        x = table(mine, start, len(left))
        out += x @ (x if right is left else table(theirs, start, len(right))).T
    return out


def compare(left: list[tuple], right: list[tuple], threshold: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Members are (row, copies, set). Of the pairs inside left, or between left and right if there are any: (row, linked copies, linked sets) and a forest of the links."""
    other = right or left
    sizes = [np.array([len(m[2]) for m in x], np.float32) for x in (left, other)]
    sets = [m[2] for m in left]
    both = overlaps(sets, [m[2] for m in right] if right else sets)
    linked = both >= threshold * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-4
    if not right:
        np.fill_diagonal(linked, False)
    links = []
    for members, of, x in ((left, other, linked), (right, left, linked.T)):
        copies, counts = x @ np.array([m[1] for m in of], np.float64), x.sum(axis=1)  # sums of whole numbers, exact as doubles
        links += [(members[k][0], int(copies[k]), int(counts[k])) for k in (np.flatnonzero(counts).tolist() if members else ())]
    forest = []
    names = [[m[0] for m in x] for x in ((left, right) if right else (left,))]
    todo = [np.ones(len(x), bool) for x in names]
    for side, own in enumerate(todo):
        while own.any():
            reach = [(side, int(np.argmax(own)))]
            own[reach[0][1]] = False
            while reach:
                here, k = reach.pop()
                there = 1 - here if right else 0
                new = np.flatnonzero((linked[:, k] if here else linked[k]) & todo[there]).tolist()
                todo[there][new] = False
                reach += [(there, j) for j in new]
                forest += [(names[here][k], names[there][j]) for j in new]
    return links, forest


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = 1024, block_shingles: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, class_id (least doc_id of its class), class_size, n_links (documents of similarity threshold or more, copies too), kept (one row of each class, of the least doc_id), row_key."""
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    keyed = rows.withColumn("row_key", row_key("doc_id", "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    bands, depth = bands_for(threshold, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(word_numbers(words(t)), shingle) for t in batch.column(1).to_pylist()]
            signs = [signature(s, bands, depth).view(np.int64) if len(s) else np.empty(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([set_key(s) for s in sets], pa.binary()), pa.array(list(map(len, sets)), pa.int64()), pa.array(signs, pa.list_(pa.int64()))], ["doc_id", "row_key", "key", "size", "bands"])

    signed = keyed.mapInArrow(sign, f"doc_id {kind}, row_key struct<a:long,b:long>, key binary, size long, bands array<long>")
    signed = saved(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
    total = signed.count()
    with_key = signed.select("row", "doc_id", "row_key", "key", "size").where("key <> X''")
    reps = saved(with_key.groupBy("key").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size")), "representatives")

    # Ties inside buckets, and the components that they make.
    own = bitmap_filter(signed.select("row", "bands"), reps.select(F.col("rep").alias("row")), "row")  # a copy that passes has the ties of its representative
    own = own.select(F.col("row").alias("rep"), F.explode("bands").alias("bucket"))
    own = saved(own, "buckets")
    least = own.groupBy("bucket").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    least = saved(least, "bucket-firsts")
    met = saved(bitmap_filter(own, least, "bucket"), "shared-buckets")  # most buckets hold one representative, and their rows stay where they are
    ties = spread_join(met, least, "bucket", "n", total).where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    groups = saved(components(ties), "candidates")

    # The texts of the candidates: only those of representatives are shuffled, as texts pack better than sets of numbers.
    groups = groups.withColumnRenamed("node", "rep").join(reps, "rep")
    sized = groups.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("members") / block, F.col("shingles") / block_shingles)).cast("int")
    members = saved(spread_join(groups, sized, "root", "members", total).select("key", "rep", "copies", "root", blocks.alias("blocks")), "members")
    wanted = signed.select("row", "doc_id").join(members.select(F.col("rep").alias("row")), "row").select("doc_id")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [set_key(shingle_set(word_numbers(words(t)), shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(1)], ["key", "text"])

    found = bitmap_filter(rows, saved(wanted, "wanted"), "doc_id").mapInArrow(name, "key binary, text string")
    found = found.join(members.hint("merge"), "key").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "copies", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}

        def close() -> Iterator[pa.RecordBatch]:
            left = [m for o, m in held.values() if o == group[1]]
            right = [m for o, m in held.values() if o != group[1]]
            if len(left) + len(right) > 1 and (left or group[1] == group[2]) and (right or group[1] == group[2]):
                links, forest = compare(left, right, threshold)
                out = [(r, n, k, None) for r, n, k in links] + [(a, 0, 0, b) for a, b in forest]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["rep", "links", "sets", "to"])

        for batch in batches:
            for root, low, high, o, rep, copies, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root, low, high) != group:
                    if group:
                        yield from close()
                    group, held = (root, low, high), {}
                if rep not in held:
                    held[rep] = o, (rep, copies, shingle_set(word_numbers(words(s)), shingle))
        if group:
            yield from close()

    order = ["root", "low", "high"]
    checked = dealt.repartition(parts(spark), *order).sortWithinPartitions(*order).mapInArrow(verify, "rep long, links long, sets long, to long")
    checked = saved(checked, "links")

    # Classes, and what each representative counts.
    classes = saved(components(checked.where("to IS NOT NULL").select(F.col("rep").alias("a"), F.col("to").alias("b"))), "classes")
    links = checked.where("to IS NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    told = reps.join(classes.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
    told = saved(told.select("key", "copies", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "told")
    of = saved(spread_join(with_key.drop("size"), told, "key", "copies", total), "of-class")
    named = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("class_size"))
    out = spread_join(of, saved(named, "named"), "root", "class_size", total)
    out = out.select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", "n_links", (F.col("row") == F.col("first.row")).alias("kept"), "row_key")
    alone = signed.where("key = X''").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"), "row_key")
    return out.unionByName(alone)
