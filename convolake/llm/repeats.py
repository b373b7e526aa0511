"""Windows that repeat anywhere in a table of texts: what the two operators on repeated passages share.

A text is a sequence of units, bytes or words. Each window of a fixed number of units has one anchor, the least of the hashes of its q-grams, which follows from the
window alone; so equal windows have equal anchors at equal places. The windows of one anchor are consecutive, and the stretch that they cover is its context.
  1. Texts are read into the hashes of their anchors. Equal texts count once, as all of their windows repeat anyway.
  2. Hashes that occur twice or more are found by counting; only texts that have one are read again, into the contexts of those anchors.
  3. Contexts are dealt out by the hash, so that equal windows meet in one task, where the engine of the operator finds those that repeat. Of equal contexts a task
     sends two at most, and settles the others with them before the shuffle.
  4. The covered stretches go back to their texts.
No step makes pairs; each text crosses the network only if it has a candidate, and at most twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import bitmap_filter, parts, saved, spread_join


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, by block-wise running minima from both sides."""
    n = len(x)
    if w == 1:
        return x
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(grams: np.ndarray, window: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: its hash, its place, its first window and the one after its last. grams are the hashes of all q-grams."""
    w = window - q + 1
    if len(grams) < w:
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, empty, empty
    bits = np.uint64(max(20, int(len(grams)).bit_length()))
    tagged = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)  # of equal hashes the first is the anchor
    at = (sliding_least(tagged, w) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return grams[at[first]], at[first], first, np.append(first[1:], len(at))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that are true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


class Kind:
    """How an operator sees a text. window, q: units. read: the units. grams: hashes of the q-grams of units. cut: the bytes of a stretch of units. engine: of such distinct stretches, and the times that each occurs, the places where a repeated window starts. shard: bytes of contexts that an engine gets at once; those of one anchor stay together."""

    def __init__(self, window: int, q: int, read: Callable, grams: Callable, cut: Callable, engine: Callable, shard: int):
        self.window, self.q, self.read, self.grams, self.cut, self.engine, self.shard = window, q, read, grams, cut, engine, shard


def _owners(texts: DataFrame, kind: Kind) -> DataFrame:
    """(doc_id, sha, row, n units, hashes of the anchors) of every row of texts (doc_id, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for t in batch.column(2).to_pylist():
                units = kind.read(t)
                sizes.append(len(units))
                found.append(anchors(kind.grams(units), kind.window, kind.q)[0].view(np.int64) if len(units) >= kind.window else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "sha", "n", "hashes"])

    id_kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), "text").mapInArrow(read, f"doc_id {id_kind}, sha binary, n long, hashes array<long>")
    return saved(rows.withColumn("row", F.monotonically_increasing_id()), "anchored")


def repeated(texts: DataFrame, kind: Kind, finish: Callable[[str, list[tuple[int, int]]], tuple], finished: str) -> tuple[DataFrame, DataFrame]:
    """(owners, results): each row of texts (doc_id, text) with sha, n and copies; and by sha what finish makes of the text and its covered stretches of units, where there are any. Equal texts of a window or more have no result: all of them is covered."""
    owners = _owners(texts, kind)
    total = owners.count()
    same = saved(owners.groupBy("sha").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies")), "same-texts")
    once = owners.join(same.select("row"), "row")

    # Hashes that occur twice, and the texts that have them.
    places = saved(once.select("row", F.explode("hashes").alias("hash")), "places")
    twice = saved(places.groupBy("hash").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "twice")
    met = spread_join(places, twice, "hash", "times", total).groupBy("row").agg(F.collect_set("hash").alias("wanted"))
    met = saved(met.join(once.select("row", "doc_id", "sha"), "row").withColumn("owner", F.xxhash64("doc_id", "sha")).select("owner", "sha", "wanted"), "candidates")

    said = texts.withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("owner", F.xxhash64("doc_id", "sha"))
    said = bitmap_filter(said, met.select("owner"), "owner").select("owner", "sha", "text")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[bytes, int] = {}  # of contexts, by digest, as far as this task has sent them; it may begin anew at any time
        for batch in batches:
            out: list[tuple] = []
            for sha, t, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                units = kind.read(t)
                hashes, at, first, last = anchors(kind.grams(units), kind.window, kind.q)
                of = np.flatnonzero(np.isin(hashes, np.array(wanted, np.int64).view(np.uint64)))
                low = high = -1  # what this task has settled of the text and not yet sent
                for h, p, a, b in zip(*(x.tolist() for x in (hashes[of].view(np.int64), at[of], first[of], last[of] - 1 + kind.window)), strict=True):
                    cut = kind.cut(units, a, b)
                    key = blake2b(cut, digest_size=16, salt=(p - a).to_bytes(8, "little")).digest()
                    seen = times.get(key, 0)
                    if seen < 2:
                        times[key] = seen + 1
                        out.append((h, sha, a, b, p - a, cut))
                    elif a <= high:
                        high = b
                    else:
                        if high > 0:
                            out.append((0, sha, low, high, 0, None))
                        low, high = a, b
                    if len(out) > 20_000:
                        yield _context_rows(out)
                        out = []
                if high > 0:
                    out.append((0, sha, low, high, 0, None))
                if len(times) > 300_000:
                    times = {}
            if out:
                yield _context_rows(out)

    pairs = said.join(met.select("owner", "sha", "wanted"), ["owner", "sha"]).select("sha", "text", "wanted")
    found = saved(pairs.mapInArrow(contexts, "hash long, sha binary, low long, high long, lead long, cut binary"), "contexts")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], dict[tuple[bytes, int], int]] = {}
        size, now = 0, None

        def close() -> Iterator[pa.RecordBatch]:
            shas, lows, highs = [], [], []
            keys = list(held)
            for (lead, cut), mask in zip(keys, kind.engine([cut for _, cut in keys], np.array([len(held[k]) for k in keys])), strict=True):
                starts, ends = runs(mask)
                for (sha, low), _ in held[lead, cut].items() if len(starts) else ():
                    shas += [sha] * len(starts)
                    lows.append(starts + low)
                    highs.append(ends - 1 + kind.window + low)
            if shas:
                yield pa.RecordBatch.from_arrays([pa.array(shas, pa.binary()), pa.array(np.concatenate(lows), pa.int64()), pa.array(np.concatenate(highs), pa.int64())], ["sha", "low", "high"])

        for batch in batches:
            for key, sha, low, high, lead, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if size > kind.shard:
                        yield from close()
                        held, size = {}, 0
                    now = key
                own = held.setdefault((lead, cut), {})
                if not own:
                    size += len(cut)
                own[sha, low] = high
        if held:
            yield from close()

    dealt = found.where("cut IS NOT NULL").repartition(parts(texts.sparkSession), "hash").sortWithinPartitions("hash").mapInArrow(search, "sha binary, low long, high long")
    covered = dealt.unionByName(found.where("cut IS NULL").select("sha", "low", "high"))
    covered = saved(covered.groupBy("sha").agg(F.collect_set(F.struct("low", "high")).alias("covered")), "covered")

    # Back to the texts; of those with copies all is covered.
    single = same.where("copies = 1").join(owners.select("row", "doc_id"), "row").withColumn("owner", F.xxhash64("doc_id", "sha"))
    todo = saved(covered.join(single.select("sha", "owner"), "sha").select("owner", "sha", "covered"), "todo")

    def close_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(sha, *finish(t, merged([(x["low"], x["high"]) for x in of]))) for sha, t, of in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["sha", *(x.split()[0] for x in finished.split(", "))])

    said = bitmap_filter(texts.withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("owner", F.xxhash64("doc_id", "sha")), todo.select("owner"), "owner")
    results = said.select("owner", "sha", "text").join(todo, ["owner", "sha"]).select("sha", "text", "covered").mapInArrow(close_texts, f"sha binary, {finished}")
    told = saved(same.select("sha", "copies").join(results, "sha", "left"), "results")
    return owners.select("doc_id", "sha", "n"), told


def _context_rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["hash", "sha", "low", "high", "lead", "cut"])


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching stretches as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out
