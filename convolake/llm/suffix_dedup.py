"""Byte strings that repeat, by bucket-pointer refinement of suffixes.

The suffixes that are sorted are those that may start a repeated string (see repeats): where contexts of equal anchors meet, each place is put into a bucket by
its first bytes. A bucket is then refined by sorting its places on the buckets of later offsets, which doubles the depth; the buckets found so serve the next
round. A place alone in its bucket can be in no repeated string, so strings that hold one leave, and with them all places that only they need.

Null texts count as empty; texts shorter than the length keep all. Rows that repeat are copies, all of which lose what they share. A null doc_id stays null; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import spread_join, texts
from convolake.llm.repeats import Kind, repeated
from convolake.llm.shingles import mix

_ODD = 0x9E3779B97F4A7C15 | 1


def byte_grams(data: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams of bytes, as differences of running sums."""
    n = len(data) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(data), _ODD, np.uint64))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(mix(np.arange(1, 257, dtype=np.uint64))[data] * power, out=sums[1:])
        back = np.cumprod(np.full(n, pow(_ODD, -1, 1 << 64), np.uint64))
        return mix((sums[q:] - sums[:n]) * back)


def _covers(flags: np.ndarray, span: int) -> np.ndarray:
    """Whether a flag is set at one of the span places that end here."""
    total = np.cumsum(flags, dtype=np.int64)
    out = total.copy()
    out[span:] -= total[:-span] if span < len(total) else 0
    return out > 0


def _free(flags: np.ndarray, span: int) -> np.ndarray:
    """Whether no flag is set at the span places from here on."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    end = np.minimum(np.arange(len(flags)) + span, len(flags))
    return total[end] == total[:-1]


def refine(data: np.ndarray, alive: np.ndarray, length: int, q: int = 8, times: np.ndarray | None = None) -> np.ndarray:
    """Of the places in alive those whose string of this length is also at another of them, or is there more than once itself. A string from an alive place must end inside data. times: how often each place is there; once if not given."""
    n = len(data)
    q = min(q, length)
    alive = alive.copy()
    value = np.zeros(n, np.uint64)
    for k in range(q):
        value[: n - k] = value[: n - k] << np.uint64(8) | data[k:]
    need = _covers(alive, length - q + 1)
    bucket, alone = np.zeros(n, np.int64), np.ones(n, bool)
    depth, key = q, value.astype(np.int64)
    while True:
        at = np.flatnonzero(need)
        _, inverse, counts = np.unique(key[at] if depth == q else key, return_inverse=True, return_counts=True)
        bucket[at], alone[at] = inverse, (counts[inverse] == 1) & (True if times is None else times[at] == 1)
        alive &= _free(alone & need, length - depth + 1)
        if depth == length or not alive.any():
            return alive
        step = min(depth, length - depth)
        depth += step
        need = _covers(alive, length - depth + 1)
        at = np.flatnonzero(need)
        key = bucket[at] * n + bucket[at + step]


def engine_for(length: int):
    def engine(cuts: list[bytes], times: np.ndarray) -> list[np.ndarray]:
        """Of each context the places whose string repeats."""
        data = np.frombuffer(b"".join(cuts), np.uint8)
        sizes = np.array([len(c) for c in cuts])
        ends = np.cumsum(sizes)
        alive = np.ones(len(data), bool)
        for e in ends.tolist():
            alive[e - length + 1 : e] = False
        found = refine(data, alive, length, times=np.repeat(times, sizes))
        return [found[e - n : e - length + 1] for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]

    return engine


def _read(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def remove_repeated_bytes(docs: DataFrame, length: int = 400, q: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, after removing each byte of a string of this length that also starts elsewhere."""
    q = q or max(1, length // 4)

    def finish(text: str, covered: list[tuple[int, int]]) -> tuple[int, int, str]:
        raw, kept, at = text.encode("utf-8", "surrogatepass"), [], 0
        for a, b in covered:
            kept.append(raw[at:a])
            at = b
        return sum(b - a for a, b in covered), len(covered), hashlib.sha256(b"".join([*kept, raw[at:]])).hexdigest()

    kind = Kind(length, q, _read, lambda units: byte_grams(units, q), lambda units, a, b: units[a:b].tobytes(), engine_for(length), 1_000_000)
    owners, told = repeated(texts(docs, id_col, text_col), kind, finish, "n_removed long, n_spans long, kept_sha256 string")
    rows = spread_join(owners, told, "sha", "copies", owners.count())
    return all_or_told(rows, length, "n_bytes", ["n_spans"])


def all_or_told(rows: DataFrame, window: int, size: str, extra: list[str]) -> DataFrame:
    """Texts with a copy lose all, if they are as long as a window; others what was told of them, or nothing."""
    gone = (F.col("copies") > 1) & (F.col("n") >= window)
    told = {"n_removed": F.when(gone, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0)))}
    told |= {c: F.when(gone, F.lit(1)).otherwise(F.coalesce(c, F.lit(0))).cast("long") for c in extra}
    told["kept_sha256"] = F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha"))))
    return rows.select("doc_id", F.col("n").alias(size), *(v.alias(k) for k, v in told.items()))
