"""Groups of spelling variants, by a symmetric-delete join.

Every word emits a key of itself and of each distinct string that a single deletion leaves; words whose keys are equal meet, and a meeting counts if the two differ by one inserted,
deleted or replaced character at the very place that the keys name. Keys are 64-bit hashes of those strings, all of a word made in one pass, so that a word of n characters costs n rows
of fixed size and not n copies of itself; equal hashes of different strings meet and are told apart by the words. Deletions carry the run of equal characters they come from: two deletions
can only be a replacement if their runs share a place, so that transposed letters and the like don't become pairs. The number of words that share a key is bounded by the
length of a word times the letters in use. A word's form is the near word with the largest count, if that is ratio times its own or more; forms are followed to their last by joining the
table of links with itself, each round doubling the way, which takes log2(log_ratio(largest count)) rounds at most.

A null text has no words; a null doc_id is an empty one. Rows that repeat count again, as do repeated words. Equal counts: the smallest word in code-point order is the form.
Words of any length are allowed. An empty table gives an empty result. Columns but the two named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import blocks, saved, texts

#: Letters of the contract, as a class for Java's expressions. A fixed value.
LETTERS = r"[A-Za-zÀ-ÿ]"

#: Of the hash of a word: the weight of a place is a power of BASE; BASE times INVERSE is 1 modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Most characters that are hashed at once; a longer word is hashed by itself.
BLOCK = 1 << 20


def lower_ascii(word: Column) -> Column:
    """A to Z as a to z, and nothing else."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, ascii_uppercase, ascii_lowercase))


def without(word: Column, place: Column) -> Column:
    """word less its character at a place from 0."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, change: Callable[[Column, Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the runs of letters in whole texts, lower-cased within ASCII, that are long and frequent enough. change: of (doc_id as text, run) what the run is read as; it may be shorter than the run, never longer."""
    rows = texts(docs, id_col, text_col).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{least_length},}})"))).alias("run"))
    rows = rows.withColumn("word", lower_ascii(F.col("run")))
    if change is not None:
        rows = rows.withColumn("word", change(F.col("doc"), F.col("word"))).where(F.length("word") >= least_length)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def deletion_keys(ids: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, id, first, last: a row for each word (first and last are -1) and for each of its distinct deletions (the run of equal characters that the deleted one is of)."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = sizes.cumsum()
    begins = ends - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - begins[of]
    weights = np.full(int(sizes.max(initial=0)) + 1, BASE, np.uint64)
    weights[0] = 1
    mixed = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    terms = (mixed ^ (mixed >> np.uint64(32))) * np.multiply.accumulate(weights)[place]
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(terms)])
    whole = sums[ends] - sums[begins]
    before = sums[:-1] - sums[begins][of]
    keys = before + (whole[of] - before - terms) * np.uint64(INVERSE)
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (place[1:] == 0)
    first = place[np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0))] if len(codes) else place
    last = np.append(new[1:], True)[: len(codes)]
    none = np.full(len(words), -1, np.int64)
    return np.concatenate([whole, keys[last]]).view(np.int64), np.concatenate([ids, ids[of[last]]]), np.concatenate([none, first[last]]), np.concatenate([none, place[last]])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, words = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        for i, j in blocks(words, BLOCK):
            key, of, first, last = deletion_keys(ids[i:j], words[i:j])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(of), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["key", "id", "first", "last"])


def near_words(words: DataFrame) -> DataFrame:
    """(id, word, n, near_id, near_word, near_n), both ways, of the words (id, word, n) that are at a distance of exactly one; id must tell them apart."""
    keys = saved(words.select("id", "word").mapInArrow(_emit, "key long, id long, first int, last int"), "spelling-keys")
    a, b = (keys.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "first", "last"))) for x in "ab")
    met = a.join(b, "key").where((F.col("id_a") < F.col("id_b")) & ((F.col("first_a") >= 0) | (F.col("first_b") >= 0)))
    met = met.where((F.col("first_a") < 0) | (F.col("first_b") < 0) | ((F.col("first_a") <= F.col("last_b")) & (F.col("first_b") <= F.col("last_a"))))
    met = met.select("id_a", "id_b", F.greatest("first_a", "first_b").alias("place"), (F.col("first_a") < 0).alias("whole_a"), (F.col("first_b") < 0).alias("whole_b"))
    for x in "ab":
        met = met.join(words.select(F.col("id").alias(f"id_{x}"), F.col("word").alias(f"word_{x}"), F.col("n").alias(f"n_{x}")), f"id_{x}")
    left = {x: F.when(F.col(f"whole_{x}"), F.col(f"word_{x}")).otherwise(without(F.col(f"word_{x}"), F.col("place"))) for x in "ab"}
    pairs = saved(met.where(left["a"] == left["b"]), "spelling-pairs")
    one = lambda x, y: pairs.select(*(F.col(f"{c}_{x}").alias(c) for c in ("id", "word", "n")), *(F.col(f"{c}_{y}").alias(f"near_{c}") for c in ("id", "word", "n")))
    return one("a", "b").unionByName(one("b", "a"))


def last_forms(links: DataFrame) -> DataFrame:
    """(id, root) of links (id, form), which have no circle: where following forms ends."""
    now = saved(links.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = now.select(F.col("id").alias("root"), F.col("root").alias("onward"))
        step = saved(now.join(onward, "root", "left").select("id", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "spelling-roots")
        now = step.select("id", "root")
        if step.where("moved").isEmpty():
            return now


def variant_groups(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """Per word of counts (word, n): word, form, root, n, n_near, form_n. ratio: how many times as frequent a form is; more than 1."""
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could go in circles")
    words = saved(counts.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    best = near_words(words).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near_word").alias("word"), F.col("near_id").alias("id"))).alias("best"), F.first("n").alias("own"))
    best = saved(best.select("id", "n_near", F.when(-F.col("best.less") >= ratio * F.col("own"), F.col("best")).alias("form")), "spelling-forms")
    roots = last_forms(best.where("form IS NOT NULL").select("id", F.col("form.id").alias("form")))
    roots = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = words.join(best, "id", "left").join(roots, "id", "left")
    return out.select("word", F.col("form.word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("form.less")).alias("form_n"))
