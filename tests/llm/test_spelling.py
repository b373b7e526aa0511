import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from convolake.llm import spelling
from convolake.llm.queries import QUERIES, _misspelt

SCHEMA = "doc_id long, text string, word string, n int"


def near(a, b):
    """Exactly one inserted, deleted or replaced character."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def groups(counts, ratio=5):
    """(word, form, root, n, n_near, form_n) by comparing every word with every other."""
    out, form = set(), {}
    around = {w: [x for x in counts if abs(len(x) - len(w)) < 2 and near(w, x)] for w in counts}
    for w, others in around.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(around[w]), counts.get(form[w])))
    return out


def counted(rows, change=True):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if change and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_whole_table_against_every_pair(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = groups(counted([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    assert {tuple(r) for r in QUERIES["op11_spelling_variants"](spark, sf_dir).select("word", "form", "root", "n", "n_near", "form_n").collect()} == want


@pytest.mark.parametrize("letters", ["ab", "aàb", "abcdeé"])
def test_random_words(spark, letters):
    deal = random.Random(letters)
    counts = {"".join(deal.choice(letters) for _ in range(deal.randint(1, 9))): deal.choice([5, 7, 25, 30, 125, 700, 4000]) for _ in range(400)}
    got = spelling.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == groups(counts)


def test_odd_rows(spark):
    word, other = "interview", "intervie"
    rows = [(1, f"{word} " * 30, "clash", 3), (1, f"{word} " * 30, "clash", 3), (2, f"Interviev{'.'}" * 5 + other.upper() * 1, "x", 1), (3, None, None, None), (None, f"{other} " * 5, "y", 2), (4, "", "y", 2), (5, "ÉÀéàÿ× " * 5 + "short " * 9, "y", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in spelling.word_counts(df, change=_misspelt).collect()}
    assert got == set(counted([r[:2] for r in rows]).items()) and got
    found = spelling.variant_groups(spelling.word_counts(df)).collect()
    assert {(r.word, r.form, r.root) for r in found} >= {("intervie", "interview", "interview"), ("interviev", "interview", "interview")}
    assert spelling.variant_groups(spelling.word_counts(df.limit(0))).collect() == []
    with pytest.raises(ValueError):
        spelling.variant_groups(spelling.word_counts(df), ratio=1)


def test_chains_ties_and_long_words(spark):
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(150_000))
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "cccccc": 10, "cccccd": 50, "cccccb": 50, long: 50, long[:70_000] + long[70_001:]: 5, long[:-1] + "z": 9, long[:9] + "x" + long[9:]: 10}
    got = {r.word: r for r in spelling.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert [got[w].root for w in ("aaaaaa", "aaaaab", "aaaabb")] == ["aaabbb"] * 3 and got["aaaaaa"].form == "aaaaab"
    assert got["cccccc"].form == "cccccb" and got["cccccc"].n_near == 2 and got["cccccd"].form is None
    assert got[long].n_near == 3 and {w for w, r in got.items() if r.root == long} == set(counts) - {w for w in counts if len(w) == 6}


def test_keys_of_equal_strings_are_equal():
    deal = random.Random(5)
    words = ["".join(deal.choice("aab🙂ß") for _ in range(deal.randint(0, 9))) for _ in range(300)]
    key, of, first, last = spelling.deletion_keys(np.arange(len(words)), words)
    said, n = {}, Counter()
    for k, i, a, b in zip(key.tolist(), of.tolist(), first.tolist(), last.tolist()):
        left = words[i] if a < 0 else words[i][:a] + words[i][a + 1 :]
        assert a < 0 or (len(set(words[i][a : b + 1])) == 1 and left == words[i][:b] + words[i][b + 1 :])
        assert said.setdefault(k, left) == left
        n[i] += 1
    assert len(set(said.values())) == len(said)
    assert all(n[i] == 1 + len({w[:k] + w[k + 1 :] for k in range(len(w))}) for i, w in enumerate(words))


def test_no_pair_of_words_that_are_two_apart_is_made(spark):
    """Transposed letters share keys; their runs of the deleted character don't meet."""
    counts = spark.createDataFrame([("converse", 9), ("convesre", 9), ("conversed", 9)], "word string, n long")
    words = counts.withColumn("id", F.monotonically_increasing_id())
    assert {(r.word, r.near_word) for r in spelling.near_words(words).collect()} == {("converse", "conversed"), ("conversed", "converse")}
