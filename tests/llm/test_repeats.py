import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from convolake.llm.fm_dedup import Index, remove_repeated_words
from convolake.llm.suffix_dedup import refine, remove_repeated_bytes

SCHEMA = "doc_id long, text string, sha string, n int, copies int"


def brute(units, window, join):
    """units: of each text."""
    seen = Counter(tuple(u[i : i + window]) for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i : i + window])] > 1:
                gone[i : i + window] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(u), int(gone.sum()), spans, hashlib.sha256(join([x for x, g in zip(u, gone) if not g])).hexdigest()))
    return out


def corpus(seed, deal_word, join, passage):
    deal = random.Random(seed)
    say = lambda n: [deal_word(deal) for _ in range(n)]
    shared = [say(n) for n in (passage - 1, passage, passage + 1, 2 * passage, 5 * passage)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(deal.randint(0, 4)):
            own += say(deal.randint(0, 2 * passage))
            if deal.random() < 0.6:
                x = deal.choice(shared)
                a = deal.randint(0, len(x) // 2)
                own += x[a : a + deal.randint(1, len(x))]
        rows.append((i, join(own)))
    rows += [(60, None), (61, ""), (62, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (63, join(say(3) * 300)), (64, join(say(1) * 900)), (65, join(say(4000))), (66, join(shared[4]))]
    return rows


@pytest.mark.parametrize("length", [40, 3])
def test_bytes(spark, length):
    rows = corpus(1, lambda d: d.choice("abcdé\n") if length > 3 else d.choice("abcdefghijklmnopqrstuvwxyz") * 3, "".join, length)
    df = spark.createDataFrame([(i, t, "s", 1, 1) for i, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in remove_repeated_bytes(df, length=length).collect()), key=str)
    want = brute([(t or "").encode() for _, t in rows], length, bytes)
    assert got == sorted(((i, n, gone, spans, sha) for (i, _), (n, gone, spans, sha) in zip(rows, want)), key=str)
    assert sum(r[2] for r in got) > 500


@pytest.mark.parametrize("window", [12, 35])
def test_words(spark, window):
    rows = corpus(2, lambda d: d.choice(["a", "b", "the", "é", "word"]), " \n".join, window)
    df = spark.createDataFrame([(i, t, "s", 1, 1) for i, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in remove_repeated_words(df, window=window).collect()), key=str)
    units = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    want = brute(units, window, lambda x: " ".join(x).encode())
    assert got == sorted(((i, n, gone, sha) for (i, _), (n, gone, _, sha) in zip(rows, want)), key=str)


def test_empty(spark):
    df = spark.createDataFrame([(1, "a", "s", 1, 1)], SCHEMA)
    for f in (remove_repeated_bytes, remove_repeated_words):
        assert f(df.limit(0)).collect() == []
        assert f(df).first().n_removed == 0


def test_refinement_and_index():
    deal = np.random.default_rng(3)
    for _ in range(40):
        data = deal.integers(0, 3, deal.integers(20, 300)).astype(np.uint8)
        length = int(deal.integers(1, 20))
        alive = deal.random(len(data)) < 0.8
        alive[max(0, len(data) - length + 1) :] = False
        seen = Counter(data[i : i + length].tobytes() for i in np.flatnonzero(alive))
        assert refine(data, alive, length).tolist() == [bool(a) and seen[data[i : i + length].tobytes()] > 1 for i, a in enumerate(alive)]
        sequence = np.append(data.astype(np.int64) + 1, 0)
        index = Index(sequence, len(sequence) + 1)
        i = int(deal.integers(0, len(data)))
        pattern = data[i : i + int(deal.integers(1, 6))]
        low, high = np.array([0]), np.array([len(sequence)])
        for s in pattern[::-1]:
            low, high = index.back(np.array([int(s) + 1]), low, high)
        assert int(high[0] - low[0]) == sum(data[k : k + len(pattern)].tobytes() == pattern.tobytes() for k in range(len(data)))


def test_frequent_passage(spark):
    deal = random.Random(9)
    say = lambda n: " ".join(f"w{deal.randrange(5000)}" for _ in range(n))
    passage = say(60)
    rows = [(i, f"{say(40)} {passage} {say(40)}") for i in range(900)]
    df = spark.createDataFrame([(i, t, "s", 1, 1) for i, t in rows], SCHEMA).repartition(5)
    for rep, units, window in ((remove_repeated_words(df, window=20), [t.encode().split() for _, t in rows], 20), (remove_repeated_bytes(df, length=100), [t.encode() for _, t in rows], 100)):
        want = {i: x[1] for (i, _), x in zip(rows, brute(units, window, lambda x: b" ".join(x) if window == 20 else bytes(x)))}
        assert {r.doc_id: r.n_removed for r in rep.collect()} == want and min(want.values()) > 50


def test_one_text_of_equal_units(spark):
    df = spark.createDataFrame([(1, "a" * 200_000, "s", 1, 1), (2, "b " * 100_000, "s", 1, 1)], SCHEMA)
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in remove_repeated_bytes(df).collect()} == {1: (200_000, 1), 2: (200_000, 1)}
    assert {r.doc_id: r.n_removed for r in remove_repeated_words(df).collect()} == {1: 0, 2: 100_000}
