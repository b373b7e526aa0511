import random

import pytest

from convolake.llm.components import components
from convolake.llm.decontamination import contaminated, without_items
from convolake.llm.ngram_join import bands_for, near_duplicates

SCHEMA = "doc_id long, text string, row int, key string"


def shingles(text, n=5):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + min(n, len(w))]) for i in range(max(1, len(w) - n + 1))} if w else set()


def corpus(seed=3, groups=12, most=30):
    deal = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for g in range(groups):
        base = [deal.choice(vocabulary) for _ in range(deal.choice([3, 30, 120, 300]))]
        for _ in range(deal.randint(1, most)):
            own = list(base)
            for _ in range(deal.randint(0, 5)):
                own[deal.randrange(len(own))] = deal.choice(vocabulary)
            rows.append((i, " ".join(own)))
            i += 1
    return rows + [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "a b c"), (i + 4, "a  b\nc"), (i + 4, "a  b\nc"), (None, "a b c"), (i + 5, "z " * 30_000)]


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    classes = {}
    for k in range(len(rows)):
        classes.setdefault(find(k), []).append(k)
    out = []
    for of in classes.values():
        ids = [rows[k][0] for k in of if rows[k][0] is not None]
        out += [(rows[k][0], min(ids, default=None), len(of), links[k]) for k in of]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [256, 5])
def test_classes_and_links(spark, block):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 0, "c") for i, t in rows], SCHEMA).repartition(3)
    got = near_duplicates(df, block=block).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size, r.n_links) for r in got), key=str) == brute(rows)
    assert sum(r.kept for r in got) == len({(r.class_id, r.class_size) if r.class_id is not None else r for r in got})


def test_no_near_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 0, "c"), (2, "g h i j k l", 0, "c")], SCHEMA)
    assert sorted((r.doc_id, r.class_id, r.n_links, r.kept) for r in near_duplicates(df).collect()) == [(1, 1, 0, True), (2, 2, 0, True)]
    assert near_duplicates(df.limit(0)).collect() == []


def test_bands_reach_the_recall():
    for t, recall in ((0.8, 0.9999), (0.5, 0.9), (0.95, 0.999)):
        b, r = bands_for(t, recall)
        assert b * r <= 128 and 1 - (1 - t**r) ** b >= recall


def test_components(spark):
    deal = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(deal.randrange(60), deal.randrange(60)) for _ in range(40)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda k: k if root.setdefault(k, k) == k else find(root[k])
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {k: find(k) for k in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def leaks(docs, items, threshold=0.8):
    out = []
    for d, t in docs:
        for i, said in items:
            w = [x for x in (said or "").split(" ") if x]
            n = min(5, len(w))
            mine = shingles(said)
            tw = [x for x in (t or "").replace("\n", " ").split(" ") if x]
            own = {tuple(tw[k : k + n]) for k in range(len(tw) - n + 1)} if n else set()
            if mine and len(mine & own) >= threshold * len(mine):
                out.append((d, i, len(mine), len(mine & own)))
    return sorted(out, key=str)


@pytest.mark.parametrize("held_shingles", [1_000_000, 40])
def test_leaks(spark, held_shingles):
    deal = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(deal.choice(vocabulary) for _ in range(n))
    items = [(i, say(deal.choice([1, 2, 4, 5, 6, 9, 20, 40, 90]))) for i in range(60)] + [(60, None), (61, ""), (3, say(9)), (None, say(12))]
    docs = []
    for d in range(80):
        w = deal.choice(items)[1] or ""
        own = w.split(" ")
        for _ in range(deal.randint(0, 3)):
            own[deal.randrange(len(own))] = deal.choice(vocabulary)
        docs.append((d, f"{say(deal.choice([0, 3, 50]))} {' '.join(own)}\n{say(deal.choice([0, 100, 2000]))}"))
    docs += [(80, None), (81, ""), (None, items[20][1]), (5, docs[5][1])]
    df = spark.createDataFrame([(i, t, 0, "c") for i, t in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in contaminated(df, bench, held_shingles=held_shingles).collect()), key=str)
    assert got == leaks(docs, items) and len(got) > 50
    assert contaminated(df.limit(0), bench).collect() == [] == contaminated(df, bench.limit(0)).collect()
    assert contaminated(df.limit(0), bench, held_shingles=0).collect() == []
    clean = without_items(df, bench, held_shingles=held_shingles)
    assert clean.columns == df.columns
    held = {d for d, *_ in got}
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((d for d, _ in docs if d not in held), key=str)


@pytest.mark.parametrize("held_shingles", [1_000_000, 0])
def test_leaks_with_clashing_columns(spark, held_shingles):
    bench = spark.createDataFrame([(1, "a b c d e f", 5, "x", 1), (2, None, 6, "y", 2)], "item_id int, text string, doc_id int, key string, n_shared int")
    df = spark.createDataFrame([(7, "x a b c d e f", 1, "k", 3), (8, None, 2, "k", 3)], "doc_id long, text string, item_id int, key string, row int")
    assert [tuple(r) for r in contaminated(df, bench, held_shingles=held_shingles).collect()] == [(7, 1, 2, 2, 1.0)]
    assert [tuple(r) for r in without_items(df, bench, held_shingles=held_shingles).collect()] == [(8, None, 2, "k", 3)]
