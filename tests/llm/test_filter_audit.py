import random
import re
from collections import Counter
from itertools import permutations

import pytest

from convolake.llm import filter_audit

DOCS = "doc_id long, text string, lang string, part string, A int, good string"


def fails(text, doc, first):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), bool(re.search("[#$%&*|]", text)), doc is not None and first is not None and doc > first]


def brute(docs, labels):
    """Each document through each order, one after the other."""
    first, told, count = {}, {}, Counter()
    for d, t, _ in docs:
        t = t or ""
        if d is not None:
            first[t] = min(first.get(t, d), d)
    for d, q, x in labels:
        a, b = told.get(d, (False, False))
        told[d] = a or q == 1, b or x == 1
    parts = set()
    for d, t, lang in docs:
        bad, (good, toxic), part = fails(t or "", d, first.get(t or "")), told.get(d, (False, False)) if d is not None else (False, False), lang or ""
        parts.add(part)
        for order in permutations(range(5)):
            gone = next((s for s, f in enumerate(order, 1) if bad[f]), 9)
            name = "".join("ABCDE"[f] for f in order)
            for s, f in enumerate(order, 1):
                for k, what in enumerate((gone > s, gone == s, bad[f] and gone < s, bad[f] and sum(bad) == 1, gone == s and good, gone == s and toxic)):
                    count[part, name, s, k] += what
                count[part, "ABCDE"[f]] += gone == s
    return {(p, o, s, *(count[p, o, s, k] for k in range(6)), count[p, o[s - 1]]) for p in parts for o in map("".join, permutations("ABCDE")) for s in range(1, 6)}


def got(df):
    rows = df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()
    assert len(rows) == len(set(map(tuple, rows)))
    return set(map(tuple, rows))


def test_whole_table_against_each_document_in_each_order(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    assert got(filter_audit.audit(docs, labels)) == brute(docs.select("doc_id", "text", "lang").collect(), labels.select("doc_id", "quality", "toxic").collect())


def test_odd_rows(spark):
    deal = random.Random(2)
    said = ["", None, " ", "w " * 150, " ".join(map(str, range(120))), "# " * 3, "ABC" * 40, " ".join("X%d" % k for k in range(200)), "é z " * 99, "x " * 100_000]
    rows = [(deal.choice([None, *range(12)]), deal.choice(said), deal.choice([None, "", "en", "de"]), "clash", 1, "clash") for _ in range(160)] + [(99, "only", "rare", "p", 1, "q")]
    labels = [(k % 14, deal.choice([0, 1, None]), deal.choice([0, 1, None])) for k in range(30)] + [(None, 1, 1)]
    docs, told = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert got(filter_audit.audit(docs, told)) == brute([r[:3] for r in rows], labels)
    assert filter_audit.audit(docs.limit(0), told).collect() == []
    assert got(filter_audit.audit(docs, told.limit(0))) == brute([r[:3] for r in rows], [])


def test_other_filters_and_measures(spark):
    rows = [(k % 3, k % 2 == 0, None if k == 4 else k % 5 == 0, k < 3) for k in range(30)]
    df = spark.createDataFrame(rows, "site int, x boolean, y boolean, seen boolean")
    out = {(r.part, r.filter_order, r.step): r for r in filter_audit.filter_interactions(df, ["x", "y"], "site", ("seen",)).collect()}
    assert len(out) == 3 * 2 * 2
    r = out["0", "yx", 2]
    mine = [x for x in rows if x[0] == 0]
    assert (r.kept, r.removed) == (sum(not x[1] and not x[2] for x in mine), sum(bool(x[1] and not x[2]) for x in mine)) and r.seen_lost == 0 and out["0", "xy", 1].seen_lost == 1
    with pytest.raises(ValueError):
        filter_audit.filter_interactions(df, [])


def test_the_cube_is_in_the_plan(spark):
    rows = spark.createDataFrame([("p", True, False)], "part string, x boolean, y boolean")
    said = []
    kept = filter_audit.saved
    try:
        filter_audit.saved = lambda df, what, **k: said.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, what, **k)
        filter_audit.subset_survivors(rows, ["x", "y"])
    finally:
        filter_audit.saved = kept
    assert "Expand" in said[0] and "grouping_id" in said[0]
