import random
import re

import pytest

from convolake.llm.licenses import TEMPLATES, bands_for, license_scan

SCHEMA = "doc_id long, text string, license string, words int"


def words(t):
    return [w for w in re.split(r"[^\w]+|_+", (t or "").lower()) if w]


def shingles(t, n=5):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows):
    out = []
    for d, t in rows:
        own = shingles(t)
        out += [(d, k, len(x), len(x & own)) for k, said in TEMPLATES.items() if len((x := shingles(said)) & own) >= 0.8 * len(x)]
    return sorted(out, key=str)


def test_matches(spark):
    deal = random.Random(2)
    say = lambda n: " ".join(deal.choice(["lorem", "ipsum", "the", "software", "license", "under"]) for _ in range(n))
    rows = []
    for d in range(150):
        own = deal.choice([*TEMPLATES.values()]).split(" ")
        for _ in range(deal.choice([0, 0, 1, 2])):
            own[deal.randrange(len(own))] = "other"
        rows.append((d, say(deal.choice([0, 5, 60])) + "\n# " + deal.choice([" ", "\n# "]).join(own).upper() + " " + say(deal.choice([0, 9, 900]))))
    rows += [(200, None), (201, ""), (202, "under the license"), (None, TEMPLATES["MIT"]), (7, rows[7][1]), (203, "x " * 60_000 + TEMPLATES["MPL-2.0"] + " y" * 60_000), (204, " ".join(TEMPLATES.values()))]
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.license, r.n_shingles, r.n_shared) for r in license_scan(df).collect()), key=str)
    assert got == brute(rows) and len(got) > 90
    assert license_scan(df.limit(0)).collect() == []


def test_templates_need_a_shingle(spark):
    with pytest.raises(ValueError):
        license_scan(spark.createDataFrame([(1, "x", "", 1)], SCHEMA), {"short": "two words"})


def test_bands_follow_from_the_window():
    b = bands_for([5, 8], 16, 0.8, 1e-4)
    assert (1 - 4 / (16 + 5 - 4)) ** b <= 1e-4 < (1 - 4 / (16 + 5 - 4)) ** (b - 1)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(((r.doc_id, r.license, r.n_shingles, r.n_shared) for r in license_scan(docs).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
