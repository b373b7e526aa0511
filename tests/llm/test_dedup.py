import hashlib
import re

import pytest
from pyspark.sql import functions as F

from convolake.llm.exact_dedup import DigestIndex, exact_dedup
from convolake.llm.common import texts

SCHEMA = "doc_id long, text string, digest string, n int, bucket int, keep_id long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA)


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for t, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        keep = known[0] if known else None
        for k, i in enumerate([*known, *[None] * (len(ids) - len(known))]):
            out.append((i, keep, len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(5, "a  b\n"), (2, "a b "), (9, None), (3, ""), (4, " "), (7, "\x0b\x0c"), (1, "A b "), (8, "a\xa0b"), (2, "a b "), (None, "a b "), (None, "z"), (6, "word " * 50_000), (10, "word  " * 50_000)]


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_groups_and_collisions(spark, digest_bytes):
    rows = ROWS + [(100 + i, f"t{i % 300}") for i in range(900)]
    got = exact_dedup(docs(spark, rows), digest_bytes=digest_bytes, memtable_rows=50).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)


def test_hot_group(spark):
    rows = [(i, "same") for i in range(3000)] + [(5000 + i, f"{i // 2}") for i in range(3000)]
    assert sorted((tuple(r)[:5] for r in exact_dedup(docs(spark, rows)).collect()), key=str) == brute(rows)


def test_runs_are_merged(spark):
    index = DigestIndex()
    first, second = texts(docs(spark, [(3, "x"), (4, "y")])), texts(docs(spark, [(1, "x"), (2, "z")]))
    index.flush(first)
    index.flush(second)
    index.compact()
    got = {r.doc_id: r.keep_id for r in index.resolve(first.unionByName(second)).collect()}
    assert got == {1: 1, 3: 1, 4: 4, 2: 2}


def test_batches_meet_older_levels(spark):
    rows = [(i, f"t{i % 90}") for i in range(400)] + [(1000 - i, f"t{i}") for i in range(60, 140)] + ROWS
    index, batches = DigestIndex(memtable_rows=30), [rows[k::3] for k in range(3)]
    for b in batches:
        index.flush(texts(docs(spark, b)))
        index.compact()
        index.compact()
    got = index.resolve(texts(docs(spark, [r for b in batches for r in b]))).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    levels = {r.digest: r.n for r in index.merged.collect()}
    assert len(levels) == index.merged.count() and sum(levels.values()) == len(rows)


def test_empty(spark):
    assert exact_dedup(docs(spark, [(1, "x")]).where(F.lit(False))).collect() == []


def test_tables_are_released(spark):
    from pathlib import Path

    from convolake.llm.common import released, saved, scratch

    here = lambda: {p.name for p in Path(scratch(spark).removeprefix("file://")).glob("*")}
    saved(spark.range(1), "before")
    known = here()
    with released(spark):
        kept = saved(exact_dedup(docs(spark, ROWS)), "kept", outer=True)
        assert len(here()) > len(known) + 1
    assert len(here()) == len(known) + 1 and kept.count() == len(ROWS)
