"""Tables that grow by batches, and all outputs of a reading or none."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from convolake.streaming import incremental, ingest
from convolake.streaming.store import Log, Store

ROW = "platform string, conversation_id string, n int, said string"


def put(old, new):
    return old.join(new.select("platform", "conversation_id"), ["platform", "conversation_id"], "left_anti").unionByName(new)


def written(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_buckets_part_and_rows_stay(spark, tmp_path):
    deal, log = random.Random(1), Log(spark, f"{tmp_path}/log")
    store, held = Store(f"{tmp_path}/t", log, size=4000), {}
    assert store.read() is None and store.write(spark.createDataFrame([], ROW), 0, put) is None
    for number in range(1, 4):
        rows = [("p", f"c{deal.randint(0, 250)}", number, "x" * deal.randint(0, 200)) for _ in range(120)]
        rows = list({r[1]: r for r in rows}.values())
        store.write(spark.createDataFrame(rows, ROW), number, put)
        assert {r.conversation_id: r.n for r in (store.read().collect() if store.read() else [])} == {k: v[2] for k, v in held.items()}, "seen before it counts"
        log.commit(number)
        held |= {r[1]: r for r in rows}
        assert sorted(map(tuple, store.read().select("platform", "conversation_id", "n", "said").collect())) == sorted(held.values())
    buckets = store.buckets().collect()
    assert len(buckets) > 2 and sum(r.rows for r in buckets) == len(held) and sum(2.0 ** -r.depth for r in buckets) == 1
    assert max(r.size for r in buckets) < 3 * 4000
    before = {r.conversation_id for r in store.read(3).collect()}
    assert len(before) < len(held) and store.vacuum(keep=2) > 0
    assert {r.conversation_id for r in store.read(3).collect()} == before and store.read().count() == len(held)
    assert store.vacuum() > 0 and store.vacuum() == 0 and store.read().count() == len(held)
    live = {(f"run={r.folder}", f"bucket={r.depth}-{r.prefix}") for r in store.buckets().collect() if r.folder}
    assert {(p.parent.name, p.name) for p in Path(f"{tmp_path}/t/rows").glob("*/bucket=*")} == live


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    """The same batch on a table ten times as large."""
    one, wrote = spark.createDataFrame([("p", "c7", 1, "new")], ROW), []
    for size in (1000, 10_000):
        log = Log(spark, f"{tmp_path}/{size}/log")
        store = Store(f"{tmp_path}/{size}/t", log, size=20_000)
        store.write(spark.range(size).select(F.lit("p").alias("platform"), F.concat(F.lit("c"), "id").alias("conversation_id"), F.lit(0).alias("n"), F.repeat(F.lit("y"), 50).alias("said")), 0, put)
        log.commit(0)
        before = written(f"{tmp_path}/{size}/t/rows")
        store.write(one, 1, put)
        log.commit(1)
        wrote.append(written(f"{tmp_path}/{size}/t/rows") - before)
        assert store.read().where("n = 1").count() == 1 and store.read().count() == size
    assert wrote[1] < 2 * wrote[0] + 2000


def test_one_large_conversation_is_not_parted(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/log")
    store = Store(f"{tmp_path}/t", log, size=100)
    store.write(spark.createDataFrame([("p", "big", k, "x" * 100) for k in range(50)] + [(None, None, 1, None)], ROW), 3, put)
    log.commit(3, {"written": 2})
    assert store.read().count() == 51 and max(r.depth for r in store.buckets().collect()) <= 1 and log.counts(3) == {"written": 2}


READING = "platform string, conversation_id string, title string, exported_at string, html string, payload string, messages array<struct<pos:int,message_id:string,role:string,texte:string>>"


def reading(cid, n, at, title="T", html=None, payload=None, p="claude"):
    return (p, cid, title, at, html, payload, [(k, f"{cid}{k}", "user", f"t{k}") for k in range(n)])


def state(out):
    said = lambda s, *c: sorted(tuple(r[x] for x in c) for r in s.read().collect()) if s.read() is not None else []
    return said(out.messages, "conversation_id", "pos"), said(out.artefacts, "conversation_id", "kind", "content"), said(out.inventory, "conversation_id", "title", "message_count", "status", "written_at")


def test_outputs_of_readings(spark, tmp_path):
    out = ingest.Ingest(spark, f"{tmp_path}/out")
    first = [reading("a", 2, "1", html="<a>"), reading("b", 3, "1", payload="{b}"), reading("a", 1, "0", html="old")]
    assert out.step(spark.createDataFrame(first, READING), 0) == {"written": 2}
    second = [reading("a", 3, "2", "", payload="{a}"), reading("b", 1, "2", "B", payload="{part}"), reading("c", 1, "2"), reading("d", 1, "2", p="grok")]
    assert out.step(spark.createDataFrame(second, READING), 1) == {"patched": 1, "kept": 1, "written": 2}
    messages, artefacts, inventory = state(out)
    assert messages == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("b", 2), ("c", 0), ("d", 0)]
    assert artefacts == [("a", "raw", "{a}"), ("b", "raw", "{b}")]
    assert inventory == [("a", "T", 3, "patched", "2"), ("b", "B", 3, "kept", "1"), ("c", "T", 1, "written", "2"), ("d", "T", 1, "written", "2")]
    assert out.step(spark.createDataFrame(second[:1], READING), 2) == {"unchanged": 1}
    assert [(r.conversation_id, r.place) for r in out.ordered_inventory().orderBy("platform", "place").collect()] == [("a", 1), ("c", 2), ("b", 3), ("d", 1)]
    assert out.log.counts(1) == {"patched": 1, "kept": 1, "written": 2}


@pytest.mark.parametrize("broken", ["inventory", "log"])
def test_a_batch_that_breaks_off_between_outputs(spark, tmp_path, broken, monkeypatch):
    out, twin = ingest.Ingest(spark, f"{tmp_path}/out"), ingest.Ingest(spark, f"{tmp_path}/twin")
    rows = [spark.createDataFrame([reading("a", 1, "1", html="<a>"), reading("b", 2, "1")], READING), spark.createDataFrame([reading("a", 2, "2", html="<a2>"), reading("c", 1, "2", payload="{c}")], READING)]
    for x in (out, twin):
        x.step(rows[0], 0)
    before = state(out)
    of = getattr(out, broken)
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(of, "commit" if broken == "log" else "write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        out.step(rows[1], 1)
    assert state(out) == before
    for _ in range(2):  # run again, and once more after it counts
        out.step(rows[1], 1)
    twin.step(rows[1], 1)
    assert state(out) == state(twin) != before
    out.messages.vacuum()
    assert state(out) == state(twin)


def test_streams_of_readings(spark, tmp_path):
    for k, rows in enumerate(([reading("a", 1, "1")], [reading("a", 2, "2"), reading("b", 1, "2")])):
        spark.createDataFrame(rows, READING).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    out = ingest.Ingest(spark, f"{tmp_path}/out")
    for k in range(2):
        out.follow(incremental.read_stream(spark, f"{tmp_path}/in{k}", spark.createDataFrame([], READING).schema), f"{tmp_path}/check{k}") .awaitTermination() if k == 0 else out.step(spark.read.parquet(f"{tmp_path}/in1"), 1)
    assert state(out)[0] == [("a", 0), ("a", 1), ("b", 0)]


def test_summaries_of_runs(spark):
    listed = spark.createDataFrame([("p", f"c{k}", k == 6) for k in range(8)] + [("q", "z", False)], "platform string, conversation_id string, unavailable boolean")
    status = ["written", "patched", "unchanged", "kept", "failed", "rewritten"]
    tried = spark.createDataFrame([("p", f"c{k}", s) for k, s in enumerate(status)], "platform string, conversation_id string, status string")
    got = {r.platform: tuple(r)[1:] for r in ingest.run_summary(listed, tried).collect()}
    assert got == {"p": (8, 6, 3, 1, 2, 1, 1), "q": (1, 0, 0, 0, 0, 0, 0)}
