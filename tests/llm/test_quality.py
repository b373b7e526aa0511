from zlib import crc32

import numpy as np

from convolake.llm.quality import features, quality, train
from convolake.llm.common import texts

SCHEMA = "doc_id long, text string, score double, held_out string"
LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    good = [p for p, y in held if y]
    bad = [p for p, y in held if not y]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.05


def test_odd_rows(spark):
    rows = [(1, "fine words here", 0.0, "c"), (2, None, 0.0, "c"), (3, "", 0.0, "c"), (4, "BAD!! BAD!!", 0.0, "c"), (4, "BAD!! BAD!!", 0.0, "c"), (None, "x", 0.0, "c"), (5, "w " * 100_000, 0.0, "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, None), (4, 0, 0), (4, 0, 1), (99, 1, 1), (None, 1, 1), (3, None, 0)], LABELS)
    got = quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality(docs.limit(0), labels).collect() == []


def test_training_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"w{i % 2} x", 0.0, "c") for i in range(200)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, label int, toxic int")
    weights, _ = train(texts(docs), labels, max_train=50)
    assert weights[features("w1 x")].sum() > weights[features("w0 x")].sum()
    assert len(features("")) == 0 and len(features("a b")) == 6


def test_a_repeated_document_teaches_once(spark):
    rows = [(1, f"good words {i}", 0.0, "c") for i in range(500)] + [(2, "bad", 0.0, "c")]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    weights, _ = train(texts(spark.createDataFrame(rows, SCHEMA)), labels)
    assert 0 < np.count_nonzero(weights) <= len(features("good words 7")) + len(features("bad"))
