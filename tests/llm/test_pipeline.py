import re

import pytest
import sentencepiece

import corpus_pipeline
from convolake.llm.pieces import model_bytes
from convolake.llm.quality import quality


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    return {tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, sf_dir)
        assert k == len(corpus_pipeline.STAGES) - 1 or got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = got.collect()
        docs = spark.createDataFrame(rows, got.schema)
        out.append(rows)
    return out


def test_stages_against_brute_force(spark, sf_dir, stages):
    start, good, once, apart, clean, tokens = stages
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert sorted(r.doc_id for r in good) == sorted(r.doc_id for r in start if scores[r.doc_id])

    first = {}
    for r in sorted(good, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert sorted(r.doc_id for r in once) == sorted(first.values())

    sets = {r.doc_id: shingles(r.text) for r in once}
    root = {d: d for d in sets}
    find = lambda d: d if root[d] == d else find(root[d])
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in apart) == sorted({find(d) for d in ids})

    items = [shingles(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    held = [r for r in apart if not any(len(x & shingles(r.text)) >= 0.8 * len(x) for x in items)]
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in held)

    library = sentencepiece.SentencePieceProcessor(model_proto=model_bytes())
    assert {r.doc_id: r.ids for r in tokens} == {r.doc_id: library.encode(r.text) for r in held}
    assert all(r.round_trip for r in tokens)


def test_run_is_all_stages(spark, sf_dir, stages):
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted((r.doc_id, r.ids_sha256) for r in stages[-1])


def test_odd_rows_in_each_stage(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_proto=model_bytes())
    text = " ".join(f"the word{i} and" for i in range(40))
    near = text.replace("word7 ", "other ")
    rows = [(1, text), (1, text), (1, near), (2, text), (3, None), (4, ""), (None, None), (5, "a b"), (5, "c d"), (6, "THE!! " * 50_000), (None, "e f")]
    docs = spark.createDataFrame([(i, t, None, None, None, 1, True) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row_key int, kept boolean")
    seen = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    once = corpus_pipeline.exact_copies(spark, docs, sf_dir)
    assert seen(once) == sorted([(1, text), (1, near), (3, None), (5, "a b"), (5, "c d"), (6, rows[9][1]), (None, "e f")], key=str)
    assert once.columns == docs.columns
    apart = corpus_pipeline.near_copies(spark, docs, sf_dir)
    assert [x for x in seen(apart) if x[1] and len(x[1]) > 100] in ([(1, text), (6, rows[9][1])], [(1, near), (6, rows[9][1])])
    assert len(seen(apart)) == 8
    clean = corpus_pipeline.benchmark_leaks(spark, docs, sf_dir)
    assert seen(clean) == sorted(rows, key=str)
    good = seen(corpus_pipeline.quality_filter(spark, docs, sf_dir))
    assert (6, rows[9][1]) not in good and good.count((1, text)) == 2
    tokens = corpus_pipeline.encoded(spark, docs, sf_dir).collect()
    assert len(tokens) == len(rows) and all(r.round_trip and r.n_tokens == len(r.ids) for r in tokens)
    assert sorted((str(r.doc_id), r.n_tokens) for r in tokens) == sorted((str(i), len(library.encode(t or ""))) for i, t in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
