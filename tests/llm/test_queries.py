"""The registered queries against DuckDB, where SQL can express them; and all of them for rows and columns."""

import math

import duckdb
import pytest

from convolake.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1": ["doc_id", "held_out", "score", "predicted"], "op2": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], "op4": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op5": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "op7": ["doc_id", "n_words", "n_removed", "kept_sha256"], "op8": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op11": ["word", "form", "root", "n", "n_near", "form_n"], "op12": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"], "op13": ["doc_id", "start", "n_tokens", "ids_crc32"],
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    clean = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    mine = sorted((tuple(clean(v) for v in r) for r in got.select(*columns).collect()), key=str)
    assert mine == sorted((tuple(clean(v) for v in r) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    for c in COLUMNS.get(name.split("_")[0], ["doc_id"]):
        assert c in got.columns
