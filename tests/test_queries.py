"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF

NAMES = ["er_name_normalize", "er_address_normalize", "er_city_state", "er_block_evidence_topk", "er_bm25_topk", "er_tfidf_char_topk", "er_tfidf_word_topk", "er_embedding_topk", "er_ground_truth", "er_pair_features_60", "er_threshold_grid", "er_recall_gate", "er_validate_submission"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_rows_are_the_sqls(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    cur = duck.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=str)


def test_every_query_is_callable():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 45 and all(map(callable, q.values()))
    assert len([n for n in q if n.startswith("er_")]) - len([n for n in sql if n.startswith("er_")]) == 3
