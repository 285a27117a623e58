"""Every table query against its SQL, over the smallest tables."""

import math

import duckdb
import pytest

from tracelode.plans import question_queries, source_queries, table_queries

QUERIES, ORACLE = table_queries.QUERIES | source_queries.QUERIES | question_queries.QUERIES, table_queries.ORACLE | source_queries.ORACLE | question_queries.ORACLE
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple("~" if v is None else f"{v:.6f}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    want = rel.fetchall()
    at = [rel.columns.index(c) for c in columns]
    assert plain([tuple(r[c] for c in columns) for r in df.collect()]) == plain([tuple(r[i] for i in at) for r in want])
