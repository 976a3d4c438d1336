"""Queries with an SQL twin against it, on the smallest tables and on tables with quotes."""

import duckdb
import pytest

from conftest import SMALL
from larder.llm.queries import ORACLE, QUERIES


def both(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = QUERIES[name](spark, folder)
    rel = con.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    mine = sorted((tuple(r[c] for c in order) for r in df.collect()), key=str)
    return mine, sorted((tuple(dict(zip(names, r))[c] for c in order) for r in rel.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_small_tables(spark, name):
    mine, theirs = both(spark, name, SMALL)
    assert mine == theirs and mine


def test_quotes(spark, tmp_path):
    from test_quotation import make
    import pandas as pd
    rows = [(c, t, r, x) for c, t, r, x, _ in make(11, convs=5)]
    pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).to_parquet(f"{tmp_path}/conversations.parquet")
    pd.DataFrame({"doc_id": [1], "text": ["x"], "source": ["s"]}).to_parquet(f"{tmp_path}/documents.parquet")
    mine, theirs = both(spark, "op8_quotation", str(tmp_path))
    assert mine == theirs and any(r[2] for r in mine)
