"""The registered queries of the training-data operators against their SQL in DuckDB."""

import duckdb
import pytest

from farspread.llm import queries

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", [*queries.SQL])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    df = queries.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    plain = lambda rows: sorted(repr([round(float(v), 5) if isinstance(v, float) else v for v in r]) for r in rows)
    got, want = plain(df.select(cols).collect()), plain(con.sql(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall())
    assert got == want and len(got) > 400
