import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("CORPUSLOOM_DATA", "/root/testdata/sf0.001")


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")

    def plain(v):
        if v is None or isinstance(v, float) and v != v:
            return None
        if isinstance(v, float) or hasattr(v, "is_finite"):
            return round(float(v), 6) + 0.0
        if isinstance(v, list | tuple):
            return tuple(plain(x) for x in v)
        return str(v)[:26] if hasattr(v, "year") else v

    df = entry.queries()[name](spark, DATA)
    relation = connection.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    places = [relation.columns.index(c) for c in columns]
    rows = relation.limit(10**9).fetchall()
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == sorted(repr(tuple(plain(r[i]) for i in places)) for r in rows)
