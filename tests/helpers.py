"""Comparison of Spark results with DuckDB."""

from ridgeline.session import TABLES

SMALL = "/root/testdata/sf0.001"


def in_duckdb(sql, tables=None, root=SMALL):
    """Rows of a DuckDB query over the test tables, or over Arrow tables."""
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        if tables and name in tables:
            con.register(name, tables[name])
        else:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con.sql(sql)


def same_rows(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
    theirs = sorted(relation.select(*columns).fetchall(), key=repr)
    assert ours == theirs
