"""Comparing a DataFrame with what DuckDB gives for a query."""

from pathlib import Path

SF = "/root/testdata/sf0.001"


def plain(value):
    """Values of Spark and DuckDB in one form."""
    if hasattr(value, "quantize"):
        return int(value) if value == value.to_integral_value() else float(value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sql, sf=SF):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    return sorted(names), rows_of(names, found.fetchall())


def agree(df, sql, sf=SF):
    names, rows = duck(sql, sf)
    assert sorted(df.columns) == names
    assert rows_of(df.columns, df.collect()) == rows
