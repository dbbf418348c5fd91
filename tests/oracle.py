"""Comparison of a query with its SQL on one data directory."""

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connection(d: str = DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{d}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def differences(df, sql: str, path: str, d: str = DATA) -> tuple[int, int, int]:
    """(rows of the SQL, rows only there, rows only in Spark)."""
    df.write.mode("overwrite").parquet(path)
    con = connection(d)
    con.execute(f"CREATE TABLE o AS {sql}")
    con.execute(f"CREATE TABLE s AS SELECT * FROM read_parquet('{path}/*.parquet')")
    names = sorted(r[0] for r in con.execute("DESCRIBE o").fetchall())
    assert names == sorted(r[0] for r in con.execute("DESCRIBE s").fetchall())
    cols = ", ".join(f'"{n}"' for n in names)
    count = lambda a, b: con.execute(f"SELECT count(*) FROM (SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b})").fetchone()[0]
    return con.execute("SELECT count(*) FROM o").fetchone()[0], count("o", "s"), count("s", "o")
