"""Compares queries with their SQL: ``python tests/oracle.py SF NAME...`` or ``SF --all``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = Path("/root/testdata")


def rows_of(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def plain(x):
        if x is None or x is pd.NA or x != x:
            return None
        if isinstance(x, float):
            return round(x, 5)
        if hasattr(x, "isoformat"):
            return x.isoformat()[:26].removesuffix("T00:00:00")
        return x.item() if hasattr(x, "item") else x

    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


def database(sf: str):
    con = duckdb.connect()
    for p in sorted((DATA / sf).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def compare(spark, con, sf: str, name: str, query, sql: str | None) -> str:
    began = time.time()
    mine = query(spark, str(DATA / sf)).toPandas()
    took = time.time() - began
    if sql is None:
        return f"rows {len(mine)} ({took:.1f} s)"
    theirs = con.sql(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns), f"{name}: columns {sorted(mine.columns)} {sorted(theirs.columns)}"
    a, b = rows_of(mine), rows_of(theirs)
    if a != b:
        x, y = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
        raise AssertionError(f"{name}: {len(a)} and {len(b)} rows; only here {x}; only in SQL {y}")
    return f"equal, {len(a)} rows ({took:.1f} s)"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from litloom.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    session, con = local_session(), database(sf)
    session.sparkContext.setLogLevel("ERROR")
    every, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in every if names == ["--all"] else names:
        try:
            print(name, compare(session, con, sf, name, every[name], sql.get(name)), flush=True)
        except Exception as e:
            failed += 1
            print(name, "FAILED", str(e)[:900], flush=True)
    sys.exit(bool(failed))
