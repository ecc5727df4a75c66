"""Run registered queries in Spark and their SQL in DuckDB, compare the results.

    python tests/check.py [sf] [name-part ...]
"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (not isinstance(v, (list, tuple, dict)) and not hasattr(v, "__len__") and pd.isna(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{v + 0.0:.6g}" if abs(v) < 1e-12 else repr(float(v))
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if isinstance(v, list):
        return str([_cell(x) for x in v])
    return str(v)


def rows_of(table):
    names = sorted(table.schema.names)
    cols = [table.column(n).to_pylist() for n in names]
    return names, sorted(zip(*[[_cell(v) for v in c] for c in cols]))


def compare(spark_df, con, sql):
    got = spark_df.toArrow()
    want = con.execute(sql).to_arrow_table()
    gn, g = rows_of(got)
    wn, w = rows_of(want)
    if gn != wn:
        return f"columns {gn} <> {wn}"
    for n in gn:
        a, b = str(got.schema.field(n).type), str(want.schema.field(n).type)
        if a.split("[")[0].split("<")[0] != b.split("[")[0].split("<")[0]:
            return f"type of {n}: {a} <> {b}"
    if len(g) != len(w):
        return f"rows {len(g)} <> {len(w)}"
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    if bad:
        return f"{len(bad)} of {len(g)} rows differ, first: {bad[0]}"
    return None if g else "EMPTY result"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    from plotwise import catalog
    from plotwise.session import build_session

    catalog.load()
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    failed = []
    for name, fn in catalog.QUERIES.items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        t = time.time()
        try:
            if name in catalog.ORACLE:
                note = compare(fn(spark, sf_dir), con, catalog.ORACLE[name])
            else:
                n = len(fn(spark, sf_dir).toArrow())
                note = None if n else "EMPTY result"
                name += f" (rows only: {n})"
        except Exception as e:  # noqa: BLE001
            note = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if note is None else 'FAIL'} {time.time() - t:6.2f}s {name}" + (f"\n     {note}" if note else ""), flush=True)
        if note:
            failed.append(name)
    print(f"failed: {len(failed)} {failed}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
