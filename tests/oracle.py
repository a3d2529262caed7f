"""Run registered queries next to their SQL twins on DuckDB and compare whole results."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]) or pd.api.types.is_integer_dtype(df[c]):
            df[c] = df[c].astype(float)
        df[c] = df[c].map(lambda v: "" if v is None or v is pd.NA or v is pd.NaT or v != v else repr(v) if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str | None:
    """A description of the first difference, None where the results are equal."""
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} != {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows {len(spark_pdf)} != {len(duck_pdf)}"
    a, b = canonical(spark_pdf), canonical(duck_pdf)
    for c in a.columns:
        bad = a[c] != b[c]
        if bad.any():
            i = bad.idxmax()
            return f"{int(bad.sum())} rows differ in {c}, first: {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"[:1500]
    return None


def schema_note(df, con, text) -> str | None:
    """Column types that look different on the two engines (integers, doubles, text)."""
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    duck = dict((r[0], r[1]) for r in con.execute("describe " + text).fetchall())
    bad = {c: (t, duck.get(c)) for c, t in df.dtypes if kinds.get(t, t) != duck.get(c)}
    return str(bad) if bad else None


def main() -> int:
    from judgealign import build_session
    from judgealign.plans import catalog

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:] or list(catalog.QUERIES)
    spark = build_session("oracle", cpus=os.environ.get("CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    failed = []
    for name in names:
        con = connect(sf)
        t0 = time.time()
        try:
            df = catalog.QUERIES[name](spark, sf)
            got = df.toPandas()
            t1 = time.time()
            if name not in catalog.ORACLES:
                print(f"{name:32s} rows-only {len(got)} {t1 - t0:.2f}s", flush=True)
                continue
            text = catalog.ORACLES[name]
            note = schema_note(df, con, text)
            diff = compare(got, con.execute(text).df())
            print(f"{name:32s} {'OK' if not diff else 'DIFF'} rows={len(got)} spark={t1 - t0:.2f}s duck={time.time() - t1:.2f}s {'TYPES ' + note if note else ''} {diff or ''}", flush=True)
            if diff or note:
                failed.append(name)
        except Exception as e:  # noqa: BLE001
            failed.append(name)
            print(f"{name:32s} ERROR {str(e)[:1200]}", flush=True)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
