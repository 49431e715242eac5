"""Run registered queries next to their SQL twins: python tests/compare.py [sf] [name ...]"""

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def tidy(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pdf[c].dtype == object:
            pdf[c] = pdf[c].map(lambda v: "NULL" if v is None or v is pd.NA or v != v else str(v))
        elif pdf[c].dtype == bool:
            pdf[c] = pdf[c].astype(str)
        else:
            pdf[c] = pdf[c].astype(float)
    return pdf.sort_values(list(pdf.columns), kind="stable").reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame, slack: float = 0.0) -> list[str]:
    out = []
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} vs {sorted(want.columns)}"]
    if len(got) != len(want):
        return [f"rows {len(got)} vs {len(want)}"]
    a, b = tidy(got), tidy(want)
    for c in a.columns:
        if a[c].dtype == object or b[c].dtype == object:
            bad = (a[c].astype(str) != b[c].astype(str)).sum()
            if bad:
                i = np.flatnonzero(a[c].astype(str) != b[c].astype(str))[0]
                out.append(f"{c}: {bad} differ, e.g. {a[c][i]!r} vs {b[c][i]!r}")
        else:
            x, y = a[c].to_numpy(), b[c].to_numpy()
            same = (x == y) | (np.isnan(x) & np.isnan(y))
            if not same.all() and np.any(y[~np.isnan(y)] % 1):
                # a sum's last bit may tip a value that lies on a rounding tie
                same |= np.abs(x - y) <= slack
            if not same.all():
                i = np.flatnonzero(~same)[0]
                out.append(f"{c}: {(~same).sum()} differ, e.g. {x[i]!r} vs {y[i]!r}")
    return out


def main(sf="0.01", *names):
    import __spark_entry__ as e
    from tabwright.session import build_session
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con, sql, failed = duck(sf_dir), e.oracle_sql(), []
    for name, fn in e.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
        except Exception as err:                                         # noqa: BLE001
            failed.append(name)
            print(f"FAIL {name}: {type(err).__name__} {str(err)[:600]}", flush=True)
            continue
        took = time.time() - start
        if name not in sql:
            print(f"rows {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        start = time.time()
        try:
            bad = differences(got, con.execute(sql[name]).df())
        except Exception as err:                                         # noqa: BLE001
            bad = [f"oracle {type(err).__name__} {str(err)[:300]}"]
        if bad:
            failed.append(name)
        print(f"{'BAD ' if bad else 'ok  '} {name}: {len(got)} rows {took:.1f}s / duck {time.time()-start:.1f}s "
              f"{bad if bad else ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(*sys.argv[1:])
