"""Compare a Spark query with its DuckDB oracle SQL (development check).

Mirrors the driver's gate: same column names, same row count, and equal
values after sorting columns by name and rows by value.  Floats are compared
after rounding to 6 decimals.
"""

from __future__ import annotations

import math
import time

import pandas as pd
from pyspark.sql import types as T

from ..sources.tables import TABLES


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v):
    if v is None or v is pd.NA:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _canon(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _canon(v.tolist())
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_canon(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, pd.Timestamp):
        return str(v.to_pydatetime())
    return str(v)


def canonical_rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = [tuple(_canon(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return sorted(rows)


def compare(spark, sf_dir: str, names=None, con=None, verbose=True) -> dict:
    import importlib
    entry = importlib.import_module("__spark_entry__")
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = con or duck(sf_dir)
    out = {}
    for name in names or list(qs):
        rec = {}
        try:
            t0 = time.time()
            sdf = qs[name](spark, sf_dir)
            spd = sdf.toPandas()
            for f in sdf.schema:  # integers with NULLs must not become floats
                if isinstance(f.dataType, (T.LongType, T.IntegerType)):
                    spd[f.name] = spd[f.name].astype("Int64")
            rec["spark_s"] = round(time.time() - t0, 2)
            rec["rows"] = len(spd)
            if name in sqls:
                opd = con.execute(sqls[name]).fetchdf()
                for c in opd.columns.intersection(spd.columns):
                    if str(spd[c].dtype) == "Int64" and opd[c].dtype.kind in "fiu":
                        opd[c] = opd[c].astype("Int64")
                rec["oracle_rows"] = len(opd)
                same_cols = sorted(spd.columns) == sorted(opd.columns)
                rec["columns_match"] = same_cols
                if not same_cols:
                    rec["spark_cols"] = sorted(spd.columns)
                    rec["oracle_cols"] = sorted(opd.columns)
                a, b = canonical_rows(spd), canonical_rows(opd) if same_cols else []
                rec["match"] = same_cols and a == b
                if same_cols and a != b:
                    diff_a = [r for r in a if r not in set(b)][:3]
                    diff_b = [r for r in b if r not in set(a)][:3]
                    rec["spark_only"], rec["oracle_only"] = diff_a, diff_b
            else:
                rec["match"] = None
        except Exception as e:  # noqa: BLE001 - report and continue
            rec["error"] = f"{type(e).__name__}: {str(e)[:400]}"
            rec["match"] = False
        out[name] = rec
        if verbose:
            print(name, rec, flush=True)
    return out
