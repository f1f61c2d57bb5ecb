"""Local DuckDB oracle and result comparison (mirrors the driver's check:
row count, column names, order-insensitive values)."""

from __future__ import annotations

import math
from dataclasses import dataclass

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duckdb_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in DRIVER_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con


def run_oracle(con, sql: str):
    return con.execute(sql).fetch_df()


@dataclass
class Comparison:
    rows_spark: int
    rows_oracle: int
    columns_equal: bool
    values_equal: bool
    exact: bool
    detail: str = ""

    @property
    def ok(self) -> bool:
        return self.rows_spark == self.rows_oracle and self.columns_equal and self.values_equal


def _norm(v, digits):
    if v is None:
        return None
    try:
        import pandas as pd
        if v is pd.NA or v is pd.NaT:
            return None
    except Exception:  # pragma: no cover
        pass
    try:
        import numpy as np
        if isinstance(v, np.generic):
            v = v.item()
    except Exception:  # pragma: no cover
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if digits is None:
            return v
        return float(f"{v:.{digits}g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x, digits) for x in v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    return v


def _rows(pdf, cols, digits):
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v, digits) for v in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark_pdf, oracle_pdf, digits: int = 12) -> Comparison:
    sc, oc = sorted(spark_pdf.columns), sorted(oracle_pdf.columns)
    cols_eq = sc == oc
    if not cols_eq:
        return Comparison(len(spark_pdf), len(oracle_pdf), False, False, False,
                          f"columns spark={sc} oracle={oc}")
    exact = _rows(spark_pdf, sc, None) == _rows(oracle_pdf, sc, None)
    a, b = _rows(spark_pdf, sc, digits), _rows(oracle_pdf, sc, digits)
    eq = a == b
    detail = ""
    if not eq:
        for x, y in zip(a, b):
            if x != y:
                detail = f"first diff spark={x} oracle={y}"
                break
    return Comparison(len(spark_pdf), len(oracle_pdf), True, eq, exact, detail)
