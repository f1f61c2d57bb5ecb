"""Column -> Column numeric helpers shared by every operator.

All helpers are plain Catalyst expressions, so they stay inside whole-stage
codegen and can be used inside higher-order-function lambdas.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def np_round(c: str | Column, digits: int) -> Column:
    """numpy rounding rule: half-to-even on ``x * 10^digits``.

    Spark ``round`` is decimal half-up; this matches numpy and DuckDB
    ``round_even``. A rounded zero is positive: vectors drop the sign of a zero
    that scalar columns keep.
    """
    scale = float(10 ** digits)
    if digits == 0:
        return F.rint(col(c)) + F.lit(0.0)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def sql_np_round(expr: str, digits: int) -> str:
    """The same rounding rule written for the DuckDB oracle."""
    if digits == 0:
        return f"(round_even(({expr}), 0) + 0.0e0)"
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits} + 0.0e0)"


def safe_div(num: str | Column, den: str | Column, zero: float | None = 0.0) -> Column:
    """``num / den`` with ``zero`` when the denominator is 0 (ANSI-safe)."""
    d = col(den)
    return F.when(d == 0, F.lit(zero).cast("double")).otherwise(col(num) / d)


def clip_lower(c: str | Column, lower: float = 0.0) -> Column:
    """pandas ``clip(lower=)``: null stays null (``greatest`` alone would not)."""
    x = col(c)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(lower))))


def own_step(c: str | Column) -> Column:
    """The value as it is, through a higher-order function.

    Spark leaves a projection that holds one out of whole-stage code. Wide expressions beside it then become split methods,
    which HotSpot compiles, and the generators and aggregates above it stay in generated code of their own.
    """
    return F.element_at(F.transform(F.array(col(c)), lambda v: v), 1)


def case_map(c: str | Column, mapping: Mapping, default=None) -> Column:
    """Dictionary remap as a CASE expression (constant-folded, no join)."""
    x = col(c)
    out = None
    for k, v in mapping.items():
        out = (F.when(x == F.lit(k), F.lit(v)) if out is None else out.when(x == F.lit(k), F.lit(v)))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default)) if default is not None else out


def sql_case_map(expr: str, mapping: Mapping, default=None) -> str:
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, float):
            return sql_double(v)
        return str(v)

    whens = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in mapping.items())
    tail = f" else {lit(default)}" if default is not None else ""
    return f"case {expr} {whens}{tail} end"


def hash_bucket(key: str | Column, modulus: int) -> Column:
    """Deterministic bucket of a key from the first 32 bits of its md5.

    Identical to DuckDB's ``cast('0x'||substr(md5(k),1,8) as bigint) % m``.
    """
    h = F.conv(F.substring(F.md5(col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return (h % F.lit(modulus)).cast("bigint")


def sql_hash_bucket(expr: str, modulus: int) -> str:
    return f"(cast('0x' || substr(md5(cast({expr} as varchar)), 1, 8) as bigint) % {modulus})"


def sql_double(v: float) -> str:
    """A DOUBLE literal in SQL (plain ``0.5`` would be DECIMAL)."""
    s = repr(float(v))
    s = s if ("e" in s or "inf" in s or "nan" in s) else s + "e0"
    return f"({s})" if s.startswith("-") else s
