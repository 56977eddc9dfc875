"""Null-aware expression helpers (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip_lower(col, lower: float) -> Column:
    """``max(col, lower)`` that keeps NULL as NULL (``greatest`` skips NULLs)."""
    c = _c(col)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(c, F.lit(lower)))


def safe_div(a, b) -> Column:
    """Division that yields NULL instead of raising under ANSI mode."""
    return F.try_divide(_c(a), _c(b))


def n_unique(col) -> Column:
    """Distinct count where NULL counts as one more value (aggregate)."""
    c = _c(col)
    return (F.count_distinct(c) + F.max(c.isNull().cast("int"))).cast("bigint")


def first_by_key(col, order_cols: Sequence | None) -> Column:
    """Deterministic "first" of a group.

    With ``order_cols`` (names or columns): the value at the smallest row key.
    A single numeric key keeps the aggregate hash-based; several make a struct,
    which Spark aggregates by sorting. Without ``order_cols``: the group minimum.
    """
    c = _c(col)
    if not order_cols:
        return F.min(c)
    key = F.struct(*[_c(k) for k in order_cols]) if len(order_cols) > 1 else _c(order_cols[0])
    return F.min_by(c, key)


def row_hash(key_cols: Sequence[str], seed: int = 0) -> Column:
    """60 well-mixed bits of the row key and a seed, as a non-negative bigint.

    The first 15 hex digits of the MD5 of the joined key: the same in any SQL
    engine, no arithmetic that could overflow, every key bit reaches every hash bit.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key_cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def portable_bucket(key_cols: Sequence[str], k: int, seed: int = 0) -> Column:
    """``row_hash mod k``: deterministic, engine-independent, a per-row projection."""
    return row_hash(key_cols, seed) % F.lit(k).cast("bigint")


def round_half_up(col, digits: int = 6) -> Column:
    """``floor(x·10^d + 0.5) / 10^d`` on the binary value.

    Built from IEEE basic operations only, so any engine returns the same
    double (``round`` implementations differ on decimal ties). NULL, NaN,
    ±inf pass through unchanged, and so do magnitudes from 1e12 on, where a
    double holds no six decimals. Presentation only.
    """
    c = _c(col).cast("double")
    scale = float(10 ** digits)
    return (F.when(c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(1e12)), c)
             .otherwise(F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every float/double column (stable cross-engine comparison)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_half_up(f.name, digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
