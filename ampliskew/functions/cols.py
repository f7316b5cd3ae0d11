"""Small column helpers shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd(x, digits: int = 6) -> Column:
    """Round and fold -0.0 into 0.0."""
    return F.round(c(x), digits) + F.lit(0.0)


def ratio(a, b) -> Column:
    """a / b as DOUBLE, NULL when b is 0 or NULL."""
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def ratio0(a, b) -> Column:
    """a / b as DOUBLE, 0.0 when b is 0 or NULL."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def blank_to_null(x) -> Column:
    return F.nullif(F.trim(c(x)), F.lit(""))


def text_or(x, default: str) -> Column:
    """The text, or ``default`` when it is NULL or blank."""
    return F.coalesce(blank_to_null(x), F.lit(default))


def require(df: DataFrame, columns, table: str = "table") -> DataFrame:
    missing = [x for x in columns if x not in df.columns]
    if missing:
        raise ValueError(f"{table} missing required columns: {missing}")
    return df


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds)


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds)


def finite(x) -> Column:
    """The number as DOUBLE; NaN and infinities become NULL."""
    d = c(x).cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), None).otherwise(d)


def number(x) -> Column:
    """Text or number as a finite DOUBLE, NULL when it does not parse."""
    return finite(c(x).try_cast("double"))
