"""Probabilities as they are written: two places, half to even on the binary value."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def probability(x: Column) -> Column:
    """Two places, between 0.01 and 0.99."""

    @F.pandas_udf("double")
    def write(s: pd.Series) -> pd.Series:
        return s.map(lambda v: min(0.99, max(0.01, round(v, 2))), na_action="ignore")

    return write(x)


def correction(x: Column, positive: bool = True) -> Column:
    """Two places, at least 0.01 where only positive values make sense."""

    @F.pandas_udf("double")
    def write(s: pd.Series) -> pd.Series:
        return s.map(lambda v: max(0.01, round(v, 2)) if positive else round(v, 2), na_action="ignore")

    return write(x)


def from_log10(x: Column) -> Column:
    return F.pow(F.lit(10.0), x)


def log10_to_ln(x: Column) -> Column:
    return x * F.ln(F.lit(10.0))
