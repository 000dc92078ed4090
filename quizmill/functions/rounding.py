"""Rounding as Python has it: the binary value, halves to even."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def half_even(x: pd.Series, digits: pd.Series) -> pd.Series:
    """x rounded to digits places; null and not-a-number stay. Built-in rounding goes by the shortest decimal text, so 2.675 gives 2.68 there and 2.67 here."""
    return pd.Series([None if v is None or v != v else round(v, int(n)) for v, n in zip(x, digits, strict=True)], dtype="float64")
