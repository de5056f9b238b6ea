"""Text similarity that the built-in functions do not offer."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F, types as T


@F.pandas_udf(T.DoubleType())
def similarity_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Share of matching characters of two short texts, 0 to 1."""
    return pd.Series([SequenceMatcher(a=a or "", b=b or "").ratio() for a, b in zip(left, right)], dtype="float64")
