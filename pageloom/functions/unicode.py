"""NFKC, for which Spark has no expression: the one Arrow UDF of the cleaning stage."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    # ASCII is its own normal form.
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))
