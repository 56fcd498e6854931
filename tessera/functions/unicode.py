"""Exact Unicode forms that no built-in expression gives, over Arrow batches.

Each is a barrier to the optimiser: apply it after filters.  For Latin and CJK
text lower() agrees with casefold.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Full case folding: ß becomes ss, a final sigma an ordinary one."""
    return text.map(lambda t: t.casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """The compatibility composition of a text."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def search_form(text: pd.Series) -> pd.Series:
    """The case-folded compatibility composition, which texts and queries are searched in."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")
