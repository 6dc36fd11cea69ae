"""HTML character references."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """``text`` with character references resolved; null stays null.

    Spark has no such function.  Only texts with an ampersand travel to Python; the others pass
    as null and come back from the JVM side unchanged.
    """
    return F.coalesce(pandas_udf(_unescape, StringType())(F.when(F.contains(text, F.lit("&")), text)), text)
