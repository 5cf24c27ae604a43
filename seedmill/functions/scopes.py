"""The facts of ``names`` as a column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .names import facts

IMPORT = StructType([StructField("name", StringType()), StructField("statement", StringType())])
PROBLEM = StructType([StructField("line", IntegerType()), StructField("message", StringType())])
FACTS = StructType([
    StructField("parses", BooleanType()), StructField("imports", ArrayType(IMPORT)), StructField("undefined", ArrayType(StringType())),
    StructField("problems", ArrayType(PROBLEM)), StructField("head", IntegerType()),
])


@F.pandas_udf(FACTS)
def _facts(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([facts(c) for c in code], columns=FACTS.names)


def scope_facts(code: Column) -> Column:
    """FACTS as a struct; marked nondeterministic so that a filter on it doesn't analyse again."""
    return _facts.asNondeterministic()(code)
