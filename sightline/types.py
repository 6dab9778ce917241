"""Column classification and small schema helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The substrings that mark a column for a domain check.
AGE_WORDS = ("age",)
PERCENT_WORDS = ("percent", "rate", "ratio")
MONEY_WORDS = ("salary", "price", "cost", "amount")
GEO_WORDS = ("lat", "lon", "city", "state", "country", "zip", "postal")


def col(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def num(name: str) -> Column:
    """Numeric column as double."""
    return col(name).cast("double")


def sql_num(name: str) -> str:
    """SQL text of a numeric column as double.

    Long lists of aggregates are written as SQL text: one parse is much cheaper than a call per operator.
    """
    return "cast(`" + name.replace("`", "``") + "` as double)"


def sql_lit(x: float) -> str:
    """SQL text of a double literal."""
    x = float(x)
    if math.isinf(x) or math.isnan(x):
        return f"double('{x}')"
    return f"({x!r}D)" if x < 0 else f"{x!r}D"


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_string(f.dataType)]


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; the table has {df.columns}")


def name_has(name: str, words: tuple[str, ...]) -> bool:
    lowered = name.lower()
    return any(w in lowered for w in words)


def chunks(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A column-sized result as a DataFrame (never table-sized data)."""
    return spark.createDataFrame(rows, schema)
