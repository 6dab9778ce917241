"""Value counts in long form, duplicate rows, and group totals; all reduced map-side before any shuffle."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.session import cut_lineage
from sightline.types import chunks, col, is_nested

MAX_WORDS = 1 << 23  # 64-bit words of the largest table of bits that is broadcast
MOST_LOADED = 0.7  # hashes per bit beyond which half of all rows would be candidates


def comparable(df: DataFrame, name: str) -> Column:
    """A form of the column that can be grouped: maps and variants become JSON text."""
    dtype = df.schema[name].dataType
    return F.to_json(col(name)) if isinstance(dtype, (T.MapType, T.VariantType)) else col(name)


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    return "string"


def value_counts_long(df: DataFrame, names: list[str]) -> DataFrame:
    """``column, value, cnt, number`` for every distinct non-null value of every named column.

    Columns of one type family share one unpivot, values are counted in their own type and only the
    counted values are turned into text.
    """
    parts = []
    families: dict[str, list[str]] = {}
    for name in names:
        families.setdefault(_family(df.schema[name].dataType), []).append(name)
    for family, members in families.items():
        for group in chunks(members, 60):
            cells = []
            for name in group:
                nested = is_nested(df.schema[name].dataType)
                cells.append((F.to_json(col(name)) if nested else col(name).cast(family)).alias(f"_c{len(cells)}"))
            labels = ", ".join(f"'{_quoted(n)}', `_c{i}`" for i, n in enumerate(group))
            long = df.select(*cells).select(F.expr(f"stack({len(group)}, {labels}) as (column, v)")) \
                if len(group) > 1 else df.select(F.lit(group[0]).alias("column"), cells[0].alias("v"))
            number = F.lit(None).cast("double") if family == "string" else F.col("v").cast("double")
            parts.append(long.filter("v is not null").groupBy("column", "v").agg(F.count(F.lit(1)).alias("cnt"))
                         .select("column", F.col("v").cast("string").alias("value"), "cnt", number.alias("number")))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, value string, cnt bigint, number double")
    return reduce(DataFrame.unionByName, parts)


def long_numbers(df: DataFrame, names: list[str], keys: list[str] = ()) -> DataFrame:
    """``keys..., column, v`` with one row per non-null cell of the named numeric columns."""
    cells = F.array(*[F.struct(F.lit(n).alias("column"), col(n).cast("double").alias("v")) for n in names])
    return df.select(*[col(k) for k in keys], F.inline(cells)).filter("v is not null")


def _quoted(name: str) -> str:
    return name.replace("\\", "\\\\").replace("'", "\\'")


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[comparable(df, n) for n in df.columns])


def repeated_hashes(df: DataFrame) -> DataFrame:
    """Hashes that occur more than once: eight bytes per row are shuffled, not the rows."""
    return (df.select(row_hash(df).alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_k"))
            .filter("_k > 1").select("_h"))


@dataclass
class Repeats:
    """The hashes of repeated rows as a table of bits, some sixteen per hash, packed in 64-bit words."""

    count: int
    bits: int
    words: DataFrame | None  # word, mask; None if the rows have to be shuffled

    @classmethod
    def of(cls, df: DataFrame) -> "Repeats":
        found = cut_lineage(repeated_hashes(df))
        n = found.count()
        bits = min(MAX_WORDS * 64, 1 << max(10, math.ceil(math.log2(16 * n + 1))))
        if n == 0 or n > MOST_LOADED * bits:
            return cls(n, bits, None)
        place = F.col("_h").bitwiseAND(F.lit(bits - 1))
        words = found.select(place.alias("_p")).groupBy(F.shiftright("_p", 6).alias("_word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(_p & 63 as int))")).alias("_mask"))
        return cls(n, bits, F.broadcast(cut_lineage(words)))  # at most MAX_WORDS rows of 16 bytes

    def marked(self, rows: DataFrame) -> DataFrame:
        """``rows``, which have the hash _h, with _maybe: true for every repeated row and a few others."""
        place = F.col("_h").bitwiseAND(F.lit(self.bits - 1))
        met = rows.withColumn("_p", place).withColumn("_word", F.shiftright("_p", 6)).join(self.words, "_word", "left")
        hit = F.expr("shiftrightunsigned(_mask, cast(_p & 63 as int)) & 1L") == 1
        return met.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_p", "_word", "_mask")


def duplicate_groups(df: DataFrame, name: str = "copies", found: Repeats | None = None) -> DataFrame:
    """Every distinct row that occurs more than once, with its number of copies (nulls are equal).

    The hash only selects candidates; equality is decided on the whole rows of the candidates, and only those are shuffled.
    ``found`` is what ``Repeats.of`` gave, if known.
    """
    found = found or Repeats.of(df)
    keys = [comparable(df, c).alias(c) for c in df.columns]
    if found.count == 0:
        candidates = df.select(*keys).filter(F.lit(False))
    elif found.words is None:
        candidates = df.select(*keys)
    else:
        candidates = found.marked(df.select(row_hash(df).alias("_h"), *keys)).filter("_maybe")
    return (candidates.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias(name))
            .filter(col(name) > 1))


def duplicate_count(df: DataFrame, found: Repeats | None = None) -> DataFrame:
    """One row: rows beyond the first of every group of equal rows."""
    return duplicate_groups(df, "_copies", found).agg(
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def drop_duplicate_rows(df: DataFrame, found: Repeats | None = None) -> DataFrame:
    """One of every group of equal rows.

    Rows whose hash is unique pass through without a shuffle: a broadcast table of bits, sized by the number of repeated
    hashes, tells them from the candidates. Only a table with more repeats than the bits can tell apart (some ``MAX_WORDS`` *
    ``MOST_LOADED`` * 64) is shuffled once by the built-in operator.
    """
    if any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in df.schema.fields):
        raise TypeError("map and variant columns cannot be compared; convert them first")
    found = found or Repeats.of(df)
    if found.count == 0:
        return df
    if found.words is None:
        return df.dropDuplicates()
    marked = found.marked(df.withColumn("_h", row_hash(df)))
    names = [col(c) for c in df.columns]
    return marked.filter("not _maybe").select(*names).unionByName(marked.filter("_maybe").select(*names).dropDuplicates())


def column_value_summary(df: DataFrame, names: list[str]) -> DataFrame:
    """Per column: distinct values, most frequent value (ties to the smallest), its count, rarest count.

    The counted values are reduced by column map-side; no value list is built.
    """
    return value_counts_long(df, names).groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_values"), F.sum("cnt").cast("bigint").alias("non_null"),
        F.min(F.struct((-F.col("cnt")).alias("k"), "number", "value"))["value"].alias("most_frequent"),
        F.max("cnt").alias("frequency"), F.min("cnt").alias("rarest"))


def folded_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """Per text column: distinct values before and after lower-casing."""
    folds = value_counts_long(df, names).groupBy("column", F.lower("value").alias("_f")).agg(
        F.count(F.lit(1)).alias("d"))
    return folds.groupBy("column").agg(F.sum("d").cast("bigint").alias("before"), F.count(F.lit(1)).alias("after"))
