"""Helpers the operators share: reading tables, ASCII lower case, row keys, written tables, places in order, components."""

from __future__ import annotations

import ctypes
import gc
import math
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.session import scratch_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def give_back() -> None:
    """Python workers outlive a task: memory it no longer needs goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is. ``lower`` is quicker, and the same on text of ASCII only."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def written(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared scratch folder and read again: lineage ends here, a lost executor
    costs no second computation, and values such as row numbers are fixed."""
    path = f"{scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FILE_ROWS = 5_000  # rows that a file of a small table may hold at least


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has ``rows`` rows at most, in no more partitions than they fill.

    A few thousand rows out of hundreds of shuffle partitions are hundreds of files, and on a local file system Hadoop starts a
    process for each, which shares the executor's memory for a moment and so counts it twice. A large table stays as it is.
    """
    return df.coalesce(max(1, math.ceil(rows / FILE_ROWS)))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def keyed(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """``df`` with three columns that are never null and together stand for its id and whole text.

    Rows that agree on them hold the same id and text, so whatever an operator decides for one holds for all of them.
    """
    names = [free_name(df, f"key_{part}__") for part in ("none", "id", "text")]
    parts = [col(id_col).isNull(), F.coalesce(col(id_col), F.lit(0)).cast(df.schema[id_col].dataType),
             F.xxhash64(F.coalesce(col(text_col), F.lit("")), F.length(col(text_col)))]
    return df.withColumns(dict(zip(names, parts))), names


def placed(df: DataFrame, keys: list[str], order: list[str], group: str = "group", place: str = "place",
           size: str = "size") -> DataFrame:
    """Adds to every row a number of its key (ascending with it), its place from 0 within the key, and the key's rows.

    Rows are range-partitioned by key and order (nulls first) and numbered in their partition, so a key that holds a third
    of all rows lies in many partitions; a random last column spreads repeated rows. Only one row per key and partition is
    needed to turn numbers into places. The numbered rows are a written table, so they never change. ``df`` is read twice.
    """
    at, tie, part, first, rows, start = [free_name(df, f"{n}__") for n in ("at", "tie", "part", "first", "rows", "start")]
    by = [col(c).asc_nulls_first() for c in keys + order] + [F.col(tie)]
    in_order = df.withColumn(tie, F.rand(7)).repartitionByRange(*by).sortWithinPartitions(*by).drop(tie)
    numbered = written(in_order.withColumn(at, F.monotonically_increasing_id()))
    parted = numbered.withColumn(part, F.shiftright(at, 33))
    counted = parted.groupBy(*[col(k) for k in keys], part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(rows))
    of_key = Window.partitionBy(*[col(k) for k in keys])  # at most one row per partition
    before = of_key.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(
        *[col(k).alias(f"{start}{i}") for i, k in enumerate(keys)], F.col(part).alias(f"{start}p"), F.col(first),
        F.coalesce(F.sum(rows).over(before), F.lit(0)).alias(start), F.min(first).over(of_key).alias(group),
        F.sum(rows).over(of_key).alias(size))
    on = F.col(part) == F.col(f"{start}p")
    for i, k in enumerate(keys):
        on = on & col(k).eqNullSafe(F.col(f"{start}{i}"))
    return parted.join(starts, on).select(*[col(c) for c in df.columns], group,
                                          (F.col(at) - F.col(first) + F.col(start)).alias(place), size)


def salted_join(rows: DataFrame, few: DataFrame, on: str, salt: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """``rows`` joined with ``few``, which has one row per key: every key is dealt to ``salts`` tasks by ``salt``."""
    extra = free_name(rows, "salt__")
    spread = few.withColumn(extra, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn(extra, F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    return dealt.join(spread, [on, extra], how).drop(extra)


COMMON = 1000  # a key with more than one row in so many is joined apart from the others


def met_by_size(rows: DataFrame, few: DataFrame, on: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with ``few``, a written table with one row per key and the key's number of rows in ``size``.

    Fewer than ``COMMON`` keys can hold more than that share of all ``total`` rows each: those are sent to the rows, so that no
    task gets the rows of a hot key. The others are joined by a shuffle.
    """
    common = F.col(size) > total / COMMON
    often, rest = F.broadcast(few.where(common)), few.where(~common)
    return rows.join(often, on).unionByName(rows.join(often.select(on), on, "left_anti").join(rest, on))


def components(links: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars.

    ``links`` has columns u and v of any orderable type. Returns node, root: root is the smallest node of the component.
    Every round is one minimum per node and one join, so no node's neighbours ever meet in one task; a hub's rows are
    only a skewed join, which the adaptive planner splits. Rounds grow with the logarithm of the longest chain.
    """
    def smallest(both: DataFrame) -> DataFrame:
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        return both.join(low, "u")

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        # small star: a node's smaller neighbours, and the node itself, hang on the smallest of them
        small = smallest(large)
        edges = written(small.select(F.col("v").alias("u"), F.col("low").alias("v"))
                        .unionByName(small.select("u", F.col("low").alias("v"))).where("u <> v").distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
