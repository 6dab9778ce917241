"""Exact positions in a sorted table or series without gathering a series in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.functions.counts import row_hash
from sightline.session import cut_lineage, small_side
from sightline.types import col

BLOCK = 200_000  # rows of one series that share a window task


def with_position(df: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Adds the 1-based position of every row within its key, in the given order (ties by row content).

    Rows are range-partitioned on key and order, so a long series spans many partitions; a position is the
    place inside the partition plus the sizes of the partitions before it.  The partitioned rows are
    checkpointed: a lost executor cannot change which partition a row belongs to.
    """
    tie = df.withColumns({"_tie": row_hash(df), "_rand": F.rand(7)})
    by = [col(c) for c in keys] + [col(c).asc_nulls_first() for c in order] + [F.col("_tie"), F.col("_rand")]
    frozen = cut_lineage(tie.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    names = [col(k) for k in keys]
    sizes = frozen.groupBy(*names, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"),
                          F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*names, "_part").orderBy(*by[len(keys):])  # at most one range partition
    placed = frozen.withColumn("_row", F.row_number().over(inside))
    on = (F.col("_part") == F.col("_p"))
    for i, k in enumerate(keys):
        on = on & col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(starts, on).select(*[col(c) for c in df.columns],
                                          (F.col("_start") + F.col("_row")).cast("bigint").alias(name))


def lags(df: DataFrame, keys: list[str], position: str, value: Column, count: int, prefix: str = "lag_",
         block: int = BLOCK) -> DataFrame:
    """``count`` lagged values by position; every block also receives the last rows of the block before it."""
    if count >= block:
        raise ValueError("more lags than rows in a block")
    at = F.col(position) - 1
    home = F.floor(at / block)
    last_rows = (at % block) >= block - count
    copies = F.when(last_rows, F.array(home, home + 1)).otherwise(F.array(home))
    spread = df.withColumn("_value", value).withColumn("_home", home).withColumn("_block", F.explode(copies))
    w = Window.partitionBy(*[col(k) for k in keys], "_block").orderBy(position)
    lagged = spread.withColumns({f"{prefix}{i}": F.lag("_value", i).over(w) for i in range(1, count + 1)})
    return lagged.filter(F.col("_block") == F.col("_home")).drop("_value", "_home", "_block")


HASH_BITS = 63
DIGITS = (16, 16, 16, 15)  # bits settled per round; a round has at most 2^16 counts per key


def hash_ranks(hashes: DataFrame, ranks: DataFrame) -> DataFrame:
    """key, rank, cut, below, ties: the ``rank``-th smallest hash of every key (from 1), the rows under it and those on it.

    ``hashes`` has key and h (from 0, below 2^63), ``ranks`` has key and rank. Digit by digit: the rows that share the digits
    found so far are counted by their next digit (map-side first), and the digit in which the rank falls is kept. Only counts
    move, one row per key and digit value, so a key that holds a third of the rows is no special case.
    """
    known, left = ranks.select("key", "rank", F.lit(0).cast("bigint").alias("cut"), F.lit(0).cast("bigint").alias("below")), HASH_BITS
    for width in DIGITS:
        left -= width
        state = cut_lineage(known.select(F.col("key").alias("_key"), "rank", "cut", "below"))
        inside = hashes.join(small_side(state), F.col("key").eqNullSafe(F.col("_key")) & (
            F.shiftright("h", left + width) == F.col("cut"))).drop("_key", "cut")
        counted = inside.groupBy("key", "rank", "below", F.shiftright("h", left).alias("cut")).agg(F.count(F.lit(1)).alias("ties"))
        upto = Window.partitionBy("key").orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)
        run = counted.withColumn("_to", F.col("below") + F.sum("ties").over(upto)).withColumn("_from", F.col("_to") - F.col("ties"))
        known = run.filter((F.col("_from") < F.col("rank")) & (F.col("rank") <= F.col("_to"))).select(
            "key", "rank", "cut", F.col("_from").alias("below"), "ties")
    return cut_lineage(known)
