"""Exact duplicates by two passes over a Bloom filter.

Pass one sets, for every text, a few bits of a fixed-size table and keeps the bits that at least two rows set.  Pass two
asks that table: a text with a bit that only one row set is unique, and its row passes straight through.  Only rows whose
bits all repeat are shuffled, and of those only digest and id, never the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import ascii_lower, col, free_name, met_by_size, written

HASHES = 3
BITS_PER_ROW = 24
MAX_BITS = 1 << 28  # 32 MB, the most that is ever broadcast; a fuller table only lets more rows into the shuffle


def digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(bits)) for i in range(HASHES)]


def repeat_filter(rows: DataFrame, key: str, max_bits: int = MAX_BITS):
    """A column function that is true for every key held by several rows, and for few others.

    The number of rows on the wire is at most the number of bits set; the table's size follows the number of rows up to
    ``max_bits`` and never goes beyond.
    """
    spark = rows.sparkSession
    bits = min(max_bits, 1 << math.ceil(math.log2(max(1024, BITS_PER_ROW * rows.count()))))
    twice = (rows.select(F.explode(F.array(*_places(F.col(key), bits))).alias("place")).groupBy("place")
             .count().where("count > 1"))
    words = (twice.groupBy(F.expr("place div 64").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("mask")).toPandas())
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def all_repeat(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        held = shared.value
        for places in batches:
            hit = np.ones(len(places[0]), dtype=bool)
            for p in places:
                at = p.to_numpy()
                hit &= (held[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            yield pd.Series(hit)

    return lambda key_col: all_repeat(*_places(key_col, bits))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: its id, the id of the row that stays, the size of its group, whether it stays, the
    digest of its text.

    Of equal texts the row with the largest id stays, null ids being smallest; of repeated rows with the same id exactly
    one stays. Null and empty texts are one group. An empty table gives no rows. Other columns are not looked at.
    """
    rows = written(docs.select(col(id_col).alias("id"), digest(col(text_col)).alias("sha"))
                   .withColumn("row", F.monotonically_increasing_id()))
    rows = written(rows.withColumn("maybe", repeat_filter(rows, "sha", max_bits)(F.col("sha"))))
    alone = rows.where("not maybe").select("id", F.col("id").alias("keep"), F.lit(1).cast("long").alias("size"),
                                           F.lit(True).alias("kept"), "sha")
    again = rows.where("maybe")
    # struct order puts null ids first, so the largest id wins and the row number only settles repeated rows
    groups = written(again.groupBy("sha").agg(F.count("*").alias("size"), F.max(F.struct("id", "row")).alias("top")))
    met = met_by_size(again, groups, "sha", "size", again.count()).select("id", F.col("top.id").alias("keep"), "size",
                                           (F.col("row") == F.col("top.row")).alias("kept"), "sha")
    return alone.unionByName(met).select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"),
                                         F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, without repeated texts; rows found unique by the filter are never shuffled.

    Which row stays is as in ``duplicate_groups``. Of fully repeated rows any one stays.
    """
    sha, maybe = free_name(docs, "sha"), free_name(docs, "maybe")
    rows = docs.withColumn(sha, digest(col(text_col)))
    test = repeat_filter(written(rows.select(F.col(sha).alias("sha"))), "sha", max_bits)
    rows = rows.withColumn(maybe, test(F.col(sha)))
    again = rows.where(F.col(maybe)).groupBy(sha).agg(
        F.max_by(F.struct(*[col(c) for c in docs.columns]), F.struct(col(id_col))).alias("kept"))
    return rows.where(~F.col(maybe)).select(*[col(c) for c in docs.columns]).unionByName(again.select("kept.*"))
