"""Cross-site boilerplate lines, in DataFrame functions only.

Lines are compared in ASCII lower case without outer blanks, by two 64-bit hashes. Per line a HyperLogLog sketch of the
sites it occurs on is built in every task and merged by the aggregation. Only lines whose estimate is near the threshold
have their sites counted exactly. A line on enough sites is boilerplate: its first occurrence stays, every other goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import ascii_lower, col, free_name, keyed, written

MIN_SITES = 10
LG_REGISTERS = 10  # relative standard error 1.04 / 32
MARGIN = 0.15  # over four standard errors to either side of the threshold are counted exactly


def line_sites(lines: DataFrame, min_sites: int = MIN_SITES, lg: int = LG_REGISTERS, margin: float = MARGIN) -> DataFrame:
    """a, b, first: the hashes and first place of lines that occur on ``min_sites`` sites or more.

    ``lines`` has a, b, site, place; the first place is the smallest one.
    """
    spread = written(lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", lg).alias("sketch"), F.count("*").alias("n"),
                                                 F.min("place").alias("first"))
                     .where(F.col("n") >= min_sites)
                     .select("a", "b", "first", F.hll_sketch_estimate("sketch").alias("sites")))
    low, high = min_sites * (1 - margin) - 1, min_sites * (1 + margin) + 1
    near = spread.where(F.col("sites").between(low, high))
    exact = (lines.join(near.select("a", "b"), ["a", "b"], "left_semi").select("a", "b", "site").distinct()
             .groupBy("a", "b").count().where(F.col("count") >= min_sites).select("a", "b"))
    return near.join(exact, ["a", "b"], "left_semi").unionByName(spread.where(F.col("sites") > high)).select("a", "b", "first")


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                       length_col: str | None = None, min_sites: int = MIN_SITES, n_lines: str | None = None,
                       n_removed: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, the text without later occurrences of lines on ``min_sites`` sites or more.

    Lines end at \\n; blank lines are never boilerplate. The first occurrence is that of the smallest id (null last), then
    line number. A null site is a site of its own. Null texts stay null, texts whose lines all go become empty; no row is
    dropped. Repeated rows share their lines' fate. ``length_col`` is set to the new length, where given; ``n_lines``
    and ``n_removed`` name columns to add.
    """
    own, keys = keyed(docs, id_col, text_col)
    split = F.split(col(text_col), "\n", -1)
    line = F.trim(F.col("line"))
    lines = (own.select(*keys, F.coalesce(F.concat(F.lit("s"), col(site_col).cast("string")), F.lit("")).alias("site"),
                        F.posexplode(F.split(ascii_lower(col(text_col)), "\n", -1)).alias("pos", "line"))
             .where(line != ""))
    lines = written(lines.select("site", F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"),
                                 F.struct(*keys, "pos").alias("place")))
    common = line_sites(lines, min_sites)
    # a line on a third of all rows is a skewed key of this join only, which adaptive planning splits
    dropped = (lines.join(common, ["a", "b"]).where("place <> first").select("place.*").distinct()
               .groupBy(*keys).agg(F.collect_list("pos").alias("gone")))
    gone, at = free_name(own, "gone__"), free_name(own, "lines__")
    out = own.join(dropped.withColumnRenamed("gone", gone), keys, "left").withColumn(at, split)
    kept = F.array_except(F.sequence(F.lit(0), F.size(at) - 1), col(gone))
    text = F.when(col(gone).isNull(), col(text_col)).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col(at), i)), "\n"))
    extra = {}
    if n_lines:
        extra[n_lines] = F.coalesce(F.when(col(text_col).isNotNull(), F.size(at)), F.lit(0)).cast("long")
    if n_removed:
        extra[n_removed] = F.coalesce(F.size(F.when(col(gone).isNotNull(), col(gone))), F.lit(0)).cast("long")
    out = out.select("*", text.alias(free_name(out, "text__")))
    new = out.columns[-1]

    def value(c: str):
        if c == text_col:
            return col(new).alias(c)
        if c == length_col:
            return F.length(col(new)).cast(docs.schema[c].dataType).alias(c)
        return col(c)

    return out.select(*[value(c) for c in docs.columns], *[v.alias(k) for k, v in extra.items()])
