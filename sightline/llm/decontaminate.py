"""Benchmark contamination by winnowing, in DataFrame functions only.

Every window of 13 words chooses the position of its smallest hash of 8 words, so texts that share 13 words or more share a
fingerprint; neighbouring windows mostly choose the same position, which is kept once. Fingerprints of documents that a
fixed-size bit table built from the benchmark may hold are joined with those of the benchmark by the hash alone, and each hit is
extended left and right word by word, as far as a window with it can reach: runs of 13 equal words or more are hits.
Benchmark items shorter than a window are one window of their own length, whose fingerprint is the hash of it all.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import ascii_lower, col, few_files, keyed, written

WINDOW = 13
GRAM = 8
MIN_SHARE = 20  # contaminated from one hit word in twenty
MAX_TABLE_BITS = 1 << 22  # 512 kB in the plan; a fuller table only lets more windows into the join
BROADCAST_WINDOWS = 200_000  # benchmark windows (some 100 bytes each) up to which the join is a broadcast join
BROADCAST_HITS = 200_000  # hit documents and their items (some 30 bytes each) up to which documents are not shuffled
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _zipped(a: str, b: str, shift: int, join: Callable[[Column, Column], Column]) -> Column:
    """join(a[i], b[i + shift]) for every i that has both."""
    n = F.greatest(F.size(b) - shift, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, shift + 1, n), lambda x, y: join(x, y))


def _rolled(rows: DataFrame, base: str, length: int, join, name: str) -> tuple[DataFrame, str]:
    """Adds ``join`` over every run of ``length`` elements of ``base``, doubling the length step by step."""
    powers, p = {1: base}, 1
    while 2 * p <= length:
        if f"{name}{2 * p}" not in rows.columns:
            rows = rows.withColumn(f"{name}{2 * p}", _zipped(powers[p], powers[p], p, join))
        powers[2 * p] = f"{name}{2 * p}"
        p *= 2
    now, done = powers[p], p
    while done < length:
        p = 1 << int(math.log2(length - done))
        target = f"{name}{done + p}_{done}"
        if target not in rows.columns:
            rows = rows.withColumn(target, _zipped(now, powers[p], done, join))
        now, done = target, done + p
    return rows, now


def _prints(rows: DataFrame, lengths: list[int], window: int, gram: int) -> tuple[DataFrame, str, str, dict[int, str]]:
    """Adds the hashes of grams, the smallest of every window, and the hashes of all runs of the given lengths."""
    rows, grams = _rolled(rows.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w))), "h1", gram, F.xxhash64, "h")
    rows, least = _rolled(rows, grams, window - gram + 1, F.least, "m")
    runs = {}
    for n in lengths:
        rows, runs[n] = _rolled(rows, "h1", n, F.xxhash64, "h")
    return rows, grams, least, runs


def _chosen(windows: Column, grams: str, least: str, window: int, gram: int) -> Column:
    """The fingerprints of windows, given by their starts: (fp, at, before, around), a position that several windows choose
    only once. ``around`` are the words that a window with this gram can hold, ``before`` how many of them precede it."""
    reach = window - gram
    places = F.array_distinct(F.transform(windows, lambda i: (i + F.array_position(F.slice(grams, i + 1, reach + 1), F.get(
        F.col(least), i)) - 1).cast("int")))
    before = lambda p: F.least(p, F.lit(reach))
    return F.transform(places, lambda p: F.struct(
        F.get(F.col(grams), p).alias("fp"), p.alias("at"), before(p).alias("before"),
        F.slice("words", p - before(p) + 1, before(p) + window).alias("around")))


def _short(runs: dict[int, str], test=None) -> Column:
    """Runs of the lengths of short items, as (fp, at, len, span); ``test`` picks fingerprints, else only whole texts count."""
    parts = [F.expr("array()").cast("array<struct<fp: bigint, at: int, len: int, span: string>>")]
    for n, prints in runs.items():
        at = F.array_compact(F.transform(prints, lambda fp, i: F.when(test(fp), i))) if test else F.when(
            F.size("words") == n, F.array(F.lit(0))).otherwise(F.expr("array()").cast("array<int>"))
        parts.append(_runs(at, prints, n))
    return F.concat(*parts)


def _runs(at: Column, prints: str, n: int) -> Column:
    return F.transform(at, lambda i: F.struct(F.get(F.col(prints), i).alias("fp"), i.alias("at"), F.lit(n).alias("len"),
                                              F.array_join(F.slice("words", i + 1, n), " ").alias("span")))


def _entries(column: str) -> Column:
    """All entries of a column of lists of fingerprints, 0 without rows."""
    return F.coalesce(F.sum(F.size(F.col(f"{column}.fp"))), F.lit(0)).alias(column)


def _equal_ahead(a: Column, b: Column) -> Column:
    """How many words two lists have in common from their start."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, x: F.struct(
        (acc["n"] + (acc["on"] & x).cast("int")).alias("n"), (acc["on"] & x).alias("on")))["n"]


def _extended(met: DataFrame, window: int, gram: int) -> DataFrame:
    """row, at, len, windows: hits of a gram extended to both sides, word by word, where they reach a window's length."""
    behind = lambda ctx, k: F.reverse(F.slice(ctx, F.lit(1), F.col(k)))
    ahead = lambda ctx, k: F.slice(ctx, F.col(k) + gram + 1, window - gram)
    grams = [F.slice(c, F.col(k) + 1, gram) for c, k in (("around", "before"), ("other", "prior"))]
    sides = met.where(grams[0] == grams[1]).select(
        "row", "at", "before", "around", _equal_ahead(behind("around", "before"), behind("other", "prior")).alias("left"),
        _equal_ahead(ahead("around", "before"), ahead("other", "prior")).alias("right"))
    length = F.col("left") + gram + F.col("right")
    first = F.col("before") - F.col("left")
    return sides.where(length >= window).select(
        "row", (F.col("at") - F.col("left")).alias("at"), length.alias("len"),
        F.transform(F.sequence(F.lit(0), length - window), lambda k: F.xxhash64(F.array_join(F.slice(
            "around", first + k + 1, window), " "))).alias("windows"))


def _bit(fp: Column, cells: int) -> tuple[Column, Column]:
    return fp.bitwiseAND(F.lit(cells - 1)).cast("int"), F.shiftright(fp, 40).bitwiseAND(F.lit(63)).cast("int")


def _table_test(prints: DataFrame, most: int):
    """A test on fingerprints, true for all of ``prints``; false alarms, about one in 256, are left to the join."""
    cells = min(most, 1 << math.ceil(math.log2(max(4096, 256 * prints.count())))) // 64
    cell, bit = _bit(F.col("fp"), cells)
    masks = prints.select(cell.alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("mask"))
    held = dict(map(tuple, masks.groupBy("cell").agg(F.bit_or("mask")).collect()))  # at most as many rows as cells
    table = F.split(F.lit(",".join(str(held.get(i, 0)) for i in range(cells))), ",").cast("array<bigint>")

    def test(fp: Column) -> Column:
        cell, bit = _bit(fp, cells)
        return F.getbit(F.get(table, cell), bit) == 1
    return test


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM,
                  table_bits: int = MAX_TABLE_BITS, broadcast_windows: int = BROADCAST_WINDOWS,
                  broadcast_hits: int = BROADCAST_HITS) -> DataFrame:
    """id, n_words, n_hit, items (ids as sorted strings), n_items, contaminated: one row per row of ``docs``.

    A document word is hit inside any occurrence of a benchmark window. Null and empty texts have no words and no hits;
    an empty benchmark hits nothing; items without words never occur. Repeated rows and items change nothing; a null item
    id is listed as an empty string.
    """
    items = benchmark.select(F.coalesce(col(item_col).cast("string"), F.lit("")).alias("item"),
                             words(col(item_text)).alias("words")).withColumn("n", F.size("words"))
    short = sorted(r.n for r in items.where((F.col("n") > 0) & (F.col("n") < window)).select("n").distinct().collect())
    every = lambda least: F.filter(F.sequence(F.lit(-1), F.size(least) - 1), lambda i: i >= 0)
    rows, grams, least, runs = _prints(items, short, window, gram)
    # written apart: inline would have the optimizer repeat the nested computation below many times over
    held = written(rows.select(
        "item", _chosen(every(least), grams, least, window, gram).alias("chosen"), _short(runs).alias("short"),
        F.transform(every(least), lambda i: F.array_join(F.slice("words", i + 1, window), " ")).alias("spans")))
    marks = held.select(F.inline("chosen")).select("fp", F.col("before").alias("prior"), F.col("around").alias("other")).distinct()
    whole = held.select(F.inline("short")).select("fp", F.col("span").alias("known")).distinct()
    known = held.select("item", F.explode("spans").alias("span")).unionByName(
        held.select("item", F.inline("short")).select("item", "span")).distinct()
    windows = held.agg(_entries("chosen"), _entries("short")).first()
    marks, whole = written(few_files(marks, windows.chosen)), written(few_files(whole, windows.short))
    prints = marks.select("fp").unionByName(whole.select("fp")).distinct()
    if marks.count() + whole.count() <= broadcast_windows:
        marks, whole = F.broadcast(marks), F.broadcast(whole)

    test = _table_test(prints, table_bits)
    base, grams, least, runs = _prints(docs.select(col(id_col).alias("id"), words(col(text_col)).alias("words")), short, window, gram)
    base = base.withColumn("maybe", F.array_compact(F.transform(least, lambda fp, i: F.when(test(fp), i))))
    base = written(base.select("id", F.size("words").cast("long").alias("n_words"), _short(runs, test).alias("short"),
                               _chosen(F.col("maybe"), grams, least, window, gram).alias("chosen"))
                   .withColumn("row", F.monotonically_increasing_id()))
    long_hits = _extended(base.select("row", F.inline("chosen")).join(marks, "fp"), window, gram)
    short_hits = base.select("row", F.inline("short")).join(whole, "fp").where("span = known").select(
        "row", "at", "len", F.array(F.xxhash64("span")).alias("windows"))
    hits = long_hits.unionByName(short_hits).groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("at", "len"))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("windows")))).alias("windows"))
    # words covered, counted once where windows overlap
    reach = F.aggregate("places", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
                        lambda acc, p: F.struct(F.greatest(acc["end"], p["at"] + p["len"]).alias("end"),
                                                acc["n"] + F.greatest(F.lit(0), p["at"] + p["len"] - F.greatest(acc["end"], p["at"]))))
    met = base.agg(_entries("chosen"), _entries("short")).first()
    hits = written(few_files(hits.select(
        "row", reach["n"].alias("n_hit"), "windows",
        F.sha2(F.array_join(F.transform("windows", lambda x: x.cast("string")), ","), 256).alias("set")), met.chosen + met.short))
    # documents with the same windows have the same items, so copies of a document are resolved once
    sets = (hits.groupBy("set").agg(F.first("windows").alias("windows")).select("set", F.explode("windows").alias("window"))
            .join(known.select("item", F.xxhash64("span").alias("window")), "window")
            .groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items")))
    found = written(few_files(hits.join(sets, "set", "left").select("row", "n_hit", "items"), hits.count()))
    size = found.agg(F.count("row") + F.coalesce(F.sum(F.size(F.coalesce("items", F.expr("array()")))), F.lit(0))).first()[0]
    got = base.drop("short", "chosen").join(F.broadcast(found) if size <= broadcast_hits else found, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_of = F.coalesce("items", F.expr("array()").cast("array<string>"))
    return got.select("id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
                      items_of.alias("items"), ((n_hit > 0) & (MIN_SHARE * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without contaminated ones; rows that agree on id and text go or stay together."""
    own, keys = keyed(docs, id_col, text_col)
    packed = own.select(F.struct(*[F.col(k) for k in keys]).alias("place"), col(text_col).alias("text"))
    gone = contamination(packed, benchmark, "place", "text").where("contaminated")
    return own.join(gone.select("id.*").distinct(), keys, "left_anti").select(*[col(c) for c in docs.columns])
