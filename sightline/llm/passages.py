"""Repeated passages by sparse suffix arrays.

Suffixes are kept only at positions chosen by content: the smallest hash of a few words in every window of words
(minimisers), so the same passage keeps the same positions wherever it stands. The kept suffixes are sorted by the hash
of their leading words and compared with their sorted neighbours; where two agree, the match is extended left and right: all
windows of the full length around such positions are sorted and compared in the same way. A passage of at least SPAN
words that occurs twice holds a minimiser in its first half, so none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import col, keyed

SPAN = 50  # words of the shortest passage reported
GRAM = 5  # words hashed to choose positions
CACHE = 400_000

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a ^ (b >> np.uint64(31))) * _MULTIPLY + (b ^ (a << np.uint64(17)))
    return out ^ (out >> np.uint64(29))


def _rolled(x: np.ndarray, length: int, join) -> np.ndarray:
    """``join`` over all runs of ``length``, doubling step by step."""
    if len(x) < length:
        return x[:0]
    powers = {1: x}
    while 2 * max(powers) <= length:
        p = max(powers)
        powers[2 * p] = join(powers[p][:-p], powers[p][p:])
    done = max(powers)
    out = powers[done]
    while done < length:
        p = max(q for q in powers if q <= length - done)
        n = len(x) - done - p + 1
        out, done = join(out[:n], powers[p][done:done + n]), done + p
    return out


def _starts(hashes: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Positions of minimisers, one or more in the first half of every window of ``span`` words."""
    grams = _rolled(hashes, gram, _mix)
    width = span // 2 - gram + 1
    least = _rolled(grams, width, np.minimum)
    if not len(least):
        return np.zeros(0, dtype=np.int64)
    chosen = np.zeros(len(grams), dtype=bool)
    # equal smallest hashes in a window are all kept, so that the choice depends on the window's content only
    for shift in range(width):
        chosen[shift:shift + len(least)] |= grams[shift:shift + len(least)] == least
    return np.flatnonzero(chosen)


ROWS = "key bigint, place bigint, at int, asks boolean, sure boolean"


class _Rows:
    """Hashes with the place of their text and their position, gathered into frames of ``ROWS``.

    A hash that a frame holds several times is sure to be repeated, and only its first row asks for more under that key; the
    others travel under keys of their own. So a hash on a third of all rows meets as one row per frame.
    """

    def __init__(self):
        self.hashes, self.places, self.at, self.size = [], [], [], 0

    def add(self, place: int, hashes: np.ndarray, at: np.ndarray) -> None:
        self.hashes.append(hashes)
        self.places.append(np.full(len(at), place, dtype=np.int64))
        self.at.append(at)
        self.size += len(at)

    def frame(self) -> pd.DataFrame:
        hashes, places, at = [np.concatenate([*x, np.zeros(0, kind)]).astype(kind, copy=False) for x, kind in (
            (self.hashes, np.uint64), (self.places, np.int64), (self.at, np.int32))]
        self.__init__()
        _, first, which, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        asks = np.zeros(len(hashes), dtype=bool)
        asks[first] = True
        own = _mix(_mix(hashes, places.view(np.uint64)), at.astype(np.uint64))
        return pd.DataFrame({"key": np.where(asks, hashes, own).view(np.int64), "place": places, "at": at, "asks": asks,
                             "sure": count[which] > 1})


def _repeated(rows: DataFrame, partitions: int) -> DataFrame:
    """The (place, at) of rows whose hash another row has, found among neighbours sorted by key."""
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # the newest row: its right neighbour is not known yet
        for batch in batches:
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(frame) == 0:
                continue
            key, asks = frame["key"].to_numpy(), frame["asks"].to_numpy()
            equal = (key[1:] == key[:-1]) & asks[1:] & asks[:-1]
            found = frame["sure"].to_numpy().copy()
            found[1:] |= equal
            found[:-1] |= equal
            yield frame.loc[:, ["place", "at"]][:-1][found[:-1]]
            held = frame[-1:].assign(sure=found[-1:])
        if held is not None:
            yield held.loc[held["sure"], ["place", "at"]]

    return (rows.repartition(partitions, "key").sortWithinPartitions("key", "asks")
            .mapInPandas(compare, "place bigint, at int"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN,
                      gram: int = GRAM) -> DataFrame:
    """id, start, n_words: maximal runs of words covered by windows of ``span`` words that occur more than once.

    One row per run and row of ``docs``; start counts words from 0. Occurrences in the same text count too, and repeated
    rows are repeats of each other. Null, empty and shorter texts have none; an empty table gives no rows. Words are
    compared in ASCII lower case; texts and windows are told apart by 64-bit hashes.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own, keys = keyed(docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")), "id", "text")
    tagged = own.select("id", "text", F.xxhash64(*keys).alias("place"))

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for batch in batches:
            out = _Rows()
            for place, text in zip(batch["place"], batch["text"]):
                own_words = words(text)
                if len(own_words) >= span:
                    h = np.fromiter(map(known.__getitem__, own_words), np.uint64, len(own_words))
                    heads = _rolled(h, span - span // 2, _mix)  # the words that a shared passage has from there on
                    at = _starts(h, span, gram)
                    at = at[at < len(heads)]
                    out.add(place, heads[at], at)
                    if out.size > 500_000:
                        yield out.frame()
            yield out.frame()

    kept = tagged.select("place", "text").mapInPandas(suffixes, ROWS)
    seeds = _repeated(kept, partitions).groupBy("place").agg(F.array_sort(F.collect_set("at")).alias("seeds"))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for batch in batches:
            out = _Rows()
            for place, text, at in zip(batch["place"], batch["text"], batch["seeds"]):
                h = np.fromiter(map(known.__getitem__, words(text)), np.uint64)
                whole = _rolled(h, span, _mix)
                near = np.zeros(len(whole) + 1, dtype=np.int64)
                at = np.asarray(at)
                np.add.at(near, np.clip(at - span // 2 + 1, 0, len(whole)), 1)
                np.add.at(near, np.minimum(at + 1, len(whole)), -1)
                start = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                out.add(place, whole[start], start)
                if out.size > 500_000:
                    yield out.frame()
            yield out.frame()

    around = tagged.join(seeds, "place").select("place", "text", "seeds").mapInPandas(
        windows, ROWS)
    hits = _repeated(around, partitions).groupBy("place").agg(F.array_sort(F.collect_set("at")).alias("starts"))
    # runs: windows that overlap or touch are one
    empty = F.expr("array()").cast("array<struct<start:int,stop:int>>")
    runs = F.aggregate("starts", F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("stop"), empty.alias("done")),
                       lambda acc, s: F.when(s <= acc["stop"], F.struct(acc["start"].alias("start"), (s + span).alias("stop"), acc["done"].alias("done")))
                       .otherwise(F.struct(s.alias("start"), (s + span).alias("stop"), F.when(acc["stop"] < 0, acc["done"]).otherwise(
                           F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["stop"].alias("stop"))))).alias("done"))),
                       lambda acc: F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["stop"].alias("stop")))))
    found = hits.select("place", F.inline(runs))
    return tagged.select("id", "place").join(found, "place").select(
        "id", F.col("start").cast("long"), (F.col("stop") - F.col("start")).cast("long").alias("n_words"))
