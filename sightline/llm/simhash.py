"""Near duplicates by SimHash fingerprints, linked through sharded vantage-point trees.

Fingerprints are made once per text. Two of them that differ in at most R of 64 bits differ in at most R // B bits of one
of B bit blocks, so each block has a vantage-point tree of its own with that smaller radius. A tree node keeps the points
within a median distance of its vantage point on the inner side; by the triangle inequality only outer points no further
out than the radius can have partners inside, and only those visit the inner side too. A leaf is a shard: its
home points are compared with all points in it by the whole 64 bits, so every link found is exact and none is missed. The
trees are fitted on a bounded sample; a leaf that is too full for it is cut further by a tree fitted on its own points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import col, components, free_name, give_back, keyed, written

SHINGLE = 4
MAX_BITS = 4
BLOCKS = ((0, 22), (22, 21), (43, 21))  # first bit and width: with 4 bits allowed, some block differs in 1 at most
SAMPLE = 1 << 17  # fingerprints the trees are fitted on; every fingerprint is indexed
LEAF = 384  # home points a leaf should hold
FAT = 8_000  # home points beyond which a leaf gets a tree of its own
FIRST_LEAF, OWN_LEAVES = 1 << 20, 1 << 11  # so that leaves of any depth have numbers of their own
OWN_SAMPLE, OWN_ROWS = 4_096, 100_000  # points that tree is fitted on, and home points that one task deals by it
SHARD = 40_000  # points compared in one task; fuller leaves are compared in pairs of parts

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is 1 if set in over half of the shingles' hashes. Words end at ASCII white space, A-Z are
    lower-cased; fewer words than a shingle are one shingle; no words (null, empty) give 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes, both touch ASCII only
    if not words:
        return 0
    joined, end = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    last = end[min(shingle, len(words)) - 1:].tolist()
    first = [0, *(end + 1).tolist()][:len(last)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(first, last)), dtype=np.uint64, count=len(last))
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (counts @ _BYTE_BITS) > len(last)).ravel()
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (the 64 bits as a signed long), one row per row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), dtype=np.uint64,
                                 count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "fp"])
        give_back()

    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


# trees

def _grow(points: np.ndarray, radius: int, leaf: float, rng: np.random.Generator) -> list[tuple]:
    """Nodes (vantage point, distance, inner, outer) in preorder; a leaf has distance -1 and its number as inner."""
    nodes: list[tuple] = []
    leaves = 0

    def split(own: np.ndarray) -> int:
        nonlocal leaves
        at, best = len(nodes), None
        if len(own) > leaf:
            for vantage in rng.choice(own, min(6, len(own)), replace=False):
                d = np.bitwise_count(own ^ vantage)
                mu = int(np.median(d))
                for cut in {mu, mu - 1}:
                    inner = int((d <= cut).sum())
                    if 0 < inner < len(own):
                        # rows that a split leaves on either side, visitors counted with their side
                        cost = max(int((d <= cut + radius).sum()), len(own) - inner)
                        if best is None or cost < best[0]:
                            best = (cost, vantage, cut, d <= cut)
        if best is None or best[0] > 0.95 * len(own):
            nodes.append((np.uint64(0), -1, leaves, 0))
            leaves += 1
            return at
        nodes.append(())
        _, vantage, cut, side = best
        nodes[at] = (vantage, cut, split(own[side]), split(own[~side]))
        return at

    split(points)
    return nodes


def _route(nodes: list[tuple], values: np.ndarray, radius: int, at_home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf, index of the point and whether it is at home there, for every leaf that a point belongs to or visits."""
    out = []
    stack = [(0, np.arange(len(values)), at_home)]
    while stack:
        at, own, home = stack.pop()
        if not len(own):
            continue
        vantage, cut, inner, outer = nodes[at]
        if cut < 0:
            out.append((np.full(len(own), inner), own, home))
            continue
        d = np.bitwise_count(values[own] ^ vantage).astype(np.int16)
        into, beyond = d <= cut + radius, d > cut
        stack.append((inner, own[into], home[into] & (d[into] <= cut)))
        # a visitor looks for home points on both sides; a home point of the inner side is found by its outer partner
        reach = beyond | (~home & (d > cut - radius))
        stack.append((outer, own[reach], home[reach]))
    return tuple(np.concatenate(part) if out else np.empty(0, dtype=np.int64) for part in (zip(*out) if out else ((),) * 3))


def _block(prints: np.ndarray, block: tuple[int, int]) -> np.ndarray:
    return prints >> np.uint64(block[0]) & np.uint64((1 << block[1]) - 1)


def _linked(home: np.ndarray, visitors: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """(point, smallest point found with it) for points linked to a home point, by search from home points.

    A point that is reached leaves the set still compared against, so a dense group costs little more than its size.
    """
    rest = np.concatenate([home, visitors])
    at_home = np.arange(len(rest)) < len(home)
    found: list[tuple[int, int]] = []
    while len(rest) and at_home[0]:
        frontier, group = [(rest[0], True)], []
        rest, at_home = rest[1:], at_home[1:]
        while frontier:
            point, is_home = frontier.pop()
            group.append(point)
            near = np.bitwise_count(rest ^ point) <= bits
            if not is_home:
                near &= at_home
            if near.any():
                frontier.extend(zip(rest[near], at_home[near]))
                rest, at_home = rest[~near], at_home[~near]
        if len(group) > 1:
            low = min(group)
            found.extend((p, low) for p in group if p != low)
    return found


DEALT = "tree int, leaf bigint, home boolean, fp bigint"  # leaf: see FIRST_LEAF


def _refined(dealt: DataFrame, blocks, radius: int, leaf: int, fat: int, seed: int) -> DataFrame:
    """``dealt`` with every leaf of more than ``fat`` home points cut by a tree of its own, fitted on about ``OWN_SAMPLE`` of
    them, and again until no leaf is that full or the points of a leaf cannot be told apart by its block.

    So leaves stay bounded however many fingerprints there are: rounds grow with the logarithm of their number. A leaf's tree
    stays with the leaf's rows; neither trees nor leaves are gathered.
    """
    done = None
    while True:
        sizes = dealt.groupBy("tree", "leaf").agg(F.count_if("home").alias("own"))
        full = written(sizes.where(F.col("own") > fat))
        if full.isEmpty():
            return dealt if done is None else done.unionByName(dealt)
        rest = dealt.join(full, ["tree", "leaf"], "left_anti")
        done = rest if done is None else done.unionByName(rest)
        inside = dealt.join(full, ["tree", "leaf"])
        picked = inside.where(F.col("home") & (F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) / (1 << 30) * F.col("own") < OWN_SAMPLE))

        def fit(at: tuple, group: pd.DataFrame) -> pd.DataFrame:
            points = _block(group["fp"].to_numpy(dtype=np.int64).view(np.uint64), blocks[int(at[0])])
            per_leaf = max(4.0, leaf * len(points) / int(group["own"].iloc[0]))
            nodes = _grow(points, radius, per_leaf, np.random.default_rng(seed))
            return pd.DataFrame({"tree": [int(at[0])], "leaf": [int(at[1])], "own": [int(group["own"].iloc[0])],
                                 "nodes": [[int(x) for node in nodes for x in node]]})

        fitted = written(picked.select("tree", "leaf", "own", "fp").groupBy("tree", "leaf").applyInPandas(
            fit, "tree int, leaf bigint, own bigint, nodes array<bigint>"))
        cut = fitted.where(F.size("nodes") > 4)  # one node is a leaf that stays as it is
        done = done.unionByName(inside.select("tree", "leaf", "home", "fp").join(cut, ["tree", "leaf"], "left_anti"))
        salts = F.ceil(F.col("own") / OWN_ROWS).cast("int")
        trees = cut.withColumn("salts", salts).withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)")))
        salted = inside.select("tree", "leaf", "home", "fp").join(cut.select("tree", "leaf", salts.alias("salts")), ["tree", "leaf"])
        salted = salted.withColumn("salt", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("salts")).cast("int"))
        trees = trees.select(F.col("tree").alias("t"), F.col("leaf").alias("l"), F.col("salt").alias("s"), "nodes")

        def deal(at: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(own):
                return pd.DataFrame({"tree": [], "leaf": [], "home": [], "fp": []}).astype({"tree": "int32", "leaf": "int64", "home": bool, "fp": "int64"})
            flat = [int(x) for x in own["nodes"].iloc[0]]
            nodes = [(np.uint64(flat[i]), *flat[i + 1:i + 4]) for i in range(0, len(flat), 4)]
            prints = rows["fp"].to_numpy(dtype=np.int64)
            leaf_at, index, home = _route(nodes, _block(prints.view(np.uint64), blocks[int(at[0])]), radius, rows["home"].to_numpy(bool))
            return pd.DataFrame({"tree": np.full(len(index), int(at[0]), dtype=np.int32), "leaf": int(at[1]) * OWN_LEAVES + leaf_at,
                                 "home": home, "fp": prints[index]})

        dealt = written(salted.groupBy("tree", "leaf", "salt").cogroup(trees.groupBy("t", "l", "s")).applyInPandas(deal, DEALT))


def links(prints: DataFrame, max_bits: int = MAX_BITS, blocks=BLOCKS, sample: int = SAMPLE, leaf: int = LEAF,
          shard: int = SHARD, seed: int = 7, fat: int = FAT) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp, no repeats) at ``max_bits`` or fewer differing bits.

    Within a shard a connected group is given as links to its smallest member, so its size and not its square counts;
    the connected components are those of all links.
    """
    spark, radius = prints.sparkSession, max_bits // len(blocks)
    total = prints.count()
    fitted = prints.select("fp", F.xxhash64("fp").alias("order")).orderBy("order").limit(sample).select("fp").toPandas()
    points = fitted["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    per_leaf = max(4.0, leaf * len(points) / max(1, total))
    rng = np.random.default_rng(seed)
    trees = spark.sparkContext.broadcast([_grow(_block(points, b), radius, per_leaf, rng) for b in blocks])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def flush():
            own = np.concatenate(held)
            for tree, (nodes, block) in enumerate(zip(trees.value, blocks)):
                leaf_at, index, home = _route(nodes, _block(own, block), radius, np.ones(len(own), dtype=bool))
                yield pd.DataFrame({"tree": np.full(len(index), tree, dtype=np.int32), "leaf": leaf_at.astype(np.int64) + FIRST_LEAF,
                                    "home": home, "fp": own[index].view(np.int64)})

        for batch in batches:
            held.append(batch["fp"].to_numpy(dtype=np.int64).view(np.uint64))
            if sum(map(len, held)) >= 100_000:
                yield from flush()
                held.clear()
        if held:
            yield from flush()
            held.clear()
        give_back()

    dealt = written(prints.select("fp").mapInPandas(route, DEALT))
    dealt = _refined(dealt, blocks, radius, leaf, fat, seed)
    parts = dealt.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    paired = (dealt.join(parts, ["tree", "leaf"]).withColumn("own", own)
              .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
              .select("tree", "leaf", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
                      "home", "fp"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        own = group["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        home = group["home"].to_numpy(dtype=bool)
        found = np.array(_linked(own[home], own[~home], max_bits), dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"u": found[:, 0], "v": found[:, 1]})

    return paired.groupBy("tree", "leaf", "a", "b").applyInPandas(compare, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """id, fp, component: one row per row of ``docs``; component is the smallest id reachable over links.

    Null and empty texts have fingerprint 0, linked like any other. Repeated rows share all values. A null id never is
    the smallest, so a component is null only if all its ids are. An empty table gives no rows.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle))
    prints = written(rows.groupBy("fp").agg(F.min("id").alias("low")))
    reached = components(links(prints, max_bits))
    joined = prints.join(reached, prints["fp"] == reached["node"], "left")
    joined = joined.select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = joined.groupBy("root").agg(F.min("low").alias("component"))
    # a fingerprint that fills much of the table is a skewed key of this join, which adaptive planning splits
    return rows.join(joined.select("fp", "root").join(lows, "root").select("fp", "component"), "fp").select(
        "id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, one of each component: the one with the smallest id (null ids last).

    Rows that agree on id and text count as one, and one of them stays.
    """
    keys_of, keys = keyed(docs, id_col, text_col)
    group, place = free_name(keys_of, "group__"), free_name(keys_of, "place__")
    packed = keys_of.select(F.struct(*[F.col(k) for k in keys]).alias("place"), col(text_col).alias("text"))
    grouped = near_duplicates(packed, "place", "text", shingle, max_bits)
    stay = grouped.where("id = component").select(*[F.col(f"id.`{k}`").alias(k) for k in keys]).distinct()
    own = keys_of.drop(group, place)
    # joined and made unique by the same keys: the text is shuffled once
    return own.join(stay, keys, "left_semi").dropDuplicates(keys).select(*[col(c) for c in docs.columns])


def as_hex(prints: DataFrame) -> DataFrame:
    return prints.withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))
