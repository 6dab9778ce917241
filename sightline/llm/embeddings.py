"""Near-duplicate vectors by randomised-rotation binary codes with confidence bounds.

A unit vector o is turned by one random rotation; its code is the sign of every turned coordinate, o' the code as a unit
vector, and <o', o> its stored correction factor. For any unit vector q, <o', q> / <o', o> estimates <o, q> without bias,
and for a pair that links the error is normal with a deviation that the factor and the threshold give. q is rounded at
random to a few bits, so <o', q> is a sum of bit counts. A pair whose estimate plus its confidence bound stays below the
threshold is done with; every other pair is computed exactly in double precision, so no link below it is ever given.

Which codes meet is decided in the same way: the leading bits of a code are its cell, and from the sizes of a vector's
turned coordinates follows how likely a partner at the threshold has each of them on the other side. A vector visits its
own cell and every later cell that could hold such a partner, until what is left is less likely than ``miss``.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import col, components, met_by_size, salted_join, written

THRESHOLD = 0.9
SIGMAS = 5.0  # width of the confidence bound in deviations
MISS = 1e-4  # likelihood of a linked partner outside the cells that a vector visits
CELL = 4096  # vectors a cell should hold; the number of cells follows the number of vectors
HOSTS, VISITORS = 4096, 8192  # vectors of a cell, and visitors, that one task compares
SIMPLE = 16  # dimensions below which the normal law is no use: every pair of a single cell is computed exactly
TOGETHER = 256  # visitors whose estimates a task computes in one product
ROTATION_SEED = 20

INDEX = "node bigint, w bigint, dim int, vec array<double>, code array<bigint>, factor double, home bigint, visits array<bigint>"


@lru_cache(maxsize=4)
def _rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([ROTATION_SEED, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    words = -(-bits.shape[1] // 64)
    filled = np.zeros((len(bits), words * 64), dtype=bool)
    filled[:, :bits.shape[1]] = bits
    return np.packbits(filled, axis=1, bitorder="little").view(np.uint64)


def _cells(turned: np.ndarray, bits: int, threshold: float, miss: float) -> tuple[int, list[int]]:
    """The cell of a vector, and the later cells that a partner at the threshold may lie in, likeliest first."""
    home = sum(1 << i for i in range(bits) if turned[i] > 0)
    if not bits:
        return home, []
    spread = math.sqrt(1.0 - threshold * threshold) / threshold
    odds, stays = [], 1.0
    for i in range(bits):
        x = abs(turned[i])
        away = x * math.sqrt(max(1, len(turned) - 1)) / (spread * math.sqrt(max(1e-12, 1.0 - x * x)))
        flips = max(0.5 * math.erfc(away / math.sqrt(2.0)), 1e-300)
        stays *= 1.0 - flips
        odds.append((math.log((1.0 - flips) / flips), 1 << i))
    odds.sort()
    # sets of flipped bits by falling likelihood: the last bit of a set moves on, or the next one joins
    queue, left, later = [(odds[0][0], 0, odds[0][1])], 1.0 - stays - miss, []
    while queue and left > 0:
        cost, last, mask = heapq.heappop(queue)
        left -= stays * math.exp(-cost)
        if home ^ mask > home:
            later.append(home ^ mask)
        if last + 1 < bits:
            step, bit = odds[last + 1]
            heapq.heappush(queue, (cost + step, last + 1, mask | bit))
            heapq.heappush(queue, (cost + step - odds[last][0], last + 1, mask ^ odds[last][1] | bit))
    return home, later


def valid(vec: Column) -> Column:
    """Whether a vector can link at all: not null, all components finite numbers, not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def index(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, cell: int = CELL) -> DataFrame:
    """Code, correction factor, cell and later cells to visit of every vector (node, w, vec: distinct and valid)."""
    bits = max(0, math.ceil(math.log2(max(1, vectors.count()) / cell)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column("vec")
            dims = pc.list_value_length(vecs).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(own))
                x = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                turned = _unit(x) @ _rotation(int(dim))
                code = _packed(turned > 0)
                factor = np.abs(turned).sum(axis=1) / math.sqrt(dim)
                reach = [_cells(row, bits if dim >= SIMPLE else 0, threshold, miss) for row in turned]
                yield pa.RecordBatch.from_arrays([
                    part.column("node"), part.column("w"), pa.array(np.full(len(own), dim, dtype=np.int32)),
                    pa.array(list(x), pa.list_(pa.float64())), pa.array(list(code.view(np.int64)), pa.list_(pa.int64())),
                    pa.array(factor), pa.array([r[0] for r in reach], pa.int64()),
                    pa.array([[r[0], *r[1]] for r in reach], pa.list_(pa.int64()))],
                    names=["node", "w", "dim", "vec", "code", "factor", "home", "visits"])

    return written(vectors.select("node", "w", "vec").mapInArrow(run, INDEX))


def _signs(words: np.ndarray, dim: int) -> np.ndarray:
    """Packed codes as rows of 1 and -1."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, count=dim, bitorder="little")
    return bits.astype(np.float32) * 2 - 1


def _linked(hosts: pd.DataFrame, guests: pd.DataFrame, cell: int, threshold: float, sigmas: float) -> pd.DataFrame:
    """node, links, root: rows linked to each vector of this meeting, and the smallest node reached here."""
    dim = int(hosts["dim"].iloc[0])
    hosts = hosts.sort_values("node")
    h_node, h_w = hosts["node"].to_numpy(np.int64), hosts["w"].to_numpy(np.int64)
    g_node, g_w = guests["node"].to_numpy(np.int64), guests["w"].to_numpy(np.int64)
    host, guest = (_unit(np.stack(f["vec"].to_numpy()).astype(np.float64)) for f in (hosts, guests))
    factor = hosts["factor"].to_numpy()
    signs = _signs(np.stack(hosts["code"].to_numpy()).astype(np.int64), dim)
    turned = (guest @ _rotation(dim)).astype(np.float32)
    at_home = guests["home"].to_numpy(np.int64) == cell
    # a pair at the threshold has an estimate above ``least``, but for errors beyond the bound
    bound = sigmas * np.sqrt((1.0 - threshold * threshold) * np.maximum(0.0, 1.0 - factor * factor) / max(1, dim - 1))
    least = ((threshold * factor - bound) * math.sqrt(dim)).astype(np.float32) if dim >= SIMPLE else np.full(len(hosts), -np.inf, np.float32)
    linked = np.zeros(len(hosts) + len(guests), np.int64)
    label = np.concatenate([h_node, g_node])  # a vector that is host and guest is tied to itself by its node
    for start in range(0, len(guests), TOGETHER):
        may = turned[start:start + TOGETHER] @ signs.T >= least
        for g in (start + np.flatnonzero(may.any(axis=1))).tolist():
            near, spot = np.flatnonzero(may[g - start]), len(hosts) + g
            if at_home[g]:  # both visit each other's cell: the greater node finds the smaller one
                near = near[h_node[near] < g_node[g]]
            near = near[host[near] @ guest[g] >= threshold]
            if not len(near):
                continue
            linked[spot] += h_w[near].sum()
            linked[near] += g_w[g]
            met = np.unique(label[near])
            lowest = min(met[0], label[spot])
            if met[-1] != lowest:
                label[np.isin(label, met)] = lowest
            label[spot] = lowest
    out = pd.DataFrame({"node": np.concatenate([h_node, g_node]), "links": linked, "root": label})
    return out[(out["links"] > 0) | (out["root"] != out["node"])]


def links(coded: DataFrame, threshold: float = THRESHOLD, sigmas: float = SIGMAS, hosts: int = HOSTS,
          visitors: int = VISITORS) -> DataFrame:
    """node, links, root: per vector and meeting the linked rows, and an edge to a smaller vector of its component.

    A cell with many vectors or visitors is dealt into meetings of bounded size. Every pair meets once.
    """
    visits = coded.select("dim", F.explode("visits").alias("cell"), "node", "w", "vec", "home")
    load = coded.select("dim", "home", F.explode("visits").alias("cell")).groupBy("dim", "cell").agg(
        F.count_if(F.col("home") == F.col("cell")).alias("own"), F.count(F.lit(1)).alias("all")).where("own > 0").select(
        "dim", "cell", F.ceil(F.col("own") / hosts).cast("int").alias("parts"),
        F.ceil(F.col("all") / visitors).cast("int").alias("chunks"))
    load = written(load)
    key = ["dim", "cell"]
    share = F.xxhash64("node")
    inside = coded.withColumn("cell", F.col("home")).join(load, key).withColumn(
        "part", F.pmod(share, F.col("parts")).cast("int")).withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    outside = visits.join(load, key).withColumn("chunk", F.pmod(share, F.col("chunks")).cast("int")).withColumn(
        "part", F.explode(F.expr("sequence(0, parts - 1)")))

    def meet(at, host: pd.DataFrame, guest: pd.DataFrame) -> pd.DataFrame:
        if not len(host) or not len(guest):
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in ("node", "links", "root")})
        return _linked(host.rename(columns=lambda c: c.removeprefix("host_")), guest, int(at[1]), threshold, sigmas)

    group = ["dim", "cell", "part", "chunk"]
    # both sides come from one table, so one of them gets names of its own
    left = inside.select(*[F.col(c).alias(f"host_{c}") for c in (*group, "node", "w", "vec", "code", "factor")])
    left = left.groupBy(*[f"host_{c}" for c in group])
    right = outside.select(*group, "node", "w", "vec", "home").groupBy(*group)
    return written(left.cogroup(right).applyInPandas(meet, "node bigint, links bigint, root bigint"))


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                    sigmas: float = SIGMAS, miss: float = MISS, cell: int = CELL, hosts: int = HOSTS,
                    visitors: int = VISITORS) -> DataFrame:
    """id, links, component, kept: one row per row of ``rows``.

    links counts the other rows at a cosine of ``threshold`` or more, component is the smallest id reachable over links, the
    row's own included, and kept says whether it is the row's own. Equal vectors are compared once and counted as many.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; neither do vectors of
    different lengths. A null id is never the smallest: a component is null only if all its ids are, and its rows are kept.
    Rows with one id are told apart by their vectors. An empty table gives no rows; other columns are not read.
    """
    vec = col(vec_col).cast("array<double>")
    own = rows.select(col(id_col).alias("id"), F.when(valid(vec), vec).alias("vec"))
    vectors = written(own.where("vec is not null").groupBy("vec").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("w"))
                      .withColumn("node", F.monotonically_increasing_id()))
    found = links(index(vectors, threshold, miss, cell), threshold, sigmas, hosts, visitors)
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    lows = written(vectors.select("node", "low").join(reached, "node").select("root", "node", "low"))
    least = salted_join(lows.select("root", "node"), lows.groupBy("root").agg(F.min("low").alias("component")), "root",
                        F.col("node")).select("node", "component")
    known = vectors.join(counted, "node", "left").join(least, "node", "left").select(
        "vec", "w", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"), F.coalesce("component", "low").alias("component"))
    total = vectors.agg(F.sum("w")).first()[0] or 0
    met = met_by_size(own.where("vec is not null"), written(known), "vec", "w", total).select("id", "links", "component")
    alone = own.where("vec is null").select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("component"))
    return met.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))
