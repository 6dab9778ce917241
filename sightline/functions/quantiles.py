"""Exact quantiles (linear interpolation) that never gather a column or a group in one task.

1. A bounded KLL sketch brackets every wanted rank between two values.
2. While a bracket may still hold more than ``KEEP`` rows it is counted and sketched again.
3. Rows inside the brackets are counted by value (map-side first, so a value that fills a third of the
   column is one row per task), and the wanted ranks are read off these counts.

A bracket that turns out to miss its rank is widened and goes round again, so the sketch only decides
how much work is done, never the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.session import cut_lineage, small_side
from sightline.types import chunks, col, sql_lit, sql_num

KEEP = 20_000  # rows of one bracket that may be listed by value
SKETCH_K, SLACK = 8_000, 0.0015  # KLL size, and the rank slack put on both sides of a wanted rank
GROUP_K, GROUP_SLACK = 1_000, 0.01
GRID = 100  # ranks read from the sketch of one group
COLUMNS_PER_JOB = 16
COUNTED_PER_JOB = 24
NARROWED_PER_JOB = 24  # brackets whose counts and sketches share one scan
FINE = 500  # ranks read from the sketch of one bracket


@dataclass
class Bracket:
    name: str
    p: float
    n: int
    lo: float
    hi: float
    bound: float  # rows expected inside, ends included only once

    @property
    def ranks(self) -> tuple[int, int]:
        r = int(math.floor(self.p * (self.n - 1) + 1e-9))
        return r, min(r + 1, self.n - 1)


def _sketch_rank(p: float, slack: float) -> tuple[float, float]:
    return max(0.0, p - slack), min(1.0, p + slack)


def exact_quantiles(df: DataFrame, names: list[str], probs=(0.25, 0.5, 0.75), keep: int | None = None) -> dict:
    """``{name: [quantile, ...]}`` for whole columns; null for a column without values."""
    exprs = {n: sql_num(n) for n in names}
    keep = KEEP if keep is None else keep
    brackets, limits = [], {}
    for group in chunks(list(exprs), COLUMNS_PER_JOB):
        sketches = df.agg(*[F.kll_sketch_agg_double(F.expr(exprs[n]), SKETCH_K).alias(f"s{i}") for i, n in enumerate(group)])
        ends = [0.0, 1.0] + [q for p in probs for q in _sketch_rank(p, SLACK)]
        ranks = ", ".join(sql_lit(q) for q in ends)
        row = sketches.select(*[F.expr(
            f"struct(kll_sketch_get_n_double(s{i}) as n, if(kll_sketch_get_n_double(s{i}) > 0, "
            f"kll_sketch_get_quantile_double(s{i}, array({ranks})), null) as ends) as r{i}")
            for i in range(len(group))]).first()
        for i, name in enumerate(group):
            r = row[f"r{i}"]
            if not r["n"]:
                continue
            limits[name] = (r["ends"][0], r["ends"][1])
            for j, p in enumerate(probs):
                brackets.append(Bracket(name, p, r["n"], r["ends"][2 * j + 2], r["ends"][2 * j + 3], 3.0 * SLACK * r["n"]))
    solved = _solve(df, brackets, exprs, limits, keep)
    return {name: [solved.get((name, p)) for p in probs] for name in exprs}


def _solve(df, brackets, exprs, limits, keep) -> dict:
    solved = {}
    while brackets:
        brackets = _narrow(df, brackets, exprs, limits, keep)
        missed = []
        for group in chunks(brackets, 3 * COLUMNS_PER_JOB):
            tables = _inside_counts(df, group, exprs)
            for i, b in enumerate(group):
                value = _read(b, tables.get(i, []))
                if value is None:
                    missed.append(replace(b, lo=limits[b.name][0], hi=limits[b.name][1], bound=math.inf))
                else:
                    solved[(b.name, b.p)] = value
        brackets = missed
    return solved


def _narrow(df: DataFrame, brackets: list[Bracket], exprs, limits, keep: int) -> list[Bracket]:
    """Shrink brackets until each holds at most ``keep`` rows between its ends.

    A round is one aggregate over the table for all brackets still open (``NARROWED_PER_JOB`` at a time): rows below and
    on the ends, and a sketch of the rows between, from which the next and much narrower ends are read.
    """
    brackets = list(brackets)
    while True:
        still_open = [i for i, b in enumerate(brackets) if b.bound > keep]
        if not still_open:
            return brackets
        for group in chunks(still_open, NARROWED_PER_JOB):
            grid = ", ".join(sql_lit(i / FINE) for i in range(FINE + 1))
            counted = df.agg(*[F.expr(e).alias(f"{k}{j}") for j, i in enumerate(group) for k, e in _bracket_counts(
                exprs[brackets[i].name], brackets[i])])
            row = counted.select("*", *[F.expr(
                f"if(kll_sketch_get_n_double(s{j}) > 0, kll_sketch_get_quantile_double(s{j}, array({grid})), null)").alias(
                f"q{j}") for j in range(len(group))]).drop(*[f"s{j}" for j in range(len(group))]).first()
            for j, i in enumerate(group):
                brackets[i] = _shrunk(brackets[i], row[f"a{j}"], row[f"b{j}"], row[f"c{j}"], row[f"d{j}"], row[f"q{j}"],
                                      limits[brackets[i].name], keep)


def _bracket_counts(x: str, b: Bracket) -> list[tuple[str, str]]:
    lo, hi = sql_lit(b.lo), sql_lit(b.hi)
    return [("a", f"count_if({x} < {lo})"), ("b", f"count_if({x} <= {lo})"), ("c", f"count_if({x} < {hi})"),
            ("d", f"count_if({x} <= {hi})"),
            ("s", f"kll_sketch_agg_double(if({x} > {lo} and {x} < {hi}, {x}, null), {SKETCH_K})")]


def _shrunk(b: Bracket, below: int, to_lo: int, under: int, to_hi: int, grid, limits, keep: int) -> Bracket:
    r0, r1 = b.ranks
    if r0 < below or r1 >= to_hi:  # missed: open that side
        return replace(b, lo=limits[0] if r0 < below else b.lo, hi=limits[1] if r1 >= to_hi else b.hi, bound=math.inf)
    if r1 < to_lo:
        return replace(b, hi=b.lo, bound=0.0)
    if r0 >= under:
        return replace(b, lo=b.hi, bound=0.0)
    inside = under - to_lo
    if inside <= keep:
        return replace(b, bound=inside)
    left = math.floor((r0 - to_lo) / inside * FINE) - 1
    right = math.ceil((r1 - to_lo) / inside * FINE) + 1
    return replace(b, lo=b.lo if left <= 0 else grid[left], hi=b.hi if right >= FINE else grid[right])


def _inside_counts(df: DataFrame, group: list[Bracket], exprs) -> dict[int, list[tuple[float, int]]]:
    """Per bracket: rows below it (value None), rows on its ends, and the values between with their counts."""
    out: dict[int, list] = {}
    for part in chunks(list(enumerate(group)), COUNTED_PER_JOB):
        row = df.agg(*[F.expr(f"count_if({test}) as {k}{i}") for i, b in part
                       for k, test in _end_tests(exprs[b.name], b)]).first()
        for i, b in part:
            below, to_lo = row[f"a{i}"], row[f"b{i}"]
            out[i] = [(None, below), (b.lo, to_lo - below)]
            if b.hi > b.lo:
                out[i].append((b.hi, row[f"d{i}"] - row[f"c{i}"]))
    wide = [(i, b, f"({exprs[b.name]} > {sql_lit(b.lo)} and {exprs[b.name]} < {sql_lit(b.hi)})")
            for i, b in enumerate(group) if b.hi > b.lo]
    if wide:
        # the bounds on the column itself let the scan skip row groups outside every bracket
        cells = ", ".join(f"struct({i} as i, if({hit}, {exprs[b.name]}, null) as v)" for i, b, hit in wide)
        inside = (df.filter(" or ".join(hit for *_, hit in wide)).select(F.expr(f"inline(array({cells}))"))
                  .filter("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("k")))
        for r in inside.collect():  # at most KEEP values per bracket
            out[r["i"]].append((r["v"], r["k"]))
    return out


def _end_tests(x: str, b: Bracket) -> list[tuple[str, str]]:
    lo, hi = sql_lit(b.lo), sql_lit(b.hi)
    tests = [("a", f"{x} < {lo}"), ("b", f"{x} <= {lo}")]
    return tests if b.lo == b.hi else tests + [("c", f"{x} < {hi}"), ("d", f"{x} <= {hi}")]


def _read(b: Bracket, table) -> float | None:
    reached = sum(k for v, k in table if v is None)
    r0, r1 = b.ranks
    if r0 < reached:
        return None
    found = {}
    for v, k in sorted((v, k) for v, k in table if v is not None):
        reached += k
        for r in (r0, r1):
            if r not in found and r < reached:
                found[r] = v
        if r1 in found:
            break
    if r1 not in found:
        return None
    part = b.p * (b.n - 1) - r0
    return found[r0] if part <= 1e-9 else found[r0] + (found[r1] - found[r0]) * part


def grouped_quantiles(df: DataFrame, keys: list[str], value: Column, probs=(0.25, 0.5, 0.75),
                      keep: int | None = None) -> DataFrame:
    """Quantiles per group: ``keys..., n, quantiles array<double>``; hot groups stay spread over tasks.

    One bracket row per group and probability meets the rows of its group in an equi-join (broadcast while
    that table is small, split by the adaptive skew join beyond).  Counts are keyed by group *and* value.
    """
    keep = KEEP if keep is None else keep
    names = [col(k) for k in keys]
    base = df.select(*names, value.cast("double").alias("_x")).filter("_x is not null")
    sketch = base.groupBy(*names).agg(F.count("_x").alias("n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"),
                                      F.kll_sketch_agg_double("_x", GROUP_K).alias("_s"))
    small = F.col("n") <= keep
    states = []
    for i, p in enumerate(probs):
        lo, hi = [F.when(small, end).otherwise(F.kll_sketch_get_quantile_double("_s", F.lit(q)))
                  for end, q in zip((F.col("_min"), F.col("_max")), _sketch_rank(p, GROUP_SLACK))]
        states.append(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), lo.alias("lo"), hi.alias("hi"),
                               F.when(small, F.col("n").cast("double")).otherwise(3 * GROUP_SLACK * F.col("n"))
                               .alias("bound")))
    rank = F.floor(F.col("p") * (F.col("n") - 1) + F.lit(1e-9)).cast("long")
    state = (sketch.select(*names, "n", "_min", "_max", F.inline(F.array(*states)))
             .withColumn("r0", rank).withColumn("r1", F.least(rank + 1, F.col("n") - 1)))
    solved = None
    while True:
        while True:  # narrow wide brackets; the state table has one row per group and probability
            state = cut_lineage(state)
            if state.filter(F.col("bound") > keep).isEmpty():
                break
            state = state.filter(F.col("bound") <= keep).unionByName(
                _narrow_groups(base, state.filter(F.col("bound") > keep), keys, keep))
        step = cut_lineage(_finish_groups(base, state, keys))
        good = step.filter("v is not null").select(*names, "n", "i", "v")
        solved = good if solved is None else solved.unionByName(good)
        missed = step.filter("v is null")
        if missed.isEmpty():
            break
        state = missed.drop("v").withColumn("lo", F.col("_min")).withColumn("hi", F.col("_max")).withColumn(
            "bound", F.lit(float("inf")))
    listed = F.array_sort(F.collect_list(F.struct("i", "v")))  # one entry per probability
    return solved.groupBy(*names).agg(F.max("n").alias("n"),
                                      F.transform(listed, lambda s: s["v"]).alias("quantiles"))


def _meet(base: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    s, b = small_side(state).alias("s"), base.alias("b")
    on = [F.col(f"b.`{k}`").eqNullSafe(F.col(f"s.`{k}`")) for k in keys]
    return b.join(s, on).select("s.*", "b._x")


def _finish_groups(base: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    fields = state.columns
    x = F.col("_x")
    counted = (_meet(base, state, keys).filter(x <= F.col("hi"))
               .withColumn("_v", F.when(x >= F.col("lo"), x)).drop("_x")
               .groupBy(*[col(f) for f in fields], "_v").agg(F.count(F.lit(1)).alias("_k")))
    upto = Window.partitionBy(*[col(k) for k in keys], "i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0)  # at most KEEP + 2 values per bracket
    run = counted.withColumn("_to", F.sum("_k").over(upto)).withColumn("_from", F.col("_to") - F.col("_k"))
    pick = lambda r: F.max(F.when((F.col(r) >= F.col("_from")) & (F.col(r) < F.col("_to")), F.col("_v")))
    got = run.groupBy(*[col(f) for f in fields]).agg(pick("r0").alias("_v0"), pick("r1").alias("_v1"))
    part = F.col("p") * (F.col("n") - 1) - F.col("r0")
    v = F.when(part <= 1e-9, F.col("_v0")).otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * part)
    return got.withColumn("v", v).drop("_v0", "_v1")


def _narrow_groups(base: DataFrame, state: DataFrame, keys: list[str], keep: int) -> DataFrame:
    fields = state.columns
    x, lo, hi = F.col("_x"), F.col("lo"), F.col("hi")
    step = _meet(base, state, keys).groupBy(*[col(f) for f in fields]).agg(
        F.count_if(x < lo).alias("below"), F.count_if(x <= lo).alias("to_lo"), F.count_if(x < hi).alias("under"),
        F.count_if(x <= hi).alias("to_hi"),
        F.kll_sketch_agg_double(F.when((x > lo) & (x < hi), x), GROUP_K).alias("s"))
    ranks = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    step = step.withColumn("grid", F.when(F.kll_sketch_get_n_double("s") > 0,
                                           F.kll_sketch_get_quantile_double("s", ranks)))
    m = F.col("under") - F.col("to_lo")
    low_miss, high_miss = F.col("r0") < F.col("below"), F.col("r1") >= F.col("to_hi")
    left = F.floor((F.col("r0") - F.col("to_lo")) / m * GRID).cast("int") - 1
    right = F.ceil((F.col("r1") - F.col("to_lo")) / m * GRID).cast("int") + 1
    q = lambda i: F.try_element_at(F.col("grid"), F.least(F.greatest(i, F.lit(0)), F.lit(GRID)) + 1)
    on_lo, on_hi, fits = F.col("r1") < F.col("to_lo"), F.col("r0") >= F.col("under"), m <= keep
    new_lo = (F.when(low_miss, F.col("_min")).when(high_miss, lo).when(on_lo, lo).when(on_hi, hi)
              .when(fits | (left <= 0), lo).otherwise(q(left)))
    new_hi = (F.when(high_miss, F.col("_max")).when(low_miss, hi).when(on_lo, lo).when(on_hi, hi)
              .when(fits | (right >= GRID), hi).otherwise(q(right)))
    bound = (F.when(low_miss | high_miss, F.lit(float("inf"))).when(on_lo | on_hi, F.lit(0.0))
             .when(fits, m.cast("double")).otherwise(F.lit(float("inf"))))
    return step.select(*[new_lo.alias("lo") if f == "lo" else new_hi.alias("hi") if f == "hi" else
                         bound.alias("bound") if f == "bound" else col(f) for f in fields])
