"""Repair of conversation structure: the cheapest edits, and of those the least audit, by prefix doubling.

A conversation is repaired along a path through nodes (row, state), the state being what the roles so far end with. A
cost DP over rows gives the cheapest total, and with it the arcs that lie on cheapest paths: a row is four-by-four costs
between states, so blocks of rows are folded to one such matrix each and a conversation of many blocks is scanned by
doubling. Among the cheapest paths the one with the least audit wins: nodes on them are ranked by their least audit of
1, 2, 4, ... letters, a rank of twice the length being a pair of ranks joined over the pointer that leads as far, and
every node keeps the pointer of its least rank. The pointers, longest first, then mark the chosen path. No task holds
more than a block of a conversation; only its digest is made by one task, which streams its lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import col, placed, written

BLOCK = 4096  # rows of a conversation that one task folds at a time
NEVER = 1 << 40  # a cost that no path has
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3  # costs of the edits
UNENDED = 3  # what a truncated row costs that is not deleted
LETTERS = " DIKR"  # edits by rank of their letter; rank 0 stands past the end
NONE, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired roles end with so far
ENDS = (NONE, ASSISTANT)  # states a repaired conversation may end in
INSERTS = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the role that an inserted or reroled row takes
KEPT = {(NONE, SYSTEM): SYSTEM, (NONE, USER): USER, (SYSTEM, USER): USER, (USER, ASSISTANT): ASSISTANT, (ASSISTANT, USER): USER}
WHITE = " \t\n\x0b\x0c\r"
PACKED = 16  # letters up to which a rank is the audit itself, read as a number of base 5; longer ones are ranked anew


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """``rows`` with planted faults by CRC-32 of ``conv:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes
    its sentence ends, 3 repeats it, 4 makes its role user. Null values count as one space."""
    def spaced(name: str) -> Column:
        return F.coalesce(col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced(text_col), ".!?", "")).otherwise(spaced(text_col))
    return rows.where(kind != 0).withColumns({
        text_col: text, role_col: F.when(kind == 4, "user").otherwise(spaced(role_col)),
        "copy__": F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))}).drop("copy__")


# faults of rows

def _facts(rows: DataFrame) -> DataFrame:
    """c, i, n, conv, turn, kind, blank, duplicate, illegal for rows with c (conversation), i (place), n (rows), conv, turn,
    role, text. kind packs what the DP needs: role initial (1 to 3, else 0), 4 if truncated, 8 if it has to go."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    slim = written(rows.select(
        "c", "i", "n", "conv", "turn", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"),
        F.substring(bare, -1, 1).isin(".", "!", "?").alias("ended"),
        F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest")))
    first = slim.groupBy("c", "digest").agg(F.min("i").alias("i")).select("c", "i", F.lit(True).alias("first"))
    before = slim.select("c", (F.col("i") + 1).alias("i"), F.col("initial").alias("prior"))
    met = slim.join(first, ["c", "i"], "left").join(before, ["c", "i"], "left")
    duplicate = ~F.col("blank") & F.col("first").isNull()
    gone = F.col("blank") | duplicate
    initial = F.when(F.col("initial") == "s", SYSTEM).when(F.col("initial") == "u", USER).when(
        F.col("initial") == "a", ASSISTANT).otherwise(0)
    truncated = ~gone & ~F.col("ended")
    return met.select(
        "c", "i", "n", "conv", "turn", "blank", duplicate.alias("duplicate"), truncated.alias("truncated"),
        (F.col("prior").isNotNull() & ~F.concat("prior", "initial").isin("su", "ua", "au")).alias("illegal"),
        (initial + 4 * truncated.cast("int") + 8 * gone.cast("int")).alias("kind"))


# cost DP

def _arcs(kind: int) -> list[tuple[int, int, int, int]]:
    """Edits of a row: (state, next state, cost, letter)."""
    initial, truncated, gone = kind & 3, kind & 4, kind & 8
    arcs = [(s, s, DELETE, 1) for s in range(4)]
    if not gone:
        extra = UNENDED if truncated else 0
        arcs += [(s, INSERTS[s], REROLE + extra, 4) for s in range(4)]
        arcs += [(s, t, KEEP + extra, 3) for (s, role), t in KEPT.items() if role == initial]
    return arcs


_ARCS = [_arcs(kind) for kind in range(16)]


def _before(costs: list[int]) -> list[int]:
    """Costs to the end from each state, inserts allowed first, from those after the inserts (two at most are of use)."""
    for _ in range(2):
        costs = [min(costs[s], INSERT + costs[INSERTS[s]]) for s in range(4)]
    return costs


def _after(costs: list[int]) -> list[int]:
    """Costs of reaching each state, inserts allowed last."""
    for _ in range(2):
        costs = [min([costs[t]] + [INSERT + costs[s] for s in range(4) if INSERTS[s] == t]) for t in range(4)]
    return costs


_FINISH = _before([0 if s in ENDS else NEVER for s in range(4)])
_START = [0 if s == NONE else NEVER for s in range(4)]


def _behind(kinds: list[int], end: list[int]) -> list[list[int]]:
    """Costs to the end from every row of a block, given those after it."""
    out = [end]
    for kind in reversed(kinds):
        nxt, now = out[-1], [NEVER] * 4
        for s, t, cost, _ in _ARCS[kind]:
            now[s] = min(now[s], cost + nxt[t])
        out.append(_before(now))
    return out[::-1]


def _ahead(kinds: list[int], start: list[int]) -> list[list[int]]:
    """Costs of reaching every row of a block (inserts before it done), given those of reaching its first, before inserts."""
    out = [_after(start)]
    for kind in kinds:
        prior, now = out[-1], [NEVER] * 4
        for s, t, cost, _ in _ARCS[kind]:
            now[t] = min(now[t], cost + prior[s])
        out.append(_after(now))
    return out


def _matrix(kinds: bytes) -> list[int]:
    """Costs of a block from state to state, row by row of the matrix; inserts come before rows, never after the last."""
    columns = [_behind(list(kinds), [0 if s == t else NEVER for s in range(4)])[0] for t in range(4)]
    return [min(NEVER, columns[t][s]) for s in range(4) for t in range(4)]


def _product(a: Column, b: Column) -> Column:
    """First matrix a, then matrix b: the least sum over the state between them."""
    return F.array(*[F.least(F.lit(NEVER), *[a[4 * s + k] + b[4 * k + t] for k in range(4)])
                     for s in range(4) for t in range(4)])


def _scanned(blocks: DataFrame) -> DataFrame:
    """Adds to blocks (c, b, last, m) the matrices of all blocks before and behind each of them, by doubling; null where
    there are none. Rounds grow with the logarithm of the blocks of the longest conversation."""
    now = blocks.select("c", "b", F.col("m").alias("upto"), F.col("m").alias("since"))
    most, step = (blocks.agg(F.max("last")).first()[0] or 0) + 1, 1
    while step < most:
        left = now.select("c", (F.col("b") + step).alias("b"), F.col("upto").alias("earlier"))
        right = now.select("c", (F.col("b") - step).alias("b"), F.col("since").alias("later"))
        met = now.join(left, ["c", "b"], "left").join(right, ["c", "b"], "left")
        now = written(met.select(
            "c", "b", F.when(F.col("earlier").isNull(), F.col("upto")).otherwise(
                _product(F.col("earlier"), F.col("upto"))).alias("upto"),
            F.when(F.col("later").isNull(), F.col("since")).otherwise(
                _product(F.col("since"), F.col("later"))).alias("since")))
        step *= 2
    ahead = now.where(F.col("b") >= 0).select("c", (F.col("b") + 1).alias("b"), F.col("upto").alias("ahead"))
    behind = now.select("c", (F.col("b") - 1).alias("b"), F.col("since").alias("behind"))
    return blocks.join(ahead, ["c", "b"], "left").join(behind, ["c", "b"], "left")


def _apply_left(vector: list[int], matrix) -> list[int]:
    return vector if matrix is None else [min(vector[s] + matrix[4 * s + t] for s in range(4)) for t in range(4)]


def _apply_right(matrix, vector: list[int]) -> list[int]:
    return vector if matrix is None else [min(matrix[4 * s + t] + vector[t] for t in range(4)) for s in range(4)]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, list[int]] = {}  # short blocks repeat
    for batch in batches:
        made = []
        for kinds in batch.column("kinds").to_pylist():
            if kinds not in known:
                if len(known) > 10_000:
                    known.clear()
                known[kinds] = _matrix(kinds)
            made.append(known[kinds])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.int64()))],
                                         names=[*batch.schema.names, "m"])


def _cheapest_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """c, x, letter, y, total: the arcs of cheapest paths. A node is 4 * row + state; y is null where the audit ends."""
    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (zip(*out) if out else [()] * 5)],
                                          names=["c", "x", "letter", "y", "total"])

    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            if len(out) > 50_000:
                yield packed(out)
                out = []
            kinds, at, is_last = list(row["kinds"]), row["at"], row["b"] == row["last"]
            ahead = _ahead(kinds, _apply_left(_START, row["ahead"]))
            behind = _behind(kinds, _apply_right(row["behind"], _FINISH))
            total = min(a + b for a, b in zip(ahead[0], behind[0]))
            for k in range(len(kinds) + is_last):
                node = 4 * (at + k)
                ends = k == len(kinds)
                for s in range(4):
                    spent = ahead[k][s]
                    if spent + behind[k][s] != total or ends and s in ENDS:
                        continue
                    t = INSERTS[s]
                    if spent + INSERT + behind[k][t] == total:
                        out.append((row["c"], node + s, 2, None if ends and t in ENDS else node + t, total))
                    if not ends:
                        done = is_last and k + 1 == len(kinds)
                        out += [(row["c"], node + s, letter, None if done and t in ENDS else node + 4 + t, total)
                                for f, t, cost, letter in _ARCS[kinds[k]]
                                if f == s and spent + cost + behind[k + 1][t] == total]
        yield packed(out)


# the least audit

def _ranked(pairs: DataFrame, step: int) -> DataFrame:
    """c, x, rank, y from c, x, best (rank of the first ``step`` letters, rank of the next, pointer)."""
    parts = pairs.select("c", "x", F.col("best.first").alias("first"), F.col("best.rest").alias("rest"),
                         F.col("best.y").alias("y"))
    if 2 * step <= PACKED:
        return written(parts.select("c", "x", (F.col("first") * 5 ** step + F.col("rest")).alias("rank"), "y"))
    # equal audits have equal pairs, so only different pairs are sorted; numbers of range partitions ascend with them
    parts = written(parts)
    order = ["first", "rest"]
    ranks = written(parts.select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("rank", F.monotonically_increasing_id() + 1))
    # a pair that most nodes share is dealt to many tasks
    spread = ranks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return written(parts.withColumn("salt", F.pmod(F.xxhash64("c", "x"), F.lit(16)).cast("int")).join(
        spread, [*order, "salt"]).select("c", "x", "rank", "y"))


def _least_paths(arcs: DataFrame) -> DataFrame:
    """c, pos, x, letter: the nodes of every conversation's least audit in order, from the arcs of its cheapest paths.

    Round r has, per node, the rank of its least audit of 2^r letters and the node it leads to. Different edits lead to
    different nodes, so equal audits from a node end in one node and one pointer is enough. Conversations leave when their
    whole audit is covered.
    """
    least = arcs.groupBy("c", "x").agg(F.min(F.struct("letter", "y")).alias("best"))
    rounds = [written(least.select("c", "x", F.col("best.letter").alias("rank"), F.col("best.y").alias("y")))]
    step = 1
    while True:
        live = rounds[-1].where("x = 0 and y is not null").select("c")
        if live.isEmpty():
            break
        now = rounds[-1].join(live, "c", "left_semi")
        beyond = now.select("c", F.col("x").alias("y"), F.col("rank").alias("rest"), F.col("y").alias("z"))
        pairs = now.join(beyond, ["c", "y"], "left").groupBy("c", "x").agg(F.min(F.struct(
            F.col("rank").alias("first"), F.coalesce("rest", F.lit(0)).alias("rest"), F.col("z").alias("y"))).alias("best"))
        rounds.append(_ranked(pairs, step))
        step *= 2
    chosen = rounds[0].where("x = 0").select("c", "x", F.lit(0).cast("bigint").alias("pos"))
    for power in reversed(range(len(rounds))):
        ahead = chosen.join(rounds[power].where("y is not null"), ["c", "x"]).select(
            "c", F.col("y").alias("x"), (F.col("pos") + (1 << power)).alias("pos"))
        chosen = written(chosen.unionByName(ahead))
    return chosen.join(rounds[0].select("c", "x", F.col("rank").alias("letter")), ["c", "x"])


def _read_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """c, audit, repaired_sha256 from rows c, letter, line (null if deleted) that are sorted by conversation and position."""
    now, audit, digest, fresh = None, [], None, True

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array(["".join(audit)]),
                                           pa.array([digest.hexdigest()])], names=["c", "audit", "repaired_sha256"])

    for batch in batches:
        for c, letter, line in zip(*(batch.column(n).to_pylist() for n in ("c", "letter", "line"))):
            if digest is None or c != now:
                if digest is not None:
                    yield closed()
                now, audit, digest, fresh = c, [], hashlib.sha256(), True
            audit.append(LETTERS[letter])
            if line is not None:
                digest.update(line.encode("utf-8", "surrogatepass") if fresh else b"\n" + line.encode("utf-8", "surrogatepass"))
                fresh = False
    if digest is not None:
        yield closed()


class Repair:
    """The faults of a table of conversation rows and their repair.

    A conversation is the rows of one ``conv_col`` value (null is one too) by turn, nulls first, equal turns by role and
    text. Null roles and texts count as one space. A row's first fault counts: blank (nothing but white space), duplicate
    (role and text of an earlier row), truncated (not ending in ``.!?``). Repaired roles are nothing, or an optional system
    row and then user and assistant in turn. Kept rows cost 0, reroled and inserted ones 3, deleted ones 4; blank and
    duplicate rows are deleted; a truncated row that stays costs 3 more. Roles go by their first letter; others than s, u
    and a can only be reroled or deleted. Of the cheapest edits those win whose initials are least in ASCII order.

    Texts of any length and other columns, whatever their names, are no special case. An empty table gives no rows.
    """

    def __init__(self, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", block: int = BLOCK):
        base = rows.select(col(conv_col).alias("conv"), col(turn_col).alias("turn"),
                           F.coalesce(col(role_col).cast("string"), F.lit(" ")).alias("role"),
                           F.coalesce(col(text_col).cast("string"), F.lit(" ")).alias("text"))
        self.rows = placed(base, ["conv"], ["turn", "role", "text"], "c", "i", "n")
        self.facts = written(_facts(self.rows))
        packed = self.facts.groupBy("c", "n", F.expr(f"i div {block}").alias("b")).agg(
            F.array_sort(F.collect_list(F.struct("i", "kind"))).alias("own"))  # at most ``block`` rows
        kinds = F.unhex(F.array_join(F.transform("own.kind", lambda k: F.concat(F.lit("0"), F.hex(k))), ""))
        blocks = packed.select("c", "b", F.expr(f"(n - 1) div {block}").alias("last"),
                               (F.col("b") * block).alias("at"), kinds.alias("kinds"))
        made = written(blocks.mapInArrow(
            _matrices, "c bigint, b bigint, last bigint, at bigint, kinds binary, m array<bigint>"))
        self.arcs = written(_scanned(made).drop("m").mapInArrow(
            _cheapest_arcs, "c bigint, x bigint, letter bigint, y bigint, total bigint"))
        self.path = written(_least_paths(self.arcs))

    def lines(self) -> DataFrame:
        """c, pos, letter, role, text: every edit in order, with the row it leaves (null role and text if deleted)."""
        role = F.when(F.col("x") % 4 == USER, "assistant").otherwise("user")
        path = self.path.select("c", "pos", "letter", F.when(F.col("letter").isin(3, 4), F.expr("x div 4")).alias("i"),
                                role.alias("made"))
        met = path.join(self.rows.select("c", "i", "role", "text"), ["c", "i"], "left")
        return met.select("c", "pos", "letter",
                          F.when(F.col("letter") == 3, F.col("role")).when(F.col("letter") != 1, F.col("made")).alias("role"),
                          F.when(F.col("letter") == 2, "").otherwise(F.col("text")).alias("text"))

    def repaired(self) -> DataFrame:
        """conv, pos, role, text: the repaired conversations, positions ascending with gaps where rows were deleted."""
        names = self.facts.where("i = 0").select("c", "conv")
        return self.lines().where("letter <> 1").join(names, "c").select("conv", "pos", "role", "text")

    def report(self) -> DataFrame:
        """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation."""
        counted = self.facts.groupBy("c", "conv").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"),
            *[F.count_if(name).alias(name) for name in ("blank", "duplicate", "truncated", "illegal")])
        cost = self.arcs.where("x = 0").groupBy("c").agg(F.min("total").alias("cost"))
        dealt = self.lines().select("c", "pos", "letter", F.concat("role", F.lit(":"), "text").alias("line"))
        read = dealt.repartition("c").sortWithinPartitions("c", "pos").select("c", "letter", "line").mapInArrow(
            _read_out, "c bigint, audit string, repaired_sha256 string")
        return counted.join(cost, "c").join(read, "c").drop("c")


def repair_report(rows: DataFrame, original: DataFrame, conv_col: str = "conv_id", **columns: str) -> DataFrame:
    """``Repair(rows).report()`` for every conversation of ``original``; those without rows have zeros, an empty audit and
    the digest of nothing. The conversation's column keeps its name."""
    found = Repair(rows, conv_col, **columns).report()
    every = original.select(col(conv_col).alias("own")).distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    met = every.join(found, F.col("own").eqNullSafe(F.col("conv")), "left")
    return met.select(F.col("own").alias(conv_col), *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
