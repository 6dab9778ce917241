"""Merkle manifest of a table: one tree per group of rows, one tree over the groups, and a proof for every row.

Every level is a table of nodes (group, place, hash). A node at slot zero of its run computes the places of its siblings
by slot offsets, an equi-join of the level with itself fetches their hashes, and the slot-zero row emits the parent. No
task holds more than one run. Proofs go the other way: a run inherits the siblings above it from its parent, so what is
carried per row is a sixteenth of a proof.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import ascii_lower, col, placed, written

ARITY = 16
UP = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """A value as text that cannot run into its neighbour: ``-`` if null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values' fields."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _siblings(members: Column, slot: Column) -> Column:
    """What stands left and right of a slot in its run, each as one text."""
    return F.struct(F.array_join(F.slice(members, F.lit(1), slot), "").alias("left"),
                    F.array_join(F.slice(members, slot + 2, F.size(members)), "").alias("right"))


def _levels(nodes: DataFrame, most: int, arity: int) -> list[DataFrame]:
    """Runs of every level, lowest first: group, run, members (hashes in order), above (nodes of the group one level up).

    ``nodes`` has group, place, h and size (nodes of the group); ``most`` is the largest size. Groups of one node have no
    runs.
    """
    levels = []
    while most > 1:
        heads = nodes.where((F.col("size") > 1) & (F.col("place") % arity == 0))
        asked = heads.select("group", "size", F.col("place").alias("head"), F.explode(F.expr(
            f"sequence(place, least(place + {arity - 1}, size - 1))")).alias("place"))
        met = asked.join(nodes.select("group", "place", "h"), ["group", "place"])
        runs = met.groupBy("group", "head", "size").agg(F.array_sort(F.collect_list(F.struct("place", "h"))).alias("own"))
        levels.append(written(runs.select(
            "group", F.expr(f"head div {arity}").alias("run"), F.col("own.h").alias("members"),
            F.expr(f"(size + {arity - 1}) div {arity}").alias("above"))))
        nodes = levels[-1].select("group", F.col("run").alias("place"), F.col("above").alias("size"),
                                  F.sha2(F.array_join("members", ""), 256).alias("h"))
        most = -(-most // arity)
    return levels


def _tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """group, h: the one hash that remains of every group."""
    tops = nodes.where("size = 1").select("group", "h")
    for runs in levels:
        tops = tops.unionByName(runs.where("above = 1").select("group", F.sha2(F.array_join("members", ""), 256).alias("h")))
    return tops


def _with_path(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame | None:
    """The lowest runs with the siblings of all levels above them (``up``) and whatever else ``tops`` has per group.

    ``tops`` has group and up, the siblings above the group's tree.
    """
    above, extra = None, [c for c in tops.columns if c != "group"]
    for runs in reversed(levels):
        reached = runs.where("above = 1").join(tops, "group")
        if above is not None:
            reached = reached.unionByName(runs.where("above > 1").join(above, ["group", "run"]))
        below = reached.select("group", "run", "members", *extra, F.posexplode("members").alias("slot", "h"))
        above = below.select("group", (F.col("run") * arity + F.col("slot")).alias("run"), *[c for c in extra if c != "up"],
                             F.concat(F.array(_siblings(F.col("members"), F.col("slot"))), "up").alias("up"))
    return None if above is None else reached


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf leads to over the siblings of its path."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source",
             fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             altered: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """id, leaf, altered_leaf, subroot, root, path: one row per row of ``docs``.

    A leaf is the digest of the fields. Leaves of a group ascend by id (null ids first, equal ids by leaf); every ``arity``
    consecutive nodes become one until one remains, the subroot; a lone leaf is its own. Subroots ascend by group (null
    first, bytewise) and lead to the root in the same way. ``path`` holds the siblings left and right of the row's node on
    every level up to the root. ``altered`` replaces fields by other columns of ``docs`` for ``altered_leaf``, which is no
    part of the tree: folding it over the path shows whether a changed row would be noticed.

    Null values are a field of their own. Repeated rows are leaves of their own, with equal hashes at different places.
    Texts of any length are hashed whole. An empty table gives no rows. Other columns are not read.
    """
    changed = {**{f: col(f) for f in fields}, **(altered or {})}
    leaves = written(docs.select(col(id_col).alias("id"), col(group_col).alias("of"), leaf(*map(col, fields)).alias("leaf"),
                                 leaf(*[changed[f] for f in fields]).alias("altered_leaf")))
    own = written(placed(leaves, ["of"], ["id", "leaf"]))
    nodes = own.select("group", "place", F.col("leaf").alias("h"), "size")
    levels = _levels(nodes, own.agg(F.max("size")).first()[0] or 0, arity)

    subroots = written(_tops(nodes, levels))
    ranked = written(placed(subroots, [], ["group"], "tree").select(
        F.col("group").alias("of"), "place", "h", "size", F.lit(0).alias("group")))
    trees = _levels(ranked, ranked.count(), arity)
    last = _tops(ranked, trees).first()
    root = F.lit(last["h"] if last else None).cast("string")
    nothing = F.array().cast(UP)
    over = _with_path(trees, ranked.select("group").distinct().withColumn("up", nothing), arity)
    if over is None:
        tops = ranked.select(F.col("of").alias("group"), F.col("h").alias("subroot"), nothing.alias("up"))
    else:
        ways = over.select("up", "members", "run", F.posexplode("members").alias("slot", "h")).select(
            (F.col("run") * arity + F.col("slot")).alias("place"),
            F.concat(F.array(_siblings(F.col("members"), F.col("slot"))), "up").alias("up"))
        tops = ranked.join(ways, "place").select(F.col("of").alias("group"), F.col("h").alias("subroot"), "up")
    tops = written(tops)

    slot = (F.col("place") % arity).cast("int")
    lone = own.where("size = 1").join(tops, "group").select("id", "leaf", "altered_leaf", "subroot", F.col("up").alias("path"))
    runs = _with_path(levels, tops, arity)
    rows = lone
    if runs is not None:
        rows = lone.unionByName(own.where("size > 1").withColumn("run", F.expr(f"place div {arity}")).join(
            runs, ["group", "run"]).select("id", "leaf", "altered_leaf", "subroot", F.concat(
                F.array(_siblings(F.col("members"), slot)), "up").alias("path")))
    return rows.withColumn("root", root)


def tampered(docs: DataFrame, text: str, id_col: str = "doc_id", text_col: str = "text", every: int = 5) -> DataFrame:
    """``docs`` with a column ``text`` that is A-Z lower-cased in rows whose id's CRC-32 ``every`` divides."""
    hit = F.crc32(col(id_col).cast("string")) % every == 0
    return docs.withColumn(text, F.when(hit, ascii_lower(col(text_col))).otherwise(col(text_col)))
