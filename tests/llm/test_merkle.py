"""Merkle manifest against plain Python, and how changed rows show."""

import hashlib

from pyspark.sql import functions as F

from sightline.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(hashes, arity):
    """Root, and for every leaf the siblings (left, right) of each level."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        runs = [hashes[i:i + arity] for i in range(0, len(hashes), arity)]
        for leaf, spot in enumerate(at):
            run, slot = runs[spot // arity], spot % arity
            paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1:])))
            at[leaf] = spot // arity
        hashes = [digest(*run) for run in runs]
    return hashes[0], paths


def expected(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, digest(*map(field, r)), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found, subroots = [], []
    for name in names:
        members = sorted(groups[name], key=lambda m: m[:3])
        subroot, paths = tree([m[2] for m in members], arity)
        subroots.append(subroot)
        found += [(m[3][0], m[2], subroot, path, len(subroots) - 1) for m, path in zip(members, paths)]
    root, over = tree(subroots, arity)
    return sorted(repr((doc, leaf, subroot, root, path + over[of])) for doc, leaf, subroot, path, of in found)


def got(spark, rows, arity=16, extra=False):
    docs = spark.createDataFrame(rows, SCHEMA)
    if extra:
        docs = docs.withColumns({"place": F.lit(1), "group": F.lit("g"), "size": F.lit(0), "leaf": F.lit(""), "h": F.lit("")})
    found = merkle.manifest(docs, arity=arity).collect()
    return sorted(repr((r.id, r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.path])) for r in found)


def test_equals_plain_python(spark):
    rows = [(i, f"s{i % 3}" if i % 50 else None, "en", i, "Text Ünï" * (i % 4)) for i in range(400)]
    rows += [(7, "s1", "en", 7, None), (7, "s1", None, None, "x"), (7, "s1", None, None, "x"), (None, "s1", None, None, ""),
             (None, None, None, None, None), (1000, "lone", "de", 1, "a" * 300_000), (5, "Ähre", "de", 1, "b"), (6, "", "", 0, "")]
    assert got(spark, rows, extra=True) == expected(rows, 16)


def test_other_arity_and_few_rows(spark):
    rows = [(i, "s", "en", 1, "t") for i in range(33)]
    assert got(spark, rows, arity=2) == expected(rows, 2)
    assert got(spark, rows[:1]) == expected(rows[:1], 16)
    assert got(spark, rows[:17]) == expected(rows[:17], 16)


def test_more_groups_than_a_run_holds(spark):
    rows = [(i, f"g{i:04d}", "en", 1, "t") for i in range(300)]
    assert got(spark, rows) == expected(rows, 16)


def test_empty_table(spark):
    found = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert found.columns == ["id", "leaf", "altered_leaf", "subroot", "path", "root"] and found.count() == 0


def test_changed_rows_show(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, t) for i, t in enumerate(["Upper", "lower", None, "ÄB"] * 20)], SCHEMA)
    docs = merkle.tampered(docs, "other")
    found = merkle.manifest(docs, altered={"text": F.col("other")})
    found = found.withColumn("ok", merkle.folded(F.col("altered_leaf"), F.col("path")) == F.col("root"))
    assert found.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    changed = docs.where(~F.col("text").eqNullSafe(F.col("other")))
    assert 0 < changed.count() < docs.count()
    assert {r.id for r in found.where("not ok").collect()} == {r.doc_id for r in changed.collect()}
