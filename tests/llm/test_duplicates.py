"""Exact and SimHash duplicates against plain Python over small tables."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sightline.llm import exact_dedup, simhash
from sightline.llm.common import components

AWKWARD = [(1, "Same Text"), (2, "same text"), (2, "same text"), (None, "SAME TEXT"), (3, None), (4, ""), (5, "É"),
           (6, "é"), (7, "long " * 50_000), (None, None), (8, " \n\t"), (9, "a b"), (9, "a b c d e f")]


def brute_exact(rows):
    low = [(i, hashlib.sha256("".join(c.lower() if c.isascii() else c for c in (t or "")).encode()).hexdigest())
           for i, t in rows]
    out = []
    for i, h in low:
        ids = [j for j, g in low if g == h]
        out.append((i, max((j for j in ids if j is not None), default=None), len(ids), h))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, exact_dedup.MAX_BITS])
def test_exact_groups(spark, bits):
    docs = spark.createDataFrame([(i, t, "x", True) for i, t in AWKWARD], "doc_id long, text string, sha string, maybe boolean")
    got = [tuple(r) for r in exact_dedup.duplicate_groups(docs, max_bits=bits).collect()]
    assert sorted(((i, k, n, h) for i, k, n, _, h in got), key=repr) == brute_exact(AWKWARD)
    assert sum(kept for _, _, _, kept, _ in got) == len({h for *_, h in got})
    assert all(i == k for i, k, _, kept, _ in got if kept)


@pytest.mark.parametrize("bits", [64, exact_dedup.MAX_BITS])
def test_exact_keeps_whole_rows(spark, bits):
    docs = spark.createDataFrame([(i, t, "x") for i, t in AWKWARD], "doc_id long, text string, sha string")
    kept = exact_dedup.deduplicate(docs, max_bits=bits)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(2, "same text"), (4, ""), (5, "É"), (6, "é"), (7, "long " * 50_000), (8, " \n\t"), (9, "a b"), (9, "a b c d e f")],
        key=repr)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.duplicate_groups(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


def brute_print(text, k=4):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in (text or "")).replace("\x0b", " ")
             .replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_the_majority_of_xxh64_bits(spark):
    rng = random.Random(5)
    texts = [None, "", "Ein", "a b c", "a a a a a a a", "x y z w v", "É \x0b B\x0cc\td\re"]
    texts += [" ".join(rng.choice("abcdefg") * rng.randint(1, 9) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    assert [simhash.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]
    first = simhash.as_hex(simhash.fingerprints(spark.createDataFrame([(1, "the Quick brown fox")], "doc_id long, text string")))
    jvm = spark.range(1).select(F.lower(F.hex(F.xxhash64(F.lit("the quick brown fox"))))).first()[0]
    assert first.first()["fingerprint"] == jvm.rjust(16, "0")


def brute_components(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for u, v in linked:
            low = min(root[u], root[v])
            if root[u] != low or root[v] != low:
                root[u] = root[v] = low
                changed = True
    return root


@pytest.mark.parametrize("leaf,shard", [(384, 40_000), (4, 30)])
def test_vantage_point_links_lose_nothing(spark, leaf, shard):
    rng = random.Random(3)
    points = {rng.getrandbits(64) for _ in range(300)}
    for p in rng.sample(sorted(points), 60):  # chains and stars of near copies
        for _ in range(6):
            for _ in range(rng.randint(1, 5)):
                p ^= 1 << rng.randrange(64)
            points.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    want = brute_components(signed, [(a, b) for a in signed for b in signed
                                     if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4])
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), leaf=leaf, shard=shard)
    got = {p: p for p in signed}
    got.update({r.node: r.root for r in components(found).collect()})
    assert got == want


def test_component_is_the_smallest_id_and_one_stays(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base + " end"), (9, "quite another text here"), (None, base), (5, base), (7, None), (6, ""),
            (9, "quite another text here")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, id string")
    got = {(r.id, r.component) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(5, 3), (3, 3), (None, 3), (9, 9), (7, 6), (6, 6)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 6, 9]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")
    assert {r.node: r.root for r in components(edges).collect()} == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_leaves_stay_bounded_whatever_the_sample(spark, monkeypatch):
    """Trees fitted on 300 fingerprints; leaves are cut further by trees of their own, and no link is lost."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 64, 30_000, dtype=np.uint64)
    flips = np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (3000, 4)).astype(np.uint64), axis=1)
    prints = np.unique(np.concatenate([base, base[:3000] ^ flips, base[:1] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    seen = []
    right = simhash._refined

    def refined(*args):
        out = right(*args).cache()
        seen.append({(r.tree, r.leaf): r.own for r in out.groupBy("tree", "leaf").agg(F.count_if("home").alias("own")).collect()})
        seen.append(args[0].groupBy("tree", "leaf").agg(F.count_if("home").alias("own")).agg(F.max("own")).first()[0])
        return out

    monkeypatch.setattr(simhash, "_refined", refined)
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    got = simhash.links(df, sample=300, leaf=100, fat=1500).collect()
    assert seen[1] > 1500 >= max(seen[0].values()) and sum(seen[0].values()) == 3 * len(prints)
    root = {int(p): int(p) for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in got:
        u, v = (int(np.int64(x).astype(np.uint64)) for x in (r.u, r.v))
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    every = {int(p) for p in prints}
    for x, f in zip(base[:3000].tolist(), flips.tolist()):
        assert find(x) == find(x ^ f)
    for i in range(64):
        assert find(int(base[0])) == find(int(base[0]) ^ 1 << i)
    assert len(every) == len(prints)
