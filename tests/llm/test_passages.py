"""Repeated passages against a count of all windows."""

import random
from collections import Counter

import pytest

from sightline.llm import passages

SCHEMA = "doc_id long, text string, place int, hash string, at int"


def brute(rows, span):
    windows = Counter()
    texts = [(i, ["".join(c.lower() if c.isascii() else c for c in w) for w in (t or "").split()]) for i, t in rows]
    for _, w in texts:
        windows.update(tuple(w[k:k + span]) for k in range(len(w) - span + 1))
    out = []
    for i, w in texts:
        run = None
        for k in range(len(w) - span + 1):
            if windows[tuple(w[k:k + span])] > 1:
                if run and k <= run[1]:
                    run[1] = k + span
                else:
                    run = [k, k + span]
                    out.append((i, run))
    return sorted(((i, a, b - a) for i, (a, b) in out), key=repr)


@pytest.mark.parametrize("seed,partitions", [(1, 8), (2, 50), (3, 1)])
def test_equals_search(spark, seed, partitions):
    rng = random.Random(seed)
    line = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    shared = [line(rng.choice([49, 50, 51, 80, 200])) for _ in range(8)]
    rows = []
    for i in range(60):
        words = line(rng.randint(0, 150))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(shared)[: rng.choice([48, 60, 300])]
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else "  ".join(words)))
    rows += [rows[3], (None, rows[5][1]), (None, None), (70, ""), (71, "same " * 400), (72, "É " * 60),
             (73, " ".join(line(40_000)))]
    rows += [(1000 + i, rows[8][1]) for i in range(200)]  # one passage in most rows
    docs = spark.createDataFrame([(*r, 1, "h", 2) for r in rows], SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = passages.repeated_passages(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(((r.id, r.start, r.n_words) for r in got), key=repr) == brute(rows, passages.SPAN)


def test_empty_table(spark):
    assert passages.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0
