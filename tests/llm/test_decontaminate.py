"""Contamination against a plain search for every window."""

import random
import re
from pathlib import Path

import pytest

from sightline.llm import decontaminate
from sightline.session import scratch_folder

SCHEMA = "doc_id long, text string, n_words string, item_id int, row long"
ITEMS = "item_id long, text string, fp int"


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, names = tokens(text), set(), set()
        for item_id, item in items:
            v = tokens(item)
            n = min(13, len(v))
            for j in range(len(v) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i:i + n] == v[j:j + n]:
                        hit.update(range(i, i + n))
                        names.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def planted(seed, shorts):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "é", "x1", "ß", "a", "日本", "Word"]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, line(n)) for i, n in enumerate([13, 14, 20, 40, 13, 60, *shorts])]
    docs = []
    for i in range(25):
        text = line(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            _, v = rng.choice(items)
            a = rng.randint(0, max(0, len(v) - 5))
            at = rng.randint(0, len(text))
            text[at:at] = v[a:a + rng.randint(5, 30)]
        docs.append((i, " ".join(text)))
    return docs, [(i, ", ".join(v)) for i, v in items]


@pytest.mark.parametrize("seed,shorts,bits,broadcast", [(1, [], 1 << 22, 200_000), (2, [1, 3, 5, 12], 1 << 22, 200_000),
                                                        (3, [7, 8], 64, 0)])
def test_equals_search(spark, seed, shorts, bits, broadcast):
    docs, items = planted(seed, shorts)
    docs += [(None, None), (90, ""), (91, "one"), (91, "one"), (None, items[0][1]), (92, "x " * 3000 + items[2][1])]
    items += [(None, items[0][1]), (None, None), (70, ""), (71, items[1][1]), (71, items[1][1]), (72, "...")]
    got = decontaminate.contamination(
        spark.createDataFrame([(*d, "", 1, 2) for d in docs], SCHEMA),
        spark.createDataFrame([(*i, 0) for i in items], ITEMS), table_bits=bits, broadcast_windows=broadcast)
    rows = [(r.id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got.collect()]
    assert sorted(rows, key=repr) == brute(docs, items)
    assert all(r.n_items == len(r["items"]) for r in got.collect())


def test_contaminated_rows_go(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    docs = [(1, passage), (2, "clean text"), (2, "clean text"), (None, passage), (None, "other"), (3, None),
            (4, passage + " z" * 400)]
    df = spark.createDataFrame([(*d, "", 1, 2) for d in docs], SCHEMA)
    kept = decontaminate.decontaminate(df, spark.createDataFrame([(1, passage, 0)], ITEMS))
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(2, "clean text"), (2, "clean text"), (None, "other"), (3, None), docs[-1]], key=repr)


@pytest.mark.parametrize("hits", [0, 200_000])
def test_few_rows_are_few_files_whatever_the_shuffle(spark, hits):
    docs, items = planted(4, [2, 6])
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = lambda: set(Path(scratch_folder(spark).removeprefix("file:")).glob("*/part-*.parquet"))
    try:
        before = parts()
        got = decontaminate.contamination(
            spark.createDataFrame([(*d, "", 1, 2) for d in docs], SCHEMA).coalesce(1),
            spark.createDataFrame([(*i, 0) for i in items], ITEMS).coalesce(1), broadcast_hits=hits)
        rows = [(r.id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got.collect()]
        assert len(parts() - before) <= 6  # a table each
        assert hits == 0 or got.rdd.getNumPartitions() <= 8  # documents stay where they are
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(rows, key=repr) == brute(docs, items)


def test_empty_tables(spark):
    empty, none = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS)
    assert decontaminate.contamination(empty, none).count() == 0
    row = decontaminate.contamination(spark.createDataFrame([(1, "a b", "", 1, 2)], SCHEMA), none).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)
