"""Boilerplate lines against plain Python, with and without sketches near the threshold."""

import random

import pytest

from sightline.llm import line_dedup

SCHEMA = "doc_id long, text string, source string, n_chars int, pos int, line string"


def brute(rows, min_sites):
    norm = lambda s: "".join(c.lower() if c.isascii() else c for c in s).strip(" ")
    sites, first = {}, {}
    for i, t, s in rows:
        for pos, x in enumerate(t.split("\n") if t is not None else []):
            if norm(x):
                sites.setdefault(norm(x), set()).add(s)
                order = (i is None, i or 0, pos)
                first[norm(x)] = min(first.get(norm(x), order), order)
    out = []
    for i, t, s in rows:
        if t is not None:
            t = "\n".join(x for pos, x in enumerate(t.split("\n")) if not norm(x) or len(sites[norm(x)]) < min_sites
                          or first[norm(x)] == (i is None, i or 0, pos))
        out.append((i, t, s))
    return sorted(out, key=repr)


@pytest.mark.parametrize("margin", [0.15, 0.0])
def test_equals_search(spark, margin, monkeypatch):
    rng = random.Random(4)
    lines = [f" Line {k}" for k in range(30)] + ["", "É", "é "]
    rows = []
    for i in range(150):
        text = "\n".join(rng.choice(lines[: rng.choice([5, 33])]).upper() if rng.random() < .3 else rng.choice(lines)
                         for _ in range(rng.randint(1, 9)))
        rows.append((i, text, rng.choice([None, "", *"abcdefghijklmnop"])))
    rows += [rows[0], (None, " Line 1\nown", "a"), (400, None, "a"), (401, "", None), (402, "\n\n Line 1 \n", "b"),
             (403, "very long " * 30_000 + "\n Line 2", "c")]
    docs = spark.createDataFrame([(*r, 0, 1, "x") for r in rows], SCHEMA)
    got = line_dedup.remove_boilerplate(docs, length_col="n_chars", min_sites=9, n_lines="n", n_removed="gone")
    assert got.columns == [*docs.columns, "n", "gone"]
    found = got.collect()
    assert sorted(((r.doc_id, r.text, r.source) for r in found), key=repr) == brute(rows, 9)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found)


def test_many_sites_are_estimated(spark):
    rows = [(i, "common\nrare" if i < 40 else "common", f"s{i}") for i in range(5000)]
    docs = spark.createDataFrame([(*r, 0, 1, "x") for r in rows], SCHEMA)
    got = {r.doc_id: r.text for r in line_dedup.remove_boilerplate(docs, min_sites=60).collect()}
    assert got[0] == "common\nrare" and got[1] == "rare" and got[50] == ""


def test_empty_table(spark):
    assert line_dedup.remove_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0
