"""The classifier: held-out accuracy, rows without labels, awkward texts."""

import numpy as np

from sightline.llm import quality

SF_DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.scores(docs, labels)
    assert scored.count() == docs.count()
    rows = scored.join(labels, scored["id"] == labels["doc_id"]).where("held_out").collect()
    assert len(rows) > 600
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.99
    assert np.mean([r.predicted for r in rows if r.quality == 1]) >= 0.99


def test_awkward_rows(spark):
    rows = [(i, ("good calm words here " * 5 if i % 2 else "BAD!! BAD!! BAD!! ") + str(i)) for i in range(60)]
    odd = [(None, "good words"), (100, None), (101, ""), (102, "word " * 60_000), (103, None), (1, rows[1][1])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "doc_id long, text string, y int, place string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (100, None, 0), (3, 1, 0), (999, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.scores(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.id in (100, 101, 103)}) == 1
    assert len({r.score for r in got if r.id == 1}) == 1
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in got)


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.scores(docs, labels).first().score == 0.5
    assert quality.scores(docs.limit(0), labels).count() == 0


def test_one_class_gives_its_share():
    weights, a, b = quality.fit([np.array([0, 1])] * 8, np.ones(8, dtype=int), 16)
    assert not weights.any() and a == 0 and b > 1


def test_repeated_words_share_features():
    words = quality._Words()
    one, two = quality.features("foo foo foo foo", words), quality.features("bars bars bars bars", words)
    assert len(np.intersect1d(one, two)) > 3
    assert quality.features(None, words).tolist() == quality.features("", words).tolist() == [0]


def test_hinge_weights_equal_projected_gradient():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(12, rng.integers(2, 6), replace=False)) for _ in range(40)]
    values = [rng.normal(size=len(r)).astype(np.float32) for r in rows]
    y = np.where(rng.random(40) < 0.5, 1, -1)
    x = np.zeros((40, 12))
    for i, (r, v) in enumerate(zip(rows, values)):
        x[i, r] = v
    gram = (x * y[:, None]) @ (x * y[:, None]).T
    dual, step = np.zeros(40), 1 / np.linalg.eigvalsh(gram).max()
    for _ in range(60_000):
        dual = np.clip(dual + step * (1 - gram @ dual), 0, 0.7)
    got = quality._hinge(rows, values, y, 12, epochs=3000, cost=0.7)
    assert np.allclose(got, (dual * y) @ x, atol=1e-3)
    assert (dual > 0.699).any() and (dual < 1e-6).any()


def test_scores_equal_plain_python(spark):
    """The whole classifier again, with dictionaries of n-grams instead of arrays."""
    import math
    rows = [(i, ("kind words in a row " * 3 if i % 2 else "SPAM now!! 99 buy ") + f"tail {i % 7}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    weights, a, b = quality.train(docs, labels)
    words = quality._Words()
    for r in quality.scores(docs, labels).collect():
        grams = set(quality.features(rows[r.id][1], words).tolist())
        margin = sum(float(weights[g]) for g in grams) / math.sqrt(len(grams))
        assert abs(r.score - 1 / (1 + math.exp(-(a * margin + b)))) < 1e-6
