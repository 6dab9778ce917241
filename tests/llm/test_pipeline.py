"""Every stage of the pipeline, on its own input, against plain Python."""

import corpus_pipeline
from sightline.llm import line_dedup, quality, simhash
from tests.llm.test_decontaminate import brute as search_windows
from tests.llm.test_duplicates import brute_components, brute_print
from tests.llm.test_line_dedup import brute as search_lines

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    inputs, out = [], docs
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(out.cache())
        out = stage(spark, out, SF_DIR)
    assert all(d.columns == docs.columns for d in inputs)
    rows = [[(r.doc_id, r.text, r.source) for r in d.collect()] for d in inputs]

    good = {r.id for r in quality.scores(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet")).where("predicted = 1").collect()}
    assert {r[0] for r in rows[1]} == good
    assert sorted(rows[2], key=repr) == search_lines(rows[1], line_dedup.MIN_SITES)

    prints = {i: brute_print(t) for i, t, _ in rows[2]}
    nodes = sorted(set(prints.values()))
    roots = brute_components(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= simhash.MAX_BITS])
    first = {}
    for i in sorted(prints):
        first.setdefault(roots[prints[i]], i)
    assert {r[0] for r in rows[3]} == set(first.values())

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    by_window = search_windows([r[:2] for r in rows[3]], items)
    assert {r[0] for r in rows[4]} == {i for i, *_, contaminated in by_window if not contaminated}

    done = out.collect()
    assert {r.doc_id for r in done} == {r[0] for r in rows[4]}
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in done)
