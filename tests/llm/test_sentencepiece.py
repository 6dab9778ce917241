"""Encoding against a plain Viterbi and against the library run as a unigram model with the same scores."""

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece as library
from pyspark import cloudpickle
from sentencepiece import sentencepiece_model_pb2 as proto

from sightline.llm import sentencepiece as sp

SCHEMA = "doc_id long, text string, word string, id int, n int"
AWKWARD = [(1, None), (2, ""), (3, " "), (4, "hello  world\nfoo ▁x \t"), (5, "日本語 💩é̀"), (6, "a" * 3000), (7, "word, " * 20_000),
           (8, "\n\n x.\r\ny²."), (None, "null id"), (9, "again"), (9, "again"), (10, "THE!! end…  .")]


@pytest.fixture(scope="module")
def pieces():
    return sp.load()


@pytest.fixture(scope="module")
def unigram(pieces):
    model = proto.ModelProto()
    with open(sp.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = sp.UNIGRAM
    for text, i, score in pieces.rows:
        model.pieces[i].score = score / sp.UNIT
    return library.SentencePieceProcessor(model_proto=model.SerializeToString())


def viterbi(text, pieces):
    score = {p: (s, i) for p, i, s in pieces.rows}
    text = sp.SPACE + text.replace(" ", sp.SPACE) if text else ""
    best = [(0, [])] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - pieces.longest), end):
            got = score.get(text[start:end])
            if got is None and end - start == 1:
                got = (pieces.unknown, None)
            if got and (best[end] is None or best[start][0] + got[0] > best[end][0]):
                ids = [pieces.byte_ids[b] for b in text[start:end].encode()] if got[1] is None else [got[1]]
                best[end] = (best[start][0] + got[0], (start, ids))
    out, at = [], len(text)
    while at:
        at, ids = best[at][1]
        out = ids + out
    return out


def run(spark, rows, pieces, **options):
    docs = spark.createDataFrame([(*r, "w", 1, 2) for r in rows], SCHEMA)
    return sp.decode(sp.encode(docs, pieces, **options), pieces).collect()


@pytest.mark.parametrize("table_words", [sp.TABLE_WORDS, 0, 3])
def test_awkward_texts_come_back(spark, pieces, table_words):
    got = run(spark, AWKWARD, pieces, table_words=table_words)
    plain = lambda t: (t or "").replace(sp.SPACE, " ")
    assert sorted(((r.id, r.decoded) for r in got), key=repr) == sorted(((i, plain(t)) for i, t in AWKWARD), key=repr)
    texts = dict(AWKWARD)
    for r in got:
        assert r.lossless == (sp.SPACE not in (texts[r.id] or ""))
        if len(texts[r.id] or "") < 100:
            assert list(r.ids) == viterbi(texts[r.id] or "", pieces)


def test_documents_as_the_library_has_them(spark, pieces, unigram):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rng = random.Random(1)
    rows = list(enumerate(texts + ["".join(rng.choice("aest .,é\n") for _ in range(60)) for _ in range(50)]))
    got = run(spark, rows, pieces, table_words=2000)
    assert len(got) == len(rows)
    score = {i: s for _, i, s in pieces.rows}
    worth = lambda ids: sum(score.get(i, 0) for i in ids)
    texts = dict(rows)
    assert all(r.decoded == texts[r.id] and r.lossless for r in got)
    different = [r for r in got if list(r.ids) != unigram.encode(texts[r.id])]
    # paths of equal worth may differ
    assert all(abs(worth(r.ids) - worth(unigram.encode(texts[r.id]))) <= 50 for r in different)
    assert len(different) <= len(got) // 10


@pytest.mark.parametrize("table_words", [sp.TABLE_WORDS, 0])
def test_long_runs_are_not_cut(spark, pieces, table_words):
    rng = random.Random(2)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(1, "a" * 3000), (2, some("日本語中文的是不了人我在有他这", 2500)), (3, some("ABCDabcdeinorst0123+/", 5000) + "=="),
            (4, "x" + " " * 3000 + "y"), (5, "\n" * 2500 + "end"), (6, some("function(){return};,.=", 4000) + " tail"),
            (7, "the" * 341 + "re"), (8, "b " + "information" * 300 + ", é" + "=" * 1100), (9, "ab" * 512), (10, "💩" * 1500)]
    got = run(spark, rows, pieces, table_words=table_words)
    texts = dict(rows)
    assert len(got) == len(rows)
    assert [r.id for r in got if list(r.ids) != viterbi(texts[r.id], pieces) or r.decoded != texts[r.id] or not r.lossless] == []


def test_returned_ids_are_decoded(spark, pieces, monkeypatch):
    """Ids of one chunk given to another are right by themselves, but not those of the text."""
    right = sp._Known.spell

    def turned(self, chunks):
        got = right(self, chunks)
        return got[1:] + got[:1]

    docs = spark.createDataFrame([(1, "one two three", "w", 1, 2), (2, "four five", "w", 1, 2), (3, "", "w", 1, 2)], SCHEMA).coalesce(1)
    assert all(r.lossless for r in sp.round_trip(docs, pieces).collect())
    cloudpickle.register_pickle_by_value(sp)
    try:
        monkeypatch.setattr(sp._Known, "spell", turned)
        assert {r.doc_id: r.lossless for r in sp.round_trip(docs, pieces).collect()} == {1: False, 2: False, 3: True}
    finally:
        cloudpickle.unregister_pickle_by_value(sp)


def test_empty_table(spark, pieces):
    docs = spark.createDataFrame([], SCHEMA)
    assert sp.round_trip(docs, pieces).count() == 0


def test_pieces_that_share_a_hash(spark, pieces, monkeypatch):
    """Substrings are looked up by hash, but what they are is decided by their text."""
    monkeypatch.setattr(sp, "_hash", lambda text: sp.F.pmod(sp.F.xxhash64(text), sp.F.lit(4096)))
    rows = [(1, "the quick brown fox, again"), (2, "日本語 💩é̀ zq"), (3, "aaaa" * 9), (4, "x")]
    texts = dict(rows)
    got = run(spark, rows, pieces)
    assert {r.id: list(r.ids) for r in got} == {i: viterbi(t, pieces) for i, t in texts.items()}


def test_lattice_is_neither_sorted_nor_held(spark, pieces):
    """Edges go from the join to the paths as they come: gathering them by word filled the executors."""
    words = spark.createDataFrame([("▁again", 1), ("▁zq", 2)], "word string, n bigint")
    plan = sp.encode_words(words, pieces)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Sort" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("rows", [1, 40, 10_000])
def test_words_that_lie_across_batches(spark, pieces, monkeypatch, rows):
    monkeypatch.setattr(sp, "LATTICE_ROWS", rows)
    rng = random.Random(3)
    texts = ["".join(rng.choice("estaonr,é日💩") for _ in range(rng.randint(1, 30))) for _ in range(300)] + ["x" * 1024, "y" * 1025, "z" * 1030]
    words = spark.createDataFrame([(sp.SPACE + t, k) for k, t in enumerate(texts)], "word string, n bigint").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    cloudpickle.register_pickle_by_value(sp)
    try:
        got = {r.n: r.ids for r in sp.encode_words(words, pieces).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(sp)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {k: None if len(t) >= sp.LONGEST else viterbi(t, pieces) for k, t in enumerate(texts)}


def test_edges_that_are_not_together_are_an_error():
    one, two = (1 << sp._END) + (5 << sp._COST) + 1, (2 << sp._END) + (5 << sp._COST) + (1 << sp._START) + 1
    ids, starts, at = sp.best_paths(np.array([two, one, one]), np.array([0, 2, 3]), np.array([2, 1]))
    assert (ids.tolist(), starts.tolist(), at.tolist()) == ([0, 0, 0], [0, 1, 0], [0, 2, 3])
    with pytest.raises(RuntimeError):
        sp.best_paths(np.array([two, one]), np.array([0, 1, 2]), np.array([2, 1]))


def test_every_text_is_compared_with_its_own_pieces():
    spelling = pa.array([b"", b" a", b"b", b"\xc3", b"\xa9", b" "], pa.large_binary())
    lists = pa.array([[1, 2], [], [1, 3, 4], [], [1], [5, 2], [1, 2]], pa.list_(pa.int32()))
    texts = pa.array(["ab", None, "aé", "x", "", "b", "ba"])
    assert sp.come_back(texts, lists, spelling).to_pylist() == [True, True, True, False, False, True, False]
    assert sp.come_back(texts.slice(0, 0), lists.slice(0, 0), spelling).to_pylist() == []
