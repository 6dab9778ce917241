"""SentencePiece encoding as a relational lattice, and decoding.

Texts are cut into words where no piece reaches across. Every distinct word of the corpus is encoded once: its substrings
up to the longest piece are exploded and equi-joined to the piece table, which gives the edges of its lattice. They go on as they
come, word by word, and the best paths of some thousand words at a time are found by Viterbi in the task. Texts are then put together from their words' ids: the words most
often met, up to a fixed number, are broadcast; documents with any other word get those by a join. A word is never cut: one
too long for the packed edges, such as a page without blanks, has its path found by itself.

The scores of a unigram model are log-probabilities and are used as they are. Those of a merge (BPE) model are negated
merge ranks, whose sums mean nothing, so a piece of rank r counts as -log(r + 2) - 5: the path found is the best one under
that, not the order of merges. Decoding joins the pieces and is exact for any path.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import col, give_back, keyed, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TABLE_WORDS = 1 << 22  # words that are broadcast, some 20 bytes each
LONGEST = 1024  # characters of a word that the packed lattice holds; longer ones have their path found by ``whole_paths``
SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # below the lowest score, as unigram models have it
UNIGRAM = 1
UNIT = 1 << 16  # scores are whole numbers of this fraction, so sums are exact
_LETTER, _MARK = r"0-9A-Za-zÀ-ɏ", r"!-/:-@\[-`{-~"


@dataclass(frozen=True)
class Pieces:
    """The piece table: (piece, id, score in units), the ids of the 256 bytes, the pattern of words."""

    rows: list[tuple[str, int, int]]
    byte_ids: tuple[int, ...]
    unknown: int
    longest: int
    pattern: str
    size: int
    texts: tuple[bytes, ...]  # by id; control pieces are empty


def load(path: str = MODEL) -> Pieces:
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models that leave the text as it is can be decoded exactly")
    kind = proto.ModelProto.SentencePiece
    unigram = model.trainer_spec.model_type == UNIGRAM
    rows, byte_ids, texts = [], {}, []
    for i, p in enumerate(model.pieces):
        if p.type == kind.BYTE:
            byte_ids[int(p.piece[3:5], 16)] = i
            texts.append(bytes([int(p.piece[3:5], 16)]))
        elif p.type in (kind.NORMAL, kind.USER_DEFINED):
            score = p.score if unigram else -math.log(max(0.0, -p.score) + 2) - 5
            rows.append((p.piece, i, round(score * UNIT)))
            texts.append(p.piece.replace(SPACE, " ").encode())
        else:
            texts.append(b"")
    if len(byte_ids) != 256:
        raise ValueError("the model has no byte pieces, so unknown characters could not be decoded")
    names = [p for p, _, _ in rows]
    if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in names):
        raise ValueError("the model has pieces across words")
    if len(model.pieces) >= (1 << 17) - 1 or min(r[2] for r in rows) < (UNKNOWN_PENALTY - 63) * UNIT:
        raise ValueError("the model does not fit the packed lattice edges")
    # a letter and a mark behind it are cut apart if no piece has them together
    cut = not any(re.search(f"[{_LETTER}][{_MARK}]", p) for p in names)
    # no piece holds a newline, so a run of those may be cut anywhere
    pattern = f"\n{{1,{LONGEST}}}" + (f"|{SPACE}*+[{_LETTER}]++(?![^{_MARK}{SPACE}\n])" if cut else "") + \
        f"|{SPACE}*+[^{SPACE}\n]++|{SPACE}++"
    return Pieces(rows, tuple(byte_ids[b] for b in range(256)), min(s for _, _, s in rows) - round(UNKNOWN_PENALTY * UNIT),
                  max(map(len, names)), pattern, len(model.pieces), tuple(texts))


def chunks(text: str | None) -> list[str]:
    """The text between blanks; a blank before each is understood. Blanks in a row stay in one chunk with what follows."""
    if not text:
        return []
    if text[0] == " " or "  " in text:
        return [c[1:] for c in _RUN.findall(" " + text)]
    return text.split(" ")


_RUN = re.compile(" +[^ ]*")


def chunk_lists(texts: pa.Array, most: int = 3_000_000) -> Iterator[tuple[np.ndarray, pa.ListArray]]:
    """Rows and their chunks for about ``most`` bytes of text at a time: texts that need no care all at once by Arrow, the
    others one by one."""
    texts = pc.fill_null(texts, "")
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
    for rows in _slices(ends, most):
        part = texts.slice(rows[0], len(rows))
        odd = pc.or_(pc.or_(pc.equal(part, ""), pc.starts_with(part, " ")), pc.match_substring(part, "  "))
        apart = odd.to_numpy(zero_copy_only=False)
        if not apart.all():
            yield rows[~apart], pc.split_pattern(part.filter(pc.invert(odd)), " ")
        if apart.any():
            yield rows[apart], pa.array([chunks(t.as_py()) for t in part.filter(odd)], pa.list_(pa.string()))


def _slices(bounds: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Stretches of rows with about that many items, one row at least."""
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1)
        yield np.arange(first, last)
        first = last


def words_of(chunk: str, find) -> list[str]:
    if chunk.isalnum():  # the pattern would find one word
        return [SPACE + chunk]
    return find(SPACE + chunk.replace(" ", SPACE))


def count_words(docs: DataFrame, pieces: Pieces, text_col: str = "text") -> DataFrame:
    """word, n over all texts; counted within tasks first."""
    pattern = pieces.pattern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for _, lists in chunk_lists(batch.column(0), 6_000_000):
                counted = lists.flatten().value_counts()
                values, counts = counted.field("values"), counted.field("counts")
                plain = pc.utf8_is_alnum(values)  # one word each
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(SPACE, values.filter(plain), ""),
                                                  counts.filter(plain)], names=["word", "n"])
                mixed = pc.invert(plain)
                for chunk, n in zip(values.filter(mixed).to_pylist(), counts.filter(mixed).to_pylist()):
                    for word in words_of(chunk, find):
                        held[word] += n
                if len(held) > 100_000:
                    yield flush()
        yield flush()
        give_back()

    return (docs.select(col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")))


# an edge of the lattice is one long: end (11 bits), cost (22), start (11), id + 1 (17; 0 is a character without a piece); the best
# way to a boundary is one, too: the cost so far, and start and id of its last edge
_END, _COST, _START = 50, 28, 17
LATTICE_ROWS = 200_000  # edges that one pass of ``best_paths`` takes


def _hash(text: str) -> Column:
    return F.xxhash64(text)


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, n, edge: a row per edge of every word's lattice. The rows of a word lie together, as they were exploded; only the first
    has word and n, the others null. Words over ``LONGEST`` characters have the edges of their first character only."""
    spark = words.sparkSession
    table = F.broadcast(spark.createDataFrame(pieces.rows, "known string, id int, score bigint")  # the fixed vocabulary
                        .select(_hash("known").alias("hash"), "known", "id", "score"))
    subs = (words.select("word", "n", F.length("word").alias("chars"))
            .select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("chars") > LONGEST, 0).otherwise(F.col("chars") - 1))).alias("start"))
            .select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.col("chars") - F.col("start")))).alias("len"))
            .select("word", "n", "start", "len", F.expr("substring(word, start + 1, len)").alias("piece"))
            .withColumn("hash", _hash("piece")))
    # looked up by hash, which is much quicker than by text; the texts decide, as a condition beside the key
    found = subs.join(table, (subs["hash"] == table["hash"]) & F.col("known").between(F.col("piece"), F.col("piece")), "left")
    left = lambda number, bits: F.call_function("shiftleft", number.cast("bigint"), F.lit(bits))
    edge = (left(F.col("start") + F.col("len"), _END)
            .bitwiseOR(left(-F.coalesce("score", F.lit(pieces.unknown)), _COST))
            .bitwiseOR(left(F.col("start"), _START))
            .bitwiseOR(F.coalesce(F.col("id") + 1, F.lit(0)).cast("bigint")))
    first = (F.col("start") == 0) & (F.col("len") == 1)
    return found.where(F.col("id").isNotNull() | (F.col("len") == 1)).select(
        F.when(first, F.col("word")).alias("word"), F.when(first, F.col("n")).alias("n"), edge.alias("edge"))


def best_paths(edges: np.ndarray, bounds: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (-1 for a character without a piece) and starts of the pieces along the cheapest path of each word, one word after
    another, and the words' bounds in them. The edges of word i are ``edges[bounds[i]:bounds[i + 1]]``, in any order.

    All words at once, boundary by boundary. Less is better in all of a way's parts: less cost, then an earlier start, so of equal
    paths it is the one with the longer last piece. Every character has an edge, so every boundary is reached.
    """
    base = np.cumsum(chars + 1) - chars - 1  # the place of each word's boundary 0
    order = np.argsort((edges >> _END).astype(np.uint16), kind="stable")  # by boundary, then by word
    word, edges = np.repeat(np.arange(len(chars)), np.diff(bounds))[order], edges[order]
    ends, cost = edges >> _END, edges & ((1 << _END) - 1)
    origin = base[word] + ((cost >> _START) & ((1 << (_COST - _START)) - 1))
    ways = np.zeros(int(chars.sum()) + len(chars), np.int64)
    levels, reached = np.searchsorted(ends, np.arange(1, int(chars.max(initial=0)) + 2)), 0
    for end, (a, b) in enumerate(zip(levels, levels[1:]), 1):
        of = word[a:b]
        firsts = np.flatnonzero(np.diff(of, prepend=-1))
        reached += len(firsts)
        if not len(firsts):
            break
        ways[base[of[firsts]] + end] = np.minimum.reduceat((ways[origin[a:b]] & (-1 << _COST)) + cost[a:b], firsts)
    if reached != chars.sum():
        raise RuntimeError("a word's edges are not together")
    # back along the paths, all words a piece at a time
    live, at, steps = np.flatnonzero(chars > 0), chars[chars > 0], []
    sizes = np.zeros(len(chars), np.int64)
    while len(live):
        way = ways[base[live] + at]
        at = (way >> _START) & ((1 << (_COST - _START)) - 1)
        sizes[live] += 1
        steps.append((live, (way & ((1 << _START) - 1)) - 1, at))
        live, at = live[at > 0], at[at > 0]
    stops = np.cumsum(sizes)
    ids, starts = np.empty(int(sizes.sum()), np.int32), np.empty(int(sizes.sum()), np.int32)
    for back, (of, number, start) in enumerate(steps, 1):
        ids[stops[of] - back], starts[stops[of] - back] = number, start
    return ids, starts, np.concatenate([[0], stops])


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, n, ids of every distinct word; characters without a piece become the ids of their UTF-8 bytes. Ids are null for words
    over ``LONGEST`` characters."""
    byte_ids = pieces.byte_ids

    def solved(rows: pa.Table) -> pa.RecordBatch:
        edges = rows.column("edge").to_numpy()
        firsts = np.flatnonzero(rows.column("word").is_valid().to_numpy())
        held = rows.take(pa.array(firsts)).combine_chunks()
        chars = pc.utf8_length(held.column("word")).to_numpy().astype(np.int64)
        bounds, fits = np.append(firsts, len(edges)), chars <= LONGEST
        if not fits.all():
            edges = edges[np.repeat(fits, np.diff(bounds))]
            bounds = np.concatenate([[0], np.cumsum(np.diff(bounds)[fits])])
        ids, starts, at = best_paths(edges, bounds, chars[fits])
        lost = np.flatnonzero(ids < 0)
        if len(lost):
            texts = held.column("word").filter(pa.array(fits)).take(pa.array(np.searchsorted(at, lost, side="right") - 1)).to_pylist()
            spelt = [[byte_ids[b] for b in w[k].encode("utf-8", "replace")] for w, k in zip(texts, starts[lost].tolist())]
            sizes = np.ones(len(ids), np.int64)
            sizes[lost] = [len(x) for x in spelt]
            known, ids = ids, np.repeat(ids, sizes)
            ids[np.repeat(known < 0, sizes)] = [i for x in spelt for i in x]
            at = np.concatenate([[0], np.cumsum(sizes)])[at]
        offsets = np.zeros(len(chars) + 1, np.int32)
        offsets[1:][fits] = at[1:]
        offsets = np.maximum.accumulate(offsets)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)), mask=pa.array(~fits))
        return pa.RecordBatch.from_arrays([held.column("word").combine_chunks(), held.column("n").combine_chunks(), lists],
                                          names=["word", "n", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < LATTICE_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            last = int(np.flatnonzero(rows.column("word").is_valid().to_numpy())[-1])  # the word begun last may go on
            held, count = rows.slice(last).to_batches(), rows.num_rows - last
            if last:
                yield solved(rows.slice(0, last))
        if count:
            yield solved(pa.Table.from_batches(held))
        give_back()

    return lattice(words, pieces).mapInArrow(run, "word string, n bigint, ids array<int>")


def whole_path(word: str, table: dict[str, tuple[int, int]], longest: int, unknown: int, byte_ids: tuple[int, ...]) -> list[int]:
    """The ids along the best path through a word of any length, by the rules of ``best_paths``."""
    scores, starts, pieces = array("q", [0]), array("q", [0]), array("i", [0])
    lost = (-1, unknown)
    for end in range(1, len(word) + 1):
        best = None
        for start in range(max(0, end - longest), end):  # the longer last piece first
            found = table.get(word[start:end], lost if end - start == 1 else None)
            if found and (best is None or scores[start] + found[1] > best[0]):
                best = (scores[start] + found[1], start, found[0])
        scores.append(best[0])
        starts.append(best[1])
        pieces.append(best[2])
    ids, at = [], len(word)
    while at:
        ids += [pieces[at]] if pieces[at] >= 0 else [byte_ids[b] for b in reversed(word[starts[at]:at].encode("utf-8", "replace"))]
        at = starts[at]
    return ids[::-1]


def whole_paths(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, n, ids of words too long for the packed lattice."""
    shared = words.sparkSession.sparkContext.broadcast(
        ({p: (i, s) for p, i, s in pieces.rows}, pieces.longest, pieces.unknown, pieces.byte_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, word in enumerate(batch.column(0)):
                ids = pa.array([whole_path(word.as_py(), *shared.value)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, ids], names=["word", "n", "ids"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, ids array<int>")


class _Known:
    """Ids of chunks, put together from a sorted table of words' 64-bit hashes, with a bounded memory of chunks just met."""

    def __init__(self, pattern: str, hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: bytes):
        self.find, self.hashes, self.starts, self.lengths, self.ids = re.compile(pattern).findall, hashes, starts, lengths, ids
        self.met: dict[str, bytes | None] = {}
        self.before: dict[str, bytes | None] = {}

    def find_words(self, wanted: list[str]) -> Iterator[bytes | None]:
        """The bytes of each word's ids, None for words that are not in the table."""
        if not wanted or not len(self.hashes):
            return iter([None] * len(wanted))
        codes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), 42) for w in wanted], np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, codes), len(self.hashes) - 1)
        found, ids = self.hashes[at] == codes, self.ids
        return (ids[a:a + n] if ok else None for a, n, ok in zip(self.starts[at].tolist(), self.lengths[at].tolist(), found.tolist()))

    def spell(self, chunks: list[str]) -> list[bytes | None]:
        """The bytes of each distinct chunk's ids, None for chunks with a word that is not in the table."""
        if len(self.met) > 60_000:  # what is still in use is taken over, the rest forgotten
            self.met, self.before = {}, self.met
        met, before = self.met, self.before
        new = [c for c in chunks if c not in met]
        met.update((c, before[c]) for c in new if c in before)
        new = [c for c in new if c not in met] if before else new
        met.update(zip(new, self.join(new, {})))
        return list(map(met.__getitem__, chunks))

    def join(self, chunks: list[str], more: dict[str, bytes]) -> list[bytes | None]:
        """The same without memory, with the words of ``more`` besides those of the table."""
        out: list[bytes | None] = [None] * len(chunks)
        plain = [i for i, c in enumerate(chunks) if c.isalnum()]  # one word each
        words = [SPACE + chunks[i] for i in plain]
        for i, w, ids in zip(plain, words, self.find_words(words)):
            out[i] = more.get(w) if ids is None else ids
        mixed = {i: words_of(c, self.find) for i, c in enumerate(chunks) if not c.isalnum()}
        wanted = list({w for words in mixed.values() for w in words})
        known = dict(zip(wanted, self.find_words(wanted))) | more
        for i, words in mixed.items():
            parts = [known[w] for w in words]
            if None not in parts:
                out[i] = parts[0] if len(parts) == 1 else b"".join(parts)
        return out

    def unknown(self, chunks: list[str]) -> list[str]:
        words = list({w for c in chunks for w in words_of(c, self.find)})
        return [w for w, ids in zip(words, self.find_words(words)) if ids is None]


def _table(words: DataFrame, most: int, pieces: Pieces) -> tuple:
    """The words met most often, at most ``most``, as arrays for ``_Known``; the type of the ids; whether those are all."""
    sizes = words.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().toPandas().sort_values("n", ascending=False)
    fits = sizes["count"].cumsum() <= most
    held = words.where(F.col("n") >= int(sizes["n"][fits].min())) if fits.any() else words.limit(0)
    kind = np.dtype(np.uint16 if pieces.size <= 1 << 16 else np.int32)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per task: hashes, the number of ids of each, and the ids, each as bytes."""
        hashes, lengths, ids = [b""], [b""], [b""]
        for batch in batches:
            hashes.append(batch.column(0).to_numpy().tobytes())
            lengths.append(np.diff(batch.column(1).offsets.to_numpy()).astype(np.uint32).tobytes())
            ids.append(batch.column(1).flatten().to_numpy().astype(kind).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(x)], pa.binary()) for x in (hashes, lengths, ids)],
                                         names=["hashes", "lengths", "ids"])

    # packed by the tasks; the driver puts the parts in a row and finds the order of the hashes, the ids stay where they are
    got = held.select(F.xxhash64("word").alias("h"), "ids").mapInArrow(packed, "hashes binary, lengths binary, ids binary").toArrow()
    parts = {name: [x.as_buffer() for x in got.column(name)] for name in got.column_names}
    hashes = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, np.int64) for x in parts["hashes"]]])
    lengths = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(x, np.uint32) for x in parts["lengths"]]]) * np.uint32(kind.itemsize)
    ids = b"".join(parts["ids"])
    del got, parts
    order = np.argsort(hashes)
    starts = np.cumsum(lengths, dtype=np.int64)
    starts -= lengths
    starts = starts[order].astype(np.uint32 if len(ids) < 1 << 32 else np.int64)
    return (hashes[order], starts, lengths[order].astype(np.min_scalar_type(int(lengths.max(initial=0)))), ids), kind, bool(fits.all())


def _any(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether any flag is set in each of the stretches between the bounds."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[at[1:]] > total[at[:-1]]


def encode(docs: DataFrame, pieces: Pieces | None = None, id_col: str = "doc_id", text_col: str = "text",
           table_words: int = TABLE_WORDS) -> DataFrame:
    """id, ids, lossless: the ids of each text's pieces and whether they decode to it; a row per row of ``docs``. The ids
    that are returned are decoded text by text as ``decode`` does, in the task that puts them together.

    Null and empty texts have no ids and are lossless; U+2581 comes back as a blank. Repeated rows share their ids. Runs
    of any length are encoded whole. An empty table gives no rows.
    """
    pieces = pieces or load()
    spark = docs.sparkSession
    words = written(encode_words(count_words(docs, pieces, text_col), pieces))
    words = words.where("ids is not null").unionByName(written(whole_paths(words.where("ids is null"), pieces)))
    table, kind, all_held = _table(words, table_words, pieces)
    shared = spark.sparkContext.broadcast((pieces.pattern, *table, pieces.texts))
    own, keys = keyed(docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")), "id", "text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of texts all of whose words are known, from the table or from column extra; others give no row."""
        *known_words, spelling = shared.value
        known, spelling = _Known(*known_words), pa.array(spelling, pa.large_binary())
        for batch in batches:
            more = {}
            if batch.num_columns > 2:
                more = {x["word"]: np.array(x["ids"], kind).tobytes() for xs in batch.column(2).to_pylist() for x in xs}
            for rows, lists in chunk_lists(batch.column(1)):
                # every distinct chunk of the batch is spelled once; texts are gathered from those by number
                coded = lists.flatten().dictionary_encode()
                distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                ids = known.spell(distinct)
                if more:
                    rest = [i for i, x in enumerate(ids) if x is None]
                    for i, x in zip(rest, known.join([distinct[i] for i in rest], more)):
                        ids[i] = x
                missing = np.array([x is None for x in ids], dtype=bool)
                sizes = np.array([len(x) // kind.itemsize if x else 0 for x in ids], dtype=np.int64)
                pool, firsts = np.frombuffer(b"".join(x for x in ids if x), kind), np.cumsum(sizes) - sizes
                bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
                for some in _slices(bounds, 200_000):
                    own_codes = codes[bounds[some[0]]:bounds[some[-1] + 1]]
                    at = bounds[some[0]:some[-1] + 2] - bounds[some[0]]
                    keep = ~_any(missing[own_codes], at)
                    own_codes = own_codes[np.repeat(keep, np.diff(at))]
                    lengths = sizes[own_codes]
                    ends = np.cumsum(lengths)
                    values = pool[np.repeat(firsts[own_codes] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
                    at = np.concatenate([[0], np.cumsum(np.diff(at)[keep])])
                    offsets = np.concatenate([[0], ends])[at]
                    taken = pa.array(rows[some][keep])
                    done = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))
                    same = come_back(batch.column(1).take(taken), done, spelling)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), done, same], names=["id", "ids", "lossless"])
        del known
        give_back()

    out = f"id {own.schema['id'].dataType.simpleString()}, ids array<int>, lossless boolean"
    easy = own.select("id", "text").mapInArrow(whole, out)
    if all_held:  # no text can hold another word
        return easy

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words that are not in the table, for every text that has any."""
        known = _Known(*shared.value[:-1])
        for batch in batches:
            for rows, lists in chunk_lists(batch.column(3)):
                coded = lists.flatten().dictionary_encode()
                distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                missing = {i: known.unknown([c]) for i, (c, x) in enumerate(zip(distinct, known.spell(distinct))) if x is None}
                bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
                found = [sorted({w for i in codes[a:b].tolist() if i in missing for w in missing[i]}) for a, b in zip(bounds, bounds[1:])]
                keep = [i for i, x in enumerate(found) if x]
                taken = batch.take(pa.array(rows[keep]))
                yield pa.RecordBatch.from_arrays([*taken.columns[:3], pa.array([found[i] for i in keep], pa.list_(pa.string()))],
                                                 names=[*keys, "words"])

    types = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in keys)
    missing = own.select(*keys, "text").mapInArrow(others, f"{types}, words array<string>").select(
        *keys, F.explode("words").alias("word")).distinct()
    extras = (missing.join(words.select("word", "ids"), "word").groupBy(*keys)
              .agg(F.collect_list(F.struct("word", "ids")).alias("extra")))
    return easy.unionByName(own.join(extras, keys).select("id", "text", "extra").mapInArrow(whole, out))


def spelled(ids: np.ndarray, spelling: tuple[bytes, ...]) -> bytes:
    """The bytes of one list of ids; the blank before its first word goes. Long lists are spelled part by part."""
    parts = [b"".join(map(spelling.__getitem__, ids[k:k + 50_000].tolist())) for k in range(0, len(ids), 50_000)]
    return b"".join(parts)[1:]


def decoded(ids: np.ndarray, spelling: tuple[bytes, ...]) -> str:
    """The text of one list of ids."""
    return spelled(ids, spelling).decode("utf-8", "replace")


def come_back(texts: pa.Array, lists: pa.ListArray, spelling: pa.Array) -> pa.Array:
    """Whether each whole text is what its own ids decode to; a null text counts as empty. The pieces of all lists are spelled one
    behind the other by Arrow, and every text is compared with its stretch, which has a blank more in front."""
    told, ends = _bytes(spelling.take(lists.values)), lists.offsets.to_numpy()
    own = _bytes(pc.fill_null(texts, "").cast(pa.large_binary()))
    stops = told[1][ends]
    starts = np.minimum(stops[:-1] + 1, stops[1:])
    same = stops[1:] - starts == np.diff(own[1])
    for k in np.flatnonzero(same).tolist():
        a, b = int(own[1][k]), int(starts[k])
        same[k] = np.array_equal(own[0][a:int(own[1][k + 1])], told[0][b:int(stops[k + 1])])
    return pa.array(same)


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large binary values without nulls, one behind the other, and their bounds."""
    _, bounds, data = values.buffers()
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8),
            np.frombuffer(bounds, np.int64)[values.offset:values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64))


def decode(encoded: DataFrame, pieces: Pieces | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids. Null ids give null, no ids the empty text; control pieces give nothing."""
    pieces = pieces or load()
    shared = encoded.sparkSession.sparkContext.broadcast(pieces.texts)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series([None if ids is None else decoded(ids, shared.value) for ids in lists], dtype=object)

    return encoded.withColumn(out_col, text(col(ids_col)))


def round_trip(docs: DataFrame, pieces: Pieces | None = None, id_col: str = "doc_id", text_col: str = "text",
               table_words: int = TABLE_WORDS) -> DataFrame:
    """id, ids, n_pieces, lossless: whether decoding gives the text back."""
    done = encode(docs, pieces, id_col, text_col, table_words)
    return done.select(F.col("id").alias(id_col), "ids", F.size("ids").cast("long").alias("n_pieces"), "lossless")
