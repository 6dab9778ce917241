"""Text quality by naive Bayes support vectors.

Indicators of word n-grams and of word-shape n-grams are hashed, scaled by the classes' log-count ratio, and weighed by a
linear hinge-loss model fitted by dual coordinate descent. A sigmoid fitted on margins of documents that the weights had
not seen turns margins into probabilities. Fitting uses at most SAMPLE labelled documents; scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import col, give_back

BUCKETS = 1 << 20
SAMPLE = 6_000  # expected number of labelled documents that are fitted on, in one task
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
MIX = 0.25  # weight of the fitted model against the mean weight
ACCEPT = 0.7
CACHE = 150_000  # words whose hash and shape a task remembers

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_WORD, _PAIR, _SHAPE = np.uint64(1), np.uint64(2), np.uint64(3)


class _Words(dict):
    """Word (bytes) to 56 bits of its hash and 8 of its shape, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) & ~0xFF | shape(word)
        return value


def shape(word: bytes) -> int:
    """A small code: case, trailing symbols, digits, length."""
    text = word.decode("utf-8", "replace")
    letters = [c for c in text if c.isalpha()]
    upper = sum(c.isupper() for c in letters)
    if not letters:
        case = 0
    elif upper == 0:
        case = 1
    elif upper == len(letters):
        case = 3 if len(letters) > 1 else 4
    else:
        case = 2 if upper == 1 and text[0].isupper() else 5
    tail = len(text) - len(text.rstrip("".join(c for c in set(text) if not c.isalnum())))
    mark = 0 if tail == 0 else 3 if tail > 1 else 1 if text[-1] in ".,;:?!)\"'" else 2
    return ((case * 4 + mark) * 2 + any(c.isdigit() for c in text)) * 4 + min(3, len(text) // 6)


def _mixed(parts: list[np.ndarray], kind: np.uint64) -> np.ndarray:
    out = np.full(len(parts[0]), kind, dtype=np.uint64)
    for p in parts:
        out = (out ^ p) * _MULTIPLY
        out ^= out >> np.uint64(29)
    return out


def features(text: str | None, words: _Words, buckets: int = BUCKETS) -> np.ndarray:
    """Distinct buckets of the text's n-grams: one and two words, one to three shapes. Bucket 0 is always there."""
    known = list(map(words.__getitem__, (text or "").encode("utf-8", "replace").split()))
    if not known:
        return np.zeros(1, dtype=np.int32)
    hashes = np.array(known, dtype=np.uint64)
    shapes = (hashes & np.uint64(0xFF)) << np.uint64(1)
    shapes[1:] |= (hashes[1:] == hashes[:-1]).astype(np.uint64)  # a repeated word has a shape of its own
    grams = [_mixed([hashes], _WORD), _mixed([hashes[:-1], hashes[1:]], _PAIR)]
    for n in (1, 2, 3):
        if len(known) >= n:
            grams.append(_mixed([shapes[i:len(known) - n + 1 + i] for i in range(n)], _SHAPE + np.uint64(n)))
    buckets_of = (np.concatenate(grams) >> np.uint64(20)) % np.uint64(buckets - 1) + np.uint64(1)
    return np.unique(np.append(buckets_of, np.uint64(0))).astype(np.int32)


# fitting, on a bounded sample in one task

def _log_ratio(rows: list[np.ndarray], y: np.ndarray, buckets: int) -> np.ndarray:
    good, bad = np.full(buckets, SMOOTHING), np.full(buckets, SMOOTHING)
    for row, c in zip(rows, y):  # the buckets of a row are distinct
        (good if c == 1 else bad)[row] += 1
    return np.log((good / good.sum()) / (bad / bad.sum()))


def _hinge(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, buckets: int, epochs: int = EPOCHS,
           cost: float = COST, seed: int = 11) -> np.ndarray:
    """Weights of least length and hinge loss, by coordinate descent on the duals, each kept between 0 and ``cost``."""
    squares = np.array([max(float(v @ v), 1e-12) for v in values])
    w, dual = np.zeros(buckets), np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (values[i] @ w[rows[i]]) - 1
            step = min(max(dual[i] - gradient / squares[i], 0.0), cost) - dual[i]
            if step:
                dual[i] += step
                w[rows[i]] += step * y[i] * values[i]
    return w


def _weights(rows: list[np.ndarray], y: np.ndarray, buckets: int) -> np.ndarray:
    """Weight per bucket, log-count ratio included, for indicators of unit length."""
    ratio = _log_ratio(rows, y, buckets)
    ratio[0] = 0.0  # there for every text: the sigmoid's offset stands for it
    w = _hinge(rows, [(ratio[r] / np.sqrt(len(r))).astype(np.float32) for r in rows], y, buckets)
    seen = np.zeros(buckets, dtype=bool)
    for row in rows:
        seen[row] = True
    mean = np.abs(w[seen]).mean()
    w[seen] = (1 - MIX) * mean + MIX * w[seen]  # every ratio counts a little, as naive Bayes has it
    return w * ratio


def _margin(weights: np.ndarray, row: np.ndarray) -> float:
    return float(weights[row].sum() / np.sqrt(len(row)))


def _sigmoid(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on the smoothed logistic loss."""
    up, down = (y == 1).sum(), (y != 1).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        s = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * margins ** 2).sum(), (s * margins).sum()], [(s * margins).sum(), s.sum()]]) + 1e-6 * np.eye(2)
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -5, 5)
        if np.abs(g).max() < 1e-6:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, float, float]:
    """Weights, slope, offset. With one class only, its share decides alone."""
    if len(set(y.tolist())) < 2:
        up = (y == 1).sum()
        return np.zeros(buckets), 0.0, float(np.log((up + 1) / (len(y) - up + 1)))
    half = np.arange(len(y)) % 2
    margins = np.zeros(len(y))
    for k in (0, 1):
        part = [r for r, h in zip(rows, half) if h != k]
        weights = _weights(part, y[half != k], buckets)
        margins[half == k] = [_margin(weights, r) for r, h in zip(rows, half) if h == k]
    return _weights(rows, y, buckets), *_sigmoid(margins, y)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          sample: int = SAMPLE, buckets: int = BUCKETS) -> tuple[np.ndarray, float, float]:
    """The model of the labelled documents whose crc32(id as text) mod 4 is not 2. Labels other than 0 and 1 are ignored."""
    marked = (labels.where(col(label_col).isin(0, 1)).select(col(id_col).alias("id"), col(label_col).alias("y")).distinct()
              .where(~held_out(F.col("id"))))
    rate = min(1.0, sample / max(1, marked.count()))
    # hashing picks the rows, about ``sample`` of them whatever the size of the table
    some = marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    texts = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).join(F.broadcast(some), "id")

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for batch in batches:
            yield pd.DataFrame({"place": batch["place"], "y": batch["y"],
                                "row": [features(t, words, buckets) for t in batch["text"]]})
        words.clear()
        give_back()

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted(((p, int(y), np.array(r, dtype=np.int32)) for batch in batches
                       for p, y, r in zip(batch["place"], batch["y"], batch["row"])), key=lambda r: r[:2])
        if rows:
            weights, a, b = fit([r for *_, r in rows], np.array([1 if y == 1 else -1 for _, y, _ in rows]), buckets)
            yield pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()], "a": [a], "b": [b]})
            rows, weights = [], None
        give_back()

    rows = texts.select(F.xxhash64("id", "text").alias("place"), "y", "text").mapInPandas(
        index, "place bigint, y int, row array<int>")
    model = rows.repartition(1).mapInPandas(solve, "weights binary, a double, b double").first()
    if model is None:
        return np.zeros(buckets, dtype=np.float32), 0.0, 0.0
    return np.frombuffer(model["weights"], dtype=np.float32), model["a"], model["b"]


def held_out(id_col):
    """True for ids that are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scorer(docs: DataFrame, model: tuple[np.ndarray, float, float]):
    """A column function: text to the probability of a good text."""
    weights, a, b = model
    shared = docs.sparkSession.sparkContext.broadcast((np.asarray(weights, dtype=np.float64), a, b))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, a, b = shared.value
        words = _Words()
        for texts in batches:
            margins = np.array([_margin(weights, features(t, words, len(weights))) for t in texts], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35))))
        words.clear()
        give_back()

    return lambda text: score(text.cast("string"))


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           sample: int = SAMPLE) -> DataFrame:
    """id, held_out, score, predicted: one row per row of ``docs``.

    Only the text decides the score. Null and empty texts share a score, that of a text without n-grams; an empty table
    gives no rows; without labels every score is a half.
    """
    score = scorer(docs, train(docs, labels, id_col=id_col, text_col=text_col, sample=sample))
    return (docs.select(col(id_col).alias("id"), score(col(text_col)).alias("score"))
            .select("id", held_out(F.col("id")).alias("held_out"), "score",
                    (F.col("score") >= ACCEPT).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that are predicted good; nothing is shuffled for it."""
    score = scorer(docs, train(docs, labels, id_col=id_col, text_col=text_col, sample=sample))
    return docs.where(score(col(text_col)) >= ACCEPT)
