"""Toxicity from subword bags: averaged embeddings under a linear softmax.

A word is the mean of the embeddings of its character n-grams (hashed into
``BUCKETS`` rows), so a misspelling shares most of its vectors with the word. A
window of words is the mean of its words and goes into a linear softmax over
clean and toxic; embeddings and softmax are trained jointly in numpy. A
document has the score of its most toxic window, over the windows from every word
of the whole text, so a passage counts the same in a short and a long text and
wherever it starts.

Training sees at most ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled documents, the
first in hash order of their ids, and ``WINDOWS`` windows of each, spread over the
text. As a label says only that some window is toxic, the second half of
the training takes of each toxic document its most toxic windows.

Defined results: a null or empty text, or one without words, scores as a window
without words, which is 0; null ids and repeated rows are scored like any other
row; contradictory labels of an id are left out; without labels of both classes
all scores are 0; an empty table gives an empty result; only doc_id and text
are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from slotcast.llm.store import settled_labels, training_rows

BUCKETS = 1 << 16
DIMENSIONS = 4
GRAMS = (3, 4, 6)
WORDS = 4
LEAST = 3
MOST_TOXIC, MOST_CLEAN, WINDOWS = 600, 1000, 60
CACHE = 200_000
THRESHOLD = 0.7
_BREAKS = bytes.maketrans(b".,;:!?\"()[]{}|<>", b" " * 16)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_BREAKS).split()


def gram_ids(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word of every n-gram of ``words``, the marked ends included."""
    marked = [b"<" + (w.strip(b"*$%&#'-") or w) + b">" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(marked)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
    ids, of = [], []
    total = np.zeros(len(data), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        total = total[: len(data) - n + 1] * np.uint64(0x100000001B3) + data[n - 1 :]
        if n in GRAMS:
            ok = left[: len(total)] >= n
            mixed = (total[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            ids.append((mixed >> np.uint64(40)) % np.uint64(BUCKETS))
            of.append(word[: len(total)][ok])
    return np.concatenate(ids).astype(np.int64), np.concatenate(of)


def windows(n: int) -> np.ndarray:
    """First word of every window of a text of ``n`` words."""
    return np.arange(max(1, n - WORDS + 1))


def _sums(values: np.ndarray, groups: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(groups, values[:, d], size) for d in range(values.shape[1])], axis=1)


class SubwordBag:
    """The trained model: a number per n-gram, which is all the linear softmax leaves of it, and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def words(self, words: list[bytes]) -> np.ndarray:
        """The contribution of each word; words are worked out once while the cache lasts."""
        known = self.known
        fresh = list({w for w in words if w not in known})
        if fresh:
            if len(known) > CACHE:
                known.clear()
                fresh = list(set(words))
            for at in range(0, len(fresh), CACHE):
                part = fresh[at : at + CACHE]
                ids, of = gram_ids(part)
                n = np.bincount(of, minlength=len(part))
                values = np.bincount(of, self.weights[ids], len(part)) / np.maximum(n, 1)
                known.update(zip(part, values.tolist()))
        return np.fromiter((known[w] for w in words), np.float64, len(words))

    def score(self, text: str | None) -> float:
        words = tokens(text)
        if not words:
            return 0.0
        sums = np.concatenate(([0.0], np.cumsum(self.words(words))))
        first = windows(len(words))
        last = np.minimum(first + WORDS, len(words))
        best = ((sums[last] - sums[first]) / np.maximum(last - first, LEAST)).max() + self.bias
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, float(best)))))


def window_slopes(
    params: tuple[np.ndarray, np.ndarray, np.ndarray], grams: tuple[np.ndarray, np.ndarray, np.ndarray],
    words: np.ndarray, bag: np.ndarray, over: np.ndarray, labels: np.ndarray, weight: np.ndarray,
) -> tuple[float, list[np.ndarray]]:
    """Weighted softmax loss of some windows and its slopes by embeddings, softmax and bias.

    ``grams`` are bucket and word of every n-gram and their number per word;
    ``words`` and ``bag`` the words of the windows, ``over`` what a window's sum is divided by.
    """
    (embed, linear, bias), (ids, of, per_word) = params, grams
    vectors = _sums(embed[ids], of, len(per_word)) / per_word[:, None]
    mean = _sums(vectors[words], bag, len(labels)) / over
    z = mean @ linear + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    share, place = weight / weight.sum(), np.arange(len(labels))
    loss = -float((share * np.log(np.maximum(p[place, labels], 1e-300))).sum())
    p[place, labels] -= 1
    p *= share[:, None]
    back = (p @ linear.T) / over
    to_word = _sums(back[bag], words, len(per_word)) / per_word[:, None]
    return loss, [_sums(to_word[of], ids, len(embed)), mean.T @ p, p.sum(axis=0)]


def train(bags: list[list[bytes]], labels: np.ndarray, documents: np.ndarray, rounds: int = 24, clean: float = 0.8, seed: int = 8) -> SubwordBag | None:
    """Fits windows (word lists) of documents with labels 0 and 1 by Adam on the softmax loss."""
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number)) for bag in bags for w in bag), np.int64)
    ids, of = gram_ids(list(number))
    per_word = np.maximum(np.bincount(of, minlength=len(number)), 1)
    sizes = np.fromiter(map(len, bags), np.int64, len(bags))
    ends = np.cumsum(sizes)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    linear, bias = rng.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2)
    slope, size = [np.zeros_like(p) for p in (embed, linear, bias)], [np.zeros_like(p) for p in (embed, linear, bias)]
    share = labels.mean()
    weight = np.where(labels == 1, (1 - clean) / share, clean / (1 - share))
    use, step = np.ones(len(bags), bool), 0

    def parts(rows: np.ndarray):
        """Words of some windows, the window of each, and what its sum is divided by."""
        spans = [np.arange(ends[r] - sizes[r], ends[r]) for r in rows]
        words = flat[np.concatenate(spans)] if len(spans) else flat[:0]
        return words, np.repeat(np.arange(len(rows)), sizes[rows]), np.maximum(sizes[rows], LEAST)[:, None]

    for turn in range(rounds):
        if turn >= rounds // 2:
            vectors = _sums(embed[ids], of, len(number)) / per_word[:, None]
            words, bag, over = parts(np.arange(len(bags)))
            z = _sums(vectors[words], bag, len(bags)) / over @ linear + bias
            margin = z[:, 1] - z[:, 0]
            top = np.full(documents.max() + 1, -np.inf)
            np.maximum.at(top, documents, margin)
            use = (labels == 0) | (margin >= np.maximum(top[documents] - 1.0, 0) - 1e-9) | (margin >= top[documents])
        for rows in np.array_split(rng.permutation(np.flatnonzero(use)), max(2, int(use.sum()) // 8192)):
            step += 1
            grads = window_slopes((embed, linear, bias), (ids, of, per_word), *parts(rows), labels[rows], weight[rows])[1]
            # rare n-grams move less than in plain Adam: the floor is the usual slope of all that occur
            for i, (param, grad) in enumerate(zip((embed, linear, bias), grads)):
                slope[i] += 0.1 * (grad - slope[i])
                size[i] += 0.05 * (grad * grad - size[i])
                usual = math.sqrt(size[i].sum() / max(1, np.count_nonzero(size[i])))
                param -= 0.1 * slope[i] / (1 - 0.9**step) / (np.sqrt(size[i] / (1 - 0.95**step)) + 0.1 * usual + 1e-12)
                if i == 0:
                    param *= 0.99
    return SubwordBag(embed @ (linear[:, 1] - linear[:, 0]), float(bias[1] - bias[0]))


def _samples(documents: DataFrame, labels: DataFrame, column: str) -> list[tuple]:
    """(label, text of the window, document) of a bounded number of labelled documents."""
    most = F.when(F.col("label") == 1, MOST_TOXIC).otherwise(MOST_CLEAN)
    picked = training_rows(documents, settled_labels(labels, column), most, max(MOST_TOXIC, MOST_CLEAN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = tokens(text.as_py())
                places = windows(len(words))
                if len(places) > WINDOWS:
                    places = places[np.linspace(0, len(places) - 1, WINDOWS).astype(int)]
                bags = [b" ".join(words[p : p + WORDS]).decode("utf-8", "replace") for p in places]
                rows.append((label, bags))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.string()))],
                names=["label", "bags"],
            )

    return picked.mapInArrow(run, "label int, bags array<string>").collect()


def fit(documents: DataFrame, labels: DataFrame, column: str = "toxic") -> SubwordBag | None:
    """The model of the labelled rows among ``documents``; None without both classes."""
    rows = sorted(map(tuple, _samples(documents, labels, column)))
    bags = [(label, text.encode().split(), i) for i, (label, texts) in enumerate(rows) for text in texts]
    if not bags:
        return None
    return train([b for _, b, _ in bags], np.array([x for x, _, _ in bags]), np.array([i for _, _, i in bags]))


def score(documents: DataFrame, model: SubwordBag | None) -> DataFrame:
    """doc_id and score of every row."""
    schema = StructType([documents.schema["doc_id"], StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [0.0 if model is None else model.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, schema)
