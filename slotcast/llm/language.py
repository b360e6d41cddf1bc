"""Language of a text by a byte convolutional network.

Bytes of the lower-cased text are embedded; filters of several widths slide over
a window of ``WINDOW`` bytes, the most each filter finds in the window is kept
(max pooling), and a linear layer with softmax gives the language. The network
is trained in numpy with Adam on labelled windows. A text is cut into windows
from its first to its last byte, taken ``BATCH`` at a time, and its probability
of a language is the mean over its windows, weighted by their bytes.

Training sees at most ``MOST`` labelled documents of each language, the first in
hash order of their ids, and ``WINDOWS`` windows of each, spread over the text. The
output layer has one column per language; more than ``LANGUAGES`` of them end the
job, so what reaches the driver is bounded. A text of any length is read whole, a
bounded number of windows at a time.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
null ids and repeated rows are judged like any other row; rows without a
language are not learned from; without any labelled row all texts are ``und``;
an empty table gives an empty result; only doc_id, text and, to learn, lang are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from slotcast.llm.store import training_rows

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
MOST, WINDOWS = 600, 4
LANGUAGES = 512
BATCH = 512
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def to_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)


def cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows as rows, the last padded with zeros, and the bytes in each."""
    n = max(1, -(-len(data) // WINDOW))
    rows = np.zeros(n * WINDOW, np.uint8)
    rows[: len(data)] = data
    sizes = np.full(n, WINDOW)
    sizes[-1] = len(data) - (n - 1) * WINDOW
    return rows.reshape(n, WINDOW), sizes


class ByteNet:
    """Embedding, filters by width, and the linear layer; arrays of single precision."""

    def __init__(self, languages: list[str], seed: int = 4):
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        self.languages = languages
        self.params = {"embed": normal(0.5, 256, EMBEDDING), "out": normal(0.1, FILTERS * len(WIDTHS), len(languages)),
                       "bias": np.zeros(len(languages), np.float32)}
        self.params["embed"][0] = 0
        for w in WIDTHS:
            self.params[f"w{w}"] = normal((w * EMBEDDING) ** -0.5, w * EMBEDDING, FILTERS)
            self.params[f"b{w}"] = np.zeros(FILTERS, np.float32)

    def _columns(self, embedded: np.ndarray, width: int) -> np.ndarray:
        """The embedded bytes under a filter, side by side, for every place."""
        n, size, d = embedded.shape
        step = embedded.strides
        return np.lib.stride_tricks.as_strided(
            embedded, (n, size - width + 1, width * d), (step[0], step[1], step[2])
        ).reshape(-1, width * d)

    def features(self, rows: np.ndarray) -> tuple[np.ndarray, list]:
        embedded = np.ascontiguousarray(self.params["embed"][rows])
        pooled, kept = [], []
        for w in WIDTHS:
            columns = self._columns(embedded, w)
            found = (columns @ self.params[f"w{w}"]).reshape(len(rows), -1, FILTERS)
            pooled.append(np.maximum(found.max(axis=1) + self.params[f"b{w}"], 0))
            kept.append((columns, found))
        return np.concatenate(pooled, axis=1), kept

    def softmax(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.params["out"] + self.params["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.softmax(self.features(rows[i : i + BATCH])[0]) for i in range(0, len(rows), BATCH)])

    def slopes(self, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        pooled, kept = self.features(rows)
        delta = self.softmax(pooled)
        delta[np.arange(len(rows)), labels] -= 1
        delta *= (weights / weights.sum())[:, None]
        grads = {"out": pooled.T @ delta, "bias": delta.sum(axis=0), "embed": np.zeros_like(self.params["embed"])}
        back = (delta @ self.params["out"].T) * (pooled > 0)
        every = np.arange(len(rows))[:, None]
        for i, w in enumerate(WIDTHS):
            columns, found = kept[i]
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            place = found.argmax(axis=1)  # only the place of the maximum has a slope
            flat = (every * found.shape[1] + place).ravel()
            picked = columns[flat].reshape(len(rows), FILTERS, -1)
            grads[f"w{w}"] = np.einsum("nfk,nf->kf", picked, part)
            grads[f"b{w}"] = part.sum(axis=0)
            below = part[:, :, None] * self.params[f"w{w}"].T[None]
            for k in range(w):
                np.add.at(grads["embed"], rows[every, place + k], below[:, :, k * EMBEDDING : (k + 1) * EMBEDDING])
        grads["embed"][0] = 0
        return grads

    def train(self, rows: np.ndarray, labels: np.ndarray, rounds: int = 12, seed: int = 4) -> "ByteNet":
        rng = np.random.default_rng(seed)
        weights = (len(labels) / np.bincount(labels, minlength=len(self.languages)).clip(1))[labels].astype(np.float32)
        slope = {k: np.zeros_like(v) for k, v in self.params.items()}
        size = {k: np.zeros_like(v) for k, v in self.params.items()}
        step = 0
        for turn in range(max(rounds, 600 // max(1, len(rows) // 64))):
            rate = 0.01 if turn < rounds // 2 else 0.003
            for pick in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
                step += 1
                for k, g in self.slopes(rows[pick], labels[pick], weights[pick]).items():
                    slope[k] += 0.1 * (g - slope[k])
                    size[k] += 0.01 * (g * g - size[k])
                    self.params[k] -= rate * slope[k] / (1 - 0.9**step) / (np.sqrt(size[k] / (1 - 0.99**step)) + 1e-7)
        return self


def fit(documents: DataFrame) -> ByteNet | None:
    """The network learned from the rows of ``documents`` with a language; None if there are none."""
    known = (
        documents.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("lang").alias("label"))
    )
    if documents.filter(F.col("lang").isNotNull()).select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    chosen = training_rows(documents, known, F.lit(MOST), MOST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not has_letter(text.as_py()):
                    continue
                rows = cut(to_bytes(text.as_py()))[0]
                if len(rows) > WINDOWS:
                    rows = rows[np.linspace(0, len(rows) - 1, WINDOWS).astype(int)]
                langs += [lang] * len(rows)
                found += [r.tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "row"])

    samples = sorted((r["lang"], bytes(r["row"])) for r in chosen.mapInArrow(run, "lang string, row binary").collect())
    if not samples:
        return None
    languages = sorted({lang for lang, _ in samples})
    rows = np.stack([np.frombuffer(row, np.uint8) for _, row in samples])
    return ByteNet(languages).train(rows, np.array([languages.index(lang) for lang, _ in samples]))


def detect(documents: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    schema = StructType([
        documents.schema["doc_id"], StructField("lang_pred", StringType()), StructField("score", DoubleType())
    ])

    def judge(texts: list[str | None]) -> list[tuple[str, float]]:
        found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        places, windows, sizes, of = [], [], [], []
        sums = {}

        def settle() -> None:
            if windows:
                p = net.predict(np.concatenate(windows)) * np.concatenate(sizes)[:, None]
                for place, total in zip(places, np.add.reduceat(p, np.cumsum([0] + of[:-1]), axis=0)):
                    sums[place] = sums.get(place, 0) + total
                for x in (places, windows, sizes, of):
                    x.clear()

        held = 0
        for place, text in enumerate(texts):
            if net is None or not has_letter(text):
                continue
            rows, size = cut(to_bytes(text))
            for at in range(0, len(rows), 16 * BATCH):
                part = slice(at, at + 16 * BATCH)
                places.append(place)
                windows.append(rows[part])
                sizes.append(size[part])
                of.append(len(rows[part]))
                held += of[-1]
                if held >= 4 * BATCH:
                    settle()
                    held = 0
        settle()
        for place, total in sums.items():
            best = int(total.argmax())
            found[place] = (net.languages[best], min(1.0, float(total[best] / total.sum())))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = judge(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, schema)
