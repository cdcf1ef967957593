"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text's subwords are its byte n-grams; each is hashed into a table of embeddings, and the mean embedding goes through a
linear softmax. Training is stochastic gradient descent over a bounded sample of labelled rows. As the softmax is linear in
the mean, the trained model is folded into one row of class scores for each bucket, so a prediction is a mean of table rows.

Rejection: a temperature is fitted on rows kept out of training, and the least confidence that reaches the wanted precision
on them becomes the threshold of `accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, text_bytes

GRAMS = (2, 3, 4)


def gram_buckets(data: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each n of GRAMS the buckets of the n-grams that start at each byte (A-Z lower-cased)."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    for n in GRAMS:
        size = len(low) - n + 1
        if size <= 0:
            yield n, np.zeros(0, np.int32)
            continue
        packed = low[:size].copy()
        for k in range(1, n):
            packed |= low[k : k + size] << np.uint64(8 * k)
        packed = (packed + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)
        yield n, ((packed ^ (packed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int32)


def sample(docs: DataFrame, rows: int) -> DataFrame:
    """At most `rows` labelled rows, those of the smallest hash of their id: the same for the same table.

    Rows are first thinned by their hash to little more than `rows` of all, so that no task sends more than its share.
    """
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    known = docs.where(F.col("lang").isNotNull() & (F.crc32(number) % 5 != 0)).withColumn("h", F.xxhash64(F.lit("language"), number))
    every = known.select("h").count()
    share = min(1.0, (1.2 * rows + 100) / max(1, every))
    thin = known.where((F.col("h").bitwiseAND((1 << 30) - 1) < int(share * (1 << 30))) & F.col("text").isNotNull())
    return thin.select("text", "lang", "h").orderBy("h", "lang", "text").limit(rows).select("text", "lang")


class Model:
    """scores: bucket x class, the folded embeddings; temperature and threshold from the calibration rows."""

    def __init__(self, classes: list[str], scores: np.ndarray, bits: int, temperature: float = 1.0, threshold: float = 0.0):
        self.classes, self.scores, self.bits, self.temperature, self.threshold = classes, scores.astype(np.float32), bits, temperature, threshold
        self.by_class = np.ascontiguousarray(self.scores.T)

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Class scores of each row of a block; rows without an n-gram get the zero vector."""
        rows, n = len(offsets) - 1, len(self.classes)
        total, count = np.zeros((rows, n)), np.zeros(rows)
        for size, bucket in gram_buckets(data, self.bits):
            begin = np.minimum(offsets[:-1], len(bucket))
            end = np.maximum(np.minimum(offsets[1:] - size + 1, len(bucket)), begin)  # no n-gram crosses rows
            for c in range(n):
                run = np.concatenate([[0.0], np.cumsum(self.by_class[c][bucket], dtype=np.float64)])
                total[:, c] += run[end] - run[begin]
            count += end - begin
        return total / np.maximum(count, 1)[:, None]

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.logits(data, offsets) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True)) if z.shape[1] else z
        return z / z.sum(axis=1, keepdims=True)


def _rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.array(texts, pa.string()))


def train(texts: list[str], langs: list[str], bits: int = 15, dim: int = 16, epochs: int = 4, rate: float = 0.5, precision: float = 0.99, seed: int = 7) -> Model:
    """SGD over the rows, one at a time; every fifth row is kept for the calibration."""
    classes = sorted(set(langs))
    if not classes:
        return Model([], np.zeros((1 << bits, 0)), bits)
    y = np.array([classes.index(x) for x in langs])
    bags = []
    for text in texts:
        data, _ = _rows([text])
        ids = np.concatenate([b for _, b in gram_buckets(data, bits)])
        ids, n = np.unique(ids, return_counts=True)
        bags.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out = np.zeros((dim, len(classes)), np.float32)
    held = np.arange(len(texts)) % 5 == 4 if len(texts) >= 20 else np.zeros(len(texts), bool)
    steps, step = epochs * max(1, (~held).sum()), 0
    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(~held)):
            ids, share = bags[i]
            lr, step = rate * (1 - step / steps), step + 1
            if not len(ids):
                continue
            mean = share @ embed[ids]
            z = mean @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            # each subword's gradient is its share of the mean's; scaled as in fastText, the table moves by the whole of it
            grad = out @ p
            out -= lr * np.outer(mean, p)
            embed[ids] -= lr * grad[None, :] * np.minimum(1, share[:, None] * len(ids))
    model = Model(classes, embed @ out, bits)
    keep = [i for i in range(len(texts)) if held[i]] or list(range(len(texts)))
    data, offsets = _rows([texts[i] for i in keep])
    z, want = model.logits(data, offsets), y[keep]

    def loss(t: float) -> float:
        e = z / t - (z / t).max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(e).sum(axis=1)) - e[np.arange(len(want)), want]))

    model.temperature = min((float(t) for t in np.geomspace(0.05, 20, 60)), key=loss)
    p = model.probabilities(data, offsets)
    best, right = p.max(axis=1), p.argmax(axis=1) == want
    order = np.argsort(-best, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) >= precision * np.arange(1, len(order) + 1))
    model.threshold = float(best[order][good[-1]]) if len(good) else 1.0
    return model


def fit(docs: DataFrame, rows: int = 4000, **options) -> Model:
    """A model from at most `rows` labelled documents (whole texts), brought to the driver."""
    got = sample(docs, rows).collect()
    return train([r.text for r in got], [r.lang for r in got], **options)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for each row of docs (doc_id, text).

    Only the text is read. A null text, or one without a letter, gives `und`, score 0 and accepted false, as does a model without
    classes. Otherwise lang_pred is a learned value, the first in order at a tie, score its calibrated probability, and accepted
    whether the score reaches the calibrated threshold. Repeated rows each get a row; null ids stay null.
    """
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    cast = docs.select("doc_id", F.col("text").alias("text"), letters.alias("letters"))
    model_ = cast.sparkSession.sparkContext.broadcast((model.classes, model.scores, model.bits, model.temperature, model.threshold))  # bounded: 2 ** bits rows

    def run(batches):
        m = Model(*model_.value)
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            has = np.array(b.column("letters").to_pylist(), bool) & bool(m.classes)
            name, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            for i, j in blocks(offsets):
                if m.classes and has[i:j].any():
                    p = m.probabilities(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    k = p.argmax(axis=1)
                    name[i:j] = np.where(has[i:j], np.array(m.classes, object)[k], "und")
                    score[i:j] = np.where(has[i:j], p[np.arange(j - i), k], 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(name, pa.string()), pa.array(score), pa.array(has & (score >= m.threshold))], ["doc_id", "lang_pred", "score", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cast.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def op5(docs: DataFrame, rows: int = 4000) -> DataFrame:
    """The digest of `identify` over all documents, with the held-out mark."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return identify(docs, fit(docs, rows)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")

