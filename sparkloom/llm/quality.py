"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

Random indexing: every token bucket has a fixed sparse random index vector; a token's word vector is the sum of the index
vectors of its neighbours within a window, over the training sample. A document is the mean of its tokens' normalised word
and index vectors. A network with one hidden layer is trained on these, and a temperature fitted on rows kept out of training
calibrates its probabilities.

Tokens are runs of one class of characters (upper-case, lower-case or other letters, digits, or one repeated mark) cut from the
UTF-8 bytes and hashed into buckets, so markup or capitals in every word show as tokens of their own, known or not. A run of
over PIECE bytes (a sentence in a script without blanks, say) is cut into tokens of as many.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_table, mapped, mix64, text_bytes, unused

#: Classes of bytes: 0 blank, 1 lower-case and bytes over 127, 2 upper-case, 3 digit, 4 and more: each mark a class of its own.
CLASS = np.arange(256) + 4
CLASS[[9, 10, 11, 12, 13, 32]] = 0
CLASS[97:123] = 1
CLASS[128:] = 1
CLASS[65:91] = 2
CLASS[48:58] = 3
BYTES = byte_table(11)
BASE = np.uint64(0x100000001B3)
PIECE = 24


def tokens(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a block's tokens in order, and where each row's tokens begin (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    kind = CLASS[data]
    first = np.ones(len(data), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[1:] &= ~((kind[1:] == 1) & (kind[:-1] == 2) & np.concatenate([[True], kind[:-2] != 2]))  # a capital begins its word
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.arange(len(data)) - np.maximum.accumulate(np.where(first, np.arange(len(data)), 0))
    at %= PIECE
    begin = np.flatnonzero(at == 0)
    low = np.where(kind == 2, data + 32, data)
    # the hash of a token: its bytes' values times powers of BASE from its start
    value = BYTES[low] * np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE - 1, BASE)]), dtype=np.uint64)[at]
    length = np.diff(np.append(begin, len(data)))
    shout = (kind[begin] == 2) & (length > 1)
    word = mix64(np.add.reduceat(value, begin) + length.astype(np.uint64) * np.uint64(31))
    bucket = (word >> np.uint64(64 - bits)).astype(np.int32)
    keep = kind[begin] != 0
    # a word in capitals is two tokens: the mark of capitals (bucket 0), and the word
    times = np.where(shout, 2, 1)[keep]
    out = np.repeat(bucket[keep], times)
    where = np.cumsum(times) - times
    out[where[shout[keep]]] = 0
    ends = np.searchsorted(begin[keep], offsets, side="left")
    return out, np.concatenate([where, [len(out)]])[ends]


def index_vectors(bits: int, dim: int, nonzero: int = 4, seed: int = 5) -> np.ndarray:
    """A sparse vector of +1 and -1 for each bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((1 << bits, dim), np.float32)
    rows = np.arange(1 << bits)
    for k in range(nonzero):
        out[rows, rng.integers(0, dim, 1 << bits)] += 1 if k % 2 else -1
    return out


class Model:
    def __init__(self, bits: int, table: np.ndarray, shift: np.ndarray, scale: np.ndarray, w1, b1, w2, b2: float, temperature: float = 1.0, prior: float = 0.5):
        self.bits, self.table, self.shift, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature, self.prior = bits, table, shift, scale, w1, b1, w2, b2, temperature, prior

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The mean vector of each row's tokens, with the log of their number, and the share that repeat the token before them."""
        return pool(self.table, *tokens(data, offsets, self.bits))

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = (self.pooled(data, offsets) - self.shift) / self.scale
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        p = 1 / (1 + np.exp(-np.clip(z / self.temperature, -30, 30)))
        return np.where(offsets[1:] > offsets[:-1], p, self.prior)


def pool(table: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    rows = len(starts) - 1
    n = np.diff(starts)
    out = np.zeros((rows, table.shape[1] + 3))
    full = np.flatnonzero(n)
    if len(full):
        for c in range(0, len(full), 64):  # bounds the gathered vectors
            part = full[c : c + 64]
            lo, hi = starts[part[0]], starts[part[-1] + 1]
            for a in range(lo, hi, 1 << 18):  # a very long text is gathered in pieces
                b = min(a + (1 << 18), hi)
                own = np.searchsorted(starts[part + 1], np.arange(a, b), side="right")
                at = np.flatnonzero(np.diff(np.concatenate([[-1], own])))
                np.add.at(out[:, : table.shape[1]], part[own[at]], np.add.reduceat(table[ids[a:b]], at, axis=0))
        out[full, : table.shape[1]] /= n[full, None]
        same = np.zeros(len(ids) + 1)
        same[1:-1] = np.cumsum(ids[1:] == ids[:-1])
        same[-1] = same[-2] if len(ids) > 1 else 0
        out[full, -1] = (same[starts[full + 1] - 1] - same[starts[full]]) / n[full]
        for r in full:
            out[r, -2] = len(np.unique(ids[starts[r] : starts[r + 1]])) / n[r] ** 0.9
    out[:, -3] = np.log1p(n)
    return out


def train(texts: list[str], labels: list[int], bits: int = 14, dim: int = 32, window: int = 2, hidden: int = 24, epochs: int = 60, rate: float = 0.01, seed: int = 3) -> Model:
    """Word vectors, network (Adam, weight decay, minibatches) and temperature; every fifth row is kept for the temperature."""
    index = index_vectors(bits, dim)
    context = np.zeros_like(index)
    bags = []
    for text in texts:
        data, offsets = text_bytes(pa.array([text], pa.string()))
        ids, starts = tokens(data, offsets, bits)
        bags.append((ids, starts))
        for d in range(1, window + 1):
            if len(ids) > d:
                np.add.at(context, ids[d:], index[ids[:-d]])
                np.add.at(context, ids[:-d], index[ids[d:]])
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    table = np.concatenate([context / np.maximum(norm, 1), index / 2], axis=1).astype(np.float32)
    y = np.array(labels, float)
    wide = table.shape[1] + 3
    rng = np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():  # nothing to tell apart: the smoothed share of label 1
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(bits, table, np.zeros(wide), np.ones(wide), np.zeros((wide, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))), 1.0, p)
    x = np.concatenate([pool(table, *b) for b in bags])
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - shift) / scale
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    own = np.flatnonzero(~held)
    w = [rng.normal(0, wide**-0.5, (wide, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        order = rng.permutation(own)
        for k in range(0, len(order), 64):
            i = order[k : k + 64]
            h = np.maximum(x[i] @ w[0] + w[1], 0)
            e = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - y[i]) / len(i)
            back = np.outer(e, w[2]) * (h > 0)
            grads = [x[i].T @ back + 1e-3 * w[0], back.sum(axis=0), h.T @ e + 1e-3 * w[2], np.array([e.sum()])]
            t += 1
            for a, g, mm, vv in zip(w, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                a -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
    keep = np.flatnonzero(held) if held.any() else own
    z = np.maximum(x[keep] @ w[0] + w[1], 0) @ w[2] + w[3]
    loss = lambda s: float(np.mean(np.logaddexp(0, np.where(y[keep] == 1, -z, z) / s)))
    temperature = min((float(s) for s in np.geomspace(0.2, 10, 60)), key=loss)
    return Model(bits, table, shift, scale, w[0], w[1], w[2], float(w[3][0]), temperature, float((y.sum() + 1) / (len(y) + 2)))


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most `rows` labelled rows whose crc32(doc_id) mod 5 is not 0, by the smallest hash of their id, then label and text.

    A document with several labels takes part with each, and so do several texts of one id; rows with a null id, text or label don't.
    """
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = known.withColumn("h", F.xxhash64(F.lit("quality"), "doc_id"))
    share = min(1.0, (1.2 * rows + 100) / max(1, known.count()))  # thinned first, so that no task sends more than its share
    picked = known.where(F.col("h").bitwiseAND((1 << 30) - 1) < int(share * (1 << 30))).orderBy("h", "doc_id", "quality").limit(rows)
    # bounded by `rows`: the picked ids are broadcast, so that no text is shuffled
    both = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    return both.orderBy("h", "doc_id", "quality", "text").limit(rows).select("doc_id", "text", "quality")


def fit(docs: DataFrame, labels: DataFrame, rows: int = 4000, **options) -> Model:
    """A model from at most `rows` labels (whole texts), brought to the driver."""
    got = sorted(sample(docs, labels, rows).collect(), key=lambda r: (r.doc_id, r.quality, r.text))
    return train([r.text for r in got], [int(r.quality) for r in got], **options)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with the probability of label 1, and 1 if that reaches the threshold, else 0, in columns of these names (replacing
    columns that have them).

    Only the text is read; null and empty texts get the prior of label 1. All other columns and all rows stay as they are.
    """
    rest = docs.drop(*names)
    m_ = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2 ** bits vectors
    at = rest.columns.index("text")

    def run(batches):
        m = m_.value
        for b in batches:
            data, offsets = text_bytes(b.column(at))
            p = np.zeros(b.num_rows)
            for i, j in blocks(offsets):
                p[i:j] = m.probability(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*b.schema.names, *names])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    return mapped(rest, run, StructType([*rest.schema.fields]).add(names[0], DoubleType()).add(names[1], IntegerType()))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with the columns of docs."""
    names = tuple(unused(docs, "score", "predicted"))
    return score(docs, model, threshold, names).where(F.col(names[1]) == 1).select(*docs.columns)


def op9(docs: DataFrame, labels: DataFrame, rows: int = 4000) -> DataFrame:
    """The digest of `score` over all documents, with the held-out mark."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return score(docs.select("doc_id", "text"), fit(docs, labels, rows)).select("doc_id", held.alias("held_out"), "score", "predicted")
