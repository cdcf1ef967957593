"""Connected components over packed edges, in rounds that no hot node slows.

Edges travel as blocks of two columns of numbers (a row of the table is a block, dealt to a bucket of nodes). Each bucket holds the edges
of its nodes to smaller ones, and two exchanges make a round:

1. A bucket replaces what its edges lead to by what the last round's answers say, and reduces its edges to stars by a local union-find:
   each node but the least of a local component keeps one edge, to that least. Edges of its own nodes stay, the others move to
   their nodes' buckets, and it asks, once for each different root, what stands below that root.
2. A bucket answers for those of its nodes that have a smaller neighbour.

A root that a third of all nodes lead to is one question from each bucket, never a row for each of its nodes. The rounds end when no
edge has moved and no question was answered: then each node has one edge, to the least of its component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, mix64, settled

#: Edges that a task reduces at a time, and those of a block.
HOLD, CHUNK = 1_000_000, 200_000
#: Edges for each bucket that make the rounds' parallelism, and the most that a bucket shall hold.
SPREAD, MOST = 50_000, 4_000_000
BLOCKS = "n long, blob binary"
DEALT = "bucket int, kind int, n long, changed long, blob binary"
EDGE, MOVED, ASK, ANSWER = range(4)


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, one after another, compressed."""
    return pa.Codec("zstd", 1).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns), asbytes=True)


def spread(blob: bytes, n: int, columns: int = 2) -> np.ndarray:
    """The columns again, as rows of an int64 array."""
    return np.frombuffer(pa.Codec("zstd").decompress(blob, 8 * n * columns, asbytes=True), np.int64).reshape(columns, n)


def stars(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of the components that the edges make: every node but the least of each, which is its root."""
    if not len(one):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes, at = np.unique(np.concatenate([one, two]), return_inverse=True)
    a, b = at[: len(one)], at[len(one) :]
    label = np.arange(len(nodes))
    while True:  # labels are places in the sorted nodes: the least wins; nodes and their roots are hooked
        low = np.minimum(label[a], label[b])
        least = label.copy()
        for place in (a, b, label[a], label[b]):
            np.minimum.at(least, place, low)
        least = least[least]
        if (least == label).all():
            break
        label = least
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


class Edges:
    """Edges that a task gathers, reduced to stars whenever there are HOLD of them."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, one: np.ndarray, two: np.ndarray) -> None:
        self.parts.append((one, two))
        self.size += len(one)
        if self.size >= HOLD:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            self.parts = [stars(*(np.concatenate([p[k] for p in self.parts]) for k in (0, 1)))]
        self.size = 0  # what is left counts anew: at most one edge for each node
        return self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def rows(self) -> Iterator[tuple[int, bytes]]:
        """(n, blob) of the stars, in blocks."""
        one, two = self.reduce()
        for k in range(0, len(one), CHUNK):
            yield len(one[k : k + CHUNK]), squeeze(one[k : k + CHUNK], two[k : k + CHUNK])


def batch(kind: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch, by a schema of int, long and binary columns."""
    names = [x.split() for x in kind.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(names)], [n for n, _ in names])


def cut(order_by: np.ndarray) -> list[np.ndarray]:
    """The places of each different value, by value."""
    order = np.argsort(order_by, kind="stable")
    if not len(order):
        return []
    return np.split(order, np.flatnonzero(np.diff(order_by[order])) + 1)


def by_bucket(df: DataFrame, buckets: int, solve: Callable, kind: str) -> DataFrame:
    """solve(bucket, rows) for all rows of each bucket (the first column of df) in one task; it yields rows of the schema `kind`."""

    def run(batches):
        now, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != now:
                    if held:
                        yield batch(kind, list(solve(now, held)))
                    now, held = row[0], []
                held.append(row)
        if held:
            yield batch(kind, list(solve(now, held)))

    return mapped(df.repartition(buckets, df.columns[0]).sortWithinPartitions(df.columns[0]), run, kind)


def buckets_for(df: DataFrame, n: int, each: int = SPREAD, most: int = MOST) -> int:
    """How many buckets n entries make: one for `each`, up to the shuffle's partitions; more where a bucket would hold over `most`."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(parts, -(-n // each)), -(-n // most))


def place(nodes: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix64(nodes.view(np.uint64)) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def reduced(edges: DataFrame) -> DataFrame:
    """BLOCKS of edges (two long columns) that connect the same nodes: each task's stars."""

    def run(batches):
        own = Edges()
        for b in batches:
            own.add(np.asarray(b.column(0)), np.asarray(b.column(1)))
        yield batch(BLOCKS, list(own.rows()))

    return mapped(edges, run, BLOCKS)


def connected(blocks: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges in BLOCKS (settled: it is read twice): (node, root), a row for each node but the least of its
    component, which is its root. Raises if `rounds` don't suffice."""
    count = blocks.agg(F.sum("n")).first()[0] or 0
    buckets = buckets_for(blocks, count)

    def dealt(kind, one, two):
        for at in cut(place(one, buckets)):
            yield int(place(one[at[:1]], buckets)[0]), kind, len(at), 0, squeeze(one[at], two[at])

    def begin(batches):
        for b in batches:
            yield batch(DEALT, [row for n, blob in zip(*(c.to_pylist() for c in b.columns), strict=True) for row in dealt(MOVED, *spread(blob, n))])

    def joined(rows, *kinds):
        parts = [spread(r[4], r[2]) for r in rows if r[1] in kinds]
        return np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64)

    def shorten(bucket, rows):
        one, two = joined(rows, EDGE, MOVED)
        node, below = joined(rows, ANSWER)
        if len(node):
            order = np.argsort(node)
            at = np.minimum(np.searchsorted(node[order], two), len(node) - 1)
            two = np.where(node[order][at] == two, below[order][at], two)
        one, two = stars(one, two)
        home = place(one, buckets) == bucket
        if home.any():
            yield bucket, EDGE, int(home.sum()), 0, squeeze(one[home], two[home])
        yield from dealt(MOVED, one[~home], two[~home])
        roots = np.unique(two[home])
        roots = roots[place(roots, buckets) != bucket]
        yield from dealt(ASK, roots, np.full(len(roots), bucket))

    def answer(bucket, rows):
        one, two = joined(rows, EDGE, MOVED)
        asked, by = joined(rows, ASK)
        moved = sum(r[2] for r in rows if r[1] == MOVED)
        if len(one):
            yield bucket, EDGE, len(one), moved, squeeze(one, two)
            order = np.lexsort((two, one))
            node, first = np.unique(one[order], return_index=True)
            least = two[order][first]
            at = np.minimum(np.searchsorted(node, asked), len(node) - 1)
            hit = node[at] == asked
            for own in cut(by[hit]):
                yield int(by[hit][own[0]]), ANSWER, len(own), len(own), squeeze(asked[hit][own], least[at][hit][own])

    state = mapped(blocks.select("n", "blob"), begin, DEALT)
    for _ in range(rounds if count else 0):
        state = settled(by_bucket(by_bucket(state, buckets, shorten, DEALT), buckets, answer, DEALT), "forest")
        if not state.agg(F.sum("changed")).first()[0]:
            break
    else:
        if count:
            raise RuntimeError(f"components did not settle in {rounds} rounds")

    def unpacked(batches):
        for b in batches:
            for kind, n, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == EDGE:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in spread(blob, n)], ["node", "root"])

    return mapped(state.select("kind", "n", "blob"), unpacked, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long, in any order; loops are allowed): (node, root), root the smallest node of the component,
    for each node but the roots. An empty table gives an empty result."""
    return connected(settled(reduced(edges.select("a", "b")), "edges"))
