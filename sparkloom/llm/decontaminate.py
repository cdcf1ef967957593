"""Benchmark decontamination by greedy string tiling.

Documents and test items are sequences of words. Word grams of the least match length, rolled over both by Karp-Rabin hashing,
are the seeds. For each document and item that share enough seeds for the coverage, a seed whose words before differ begins a
maximal match, whose length is found by hashes of doubling width; so a repetitive text costs one match for each diagonal, never one for each pair of places. The longest
is marked again and again, and what it leaves of those it overlaps goes back to be marked later, until none of the least length
is left. The share of the item's words under tiles is its coverage, however the tiles are ordered in the document. An item of fewer words
than the least length is looked for as a whole.

The scan goes over the documents alone, with the items broadcast in blocks of a fixed size: one pass for each block.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from .common import ALNUM, blocks, gram_hashes, mapped, mix64, text_bytes, unused, word_hashes

#: Bytes of test items that are broadcast at a time.
BLOCK_BYTES = 16 << 20
#: Words of the shortest tile; and the share of an item's words under tiles from which a document is contaminated by it.
LEAST, COVERAGE = 5, 0.5

HIT = StructType().add("item_id", LongType()).add("coverage", DoubleType()).add("words", LongType()).add("tiles", ArrayType(StructType().add("item_at", LongType()).add("doc_at", LongType()).add("length", LongType())))


def tiles(item_at: np.ndarray, doc_at: np.ndarray, length: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item_at, doc_at, length) from all maximal matches of `least` words or more.

    The longest unmarked match is taken first; ties go by position in the item, then in the document.
    """
    heap = [(-n, i, j) for i, j, n in zip(item_at.tolist(), doc_at.tolist(), length.tolist(), strict=True)]
    heapq.heapify(heap)
    base = int(doc_at.min()) if len(doc_at) else 0
    item_marked, doc_marked = (np.zeros(int((at + length).max()) - low if len(at) else 0, bool) for at, low in ((item_at, 0), (doc_at, base)))
    out = []
    while heap:
        n, a, b = heapq.heappop(heap)
        marked = item_marked[a : a - n] | doc_marked[b - base : b - base - n]
        if not marked.any():
            out.append((a, b, -n))
            item_marked[a : a - n] = doc_marked[b - base : b - base - n] = True
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], marked, [True]])))
        for k, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):  # the unmarked runs go back
            if e - k >= least:
                heapq.heappush(heap, (k - e, a + k, b + k))
    return out


def doubled(words: np.ndarray, most: int) -> list[np.ndarray]:
    """Hashes of the 1, 2, 4 ... words (up to `most`) that begin at each word."""
    out = [words]
    while 2 << (len(out) - 1) <= min(most, len(words)):
        last, size = out[-1], 1 << (len(out) - 1)
        n = len(words) - 2 * size + 1
        out.append(mix64(last[:n] * np.uint64(0x9E3779B97F4A7C15) + (last[size : size + n] ^ np.uint64(size))))
    return out


class Items:
    """Seeds of a block of items, for lookups by hash. An entry is a gram of an item, with all the places where it stands there."""

    def __init__(self, ids: list[int], texts: list[str], least: int):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        self.words, self.starts = word_hashes(data, offsets, ALNUM)
        self.ids, self.least = ids, least
        self.size = np.diff(self.starts)
        grams = gram_hashes(self.words, least)
        item = np.searchsorted(self.starts, np.arange(len(grams)), side="right") - 1
        at = np.arange(len(grams)) - self.starts[item]
        whole = at + least <= self.size[item]  # no gram crosses items
        order = np.lexsort((at[whole], item[whole], grams[whole]))
        grams, item, self.at = grams[whole][order], item[whole][order], at[whole][order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (item[1:] != item[:-1])
        self.first = np.flatnonzero(new)
        self.count = np.diff(np.append(self.first, len(grams)))
        self.grams, self.item = grams[new], item[new]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.most = int(self.size.max()) if len(self.size) else 0
        self.tables = doubled(self.words, self.most)
        # items shorter than a gram, by their number of words
        self.short = {}
        for n in range(1, least):
            own = np.flatnonzero(self.size == n)
            if len(own):
                key = np.array([gram_hashes(self.words[self.starts[k] : self.starts[k] + n], n)[0] for k in own])
                order = np.argsort(key, kind="stable")
                self.short[n] = key[order], own[order]

    @staticmethod
    def _found(keys: np.ndarray, grams: np.ndarray, maybe: np.ndarray, width: int, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, place in the row, entry) of all entries of sorted keys that grams at the places `maybe` equal, inside their row."""
        lo, hi = np.searchsorted(keys, grams[maybe], side="left"), np.searchsorted(keys, grams[maybe], side="right")
        row = np.searchsorted(starts, maybe, side="right") - 1
        good = (hi > lo) & (maybe + width <= starts[row + 1])
        maybe, lo, row, n = maybe[good], lo[good], row[good], (hi - lo)[good]
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(row, n), np.repeat(maybe - starts[row], n), entry

    def whole(self, words: np.ndarray, starts: np.ndarray):
        """(row, item, place) of the first place of each short item in each row."""
        for n, (keys, own) in self.short.items():
            grams = gram_hashes(words, n)
            row, at, entry = self._found(keys, grams, np.arange(len(grams)), n, starts)
            _, first = np.unique(row * len(own) + entry, return_index=True)
            yield from zip(row[first].tolist(), own[entry[first]].tolist(), at[first].tolist(), strict=True)

    def hits(self, words: np.ndarray, starts: np.ndarray, coverage: float):
        """(row, item, item places, document places, lengths) of the maximal matches of each row and item whose seeds may suffice."""
        grams = gram_hashes(words, self.least)
        if not len(grams) or not len(self.grams):
            return
        maybe = np.flatnonzero(self.bits[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        row, at, entry = self._found(self.grams, grams, maybe, self.least, starts)
        if not len(row):
            return
        order = np.lexsort((at, entry, self.item[entry], row))
        row, at, entry = row[order], at[order], entry[order]
        item = self.item[entry]
        pair = np.append(True, (np.diff(row) != 0) | (np.diff(item) != 0))
        new = pair | np.append(True, np.diff(entry) != 0)
        begin = np.flatnonzero(pair)
        # each place of a seed in the item covers `least` of its words at most
        seeds = np.add.reduceat(np.where(new, self.count[entry], 0), begin)
        wanted = seeds * self.least >= coverage * self.size[item[begin]]
        tables = doubled(words, self.most) if wanted.any() else []
        for a, b in zip(begin[wanted].tolist(), np.append(begin[1:], len(row))[wanted].tolist(), strict=True):
            r, k = int(row[a]), int(item[a])
            i, j = self._starts(k, words[starts[r] : starts[r + 1]], at[a:b], entry[a:b])
            i_all, j_all = self.starts[k] + i, starts[r] + j
            room = np.minimum(self.size[k] - i, starts[r + 1] - starts[r] - j)
            n = np.zeros(len(i), np.int64)
            for level in range(min(len(tables), len(self.tables)) - 1, -1, -1):
                for _ in range(2 if level == min(len(tables), len(self.tables)) - 1 else 1):
                    mine, other = self.tables[level], tables[level]
                    fits = n + (1 << level) <= room
                    x, y = np.where(fits, i_all + n, 0), np.where(fits, j_all + n, 0)
                    n += np.where(fits & (mine[x] == other[y]), 1 << level, 0)
            long = n >= self.least
            yield r, k, i[long], j[long], n[long]

    def _starts(self, item: int, doc: np.ndarray, at: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the item and in the document of the seeds that begin maximal matches: the words before them differ, or there is none."""
        own = self.words[self.starts[item] : self.starts[item + 1]]
        before = lambda words, k, none: np.where(k > 0, words[np.maximum(k - 1, 0)], np.uint64(none))
        single = self.count[entry] == 1
        i, j = [self.at[self.first[entry[single]]]], [at[single]]
        keep = before(own, i[0], 1) != before(doc, j[0], 2)
        i[0], j[0] = i[0][keep], j[0][keep]
        for e in np.unique(entry[~single]):
            mine, theirs = self.at[self.first[e] : self.first[e] + self.count[e]], at[entry == e]
            left, right = before(own, mine, 1), before(doc, theirs, 2)
            for word in np.unique(left):
                x, y = mine[left == word], theirs[right != word]
                i.append(np.repeat(x, len(y)))
                j.append(np.tile(y, len(x)))
        return np.concatenate(i), np.concatenate(j)


def blocks_of(benchmark: DataFrame, most: int):
    """The benchmark's items (null ids and texts left out) in lists of at most about `most` bytes, each brought to the driver."""
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // most))
    for k in range(count):
        yield known.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k).orderBy("item_id", "text").collect()


def covered(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES, name: str = "leaks") -> DataFrame:
    """docs with an array in a column of that name (replacing one that has it), of (item_id, coverage, words, tiles) for each item of benchmark (item_id, text) that the row
    covers to `coverage` or more; all rows and other columns stay.

    Words are runs of letters, digits and bytes over 127, A-Z lower-cased. Null and empty texts cover nothing; an item of fewer than
    `least` words is covered, wholly, where its words stand in a row; items without words, null ids and null texts are left out,
    items that share an id count each, repeated rows each get their array. item_id must be an integer or cast to long. Empty tables
    give empty arrays.
    """
    rest = docs.drop(name).withColumn(name, F.array().cast(ArrayType(HIT)))
    schema, at = rest.schema, rest.columns.index("text")
    for rows in blocks_of(benchmark, block_bytes):
        block = docs.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))  # at most about block_bytes

        def run(batches, block=block):
            items = Items(*block.value, least)
            for b in batches:
                data, offsets = text_bytes(b.column(at))
                found: dict[int, list] = {}
                for i, j in blocks(offsets):
                    words, starts = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
                    for row, item, place in items.whole(words, starts):
                        size = int(items.size[item])
                        found.setdefault(i + row, []).append({"item_id": items.ids[item], "coverage": 1.0, "words": size, "tiles": [{"item_at": 0, "doc_at": place, "length": size}]})
                    for row, item, *match in items.hits(words, starts, coverage):
                        size = int(items.size[item])
                        own = tiles(*match, least)
                        words_in = sum(t[2] for t in own)
                        if words_in >= coverage * size:
                            hit = {"item_id": items.ids[item], "coverage": words_in / size, "words": words_in, "tiles": [dict(zip(("item_at", "doc_at", "length"), t, strict=True)) for t in sorted(own)]}
                            found.setdefault(i + row, []).append(hit)
                if found:
                    old = b.column(b.num_columns - 1).to_pylist()
                    new = pa.array([[*old[r], *found.get(r, [])] for r in range(b.num_rows)], b.schema.types[-1])
                    b = pa.RecordBatch.from_arrays([*b.columns[:-1], new], schema=b.schema)  # as that of batches without hits
                yield b

        rest = mapped(rest, run, schema)
    return rest


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that no item covers, with the columns of docs."""
    name = unused(docs, "leaks")[0]
    return covered(docs, benchmark, name=name, **options).where(F.size(name) == 0).select(*docs.columns)


def op7(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that covers it."""
    rows = covered(docs.select("doc_id", "text"), benchmark).select("doc_id", F.explode("leaks").alias("leak"))
    return rows.select("doc_id", "leak.item_id", "leak.coverage", F.col("leak.words").alias("n_words"), F.size("leak.tiles").alias("n_tiles"))
