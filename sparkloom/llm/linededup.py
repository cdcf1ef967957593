"""Reversible line dedup: sharded cuckoo filters backed by an exact reference-count table.

State, by key (128 hash bits of a normalised line):
- `refs`: the exact table, a row for each key: in how many documents it stands, and the smallest document that holds it.
- `postings`: (key, document), from which a deletion finds the next smallest document of a key.
- `filters`: a cuckoo filter for each shard of the keys. It holds a mark for every key of `refs`.

An insertion counts the new documents' keys first (combined before the shuffle, so a line in a third of all documents is one
row for each task). Each shard's filter is then asked for each new key: a miss proves the key new, and its counts are final; only
hits are looked up in the exact table. What the lookup shows to be new all the same gets its mark like the misses, so each key
has one of its own. A deletion takes counts back, and keys at zero leave both the table and the filter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_skewed, mapped, mix64, settled, unused

#: Fixed values of the key: the blanks that are stripped, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A null document id stands after all others.
LAST = (1 << 63) - 1


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket, over 64-bit hashes; vectorised over arrays of keys.

    It grows by doubling: when kicks fail, a second filter of twice the size is chained behind the first.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int = 1024):
        self.parts = [self._empty(capacity)]

    @classmethod
    def _empty(cls, capacity: int) -> np.ndarray:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / (cls.SLOTS * 0.8)))))
        return np.zeros((buckets, cls.SLOTS), np.uint16)

    @staticmethod
    def _split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = mix64(keys.astype(np.uint64, copy=False))  # a shard's keys share bits
        return (keys >> np.uint64(48)).astype(np.uint16) | np.uint16(1), keys

    @staticmethod
    def _other(at: np.ndarray, mark: np.ndarray, buckets: int) -> np.ndarray:
        return at ^ ((mark.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(buckets - 1)).astype(np.int64)

    def _places(self, part: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark, keys = self._split(keys)
        one = (keys & np.uint64(len(part) - 1)).astype(np.int64)
        return mark, one, self._other(one, mark, len(part))

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may have been inserted; false is certain."""
        out = np.zeros(len(keys), bool)
        for part in self.parts:
            mark, one, two = self._places(part, keys)
            out |= (part[one] == mark[:, None]).any(axis=1) | (part[two] == mark[:, None]).any(axis=1)
        return out

    def insert(self, keys: np.ndarray) -> None:
        """Adds each key once for each time it is given."""
        if not len(keys):
            return
        if int(sum((p != 0).sum() for p in self.parts[-1:])) + len(keys) > 0.85 * self.parts[-1].size:
            self.parts.append(self._empty(2 * max(len(keys), self.parts[-1].size)))
        part = self.parts[-1]
        mark, at, _ = self._places(part, keys)
        rng = np.random.default_rng(len(keys))
        mark, at = self._put(part, mark, at)
        at = self._other(at, mark, len(part))
        for _ in range(self.KICKS):
            mark, at = self._put(part, mark, at)
            if not len(mark):
                return
            # those left evict a random slot each, one to a bucket
            _, first = np.unique(at, return_index=True)
            slot = rng.integers(0, self.SLOTS, len(first))
            out = part[at[first], slot].copy()
            part[at[first], slot] = mark[first]
            mark[first] = out
            at[first] = self._other(at[first], out, len(part))
        raise OverflowError("cuckoo filter overfull")  # under 85 % load this has no realistic chance

    def _put(self, part: np.ndarray, mark: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts marks into free slots of their buckets; returns those that found none."""
        order = np.argsort(at, kind="stable")
        mark, at = mark[order], at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at, side="left")
        free = part[at] == 0
        seat = np.cumsum(free, axis=1)
        fits = rank < seat[:, -1]
        slot = np.argmax(seat == (rank + 1)[:, None], axis=1)
        part[at[fits], slot[fits]] = mark[fits]
        return mark[~fits], at[~fits]

    def delete(self, keys: np.ndarray) -> None:
        """Takes out one copy of each key, all of which must have been inserted.

        A mark that stands in several parts may be another key's in all but one of them, so it stays: no key left is lost.
        """
        parts = np.zeros(len(keys), np.int64)
        for part in self.parts:
            parts += self._slots(part, keys)[1]
        keys = keys[parts == 1]
        for part in self.parts:
            left = keys[self._slots(part, keys)[1]]
            while len(left):  # keys of the same mark and buckets take a slot each, one after another
                slot, hit = self._slots(part, left)
                taken, first = np.unique(slot[hit], return_index=True)
                part.reshape(-1)[taken] = 0
                left = np.delete(left[hit], first)

    def _slots(self, part: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first slot of a part that holds each key's mark, and whether there is one."""
        mark, one, two = self._places(part, keys)
        slots = np.concatenate([one[:, None] * self.SLOTS + np.arange(self.SLOTS), two[:, None] * self.SLOTS + np.arange(self.SLOTS)], axis=1)
        same = part.reshape(-1)[slots] == mark[:, None]
        at = same.argmax(axis=1)
        return slots[np.arange(len(keys)), at], same.any(axis=1)

    def dump(self) -> bytes:
        sizes = np.array([len(self.parts), *(len(p) for p in self.parts)], np.int64)
        return sizes.tobytes() + b"".join(p.tobytes() for p in self.parts)

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8)
        out, at = cls.__new__(cls), 8 * (n + 1)
        out.parts = []
        for k in sizes:
            out.parts.append(np.frombuffer(data, np.uint16, int(k) * cls.SLOTS, at).reshape(-1, cls.SLOTS).copy())
            at += int(k) * cls.SLOTS * 2
        return out


def lines_of(text):
    """The lines of a text column, split at newline alone."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line):
    """A line as it is compared."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def number(docs: DataFrame):
    """The document of a row, and a mark of its text that tells rows of one document apart."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64(F.coalesce("text", F.lit("")))


def keyed(docs: DataFrame, least: int = 10) -> DataFrame:
    """(h1, h2, did, tie, line): a row for each line whose key has `least` code points or more; line counts from 0 in the row of the
    document did whose text has the mark tie."""
    did, tie = number(docs)
    lines = docs.select(did.alias("did"), tie.alias("tie"), F.posexplode(lines_of(F.col("text"))).alias("line", "raw"))
    keys = lines.select("did", "tie", "line", line_key(F.col("raw")).alias("key")).where(F.length("key") >= least)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "did", "tie", "line")


@dataclass
class LineIndex:
    """The state; a new one for each change, the old ones stay valid."""

    refs: DataFrame  # h1, h2, docs, owner
    filters: DataFrame  # shard, filter
    postings: DataFrame  # h1, h2, did; a pair may be there more than once
    shards: int
    least: int
    asked: DataFrame | None = None  # the last insertion's keys, with `known`: whether they had to be looked up

    @classmethod
    def empty(cls, spark: SparkSession, shards: int, least: int = 10) -> LineIndex:
        return cls(
            spark.createDataFrame([], "h1 long, h2 long, docs long, owner long"),
            spark.createDataFrame([], "shard int, filter binary"),
            spark.createDataFrame([], "h1 long, h2 long, did long"),
            shards,
            least,
        )

    def _shard(self):
        return F.pmod(F.col("h1"), F.lit(self.shards)).cast("int")

    def _through(self, rows: DataFrame, work, kind: str) -> DataFrame:
        """work(filter, keys, batch) for each batch of a shard's rows (h1 and other long columns), whose filter it may change; the
        batches that it gives, and at a shard's end those of work(filter, None, shard)."""
        names = rows.columns
        filters = self.filters.select("shard", F.lit(0).alias("turn"), "filter", *(F.lit(0).cast("long").alias(c) for c in names))
        asked = rows.select(self._shard().alias("shard"), F.lit(1).alias("turn"), F.lit(None).cast("binary").alias("filter"), *names)
        dealt = filters.union(asked).repartition("shard").sortWithinPartitions("shard", "turn")
        at = 3 + names.index("h1")

        def run(batches):
            now, own = None, Cuckoo()
            for b in batches:
                shard, turn = (np.asarray(b.column(k)) for k in (0, 1))
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), b.num_rows] if b.num_rows else []
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    if shard[i] != now:
                        if now is not None and (out := work(own, None, now)) is not None:
                            yield out
                        now, own = int(shard[i]), Cuckoo()
                    for k in np.flatnonzero(turn[i:j] == 0):
                        own = Cuckoo.load(b.column(2)[int(i + k)].as_py())
                    part = b.slice(i, j - i).filter(pa.array(turn[i:j] == 1))
                    if part.num_rows and (out := work(own, np.asarray(part.column(at)).view(np.uint64), part)) is not None:
                        yield out
            if now is not None and (out := work(own, None, now)) is not None:
                yield out

        return mapped(dealt, run, kind)

    def _asked(self, delta: DataFrame) -> DataFrame:
        """delta (a row for each key) with `known`: false where the shard's filter proves the key new."""

        def work(own, keys, part):
            if keys is not None:
                return pa.RecordBatch.from_arrays([*part.columns[3:], pa.array(own.has(keys))], ["h1", "h2", "docs", "owner", "known"])

        return self._through(delta.select("h1", "h2", "docs", "owner"), work, "h1 long, h2 long, docs long, owner long, known boolean")

    def _marked(self, keys: DataFrame, gone: bool = False) -> DataFrame:
        """The filters with the keys' marks, or, if they are gone, without."""

        def work(own, keys, part):
            if keys is None:
                return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.dump()], pa.binary())], ["shard", "filter"])
            (own.delete if gone else own.insert)(keys)

        return self._through(keys.select("h1"), work, "shard int, filter binary")

    def insert(self, docs: DataFrame) -> LineIndex:
        """The state after adding docs (doc_id, text), none of whose ids may be in it yet."""
        return self.insert_lines(settled(keyed(docs, self.least), "lines"))

    def insert_lines(self, lines: DataFrame) -> LineIndex:
        """As insert, from the documents' `keyed` lines (settled: they are read again)."""
        rows = lines.select("h1", "h2", "did")
        delta = rows.distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.min("did").alias("owner"))
        asked = settled(self._asked(delta), "asked")
        # the exact table meets only keys that the filters let through
        old = self.refs.select("h1", "h2", F.col("docs").alias("docs0"), F.col("owner").alias("owner0"))
        both = asked.where("known").drop("known").join(old, ["h1", "h2"], "full_outer")
        summed = both.select("h1", "h2", (F.coalesce("docs", F.lit(0)) + F.coalesce("docs0", F.lit(0))).alias("docs"), F.least("owner", "owner0").alias("owner"), F.col("docs0").isNull().alias("fresh"))
        refs = settled(asked.where("not known").select("h1", "h2", "docs", "owner", F.lit(True).alias("fresh")).union(summed), "refs")
        filters = settled(self._marked(refs.where("fresh")), "filters")
        return LineIndex(refs.drop("fresh"), filters, self.postings.union(rows), self.shards, self.least, asked)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The state after taking out the documents of ids (doc_id); ids that it doesn't hold change nothing."""
        gone = ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did")).distinct()
        lost = self.postings.join(gone, "did", "left_semi")
        kept = settled(self.postings.join(gone, "did", "left_anti").select("h1", "h2", "did").distinct(), "postings")
        touched = settled(lost.select("h1", "h2").distinct(), "touched")
        again = settled(kept.join(touched, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.min("did").alias("owner")), "again")
        refs = settled(self.refs.join(touched, ["h1", "h2"], "left_anti").union(again), "refs")
        dead = touched.join(again, ["h1", "h2"], "left_anti")
        return LineIndex(refs, settled(self._marked(dead, gone=True), "filters"), kept, self.shards, self.least)


def shards_for(spark: SparkSession) -> int:
    """Four shards for each shuffle partition, so that a filter stays a small share of a task."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def drops(lines: DataFrame, refs: DataFrame) -> DataFrame:
    """(did, tie, gone): for each row of `keyed` documents that loses lines, their numbers. A line goes if its key stands in two
    documents or more and it isn't in the smallest."""
    shared = refs.where("docs >= 2").select("h1", "h2", "owner", "docs")
    hit = joined_skewed(lines, shared, ["h1", "h2"], "docs").where("did <> owner")
    return hit.groupBy("did", "tie").agg(F.collect_set("line").alias("gone"))  # bounded by the lines of one text


def dedup(docs: DataFrame, least: int = 10, refs: DataFrame | None = None, names: tuple[str, str] = ("n_lines", "n_dropped"), spare: float = 1.0) -> DataFrame:
    """docs with text deduplicated by line, and the number of its lines and of those dropped in columns of these names (replacing
    columns that have them); all rows and other columns stay.

    refs: the reference counts of an index that holds docs; by default those of docs, of which one half by hash is inserted into an
    empty index, and then the other, whose lines are asked for in the filters of the first. spare: rows that would lose more than
    this share of their code points lose nothing (they are copies rather than texts with repeated lines).

    Null and empty texts are one empty line, and keep their text. Rows that share an id are one document (a null id too: one
    document after all others); each loses the lines that a smaller document holds. Ids must be integers or cast to long. An empty
    table gives an empty result.
    """
    lines = settled(keyed(docs, least), "lines")
    if refs is None:
        index = LineIndex.empty(docs.sparkSession, shards_for(docs.sparkSession), least)
        for part in (0, 1):
            index = index.insert_lines(lines.where(F.pmod(F.xxhash64(F.lit("part"), "did"), F.lit(2)) == part))
        refs = index.refs
    rest = docs.drop(*names)
    did, tie, gone = unused(rest, "did", "tie", "gone")
    lost = settled(drops(lines, refs), "drops").withColumnsRenamed({"did": did, "tie": tie, "gone": gone})
    mine = number(docs)
    both = rest.withColumns({did: mine[0], tie: mine[1]}).join(lost, [did, tie], "left").select(*rest.columns, gone)
    at = rest.columns.index("text")

    def run(batches):
        for b in batches:
            out, total, fewer = [], [], []
            for text, numbers in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                total.append(len(lines))
                kept = [x for i, x in enumerate(lines) if i not in numbers] if (numbers := set(numbers or ())) else lines
                if numbers and sum(len(lines[i]) for i in numbers) > spare * len(text):
                    numbers, kept = (), lines
                fewer.append(len(lines) - len(kept))
                out.append("\n".join(kept) if numbers else text)
            columns = [*b.columns[:-1]]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(fewer, pa.int64())], [*b.schema.names[:-1], *names])

    from pyspark.sql.types import LongType, StructType

    return mapped(both, run, StructType([*rest.schema.fields]).add(names[0], LongType()).add(names[1], LongType()))


def op4(docs: DataFrame) -> DataFrame:
    """The digest of `dedup` over all documents."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, i, raw, translate(trim(raw, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS raw, generate_subscripts(string_split(coalesce(text, ''), E'\n'), 1) AS i FROM documents)
), s AS (
  SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), m AS (SELECT l.doc_id, i, raw, (s.owner IS NOT NULL AND s.owner <> l.doc_id) AS gone FROM l LEFT JOIN s USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(raw, E'\n' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
