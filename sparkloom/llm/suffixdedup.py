"""Suffix-array dedup: byte strings of LENGTH that start earlier elsewhere are removed.

The suffix arrays are built over what can repeat at all, in blocks that any executor holds:

1. Every LENGTH-byte string is named by its minimiser, the least hash of its GRAM-byte substrings, so equal strings have equal
   names. Neighbouring strings of one name are a run; a run's segment is the bytes that they cover.
2. Runs are combined within each map task, then by name: names of one run only can't repeat. Equal segments of a name are one
   (their earliest occurrence; the later ones are covered whole), so a passage in a third of all documents is a row for each task.
3. Names with different segments are settled by suffix arrays over their segments, some MB at a time: two-stage sorting
   directly sorts the suffixes smaller than their successors and induces the rest by bucket scans; adjacent common
   prefixes of LENGTH or more make groups of equal strings, of which the earliest stays.
4. The covered ranges meet their documents.

Names of more than CROWD different segments (a common phrase in ever new surroundings) would make one large array; they are found on
a sample of the documents and kept as a bitmap of fixed size, and each string of a name whose bit is set is then named by its own
two hashes instead, which spreads them. Sample and bitmap only route: the result is the same either way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_table, mix64, settled, text_bytes

LENGTH, GRAM = 100, 24
#: Bytes of text whose runs are combined at a time, of segments in one suffix array, and of text that is hashed at a time.
COMBINE, ARRAY, BLOCK = 12 << 20, 1 << 19, 1 << 18
#: Names of more different segments than this are spread. SAMPLE: one document of so many is counted. BITS: the bitmap has 2 ** BITS.
CROWD, SAMPLE, BITS = 20_000, 64, 27
LAST = (1 << 63) - 1
BYTES = byte_table(41)
BASE, BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
RUN = np.dtype([("name", "<u8"), ("seg", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("at", "<i8"), ("more", "<i8"), ("multi", "<i8")])


def rolled(value: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the `width` values from each place, by doubling: those of 1, 2, 4 ... values are combined to width."""
    out, have, part, size = None, 0, value, 1
    left = width
    while left:
        if left & 1:
            if out is None:
                out, have = part, size
            else:
                n = len(value) - have - size + 1
                out = mix_pair(out[: max(n, 0)], part[have : have + max(n, 0)])
                have += size
        left >>= 1
        if left:
            n = max(len(value) - 2 * size + 1, 0)
            part, size = mix_pair(part[:n], part[size : size + n]), 2 * size
    return out


def mix_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * BASE + (b ^ (b >> np.uint64(31)))
    return (x ^ (x >> np.uint64(29))) * BASE2


def least_of(value: np.ndarray, width: int) -> np.ndarray:
    """The least of the `width` values from each place."""
    size = 1
    while 2 * size <= width:
        value = np.minimum(value[:-size], value[size:])
        size *= 2
    rest = width - size
    return np.minimum(value[: len(value) - rest], value[rest:]) if rest else value


def runs_of(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, ties: np.ndarray, spread: np.ndarray | None) -> np.ndarray:
    """The RUNs of a block of rows. more: strings in the run besides the first; multi: whether its name stands in it twice."""
    if len(data) < LENGTH:
        return np.zeros(0, RUN)
    grams = rolled(BYTES[data], GRAM)
    low = least_of(grams, LENGTH - GRAM + 1)
    starts = np.arange(len(low))
    row = np.searchsorted(offsets, starts, side="right") - 1
    inside = starts + LENGTH <= offsets[row + 1]  # no string crosses documents
    first = inside.copy()
    first[1:] &= (low[1:] != low[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    again = np.zeros(len(low), bool)
    again[:-1] = (grams[: len(low) - 1] == low[:-1]) & (low[1:] == low[:-1]) & inside[1:] & (row[1:] == row[:-1])
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, RUN)
    # a run ends before the next one, or where its document's last string is
    after = np.append(begin[1:], len(low))
    end = np.minimum(after, offsets[row[begin] + 1] - LENGTH + 1)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(again)])
    out = np.zeros(len(begin), RUN)
    out["name"], out["doc"], out["tie"] = low[begin], docs[row[begin]], ties[row[begin]]
    out["at"], out["more"] = begin - offsets[row[begin]], end - begin - 1
    out["multi"] = prefix[end] > prefix[begin]
    # a segment's hash, from prefix sums of its bytes' values times powers
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), BASE)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), np.uint64(pow(int(BASE), -1, 1 << 64)))]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(BYTES[data]) * up[:-1], dtype=np.uint64)])

    def hashed(a, b):
        return mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))

    out["seg"] = hashed(begin, end + LENGTH - 1)
    if spread is not None:
        bit = (out["name"] >> np.uint64(8)) & np.uint64((1 << BITS) - 1)
        crowd = (spread[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
        if crowd.any():
            few, n = out[crowd], out["more"][crowd] + 1
            own = np.repeat(few, n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            where = np.repeat(begin[crowd], n) + step
            own["at"] += step
            own["more"] = own["multi"] = 0
            own["seg"] = hashed(where, where + LENGTH)
            own["name"] = mix64(rolled(BYTES[data], LENGTH)[where] ^ np.uint64(0xA5A5A5A5))
            out = np.concatenate([out[~crowd], own])
    return out


def combined(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest run of each name and segment, and the others, whose strings are all covered."""
    runs = runs[np.lexsort((runs["at"], runs["tie"], runs["doc"], runs["seg"], runs["name"]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs["name"][1:] != runs["name"][:-1]) | (runs["seg"][1:] != runs["seg"][:-1])
    head = runs[np.maximum.accumulate(np.where(new, np.arange(len(runs)), 0))] if len(runs) else runs
    later = (runs["doc"] != head["doc"]) | (runs["tie"] != head["tie"]) | (runs["at"] != head["at"])
    return runs[new], runs[later]


def pack(runs: np.ndarray) -> bytes:
    """Columns one after another, compressed."""
    raw = b"".join(np.ascontiguousarray(runs[k]).tobytes() for k in RUN.names)
    return len(runs).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    out = np.zeros(n, RUN)
    raw = pa.Codec("zstd").decompress(blob[8:], n * RUN.itemsize, asbytes=True)
    for k, name in enumerate(RUN.names):
        out[name] = np.frombuffer(raw, "<u8" if k < 2 else "<i8", n, 8 * n * k)
    return out


# two-stage suffix sorting


def by_first_bytes(padded: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """places in order of the `depth` bytes from each: by eight bytes at a time, those that are still equal by the next eight."""
    words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    key = words[places].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    edge = np.append(True, key[1:] != key[:-1])
    for k in range(8, depth, 8):
        tied = np.flatnonzero(~edge | ~np.append(edge[1:], True))
        if not len(tied):
            break
        group, key = np.cumsum(edge)[tied], words[places[tied] + k].astype(np.uint64)
        order = np.lexsort((key, group))
        places[tied], key = places[tied][order], key[order]
        edge[tied[1:]] |= key[1:] != key[:-1]
    return places


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The suffixes of text (uint8) in order of their first `depth` bytes at least (more, for induced ones).

    Stage one sorts the suffixes smaller than their successors. Stage two goes through the buckets of first bytes upwards: each
    suffix in order puts the one that begins a byte earlier, if that is the larger, next in its own bucket, before the
    bucket's sorted ones.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # the next place where the byte changes decides; at the end the suffix is larger than the empty one
    change = np.flatnonzero(text[1:] != text[:-1])
    following = np.searchsorted(change, np.arange(n))
    smaller = np.zeros(n, bool)
    has = following < len(change)
    at = change[following[has]]
    smaller[has] = text[at] < text[at + 1]
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    direct = np.flatnonzero(smaller)
    if len(direct):
        direct = by_first_bytes(padded, direct, depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))  # the successor of the last suffix is the empty one, the least of all
    out = []
    for c in range(256):
        bucket = []
        if waiting[c]:
            step = np.concatenate(waiting[c])
            while len(step):
                bucket.append(step)
                step = step[step > 0] - 1
                step = step[text[step] == c]
        sorted_ones = direct[bounds[c] : bounds[c + 1]]
        if not bucket and not len(sorted_ones):
            continue
        whole = np.concatenate([*bucket, sorted_ones])
        out.append(whole)
        before = whole[whole > 0] - 1
        byte = text[before]
        before, byte = before[byte > c], byte[byte > c]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cuts = np.flatnonzero(byte[1:] != byte[:-1]) + 1
        for part, first in zip(np.split(before, cuts), byte[np.concatenate([[0], cuts])] if len(byte) else [], strict=False):
            waiting[first].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, suffixes: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The common prefix of each suffix with the one before it (0 for the first), counted up to `depth`."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    out = np.zeros(len(suffixes), np.int64)
    live = np.arange(1, len(suffixes))
    for k in range(0, depth, 8):
        diff = words[suffixes[live] + k] ^ words[suffixes[live - 1] + k]
        apart = diff != 0
        lowest = diff[apart] & (~diff[apart] + np.uint64(1))
        out[live[apart]] = k + np.floor(np.log2(lowest.astype(np.float64))).astype(np.int64) // 8
        live = live[~apart]
    out[live] = depth
    room = len(text) - suffixes
    out[1:] = np.minimum(out[1:], np.minimum(room[1:], room[:-1]))
    return np.minimum(out, depth)


def repeats(segments: list[bytes], docs: np.ndarray, ties: np.ndarray, ats: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, tie, begin, end) of the ranges covered by strings of LENGTH that stand earlier in the segments."""
    text = np.frombuffer(b"".join(segments), np.uint8)
    size = np.array([len(s) for s in segments])
    begin = np.cumsum(size) - size
    order = suffix_array(text)
    own = np.searchsorted(begin, order, side="right") - 1
    whole = order - begin[own] + LENGTH <= size[own]  # strings inside their segment
    order, own = order[whole], own[whole]
    group = np.cumsum(common_prefixes(text, order) < LENGTH)
    doc, tie, at = docs[own], ties[own], ats[own] + order - begin[own]
    rank = np.lexsort((at, tie, doc, group))
    group, doc, tie, at = group[rank], doc[rank], tie[rank], at[rank]
    head = np.zeros(len(group), np.int64)
    head[1:] = np.where(group[1:] != group[:-1], np.arange(1, len(group)), 0)
    head = np.maximum.accumulate(head)
    later = (doc != doc[head]) | (tie != tie[head]) | (at != at[head])
    doc, tie, at = doc[later], tie[later], at[later]
    rank = np.lexsort((at, tie, doc))
    doc, tie, at = doc[rank], tie[rank], at[rank]
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (at[1:] > at[:-1] + LENGTH)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return doc[first], tie[first], at[first], at[last] + LENGTH


# the stages

FOUND = "kind int, doc long, tie long, name long, at long, upto long"


def _found(kind: int, doc, tie, name, at, upto) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(doc), kind, np.int32)), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (doc, tie, name, at, upto))]
    return pa.RecordBatch.from_arrays(columns, ["kind", "doc", "tie", "name", "at", "upto"])


def packed_runs(docs: DataFrame, buckets: int, spread=None) -> DataFrame:
    """(bucket, kind, blob) from docs (doc, tie, text): RUNs that may be the earliest (kind 0), and those that aren't (kind 1)."""
    shift = np.uint64(max(0, 64 - int(np.ceil(np.log2(buckets))))) if buckets > 1 else None

    def run(batches):
        held, size = [], 0

        def flush():
            first, later = combined(np.concatenate(held))
            rows = []
            for kind, part in ((0, first), (1, later)):
                bucket = (mix64(part["name"]) >> shift).astype(np.int64) % buckets if shift is not None else np.zeros(len(part), np.int64)
                order = np.argsort(bucket, kind="stable")
                part, bucket = part[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                rows += [(int(b[0]), kind, pack(p)) for p, b in zip(np.split(part, cuts), np.split(bucket, cuts), strict=True) if len(p)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "blob"])

        for b in batches:
            doc, tie = (np.asarray(b.column(k)) for k in (0, 1))
            data, offsets = text_bytes(b.column(2))
            for i, j in blocks(offsets, BLOCK):
                held.append(runs_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], doc[i:j], tie[i:j], spread.value if spread is not None else None))
                size += int(offsets[j] - offsets[i])
                if size >= COMBINE:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("doc", "tie", "text").mapInArrow(run, "bucket int, kind int, blob binary")


def by_name(packed: DataFrame) -> DataFrame:
    """FOUND rows: kind 0 segments to compare (at to upto), kind 1 ranges that are covered."""

    def solve(first: list[bytes], later: list[bytes]):
        if later:
            gone = np.concatenate([unpack(x) for x in later])
            yield _found(1, gone["doc"], gone["tie"], gone["name"], gone["at"], gone["at"] + gone["more"] + LENGTH)
        if not first:
            return
        runs, gone = combined(np.concatenate([unpack(x) for x in first]))
        if len(gone):
            yield _found(1, gone["doc"], gone["tie"], gone["name"], gone["at"], gone["at"] + gone["more"] + LENGTH)
        new = np.ones(len(runs), bool)
        new[1:] = runs["name"][1:] != runs["name"][:-1]
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(runs)))
        ask = (np.repeat(count, count) > 1) | (np.repeat(np.maximum.reduceat(runs["multi"], start), count) > 0)
        runs = runs[ask]
        if len(runs):
            yield _found(0, runs["doc"], runs["tie"], runs["name"], runs["at"], runs["at"] + runs["more"] + LENGTH)

    def run(batches):
        now, parts = None, ([], [])
        for b in batches:
            for bucket, kind, blob in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket != now:
                    if now is not None:
                        yield from solve(*parts)
                    now, parts = bucket, ([], [])
                parts[kind].append(blob)
        if now is not None:
            yield from solve(*parts)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, FOUND)


def crowds(docs: DataFrame) -> np.ndarray:
    """The bitmap of the names to spread: those whose different segments, counted on a sample of the documents, are over the limit."""

    def run(batches):
        for b in batches:
            doc, tie = (np.asarray(b.column(k)) for k in (0, 1))
            data, offsets = text_bytes(b.column(2))
            for i, j in blocks(offsets, BLOCK):
                runs = runs_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], doc[i:j], tie[i:j], None)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(runs[k]).view(np.int64)) for k in ("name", "seg")], ["name", "seg"])

    sample = docs.where(F.pmod(F.xxhash64(F.lit("crowd"), "doc", "tie"), F.lit(SAMPLE)) == 0)
    pairs = sample.select("doc", "tie", "text").mapInArrow(run, "name long, seg long")
    counts = pairs.groupBy("name", "seg").agg(F.count(F.lit(1)).alias("n")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    bit = F.shiftright("name", 8).bitwiseAND(F.lit((1 << BITS) - 1))
    marks = counts.where(F.col("n") > CROWD / SAMPLE).select(bit.alias("bit"))
    parts = marks.groupBy(F.shiftright("bit", 16).alias("part")).agg(F.collect_set(F.col("bit").bitwiseAND(F.lit(0xFFFF)).cast("int")).alias("low"))

    def drawn(batches):
        for b in batches:
            maps = []
            for low in b.column(1).to_pylist():
                part = np.zeros(1 << 16, np.uint8)
                part[low] = 1
                maps.append(np.packbits(part, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(maps, pa.binary())], ["part", "bits"])

    out = np.zeros(1 << (BITS - 3), np.uint8)
    for part, bits in parts.mapInArrow(drawn, "part long, bits binary").collect():  # 2 ** BITS bits at most
        out[part << 13 : (part + 1) << 13] = np.frombuffer(bits, np.uint8)
    return out


def zipped(docs: DataFrame) -> DataFrame:
    """(doc, tie, size, z): the texts' bytes, compressed for the shuffle."""

    def run(batches):
        codec = pa.Codec("zstd", 1)
        for b in batches:
            data, offsets = text_bytes(b.column(2))
            z = [codec.compress(data[i:j].tobytes(), asbytes=True) if j > i else b"" for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(offsets)), pa.array(z, pa.binary())], ["doc", "tie", "size", "z"])

    return docs.select("doc", "tie", "text").mapInArrow(run, "doc long, tie long, size long, z binary")


def unzipped(z: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(z, size, asbytes=True) if size else b""


def by_suffixes(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, tie, at, upto): the covered ranges that suffix arrays over the segments of `found` give."""

    def cut(batches):
        for b in batches:
            doc, tie, size = (np.asarray(b.column(k)) for k in range(3))
            ends, name, at, upto = listed(b.column(4), "name", "at", "upto")
            which = np.repeat(np.arange(b.num_rows), np.diff(ends))
            pieces, text, last = [], b"", -1
            begin = 0
            for k, row in enumerate(which):
                if row != last:
                    text, last = unzipped(b.column(3)[int(row)].as_py(), int(size[row])), row
                pieces.append(text[at[k] : upto[k]])
                if len(pieces) == 10_000 or k + 1 == len(which):
                    own = slice(begin, k + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (name[own], doc[which[own]], tie[which[own]], at[own])] + [pa.array(pieces, pa.binary())], ["name", "doc", "tie", "at", "segment"])
                    pieces, begin = [], k + 1

    def sort(batches):
        held, size, last = [], 0, None
        for b in batches:
            name = np.asarray(b.column(0))
            cuts = [0, *(np.flatnonzero(np.diff(name)) + 1), b.num_rows] if b.num_rows else []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if size >= ARRAY and name[i] != last:  # only between names
                    yield _ranges(held)
                    held, size = [], 0
                part = b.slice(i, j - i)
                held.append(part)
                offsets = text_bytes(part.column(4))[1]
                size, last = size + int(offsets[-1]), name[i]
        if held:
            yield _ranges(held)

    def _ranges(parts):
        whole = pa.Table.from_batches(parts)
        doc, tie, at = (np.asarray(whole.column(k)) for k in (1, 2, 3))
        out = repeats(whole.column(4).to_pylist(), doc, tie, at)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["doc", "tie", "at", "upto"])

    asked = found.where("kind = 0").groupBy("doc", "tie").agg(F.collect_list(F.struct("name", "at", "upto")).alias("parts"))  # of one document
    rows = texts.hint("merge").join(asked, ["doc", "tie"]).select("doc", "tie", "size", "z", "parts").mapInArrow(cut, "name long, doc long, tie long, at long, segment binary")
    return rows.repartition("name").sortWithinPartitions("name").mapInArrow(sort, "doc long, tie long, at long, upto long")


def listed(column: pa.Array, *names: str) -> list[np.ndarray]:
    """Where each row's list begins (one more at the end), and the fields of all its structs, of a column of lists; null lists are empty."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    return [np.concatenate([[0], np.cumsum(lengths)]), *(np.asarray(flat.field(n)) for n in names)]


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, kept) for each row of docs (doc_id integer, text): the removed runs as array of struct(begin, end) in bytes, and
    the bytes that are left.

    Earlier means: a smaller document, or the same and an earlier start. Null texts are empty; null ids come after all others. Rows that
    share an id are documents in order of a hash of their text; rows equal in both are one document, and each gets its result.
    Texts shorter than LENGTH bytes are kept whole. Other columns of docs are left out, whatever their names; ids must be integers or
    cast to long. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.col("doc_id").isNull().alias("none"), F.coalesce("text", F.lit("")).alias("text"))
    repeated = not ids.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    ids = ids.withColumn("tie", F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = spark.sparkContext.broadcast(crowds(ids))
    found = settled(by_name(packed_runs(ids, buckets, spread)), "runs")
    texts = zipped(ids.select("doc", "tie", "text"))
    ranges = found.where("kind = 1").select("doc", "tie", "at", "upto").union(by_suffixes(found, texts))
    parts = ranges.groupBy("doc", "tie").agg(F.collect_list(F.struct("at", "upto")).alias("parts"))  # of one document

    def cut(batches):
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                ends, at, upto = listed(b.column(4), "at", "upto")
                kept, counts, begins, stops = [], [0], [], []
                for k, (size, z) in enumerate(zip(np.asarray(b.column(2)).tolist(), b.column(3), strict=True)):
                    lo, hi = at[ends[k] : ends[k + 1]], upto[ends[k] : ends[k + 1]]
                    text = unzipped(z.as_py(), size)
                    if len(lo):
                        order = np.argsort(lo, kind="stable")
                        lo, hi = lo[order], np.maximum.accumulate(hi[order])
                        first = np.append(True, lo[1:] > hi[:-1])
                        lo, hi = lo[first], hi[np.append(first[1:], True)]
                        edges = [0, *np.stack([lo, hi], axis=1).ravel().tolist(), size]
                        text = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                        begins.append(lo)
                        stops.append(hi)
                    counts.append(counts[-1] + len(lo))
                    kept.append(text)
                none = [np.zeros(0, np.int64)]
                spans = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays([pa.array(np.concatenate(x or none)) for x in (begins, stops)], ["begin", "end"]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), spans.cast(kind), pa.array(kept, pa.binary())], ["doc", "size", "spans", "kept"])

    rows = texts.hint("merge").join(parts, ["doc", "tie"], "left").select("doc", "tie", "size", "z", "parts")
    rows = rows.mapInArrow(cut, "doc long, size long, spans array<struct<begin:long,end:long>>, kept binary")
    nulls = not docs.where("doc_id is null").select("doc_id").isEmpty()
    number = F.when(F.col("doc") != LAST, F.col("doc")) if nulls else F.col("doc")
    return rows.select(number.alias("doc_id"), "size", "spans", "kept")


def op1(docs: DataFrame) -> DataFrame:
    """The digest of `covered` over all documents."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["begin"])
    return covered(docs).select("doc_id", F.col("size").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
