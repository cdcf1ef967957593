"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases as in LZ78: each phrase is the shortest that is not yet in the dictionary. The phrases
cut the text into consecutive pieces; the set of pieces is hashed, and the least hash under each of SIZE permutations makes the
signature. Texts that compress to like dictionaries share phrases, and so minima: the likeness is the share of equal minima.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

SIZE = 64
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: The permutations: x -> x * A + B on 64 bits, of which the upper 32 count.
A = mix64(np.arange(1, SIZE + 1, dtype=np.uint64)) | np.uint64(1)
B = mix64(np.arange(1001, SIZE + 1001, dtype=np.uint64))
EMPTY = np.full(SIZE, 0xFFFFFFFF, np.uint32)


def parse(text: str, state: tuple[dict, int] | None = None) -> tuple[list[int], tuple[dict, int]]:
    """The ends of the phrases that end within text, and the parser's state after it: its dictionary and the node it stands at.

    A node and a character lead to a node; node 0 is the empty phrase. Parsing the rest of a text from the state goes on as if
    it had been parsed at once.
    """
    steps, node = state or ({}, 0)
    get, ends, fresh = steps.get, [], len(steps) + 1
    for i, c in enumerate(text):
        key = (node, c)
        nxt = get(key)
        if nxt is None:
            steps[key] = fresh
            fresh += 1
            ends.append(i + 1)
            node = 0
        else:
            node = nxt
    return ends, (steps, node)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE's powers up to n and those of its inverse modulo 2 ** 64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n + 1, BASE), np.full(n + 1, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Powers:
    def __init__(self):
        self.up, self.down = powers(1 << 12)

    def __call__(self, n: int):
        if n >= len(self.up):
            self.up, self.down = powers(2 * n)
        return self.up, self.down


def signature(text: str, ends: list[int], grown: Powers) -> np.ndarray:
    """The minima over the hashes of the pieces that `ends` cuts text into (a last open piece included)."""
    if not text:
        return EMPTY.copy()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    stops = np.array(ends if ends and ends[-1] == len(text) else [*ends, len(text)], np.int64)
    starts = np.concatenate([[0], stops[:-1]])
    up, down = grown(len(text))
    run = np.concatenate([[np.uint64(0)], np.cumsum(mix64(codes) * up[: len(codes)], dtype=np.uint64)])
    pieces = np.unique(mix64((run[stops] - run[starts]) * down[starts]))
    out = EMPTY.copy()
    for k in range(0, len(pieces), 4096):
        part = (pieces[k : k + 4096, None] * A[None, :] + B[None, :]) >> np.uint64(32)
        out = np.minimum(out, part.min(axis=0).astype(np.uint32))
    return out


def fingerprint(text: str) -> str:
    """The signature of a whole text, as base64."""
    return encoded(signature(text, parse(text)[0], Powers()))


def encoded(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype("<u4").tobytes()).decode()


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    return float((one == two).mean())


def similarity(one: str, two: str) -> float:
    """The likeness of two fingerprints."""
    return likeness(*(np.frombuffer(base64.b64decode(x), "<u4") for x in (one, two)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with a `fingerprint` column (replacing one of that name); a null text counts as empty, empty texts share one fingerprint."""
    rest = docs.drop("fingerprint")
    at = rest.columns.index("text")

    def run(batches):
        grown = Powers()
        for b in batches:
            out = [encoded(signature(t or "", parse(t or "")[0], grown)) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "fingerprint"])

    from pyspark.sql.types import StringType, StructType

    return rest.mapInArrow(run, StructType([*rest.schema.fields]).add("fingerprint", StringType()))


def looked_up(values: list[int | None], at, none: int = -(1 << 62)):
    """Element `at` of a list, which stands in the plan as one constant."""
    text = ",".join(str(none if v is None else v) for v in values)
    found = F.get(F.split(F.lit(text), ",").cast("array<long>"), at)
    return F.when(found != none, found)


def above(bounds: list[int], value, equal: bool = False):
    """How many of bounds (downwards) are greater than value, or as great: by binary search."""
    listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))

    def step(have, size):
        b = F.get(listed, have + size - 1)
        return F.when((have + size <= len(bounds)) & ((b >= value) if equal else (b > value)), have + size).otherwise(have)

    return F.aggregate(steps, F.lit(0), step) if bounds else F.lit(0)


def neighbours(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) dealt out in ranges of (doc_id, hash of text), each sorted downwards and followed by the first row of the next.

    Columns: part, doc_id, text, own (false for such a following row). Rows of one id go by a hash of their text, then by text; null ids
    come last; the last range is followed by the first row of all. The bounds are quantiles of the ids, four for each shuffle
    partition, and an id (or the null ids) that fills several ranges is cut by the hash; rows go to ranges by comparison, so a
    retried task meets the same ranges. Only first rows travel twice.
    """
    spark = docs.sparkSession
    wanted = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = 4 * wanted  # several for each partition, as they are dealt by hash
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    shares = [k / ranges for k in range(1, ranges)]
    found = ids.where("doc_id is not null").select("doc_id").approxQuantile("doc_id", shares, 0.2 / ranges)
    bounds = [int(b) for b in sorted(found, reverse=True)]  # downwards: an id's first range is the number of bounds above it
    nulls, every = ids.agg(F.count(F.when(F.col("doc_id").isNull(), 1)), F.count(F.lit(1))).first()
    spare = max(1, -(-nulls * ranges // max(1, every)))
    unit = F.shiftrightunsigned("mark", 11) / float(1 << 53)
    first = above(bounds, F.col("doc_id"))
    part = F.when(F.col("doc_id").isNull(), len(bounds) + 1 + F.floor(unit * spare)).otherwise(first + F.floor(unit * (above(bounds, F.col("doc_id"), True) - first + 1)))
    dealt = ids.withColumn("part", part.cast("int"))
    order = F.struct(F.col("doc_id"), F.bitwise_not(F.shiftrightunsigned("mark", 1)).alias("low"), F.bitwise_not("mark").alias("mark"))
    tops = {r["part"]: r["top"] for r in dealt.groupBy("part").agg(F.max(order).alias("top")).collect()}  # a row for each range
    full = sorted(tops)
    if not full:
        return dealt.select("part", "doc_id", "text", F.lit(True).alias("own"))
    before = {full[k]: full[k - 1] for k in range(len(full))}  # the first range follows the last
    span = range(full[-1] + 1)
    top = looked_up([tops[k]["doc_id"] if k in tops else None for k in span], F.col("part"))
    mark = looked_up([~tops[k]["mark"] if k in tops else None for k in span], F.col("part"))
    extra = F.when(F.col("doc_id").eqNullSafe(top) & (F.col("mark") == mark), looked_up([before.get(k) for k in span], F.col("part")).cast("int"))
    copies = F.when(extra.isNull(), F.array(F.struct(F.col("part").alias("part"), F.lit(True).alias("own")))).otherwise(
        F.array(F.struct(F.col("part").alias("part"), F.lit(True).alias("own")), F.struct(extra.alias("part"), F.lit(False).alias("own")))
    )
    rows = dealt.withColumn("to", F.explode(copies)).select(F.col("to.part").alias("part"), "doc_id", "mark", "text", F.col("to.own").alias("own"))
    rows = rows.repartition(wanted, "part").sortWithinPartitions("part", F.desc("own"), F.desc_nulls_last("doc_id"), F.shiftrightunsigned("mark", 1), "mark", "text")
    return rows.select("part", "doc_id", "text", "own")


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as many first code points of `following`, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def op3(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document's.

    A null text is empty; the next document of a single row is itself; rows of one id follow each other in order of a hash of their
    text, then of the text. Other columns of docs are left out, whatever their names; ids must be integers or cast to long. Texts
    are parsed whole, in memory in proportion to the longest. An empty table gives an empty result.
    """

    def run(batches):
        grown = Powers()

        def answer(held, following, next_sig):
            doc_id, text, ends, sig, state, keep = held
            new = edited(text, following)
            more, _ = parse(new[keep:], state)
            cut = [e for e in ends if e <= keep]
            new_sig = signature(new, [*cut, *(e + keep for e in more)], grown)
            return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), encoded(sig), encoded(new_sig), likeness(sig, new_sig), likeness(sig, next_sig)

        def read(doc_id, text):
            keep = len(text) - len(text) // 2
            ends, state = parse(text[:keep])
            halfway = (dict(state[0]), state[1])  # the edited text goes on from here
            more, _ = parse(text[keep:], state)
            ends += [e + keep for e in more]
            return doc_id, text, ends, signature(text, ends, grown), halfway, keep

        held = part = None
        for b in batches:
            out = []
            for p, doc_id, text, own in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if p != part:
                    held, part = None, p  # the range before ended with its following row
                if own:
                    now = read(doc_id, text)
                    if held:
                        out.append(answer(held, text, now[3]))
                    held = now
                elif held:
                    out.append(answer(held, text, signature(text, parse(text)[0], grown)))
                    held = None  # of several tied following rows the first counts
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 7, KINDS, strict=True)],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return neighbours(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
