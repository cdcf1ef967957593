"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. Block j (from 0) of a source with weight w (its share of the weights' sum) is released at slot
floor(j / w) and due by slot ceil((j + 1) / w); of the released blocks the one with the earliest deadline gets the slot. Then, at
every slot, no source is a whole block away from its share. Weights are taken as they are, in whole numbers of any size.

When a source runs out, the others go on with their weights scaled up, in a new phase, in which shares count from its first slot. The
driver schedules block by block: at most MOST_BLOCKS and one for each source, as a larger table has larger blocks. No row is
dropped or repeated.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .common import unused

#: A null source is a source of its own under this name.
NULL_SOURCE = "\x00null"
#: Blocks that the driver schedules, but for one of each source. A table of over MOST_BLOCKS * block_rows rows has larger blocks.
MOST_BLOCKS = 500_000


def whole(weights: dict[str, float]) -> dict[str, int]:
    """The weights' exact proportions in whole numbers."""
    exact = {k: Fraction(w) for k, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    return {k: int(x * scale) for k, x in exact.items()}


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int]]:
    """(source, first slot of its phase) for each slot: the released block of the earliest deadline, the source first in order at a tie."""
    parts = whole(weights)
    left = {k: n for k, n in sorted(blocks.items()) if n}
    total, start = sum(parts[k] for k in left), 0
    while left:
        slot = 0
        waiting = [(0, k, 0) for k in left]  # release, source, block of the phase; sorted, so a heap
        ready: list[tuple[int, str, int]] = []
        while True:
            while waiting and waiting[0][0] <= slot:
                _, k, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(j + 1) * total // parts[k]), k, j))
            due, k, j = heapq.heappop(ready)
            assert due > slot, "a deadline was missed"
            yield k, start
            slot += 1
            if j + 1 == left[k]:
                break
            heapq.heappush(waiting, ((j + 1) * total // parts[k], k, j + 1))
        for _, other, done in waiting + ready:
            left[other] -= done
        total -= parts[k]
        del left[k]
        start += slot


def mix(
    df: DataFrame,
    source: str = "source",
    key: str = "doc_id",
    weights: dict[str, float] | None = None,
    alpha: float = 0.5,
    block_rows: int = 64,
    bucket_rows: int = 2_000,
) -> DataFrame:
    """df with block, slot and position columns, in which sorting by position gives the mixture.

    weights: target weights by source, for all sources present (KeyError else); by default proportional to rows ** alpha, as
    in temperature sampling. Within a source rows go in the order of a hash of their row, dealt over buckets of about
    bucket_rows, so no source, however large, is sorted in one task. block_rows: the least rows of a block.

    Result columns (replacing columns of these names): mix_block, the source's block; mix_slot, its slot; mix_position =
    mix_slot * rows of a block + place in the block. Null sources are one source; null or repeated keys are placed like others,
    rows equal in all columns in arbitrary order. An empty table gives an empty result.
    """
    made = ("mix_block", "mix_slot", "mix_position")
    df = df.drop(*made)
    s_, b_, p_, o_ = unused(df, "src", "bucket", "place", "start")
    spark = df.sparkSession
    src = F.coalesce(F.col(source).cast("string"), F.lit(NULL_SOURCE))
    totals = {r[0]: r[1] for r in df.groupBy(src.alias("s")).count().collect()}  # a row for each source
    if not totals:
        return df.withColumns({k: F.lit(0).cast("long") for k in made})
    if weights is None:
        weights = {k: float(n) ** alpha for k, n in totals.items()}
    missing = sorted(set(totals) - set(weights))
    if missing:
        raise KeyError(f"no weight for sources {missing}")
    if any(not weights[k] > 0 for k in totals):
        raise ValueError("weights must be above 0")
    buckets = max(1, -(-max(totals.values()) // bucket_rows))
    block_rows = max(block_rows, -(-sum(totals.values()) // MOST_BLOCKS))
    # of all columns that can be hashed, so that rows of one key (or of none) don't meet
    mixed = F.xxhash64(F.lit("mix"), F.col(key), *(F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, AtomicType) and f.name != key))
    dealt = df.withColumns({s_: src, b_: F.pmod(mixed, F.lit(buckets))})
    sizes = dealt.groupBy(s_, b_).agg(F.count(F.lit(1)).alias("n"))
    # a row for each source and bucket; the running sum goes over at most `buckets` rows of a source
    starts = sizes.select(s_, b_, (F.sum("n").over(Window.partitionBy(s_).orderBy(b_)) - F.col("n")).alias(o_))
    place = F.row_number().over(Window.partitionBy(s_, b_).orderBy(mixed, F.col(key))) - 1
    placed = dealt.withColumn(p_, place).join(starts, [s_, b_])
    placed = placed.withColumn(p_, F.col(o_) + F.col(p_))
    placed = placed.withColumn("mix_block", F.floor(F.col(p_) / block_rows).cast("long"))

    order = list(schedule({k: -(-n // block_rows) for k, n in totals.items()}, weights))
    table = pa.table({"src": pa.array([k for k, _ in order], pa.string()), "slot": pa.array(range(len(order)), pa.int64())})
    blocks = F.row_number().over(Window.partitionBy("src").orderBy("slot")) - 1
    slots = spark.createDataFrame(table).select(F.col("src").alias(s_), blocks.cast("long").alias("mix_block"), F.col("slot").alias("mix_slot"))
    out = placed.join(slots, [s_, "mix_block"])
    out = out.withColumn("mix_position", F.col("mix_slot") * block_rows + F.col(p_) % block_rows)
    return out.select(*df.columns, *made)
