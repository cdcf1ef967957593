"""What a Python worker holds: bounded batches, bounded work on a task's keys, and memory that goes back to the system."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, ngramjoin
from sparkloom.llm.common import BATCH, BATCH_BYTES, mapped
from sparkloom.llm.forest import Edges, spread


def test_batches_are_bounded_by_bytes_and_lose_no_row(spark):
    was = spark.conf.get(BATCH_BYTES, None)
    spark.conf.unset(BATCH_BYTES)
    docs = spark.range(0, 9000, 1, 1).select("id", F.expr("repeat('abcdefghij', 300)").alias("text"))  # 27 MB in fewer rows than a batch may have

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "size"])

    try:
        got = mapped(docs, run, "rows long, size long").collect()
        assert sum(r["rows"] for r in got) == 9000
        assert max(r["size"] for r in got) < 1.1 * BATCH
        spark.conf.set(BATCH_BYTES, str(1 << 20))  # what the session sets holds
        assert max(r["size"] for r in mapped(docs, run, "rows long, size long").collect()) < 1.1 * (1 << 20)
    finally:
        spark.conf.set(BATCH_BYTES, was) if was else spark.conf.unset(BATCH_BYTES)


def test_workers_give_back_what_a_task_has_freed(spark):
    def look(grow):
        def run(batches):
            import os
            import sys

            list(batches)
            if grow:
                held, sys.pins = [], []
                for _ in range(3000):  # 150 MB, between allocations that stay: freeing alone leaves them in the heap
                    held.append(np.ones(6250))
                    sys.pins.append(np.ones(250))
                del held
            with open("/proc/self/statm") as f:
                yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([int(f.read().split()[1]) * 4096])], ["pid", "size"])

        return mapped(spark.range(0, 1, 1, 1), run, "pid long, size long").collect()[0]

    grown = look(True)
    after = next(x for x in (look(False) for _ in range(20)) if x["pid"] == grown["pid"])  # the session's workers may take turns
    assert after["size"] < grown["size"] - (100 << 20)


def test_a_tasks_keys_are_dealt_bucket_by_bucket(monkeypatch):
    monkeypatch.setattr(ngramjoin, "TIE", 5)
    rng = np.random.default_rng(4)
    keys, owners = rng.integers(0, 400, 4000), rng.integers(-60, 60, 4000)
    ties = Edges()
    got, last = {}, set()
    for bucket, kind, n, blob in ngramjoin.packed_keys(keys, owners, 7, ties):
        assert kind == 0 and bucket not in last
        last.add(bucket)
        k, o = spread(blob, n)
        assert sorted(zip(k.tolist(), o.tolist(), strict=True)) == list(zip(k.tolist(), o.tolist(), strict=True))
        for a, b in zip(k.tolist(), o.tolist(), strict=True):
            got.setdefault(a, []).append(b)
    wanted = {k: sorted(set(owners[keys == k].tolist())) for k in set(keys.tolist())}
    assert got == {k: v[:5] for k, v in wanted.items()}
    tied = set(zip(*(np.concatenate([p[k] for p in ties.parts]).tolist() for k in (0, 1)), strict=True))
    assert tied == {(o, v[0]) for v in wanted.values() for o in v[5:]}


def test_a_million_keys_take_little_more_than_their_own_size():
    rng = np.random.default_rng(5)
    keys, owners = rng.integers(-(1 << 62), 1 << 62, ngramjoin.COMBINE), rng.integers(0, 3000, ngramjoin.COMBINE)
    tracemalloc.start()
    n = sum(len(blob) > 0 for *_, blob in ngramjoin.packed_keys(keys, owners, 100, Edges()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.start()
    ngramjoin.distinct(keys, owners)  # all at once, as it was
    at_once = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 100
    assert peak < 45e6 < at_once, (peak, at_once)


def test_a_task_of_batches_with_and_without_hits(spark):
    item = " ".join(f"w{k}" for k in range(40))
    rows = [(k, f"{item} and more" if k in (3, 17, 18) else f"other words {k}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, "4")
    try:
        got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontaminate.covered(docs, bench).collect()}
        assert got == {k: [1] if k in (3, 17, 18) else [] for k in range(30)}
        assert decontaminate.clean(docs, bench).count() == 27
    finally:
        spark.conf.set(name, was)
