from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import mixing


def lag(blocks, weights, names=None):
    """The greatest distance of a source (of names) from its share of a phase, in blocks, at any slot; and the blocks served."""
    exact = {k: Fraction(w) for k, w in weights.items()}
    live, phase, worst, served = {}, None, 0, dict.fromkeys(blocks, 0)
    for t, (k, start) in enumerate(mixing.schedule(blocks, weights)):
        if start != phase:
            phase = start
            live = {x: 0 for x in blocks if served[x] < blocks[x]}
            total = sum(exact[x] for x in live)
            share = {x: float(exact[x] / total) for x in live}
        served[k] += 1
        live[k] += 1
        for x in names or live:
            if x in live:
                worst = max(worst, abs(live[x] - (t + 1 - phase) * share[x]))
    return worst, served


def test_no_source_is_a_block_off_its_share():
    for blocks, weights in (
        ({"a": 50}, {"a": 1}),
        ({"a": 500, "b": 300, "c": 200}, {"a": 5, "b": 3, "c": 2}),
        ({"a": 997, "b": 3, "c": 2, "d": 0}, {"a": 997, "b": 1, "c": 2, "d": 9}),
        ({f"s{k}": 40 + k for k in range(20)}, {f"s{k}": (k + 1) ** 0.5 for k in range(20)}),
        ({"big": 2970, **{f"s{k:02d}": 313 for k in range(19)}}, {"big": 190_000**0.5, **{f"s{k:02d}": 20_000**0.5 for k in range(19)}}),
    ):
        worst, served = lag(blocks, weights)
        assert worst < 1 + 1e-9 and served == blocks


def test_exact_weights_do_not_drift():
    for weights in ({"a": Fraction(1, 3), "b": Fraction(2, 3)}, {"a": 1e-5, "b": 1 - 1e-5}, {"a": 1 / 3, "b": 1 / 7, "c": 0.2}):
        total = sum(map(Fraction, weights.values()))
        worst, _ = lag({k: int(400_000 * Fraction(w) / total) + 1 for k, w in weights.items()}, weights)
        assert worst < 1 + 1e-6


def test_many_sources():
    blocks = {f"host{k}": 1 + k % 40 for k in range(2000)}
    assert lag(blocks, {k: n**0.5 for k, n in blocks.items()}, ["host7", "host39"])[1] == blocks


def plain_schedule(blocks, weights):
    """Slot by slot: the released block of the earliest deadline, the weights scaled up when a source ends."""
    out, left, done, start = [], {k: n for k, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0
    while left:
        total = sum(Fraction(weights[k]) for k in left)
        w = {k: Fraction(weights[k]) / total for k in left}
        took, slot = dict.fromkeys(left, 0), 0
        while all(left.values()):
            ready = [(-((took[k] + 1) // -w[k]), k) for k in left if took[k] // w[k] <= slot]
            k = min(ready)[1]
            out.append((k, done[k], start + slot))
            took[k] += 1
            done[k] += 1
            left[k] -= 1
            slot += 1
        start += slot
        left = {k: n for k, n in left.items() if n}
    return sorted(out)


def test_mix_against_plain_schedule(spark, monkeypatch):
    counts = {"a": 95, "b": 33, "c": 7, None: 12}
    rows = [(k * 1000 + i, s, "x") for k, (s, n) in enumerate(counts.items()) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, mix_slot string").repartition(3)
    weights = {"a": 2.0, "b": 3.0, "c": 0.7, mixing.NULL_SOURCE: 1.0}
    for most, size in ((500_000, 4), (30, 5)):  # a table of more blocks than the driver schedules has larger ones
        monkeypatch.setattr(mixing, "MOST_BLOCKS", most)
        out = mixing.mix(docs, weights=weights, block_rows=4, bucket_rows=10)
        got = out.collect()
        assert sorted((r.doc_id, r.source) for r in got) == sorted((r[0], r[1]) for r in rows)
        want = plain_schedule({s or mixing.NULL_SOURCE: -(-n // size) for s, n in counts.items()}, weights)
        assert sorted({(r.source or mixing.NULL_SOURCE, r.mix_block, r.mix_slot) for r in got}) == want
        assert len({r.mix_position for r in got}) == len(rows) and all(r.mix_position // size == r.mix_slot for r in got)
        sizes = out.groupBy("source", "mix_block").count().groupBy("source").agg(F.sum(F.when(F.col("count") < size, 1).otherwise(0)).alias("n"))
        assert all(r.n <= 1 for r in sizes.collect())


def test_rows_without_a_key_are_dealt_like_others(spark):
    docs = spark.range(400).selectExpr("CAST(NULL AS long) AS doc_id", "'s' AS source", "concat('text ', id) AS text", "array(id) AS more")
    got = mixing.mix(docs, block_rows=8, bucket_rows=20).collect()
    assert len({r.mix_position for r in got}) == 400 and max(r.mix_block for r in got) == 49


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, None)], "doc_id long, source string")
    assert mixing.mix(docs).count() == 4
    assert mixing.mix(docs.limit(0)).columns == ["doc_id", "source", "mix_block", "mix_slot", "mix_position"]
    with pytest.raises(KeyError):
        mixing.mix(docs, weights={"a": 1})
    with pytest.raises(ValueError):
        mixing.mix(docs, weights={"a": 1, mixing.NULL_SOURCE: 0})
