import itertools
import random
import resource
import time

import pyarrow as pa

from sparkloom.llm import decontaminate
from sparkloom.llm.common import ALNUM, text_bytes, word_hashes


def plain_tiles(item, doc, least):
    """Greedy string tiling by trying all pairs."""
    im, dm, out = set(), set(), []
    while True:
        best = None
        for a, b in itertools.product(range(len(item)), range(len(doc))):
            n = 0
            while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and a + n not in im and b + n not in dm:
                n += 1
            if n >= least and (best is None or (-n, a, b) < best):
                best = (-n, a, b)
        if best is None:
            return sorted(out)
        n, a, b = -best[0], best[1], best[2]
        out.append((a, b, n))
        im.update(range(a, a + n))
        dm.update(range(b, b + n))


def tiled(item, doc, least):
    items = decontaminate.Items([1], [" ".join(item)], least)
    words, starts = word_hashes(*text_bytes(pa.array([" ".join(doc)])), ALNUM)
    return sorted(t for _, _, *match in items.hits(words, starts, 0) for t in decontaminate.tiles(*match, least))


def test_tiles_are_those_of_plain_tiling():
    rng = random.Random(1)
    for k in range(120):
        letters = "abc" if k % 3 else "ab" if k % 2 else "a"
        item = [rng.choice(letters) for _ in range(rng.randint(3, 18))]
        doc = [rng.choice(letters) for _ in range(rng.randint(3, 25))]
        assert tiled(item, doc, 3) == plain_tiles(item, doc, 3)


def test_repetitive_texts_cost_diagonals_only():
    began, before = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert sum(n for *_, n in tiled(["w"] * 4000, ["w"] * 20_000, 5)) == 4000
    assert sum(n for *_, n in tiled(["a", "b"] * 1000, ["b", "a"] * 4000, 5)) == 2000
    assert time.perf_counter() - began < 30
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB; all pairs of places would take GB


def test_query_against_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    items = [(k, text(rng.choice([0, 1, 2, 3, 4, 5, 9, 30]))) for k in range(25)]
    docs = [(k, text(rng.randint(0, 60))) for k in range(40)]
    for k in range(40, 60):
        item, at = rng.choice(items)[1], rng.randrange(3)
        docs.append((k, text(20) + item[at : len(item) // 2 + at] + text(4) + item[len(item) // 2 + at :]))
    want = []
    for d, doc in docs:
        for i, item in items:
            if 0 < len(item) < 5:
                if any(doc[k : k + len(item)] == item for k in range(len(doc) - len(item) + 1)):
                    want.append((d, i, len(item), 1))
            elif item:
                own = plain_tiles(item, doc, 5)
                if sum(t[2] for t in own) >= 0.5 * len(item):
                    want.append((d, i, sum(t[2] for t in own), len(own)))
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(t)) for i, t in rows], f"{key} long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_words, r.n_tiles) for r in decontaminate.op7(frame(docs, "doc_id"), frame(items, "item_id")).collect())
    assert got == sorted(want) and len({n for *_, n in want}) > 1


def test_reordered_passages_and_edge_cases(spark):
    item = " ".join(f"w{k}" for k in range(20))
    turned = " ".join(f"w{k}" for k in [*range(10, 20), *range(10)])
    rows = [(1, f"before {item} after"), (2, f"x {turned.upper()}! y"), (3, "w0 w1 w2 w3 w4 w5 else"), (4, None), (5, ""), (6, "text without any of it: all of it is short"), (6, item)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame([(7, item), (8, "too short"), (10, "all of it"), (None, item), (9, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in decontaminate.op7(docs, bench).collect())
    assert got == [(1, 7, 1.0, 1), (2, 7, 1.0, 2), (6, 7, 1.0, 1), (6, 10, 1.0, 1)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench, block_bytes=8).collect()) == [3, 4, 5]
    assert decontaminate.op7(docs.limit(0), bench).count() == 0
    assert decontaminate.op7(docs, bench.limit(0)).count() == 0
