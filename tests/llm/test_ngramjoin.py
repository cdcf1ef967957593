import itertools
import random

import numpy as np

from sparkloom.llm import ngramjoin


def plain(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        s = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * s >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def corpus(seed, docs, words):
    """Documents in chains of edits, so that likenesses fall on both sides of the threshold."""
    rng = random.Random(seed)
    rows, now = [], []
    for i in range(docs):
        if not now or rng.random() < 0.15:
            now = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([1, 2, 3, 6, 12, words, words * 3]))]
        else:
            now = list(now)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                k = rng.randrange(len(now))
                now[k : k + rng.choice([0, 1])] = [f"w{rng.randrange(5000)}"] * rng.choice([0, 1]) or [f"v{i}"]
        rows.append((i, " ".join(now)))
    return rows


def test_join_against_brute_force(spark):
    for seed, width, percent, block in ((1, 3, 90, 400), (2, 3, 90, 5), (3, 5, 80, 6), (4, 2, 70, 4)):
        rows = corpus(seed, 150, 60) + [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "oNE")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted(tuple(r) for r in ngramjoin.join(docs, width, percent, block).collect())
        assert got == plain(rows, width, percent)


def test_tree_links_reach_what_all_pairs_reach():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(300):
        if sets and rng.random() < 0.8:
            s = sets[rng.integers(len(sets))].copy()
            s[rng.integers(0, len(s), 4)] = rng.integers(0, 2**63, 4)
            sets.append(np.unique(s))
        else:
            sets.append(np.unique(rng.integers(0, 2**63, rng.integers(5, 80)).astype(np.uint64)))
    forest, plain_forest = (ngramjoin.Forest(np.arange(len(sets))) for _ in range(2))
    tree = ngramjoin.Tree.of(np.arange(len(sets)), sets, 512)
    n = len(list(ngramjoin.link(tree, tree, forest, 80, ngramjoin.alike(sets, 80))))
    for a, b in itertools.combinations(range(len(sets)), 2):
        s = len(np.intersect1d(sets[a], sets[b]))
        if 100 * s >= 80 * (len(sets[a]) + len(sets[b]) - s):
            plain_forest.union(a, b)
    roots = [plain_forest.find(k) for k in range(len(sets))]
    assert [forest.find(k) for k in range(len(sets))] == roots
    assert n == len(sets) - len(set(roots))


def test_exact_tests_agree():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60)).astype(np.uint64)) for _ in range(40)]
    a, b = (m.ravel() for m in np.meshgrid(np.arange(40), np.arange(40)))
    want = [100 * len(set(sets[i]) & set(sets[j])) >= 55 * len(set(sets[i]) | set(sets[j])) for i, j in zip(a, b, strict=True)]
    assert ngramjoin.alike(sets, 55)(a, b).tolist() == ngramjoin.alike(sets, 55, 0)(a, b).tolist() == want


def test_a_star_of_many_blocks(spark):
    """Copies that link with their original alone, and texts that share a passage and link with nothing."""
    rng = random.Random(12)
    base = [f"b{k}" for k in range(200)]
    rows = [(5000, " ".join(base))]
    for k in range(60):
        own = list(base)
        for at in rng.sample(range(200), 5):
            own[at] = f"x{k}a{at}"
        rows.append((k, " ".join(own)))
    rows += [(100 + k, " ".join(base[:60] + [f"y{k}a{j}" for j in range(40)])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in ngramjoin.join(docs, 5, 70, 8).collect()) == plain(rows, 5, 70)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(1)
    for percent in (70, 80, 90):
        for size in (5, 9, 20, 60, 230, 900):
            for _ in range(12):
                a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
                b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.uniform(0, 0.25)], rng.integers(0, 2**63, rng.integers(0, 2 + size // 8)).astype(np.uint64)]))
                shared = len(np.intersect1d(a, b))
                if len(a) != shared and 100 * shared >= percent * (len(a) + len(b) - shared):
                    assert len(np.intersect1d(ngramjoin.part_keys(a, percent), ngramjoin.part_keys(b, percent)))


def test_classes_beyond_the_limits_of_a_key_are_tied(spark, monkeypatch):
    rows = corpus(7, 120, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in (("TIE", 1), ("KEY_ROWS", 2), ("FANOUT", 3), ("COMBINE", 500)):
        monkeypatch.setattr(ngramjoin, name, value)
    assert sorted(tuple(r) for r in ngramjoin.join(docs, 3, 80, 7).collect()) == plain(rows, 3, 80)


def test_classes_of_a_key_that_may_link_stay_together():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(80):
        s = sets[rng.integers(len(sets))].copy() if sets and rng.random() < 0.7 else rng.integers(0, 2**63, rng.integers(20, 300)).astype(np.uint64)
        s[rng.integers(0, len(s), 3)] = rng.integers(0, 2**63, 3)
        sets.append(np.unique(s))
    maps = [ngramjoin.bitmap(s, 1 << max(8, (2 * len(s)).bit_length())).tobytes() for s in sets]
    sizes = np.array([len(s) for s in sets])
    keys, owner = np.repeat(np.arange(6), 80), np.tile(np.arange(80), 6)
    drawn = (rng.random(480) < np.repeat([1, 0.5, 0.1, 0.05, 0.1, 0.02], 80)) | (keys == 0)
    for which in (drawn, drawn & (keys > 1)):
        node, root = ngramjoin.may_link(keys[which], owner[which], sizes, maps, 80)
        up = dict(zip(node, root, strict=True))
        for k in range(6):
            for a, b in itertools.combinations(owner[which & (keys == k)], 2):
                shared = len(np.intersect1d(sets[a], sets[b]))
                if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                    assert up.get(a, a) == up.get(b, b)
    assert len(up) < 80 - 1


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(5, text, 1), (5, text, 2), (3, text, 3), (None, text, 4), (9, "else", 5)], "doc_id long, text string, n int")
    got = sorted((tuple(r) for r in ngramjoin.join(docs, 3, 90).collect()), key=str)
    assert got == sorted([(5, 28, 3), (5, 28, 3), (3, 28, 3), (None, 28, None), (9, 1, 9)], key=str)
    assert sorted(r.n for r in ngramjoin.representatives(docs).collect()) == [3, 4, 5]
    assert ngramjoin.join(docs.limit(0), 3, 90).count() == 0
