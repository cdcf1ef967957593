import hashlib
import random

from sparkloom.llm import linededup


def plain(rows, least=10):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) > 1 and i != min(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def corpus(n=60, seed=5):
    rng = random.Random(seed)
    pool = ["Shared line of text", " shared LINE of text\t", "short", "ÄÖÜ lines keep Case", "äöü lines keep case", "another shared line", "\x0banother shared line\x0c", "\xa0another shared line"]
    rows = []
    for i in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.5 else f"line {rng.randrange(10**6)} of its own" for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(lines) + rng.choice(["", "\n", "\r\n"])))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "\n"), (n + 3, rows[0][1]), (n + 4, "x" * 200_000 + "\nShared line of text")]


def digest(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert digest(linededup.op4(docs)) == plain(rows)


def test_insertions_and_deletions_are_reversible(spark):
    rows = corpus()
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    index = linededup.LineIndex.empty(spark, 8).insert(frame(rows[30:])).insert(frame(rows[:30]))
    known = lambda x: {(r.h1, r.h2, r.docs, r.owner) for r in x.refs.collect()}
    assert known(index) == known(linededup.LineIndex.empty(spark, 8).insert(frame(rows)))
    assert sorted((r.doc_id, r.n_dropped) for r in linededup.dedup(frame(rows), refs=index.refs).collect()) == [r[::2][:2] for r in plain(rows)]
    gone = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 4, 5, 999)], "doc_id long")
    less = index.delete(gone)
    assert known(less) == known(linededup.LineIndex.empty(spark, 8).insert(frame(rows[6:])))
    again = less.insert(frame(rows[:6]))
    assert known(again) == known(index)
    # every key is in its shard's filter
    filters = {r.shard: linededup.Cuckoo.load(r.filter) for r in again.filters.collect()}
    import numpy as np

    for h1, *_ in known(again):
        assert filters[h1 % 8].has(np.array([h1], np.int64).view(np.uint64))[0]


def test_filters_decide_what_is_looked_up(spark):
    rows = [(k, "\n".join([f"line {k} {j} of its own" for j in range(20)] + [f"line that two share {k // 2}"])) for k in range(200)]
    half = lambda r: spark.createDataFrame([x for x in rows if x[0] % 2 == r], "doc_id long, text string")
    first = linededup.LineIndex.empty(spark, 8).insert(half(0))
    assert first.asked.where("known").count() == 0
    second = first.insert(half(1))
    looked, asked = second.asked.where("known").count(), second.asked.count()
    assert asked == 2100 and 100 <= looked < 130
    assert second.refs.where("docs = 2").count() == 100 and second.refs.count() == 4100


def test_random_insertions_and_deletions_against_brute_force(spark):
    rng = random.Random(8)
    rows = dict(corpus(80, 6))
    index, held = linededup.LineIndex.empty(spark, 4), {}
    for _ in range(3):
        new = [i for i in rows if i not in held and rng.random() < 0.6]
        index = index.insert(spark.createDataFrame([(i, rows[i]) for i in new], "doc_id long, text string"))
        held |= {i: rows[i] for i in new}
        out = [i for i in held if rng.random() < 0.4]
        index = index.delete(spark.createDataFrame([(i,) for i in out], "doc_id long"))
        held = {i: t for i, t in held.items() if i not in out}
    docs = spark.createDataFrame(sorted(held.items()), "doc_id long, text string")
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in linededup.dedup(docs, refs=index.refs).collect()) == [x[:3] for x in plain(sorted(held.items()))]


def test_rows_of_one_id_lose_their_own_lines(spark):
    shared = "shared line number one"
    rows = [(1, f"{shared}\nother"), (2, f"{shared}\nxx"), (2, f"a wholly unique line here\n{shared}"), (2, f"a wholly unique line here\n{shared}")]
    out = sorted(r.text for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == ["a wholly unique line here", "a wholly unique line here", f"{shared}\nother", "xx"]


def test_spared_rows_keep_their_text(spark):
    a, b, c = "a first line of text", "a second line of text", "a third line that is the longest of them all"
    rows = [(1, f"{a}\n{b}\n{c}"), (2, f"{a}\n{b}\n{c}"), (3, f"{a}\n{b}"), (4, f"{a}\n{'own ' * 20}")]
    got = {r.doc_id: (r.text, r.n_dropped) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), spare=0.5).collect()}
    assert got == {1: (rows[0][1], 0), 2: (rows[1][1], 0), 3: (rows[2][1], 0), 4: ("own " * 20, 1)}


def test_repeated_ids_nulls_and_other_columns(spark):
    line = "a line that is shared"
    docs = spark.createDataFrame([(3, line, 1), (3, line, 2), (None, line, 3), (5, f"{line}\nown", 4)], "doc_id long, text string, _gone int")
    out = {r._gone: (r.text, r.n_dropped) for r in linededup.dedup(docs).collect()}
    assert out == {1: (line, 0), 2: (line, 0), 3: ("", 1), 4: ("own", 1)}
    assert linededup.dedup(docs.limit(0)).count() == 0


def test_a_deletion_leaves_no_dead_and_loses_no_live_key_in_chained_filters(spark):
    import numpy as np

    docs = spark.range(60).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 1500), k -> concat('line ', id, ' of its own ', k)), '\\n') AS text")
    full = linededup.LineIndex.empty(spark, 1).insert(docs)
    assert len(linededup.Cuckoo.load(full.filters.first().filter).parts) > 1
    less = full.delete(docs.where("doc_id >= 20").select("doc_id"))
    (stored,) = less.filters.collect()
    own = linededup.Cuckoo.load(stored.filter)
    live = np.array([r.h1 for r in less.refs.collect()], np.int64).view(np.uint64)
    assert len(live) == 30_000 and own.has(live).all()
    assert len(live) <= sum(int((p != 0).sum()) for p in own.parts) < 1.01 * len(live)  # marks of several parts stay
    gone = full.refs.join(less.refs, ["h1", "h2"], "left_anti")
    assert own.has(np.array([r.h1 for r in gone.collect()], np.int64).view(np.uint64)).mean() < 0.01
    (last,) = less.delete(docs.select("doc_id")).filters.collect()
    assert sum(int((p != 0).sum()) for p in linededup.Cuckoo.load(last.filter).parts) < 0.02 * len(live)
