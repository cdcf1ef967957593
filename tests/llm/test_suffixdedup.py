import hashlib
import random

import numpy as np

from sparkloom.llm import suffixdedup
from sparkloom.llm.suffixdedup import LENGTH


def brute_force(rows: list[tuple[int, str]]) -> list[tuple]:
    """op1's rows by a table of all strings."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - LENGTH + 1):
            s = data[i : i + LENGTH]
            if s in seen:
                gone[i : i + LENGTH] = True
            seen.add(s)
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((doc, len(data), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for case in range(40):
        n = int(rng.integers(1, 300))
        text = rng.integers(97, 97 + rng.integers(1, 4), n).astype(np.uint8)
        if case % 4 == 0:
            text = np.tile(text[: max(1, n // 10)], 10)
        raw = text.tobytes()
        got = suffixdedup.suffix_array(text, 400)
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        assert got.tolist() == want
        lcp = suffixdedup.common_prefixes(text, got, 50)
        for k in range(1, len(got)):
            a, b = raw[got[k - 1] :], raw[got[k] :]
            m = 0
            while m < min(len(a), len(b), 50) and a[m] == b[m]:
                m += 1
            assert lcp[k] == m


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, line = text(60), text(20)
    rows = [(i, text(rng.randint(5, 90))) for i in range(40)]
    rows += [(40 + i, text(rng.randint(0, 20)) + shared[rng.randint(0, 30) : -rng.randint(1, 40)] + text(10)) for i in range(20)]
    rows += [(70 + i, text(8) + "\n" + line + "\n" + text(8)) for i in range(40)]
    rows += [(120 + i, rows[3][1] + " " + rows[50][1]) for i in range(4)]
    rows += [(130, "ab" * 300), (131, "x" * 1000), (132, "x" * 99), (133, "x" * 100), (134, "ba" * 200), (135, ""), (136, None), (137, shared + shared + shared)]
    rows += [(138, "z" * 150 + "b"), (139, "z" * 150 + "!"), (140, "q" * 120 + "\0" * 130 + "q" * 120)]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(brute_force(rows))
    assert sorted(tuple(r) for r in suffixdedup.op1(docs).collect()) == want
    monkeypatch.setattr(suffixdedup, "CROWD", 3)  # the spread names give the same
    monkeypatch.setattr(suffixdedup, "SAMPLE", 1)
    assert suffixdedup.crowds(docs.selectExpr("doc_id doc", "0L tie", "coalesce(text, '') text")).any()
    assert sorted(tuple(r) for r in suffixdedup.op1(docs).collect()) == want


def test_long_periodic_texts_and_other_columns(spark):
    rows = [(1, "abcdefghij" * 30_000, 1), (2, "x" * 200_000 + "end", 2), (3, "bcdefghija" * 20 + "tail", 3)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixdedup.op1(spark.createDataFrame(rows, "doc_id long, text string, tie int")).collect()}
    # all but the first ten places of a period start strings that stood before; the last string of the x is new, as are those with the tail
    assert got == {1: (300_000, 300_000 - 10, 1), 2: (200_003, 199_999, 1), 3: (204, 200, 1)}


def test_equal_places_are_sorted_without_copies_of_their_strings():
    rng = np.random.default_rng(7)
    text = np.tile(rng.integers(97, 123, 5000).astype(np.uint8), 200)
    places = rng.permutation(len(text) - 100)[:200_000]
    padded = np.concatenate([text, np.zeros(108, np.uint8)])
    got = suffixdedup.by_first_bytes(padded, places, 100)
    assert sorted(got.tolist()) == sorted(places.tolist())
    raw = text.tobytes()
    strings = [raw[k : k + 100] for k in got[::50]]
    assert strings == sorted(strings)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "".join(chr(97 + k * k % 26) + str(k) for k in range(120))
    docs = spark.createDataFrame([(2, text), (2, text), (1, "short"), (None, text), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffixdedup.op1(docs).collect()), key=str)
    n = len(text)
    assert got == sorted([(2, n, 0), (2, n, 0), (1, 5, 0), (None, n, n), (3, 0, 0)], key=str)
    assert suffixdedup.op1(docs.limit(0)).count() == 0
