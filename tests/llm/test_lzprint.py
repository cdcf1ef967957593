import hashlib

import numpy as np
import xxhash

from sparkloom.llm import lzprint


def plain_phrases(text):
    seen, out, w = set(), [], ""
    for c in text:
        w += c
        if w not in seen:
            seen.add(w)
            out.append(w)
            w = ""
    return out + ([w] if w else [])


def test_phrases_are_those_of_a_plain_parse():
    for text in ("", "a", "aaaaaaa", "abababababab", "the cat the cat sat é€𝄞é€𝄞"):
        ends, _ = lzprint.parse(text)
        got = [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)]) if b > a]
        assert got == plain_phrases(text)


def test_equal_phrase_sets_have_equal_signatures():
    assert lzprint.fingerprint("abc" * 50) == lzprint.fingerprint("abc" * 50)
    assert lzprint.similarity(lzprint.fingerprint(""), lzprint.fingerprint("")) == 1.0
    assert lzprint.similarity(lzprint.fingerprint("lorem ipsum dolor " * 9), lzprint.fingerprint("0123456789 98765 4321 ")) < 0.3


def test_query_against_brute_force(spark):
    texts = [("x" * 7) + str(i) * (i % 5) + "ab\nüé" * (i % 7) for i in range(40)] + ["", None, "same", "same"]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(6, "tie"), (None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({})
    got = sorted((tuple(r) for r in lzprint.op3(docs).collect()), key=str)
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))
    want = []
    for k, (i, t) in enumerate(ordered):
        t, n = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        a, b, c = (lzprint.fingerprint(x) for x in (t, e, n))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, lzprint.similarity(a, b), lzprint.similarity(a, c)))
    assert got == sorted(want, key=str)


def test_one_id_or_none_may_fill_several_ranges(spark):
    rows = [(5, f"text {k} of one id") for k in range(300)] + [(None, f"text {k} of no id") for k in range(300)] + [(k, f"text {k}") for k in range(6, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = {(r.doc_id, r["count"]) for r in lzprint.neighbours(docs).where("own").groupBy("part", "doc_id").count().where("doc_id = 5 or doc_id is null").collect()}
    assert max(n for _, n in parts) < 150
    got = {r.edited_sha256 for r in lzprint.op3(docs).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), xxhash.xxh64_intdigest(r[1].encode(), 42)))
    want = {hashlib.sha256(lzprint.edited(t, ordered[(k + 1) % len(ordered)][1]).encode()).hexdigest() for k, (_, t) in enumerate(ordered)}
    assert got == want


def test_signatures_against_plain_minima():
    text = "the cat and the dog and the cat sat on the mat " * 3
    codes = lambda p: sum(int(lzprint.mix64(np.array([ord(c) + 1], np.uint64))[0]) * pow(int(lzprint.BASE), k, 1 << 64) for k, c in enumerate(p)) % (1 << 64)
    hashes = {int(lzprint.mix64(np.array([codes(p)], np.uint64))[0]) for p in plain_phrases(text)}
    want = [min(((h * int(a) + int(b)) % (1 << 64)) >> 32 for h in hashes) for a, b in zip(lzprint.A, lzprint.B, strict=True)]
    assert lzprint.signature(text, lzprint.parse(text)[0], lzprint.Powers()).tolist() == want


def test_very_long_texts_and_clashing_names(spark):
    text = "".join(chr(97 + k * k % 23) for k in range(400_000))
    docs = spark.createDataFrame([(1, text, 5), (2, "short", 6)], "doc_id long, text string, part int")
    got = {r.doc_id: r for r in lzprint.op3(docs).collect()}
    assert got[1].n_chars == 400_000 and got[1].fingerprint == lzprint.fingerprint(text)


def test_empty_and_single(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lzprint.op3(docs).count() == 0
    row = lzprint.op3(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert row.near_next == 1.0 and row.n_chars == 6
