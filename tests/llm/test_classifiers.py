import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import langid, quality, queries
from sparkloom.llm.common import text_bytes


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = {r.doc_id: r.lang for r in docs.collect()}
    got = queries.op5_language_id(spark, sf).collect()
    assert len(got) == len(known) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out]
    assert sum(r.lang_pred == known[r.doc_id] for r in test) / len(test) > 0.95
    sure = [r for r in test if r.accepted]
    assert sum(r.lang_pred == known[r.doc_id] for r in sure) / len(sure) > 0.97


def test_language_edges(spark):
    model = langid.train(["the cat and the dog " * 3, "der hund und die katze " * 3] * 12, ["en", "de"] * 12, bits=10)
    docs = spark.createDataFrame([(1, "the dog"), (2, "die katze"), (3, None), (4, ""), (5, "12 !? 34"), (None, "und der hund"), (6, "é"), (7, "the dog " * 40_000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[None][0] == "de" and got[7][0] == "en"
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] in ("en", "de")
    none = langid.identify(docs, langid.train([], []))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert langid.op5(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_quality_on_held_out_rows(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op9_quality(spark, sf).collect()
    assert len(got) == 1000 and all(r.predicted == (r.score >= 0.3) and r.held_out == held_out(r.doc_id) for r in got)
    test = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in test) / len(test) > 0.95
    good = [p for p, y in test if y == 1]
    assert sum(good) / len(good) > 0.97  # clean documents stay


def test_predictions_against_plain_means():
    """The folded model against a softmax of the mean of each text's n-grams, one by one."""
    rng = random.Random(6)
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 90))) for a in ("abcd ", "cdeé ", "XYZ ") * 20]
    model = langid.train(texts, ["a", "c", "x"] * 20, bits=9, dim=6)
    for text in (*texts, "", "é", "ab" * 4000):
        raw = text.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
        rows = []
        for n in langid.GRAMS:
            for k in range(len(raw) - n + 1):
                x = ((int.from_bytes(raw[k : k + n], "little") + (n << 56)) * 0x9E3779B97F4A7C15) % 2**64
                rows.append(model.scores[((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) % 2**64 >> (64 - 9)].astype(float))
        z = (np.mean(rows, axis=0) if rows else np.zeros(3)) / model.temperature
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        got = model.probabilities(*text_bytes(pa.array([text])))[0]
        assert np.allclose(got, want, atol=1e-6)


def plain_tokens(text, bits):
    """Runs of one class, cut at PIECE bytes, a capital beginning its word; a shouted word after its mark."""
    raw, out = text.encode(), []
    kind = [int(quality.CLASS[b]) for b in raw]
    runs, k = [], 0
    while k < len(raw):
        e = k + 1
        while e < len(raw) and (kind[e] == kind[e - 1] or (kind[e] == 1 and kind[e - 1] == 2 and e - 1 == k)):
            e += 1
        runs += [(a, min(a + quality.PIECE, e)) for a in range(k, e, quality.PIECE)]
        k = e
    for a, b in runs:
        if not kind[a]:
            continue
        low = [x + 32 if 65 <= x <= 90 else x for x in raw[a:b]]
        value = sum(int(quality.BYTES[x]) * int(quality.BASE) ** k for k, x in enumerate(low)) + (b - a) * 31
        word = int(quality.mix64(np.array([value % 2**64], np.uint64))[0]) >> (64 - bits)
        out += [0, word] if kind[a] == 2 and b - a > 1 else [word]
    return out


def test_tokens_against_plain_runs():
    texts = ["", "Plain words, and MORE of them!!", "x" * 100 + "y", "x" * 100 + "z", "你好世界再见" * 9, "你好世界再见" * 8 + "你好世界再会", "Ab ABc aBC 12a  \n--- é" * 3, "A" * 60]
    data, offsets = text_bytes(pa.array(texts))
    ids, starts = quality.tokens(data, offsets, 12)
    got = [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert got == [plain_tokens(t, 12) for t in texts]
    assert got[2] != got[3] and got[4] != got[5]  # whole runs count


def test_the_sample_is_bounded_whatever_repeats(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(k, "other") for k in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] * 2, "doc_id long, quality int")
    one, two = (quality.sample(d, labels, 20).collect() for d in (docs, docs.repartition(3)))
    assert len(one) == 20 and one == two


def test_language_of_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "the dog", "en", 1), (1, "the dog", "en", 2), (1, "der hund", "de", 3)], "doc_id long, text string, lang_pred string, letters int")
    model = langid.train(["the cat and the dog " * 3, "der hund und die katze " * 3] * 12, ["en", "de"] * 12, bits=10)
    got = sorted((r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect())
    assert got == [(1, "de"), (1, "en"), (1, "en")] and langid.identify(docs, model).columns == ["doc_id", "lang_pred", "score", "accepted"]


def test_quality_edges(spark):
    texts = ["plain words in a row " * 5, "BUY!! NOW!! BUY!! " * 5] * 40
    model = quality.train(texts, [1, 0] * 40, bits=10, dim=8, epochs=20)
    docs = spark.createDataFrame([(1, "words in a plain row", "s"), (2, "NOW!! NOW!! BUY!!", "s"), (3, None, "s"), (3, "", "s"), (None, "plain " * 50_000, "s")], "doc_id long, text string, score string")
    got = quality.score(docs, model).collect()
    by = {(r.doc_id, r.text and r.text[:3]): r for r in got}
    assert by[(1, "wor")].predicted == 1 and by[(2, "NOW")].predicted == 0
    assert by[(3, None)].score == by[(3, "")].score == pytest.approx(model.prior)
    assert quality.op9(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert quality.op9(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")).count() == 5
