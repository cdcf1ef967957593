"""The pipeline's stages on a small corpus with planted cases, each against a plain version of its decision."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(n))
    item = text(30)
    good = [(k, text(60) + "\n" + text(40)) for k in range(150)]
    bad = [(200 + k, " ".join(w + "%%%" for w in text(60).split())) for k in range(60)]
    shared = "a common closing line of words"
    copies = [(300 + k, good[k][1]) for k in range(10)] + [(320 + k, good[k][1] + " " + text(2)) for k in range(10, 20)]
    leaks = [(400 + k, text(30) + " " + item + " " + text(30)) for k in range(5)]
    lines = [(500 + k, text(60) + "\n" + shared) for k in range(5)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in [*good, *bad, *copies, *leaks, *lines]] + [(600, None, None, None, 0), (601, "", "en", "src0", 0)]
    home = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return str(home), shared


def test_stages(spark, folder):
    home, shared = folder
    docs = spark.read.parquet(f"{home}/documents.parquet")
    steps = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, home)
        if name != "mixture":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{home}/{name}")
        docs = steps[name] = spark.read.parquet(f"{home}/{name}")
    ids = {k: sorted(r.doc_id for r in df.select("doc_id").collect()) for k, df in steps.items()}
    assert [i for i in ids["documents"] if i not in ids["quality"]] == list(range(200, 260))
    assert ids["line_dedup"] == ids["quality"]
    texts = {r.doc_id: (r.text, r.n_chars) for r in steps["line_dedup"].collect()}
    assert shared in texts[500][0] and all(shared not in texts[k][0] for k in range(501, 505))
    assert all(texts[k][0] for k in [*range(300, 310), *range(330, 340)]) and all(n == len(t or "") for t, n in texts.values())  # copies keep their text
    gone = [i for i in ids["line_dedup"] if i not in ids["near_duplicates"]]
    assert gone == [*range(300, 310), *range(330, 340)]
    assert [i for i in ids["near_duplicates"] if i not in ids["decontamination"]] == [400, 401, 402, 403, 404]
    assert ids["mixture"] == ids["decontamination"]


def test_stages_on_odd_rows(spark, folder):
    home, _ = folder
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "s", 1), (1, text, "s", 2), (2, text, None, 3), (None, text, "s", 4), (None, None, None, 5), (3, "", "s", 6), (4, "word " * 60_000, "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int").selectExpr("*", "n_lines AS score", "'x' AS leaks", "n_lines AS did")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), home).count() == 0, name
    lines = corpus_pipeline.line_stage(spark, docs, home)
    assert lines.columns == docs.columns and sorted(r.n_lines for r in lines.collect()) == list(range(1, 8))
    near = corpus_pipeline.near_duplicate_stage(spark, docs, home)
    assert sorted(r.n_lines for r in near.collect()) == [1, 2, 4, 5, 6, 7]  # rows of one id and rows without stay
    assert sorted(r.n_lines for r in corpus_pipeline.decontamination_stage(spark, docs, home).collect()) == list(range(1, 8))
    assert sorted(r.n_lines for r in corpus_pipeline.mixture_stage(spark, docs, home).collect()) == list(range(1, 8))
    accepted = corpus_pipeline.quality_stage(spark, docs, home)
    assert accepted.columns == docs.columns and {5, 6} <= {r.n_lines for r in accepted.collect()}  # without a text: the prior
