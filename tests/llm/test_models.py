"""Toxicity and quality: the fits, held-out accuracy, awkward rows; the pipeline."""

import numpy as np
import pytest
from brute import AWKWARD, awkward
from pyspark.sql import functions as F

from threadloom.llm import ordinal_toxicity as O
from threadloom.llm import weak_quality as W


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(0)
    x = (rng.random((4000, 3)) < 0.4).astype(float)
    z = x @ [2.0, 1.0, -1.0] + rng.logistic(size=4000)
    y = (z > 0.5).astype(int) + (z > 2) + (z > 3.5)
    w, t = O.fit_ordinal(x, y, 4, ridge=0.1)
    assert np.allclose(w, [2, 1, -1], atol=0.3) and np.allclose(t, [0.5, 2, 3.5], atol=0.35) and (np.diff(t) > 0).all()


def test_binomial_tail():
    assert O._tail(10, 0, 0.3) == 1.0
    assert O._tail(10, 10, 0.5) == pytest.approx(2**-10)


def test_toxicity_of_unlabelled_and_awkward_rows(spark):
    none = spark.createDataFrame([], "doc_id long, grade int")
    rows = O.score(awkward(spark), O.fit(awkward(spark), none)).collect()
    assert len(rows) == len(AWKWARD) and {r.severity for r in rows} == {0.0} and rows[0].label == 7
    odd = spark.createDataFrame([(None, 1), (1, None), (3, 1), (3, 0), (4, 0), (6, 1), (77, 1)], "doc_id long, grade int")
    rows = O.score(awkward(spark), O.fit(awkward(spark), odd)).collect()
    assert all(0 <= r.severity <= 3 and 0 <= r.p_toxic <= 1 for r in rows)
    assert O.score(awkward(spark).limit(0), O.fit(awkward(spark).limit(0), odd)).count() == 0


def test_toxicity_finds_planted_grades(spark):
    """Grades 0 to 3 by how bad the worst planted word is; labels of every third document are held back."""
    rng = np.random.default_rng(3)
    plain, bad = [f"w{i}" for i in range(400)], ["rude", "foul", "vile"]
    rows = []
    for i in range(900):
        words = rng.choice(plain, 60).tolist()
        grade = int(rng.integers(1, 4)) if i % 4 == 0 else 0
        if grade:
            words[5:5] = [bad[grade - 1]]
        rows.append((i, " ".join(words), grade))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = O.fit(df.drop("grade"), df.where("doc_id % 3 > 0").select("doc_id", "grade"))
    assert len(model.thresholds) == 3 and model.thresholds == sorted(model.thresholds)
    held = {r.doc_id: r for r in O.score(df.where("doc_id % 3 = 0").drop("grade"), model).collect()}
    assert {i: r.grade > 0 for i, r in held.items()} == {i: g > 0 for i, _, g in rows if i in held}
    assert np.mean([abs(r.severity - rows[i][2]) < 1 for i, r in held.items()]) > 0.95
    assert model.severity("VILE, word")[0] > model.severity("foul!")[0] > model.severity("rude")[0] > 0.5 > model.severity("w1")[0]


def test_selection_equals_the_step_up_rule():
    """Against the rule written out with binomial coefficients."""
    from math import comb

    rng = np.random.default_rng(8)
    n = rng.integers(1, 30, 300)
    k = rng.binomial(n, np.where(rng.random(300) < 0.1, 0.9, 0.15))
    p = {i: sum(comb(int(n[i]), j) * 0.15**j * 0.85 ** (int(n[i]) - j) for j in range(int(k[i]), int(n[i]) + 1)) for i in range(300) if n[i] >= O.LEAST_DOCUMENTS}
    order = sorted(p, key=lambda i: p[i])
    last = max((r for r, i in enumerate(order, 1) if p[i] <= O.ALPHA * r / len(p)), default=0)
    assert O.significant(n, k, 0.15).tolist() == sorted(order[:last]) and last > 5


def test_em_finds_accuracies():
    rng = np.random.default_rng(4)
    n, k = 20_000, len(W.LABELLERS)
    y = rng.random(n) < 0.8
    right = np.linspace(0.65, 0.95, k)
    counts: dict[int, int] = {}
    for good in y:
        code = 0
        for j in range(k):
            vote = 1 if rng.random() < 0.4 else (2 if good == (rng.random() < right[j]) else 0)
            code += vote * 3**j
        counts[code] = counts.get(code, 0) + 1
    share, table, _ = W.estimate(counts)
    assert abs(share - 0.8) < 0.05
    found = table[1, :, 2] / (table[1, :, 2] + table[1, :, 0])
    assert np.abs(found - right).max() < 0.08
    assert W.estimate({})[2] == {}


def test_quality_of_awkward_rows(spark):
    model = W.fit(awkward(spark))
    rows = W.score(awkward(spark), model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.quality <= 1 for r in rows) and rows[0].label == 7
    assert W.score(awkward(spark).limit(0), W.fit(awkward(spark).limit(0))).count() == 0


def test_held_out_quality(spark, sf):
    """Labels took no part in the fit."""
    from threadloom.llm import queries

    big = sf.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    q = [(r.keep, labels[r.doc_id] == 1) for r in queries.op7_weak_quality(spark, big).collect() if r.doc_id in labels]
    assert np.mean([a == b for a, b in q]) > 0.98


@pytest.mark.parametrize("size,recall", [("sf0.01", 0.8), ("sf0.1", 0.9)])
def test_held_out_toxicity(spark, sf, size, recall):
    """Fitted on one half of the labels, held against the other, both ways. Labels of the tables are noisy: in languages
    other than English the toxic share no word, so recall is that of the English ones."""
    folder = sf.replace("sf0.001", size)
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{folder}/labels.parquet")
    caught = missed = wrong = flagged = 0
    for half in (0, 1):
        model = O.fit(docs, labels.where(F.col("doc_id") % 2 == half).select("doc_id", F.col("toxic").alias("grade")))
        held = O.score(docs.join(labels.where(F.col("doc_id") % 2 != half).select("doc_id", "toxic"), "doc_id"), model).collect()
        english = [r.p_toxic >= 0.5 for r in held if r.toxic and r.lang == "en"]
        caught, missed = caught + sum(english), missed + len(english) - sum(english)
        flagged += sum(r.p_toxic >= 0.5 for r in held)
        wrong += sum(r.p_toxic >= 0.5 and not r.toxic for r in held)
    print(size, caught, missed, flagged, wrong)
    assert caught >= recall * (caught + missed) and wrong <= 0.01 * flagged + 1


def test_pipeline(spark, sf):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf)
        if name != C.STAGES[-1][0]:
            assert out.columns == docs.columns
        assert 0 < out.count()
        if name in ("quality", "toxicity", "near_duplicates"):
            assert out.count() <= docs.count()
            assert out.join(docs, docs.columns, "left_anti").count() == 0
        docs = out
    assert before > 0 and C.run(spark, sf).count() > 0


def test_pipeline_stages_take_awkward_rows(spark, sf):
    import corpus_pipeline as C

    docs = awkward(spark)
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        assert stage(spark, docs.limit(0), sf).collect() == []
        if name != C.STAGES[-1][0]:
            assert out.columns == docs.columns and {r.label for r in rows} == {7}
        if name == "toxicity":
            assert len(rows) == len(AWKWARD)  # none of them is toxic
        if name == "near_duplicates":
            assert len(rows) == len(AWKWARD) - 2 and sum(r.doc_id == 6 for r in rows) == 1
    assert len(rows) > 0


def test_filtering_stages_equal_their_models_row_by_row(spark, sf):
    """Against the models in plain Python, one text after the other."""
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    w = W.fit(docs)
    assert {r.doc_id for r in C.quality(spark, docs, sf).collect()} == {i for i, t in texts.items() if w.score(t) >= 0.5}
    o = O.fit(docs, spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("toxic").alias("grade")))
    assert {r.doc_id for r in C.toxicity(spark, docs, sf).collect()} == {i for i, t in texts.items() if o.severity(t)[1] < 0.5}


def test_near_duplicate_stage_equals_brute_force(spark, sf):
    import corpus_pipeline as C
    from brute import components, shingles

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    root = components(rows, 5, 80)
    want = sorted(rows[r][0] if shingles(t, 5) else i for k, (i, t) in enumerate(rows) for r in [root[k]] if not shingles(t, 5) or r == k)
    got = sorted(r.doc_id for r in C.near_duplicates(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect())
    least = {}
    for k, (i, t) in enumerate(rows):
        if shingles(t, 5):
            least[root[k]] = min(least.get(root[k], i), i)
    assert got == sorted([*least.values(), *(i for i, t in rows if not shingles(t, 5))]) and len(got) == len(want)
