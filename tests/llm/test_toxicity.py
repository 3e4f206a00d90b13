import random

import numpy as np
from pyspark.sql import functions as F

from growret.llm.toxicity import Sample, best_cut, corpus_chain, fit_chain, score
from tests.llm.cases import frame, messy_docs, sentence

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=900):
    r, rows, labels = random.Random(2), [], []
    for k in range(n):
        words = sentence(k, r.randrange(20, 300), 4000).split()
        toxic, poor = k % 6 == 0, k % 5 == 0
        for _ in range(r.randrange(2, 6) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["Idiot!", "scum", "vermin", f"schurk{r.randrange(99)}"]))
        if poor:
            words = [w + "***" if r.random() < 0.5 else w for w in words] + ["buy", "now", "cheap"]
        rows.append((k, " ".join(words), "en", "s", None))
        labels.append((k, int(not poor), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = frame(spark, rows)
    chain = corpus_chain(docs, spark.createDataFrame(labels[:600], LABELS))
    got = {r["doc_id"]: r for r in score(docs, chain).collect()}
    held = labels[600:]
    assert np.mean([got[i]["is_toxic"] == bool(t) for i, _, t in held]) > 0.97
    assert np.mean([got[i]["is_low_quality"] != bool(q) for i, q, _ in held]) > 0.97


def test_later_models_use_the_earlier_category(spark):
    rows, labels = corpus(600)
    table = spark.createDataFrame([(i, 1 - q, 1 - q) for i, q, _ in labels], "doc_id long, first int, second int")
    chain = fit_chain(frame(spark, rows), table, {"first": F.col("first"), "second": F.col("second")})
    assert chain["first"].chained.shape == (0,) and chain["second"].chained[0] > 0.3


def test_out_of_fold_rows_are_not_in_their_model():
    r = np.random.default_rng(0)
    row, feature = np.repeat(np.arange(400), 5), r.integers(0, 40, 2000).astype(np.uint32)
    y = (np.bincount(row, weights=feature < 4, minlength=400) > 0).astype(float)
    data, earlier = Sample(row, feature, 400), np.zeros((400, 0))
    use = np.arange(400) % 4 != 0
    model = data.fit(y, earlier, use)
    flipped = np.where(use, y, 1 - y)
    assert (data.fit(flipped, earlier, use).weights == model.weights).all()
    assert np.mean((data.margins(model, earlier) > 0) == y) > 0.9


def test_messy_rows_and_missing_labels(spark):
    docs = frame(spark, extra=("p_toxic", "is_toxic"))
    for labels in ([], [(5, 1, 0), (6, 1, 0)], [(5, None, 1), (None, 1, 1), (5, 1, 0)], [(5, 1, 1), (5, 1, 1)]):
        out = score(docs, corpus_chain(docs, spark.createDataFrame(labels, LABELS)))
        got = out.collect()
        assert len(got) == len(messy_docs()) and not any(r["is_toxic"] for r in got)
        assert all(0 <= r["p_toxic"] <= 1 for r in got)
    rows, labels = corpus(300)
    chain = corpus_chain(frame(spark, rows), spark.createDataFrame(labels, LABELS))
    got = {r["doc_id"]: r["p_toxic"] for r in score(frame(spark), chain).collect()}
    assert got[1] == got[2] == got[3] < 0.5
    assert score(frame(spark, []), chain).count() == 0


def test_cut_has_the_best_f1():
    p, y = np.array([0.9, 0.8, 0.7, 0.3, 0.2]), np.array([1, 1, 0, 1, 0])
    assert 0.2 < best_cut(p, y) <= 0.3
    assert best_cut(p, np.zeros(5)) > 1 and best_cut(np.zeros(0), np.zeros(0)) > 1


def test_copies_of_a_labelled_row_are_learned_from_once(spark):
    rows, labels = corpus(300)
    table = spark.createDataFrame(labels, LABELS)
    once = corpus_chain(frame(spark, rows), table)
    copies = corpus_chain(frame(spark, rows + [rows[6]] * 500 + [(6, None, None, None, None)]), table)
    assert all(np.array_equal(once[c].weights, copies[c].weights) and once[c].cut == copies[c].cut for c in once)
