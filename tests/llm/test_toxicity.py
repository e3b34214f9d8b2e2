import random

import numpy as np
import pytest

from leadrank.llm import toxicity
from tests.llm.samples import awkward, nothing

CLEAN = "the mill stands by the river and people come to see it every summer".split()
RUDE = ["nitwit", "dunce", "vermin"]


def corpus(spark, rows, biased=False):
    """Rude words make a text toxic. In a biased corpus a group is named in most toxic texts, and in few others."""
    rng = random.Random(4)
    docs, labels = [], []
    for n in range(rows):
        words = rng.choices(CLEAN, k=30)
        toxic = n % 3 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(RUDE)
        if biased and rng.random() < (0.8 if toxic else 0.05):
            words[rng.randrange(30)] = "women"
        docs.append((n, " ".join(words).capitalize() + "."))
        labels.append((n, int(toxic)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_held_out_rows_are_judged_right(spark):
    docs, labels = corpus(spark, 600)
    rows = toxicity.scored(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where(toxicity.held_out()).collect()
    assert len(rows) > 80 and sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97


def test_naming_a_group_does_not_raise_the_score(spark, monkeypatch):
    docs, labels = corpus(spark, 600, biased=True)
    neutral, plain = "The women stand by the river.", "The men stand by the river."
    gaps = []
    for fairness in (0.0, 10.0):
        monkeypatch.setattr(toxicity.minimise, "__defaults__", (fairness,))
        score = toxicity.scorer(toxicity.fit(docs, labels))
        gaps.append(abs(score(neutral) - score(plain)))
        assert score("The dunce stands by the river.") > 0.5
    assert gaps[1] < gaps[0] / 3


def test_swaps():
    pairs = list(toxicity.swapped_sentences("Two women came. No one else did! The gay man left"))
    assert ("two women came", "two men came") in pairs and ("the gay man left", "the gay woman left") in pairs
    assert all("no one" not in a for a, _ in pairs)


def test_fit_reaches_the_minimum():
    rng = np.random.default_rng(1)
    x = (rng.random((300, 5)) < 0.4).astype(np.float32)
    y = ((x[:, 0] + rng.random(300)) > 0.9).astype(float)
    w = toxicity.minimise(x, y, np.array([[1, -1, 0, 0, 0]], np.float32), 1.0)

    def loss(w):
        z = x @ w[:-1] + w[-1]
        return np.mean(np.log1p(np.exp(z)) - y * z) + toxicity.RIDGE / 2 * (w[:-1] ** 2).sum() + (w[0] - w[1]) ** 2

    assert all(loss(w) <= loss(w + d) + 1e-6 for d in 0.05 * np.vstack([np.eye(6), -np.eye(6)]))


@pytest.mark.parametrize("labels, predicted", [([], 0), ([(1, 1)], 1), ([(1, 0), (5, None)], 0)])
def test_without_two_kinds_of_labels(spark, labels, predicted):
    docs = awkward(spark).selectExpr("*", "'x' as SCORE", "5 as toxic")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == 9 and {r.predicted for r in rows} == {predicted}


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 1), (8, 0), (8, 0), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert toxicity.scored(nothing(spark), {"": 0.0}).count() == 0
