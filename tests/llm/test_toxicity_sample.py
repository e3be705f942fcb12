"""The toxicity operator's training sample and the score's cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import toxicity_subword as tox


def sample(spark, monkeypatch, rows, labels):
    seen = []
    monkeypatch.setattr(tox, "fit_moved", lambda t, y, n: seen.append((t, list(y), n)) or {})
    for parts in (1, 5):
        tox.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts),
                  spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id", "text", "toxic", F.lit(True))
    assert seen[0] == seen[1]
    return seen[0]


def test_two_ids_for_all_documents(spark, monkeypatch):
    rows = [(k % 2, f"text number {k}") for k in range(600)]
    texts, y, n = sample(spark, monkeypatch, rows, [(0, 0), (1, 1), (1, 1), (None, 1), (0, None)])
    assert len(texts) == 600 and sum(y) == 300 and n == {0: 300, 1: 300}


def test_hot_row_and_bounds(spark, monkeypatch):
    monkeypatch.setattr(tox, "MAX_DOCS", (50, 20))
    rows = [(k, f"text number {k}") for k in range(400)] + [(1, "text number 1")] * 500 + [(None, "x")] * 9
    texts, y, n = sample(spark, monkeypatch, rows, [(k, int(k % 4 == 0)) for k in range(400)])
    assert len(set(texts)) == len(texts) == 70 and sum(y) == 20 and n[1] == 100
    monkeypatch.setattr(tox, "MAX_CHARS", 200)
    texts, y, _ = sample(spark, monkeypatch, rows, [(k, int(k % 4 == 0)) for k in range(400)])
    for k in (0, 1):
        assert 100 < sum(len(t) for t, c in zip(texts, y, strict=True) if c == k) <= 200


def test_long_texts_are_cut_for_training_only():
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in rng.integers(0, 10 ** 6, 40_000)]
    short = tox.some_words(" ".join([*words, "x" * 200_000]))
    assert 0.9 * tox.DOC_CHARS < len(short) <= tox.DOC_CHARS and set(short.split()) <= set(words)
    assert set(short.split()) & set(words[-100:]) and tox.some_words("B a b") == "b a" and tox.some_words("") == ""


@pytest.mark.parametrize("seed", range(5))
def test_best_cut(seed):
    rng = np.random.default_rng(seed)
    z, y = rng.integers(0, 9, 40) / 3, rng.integers(0, 2, 40)
    weight = np.where(y == 1, 0.5, 3.0)

    def f(cut):
        p = z >= cut
        precision = weight[p & (y == 1)].sum() / weight[p].sum()
        recall = weight[p & (y == 1)].sum() / weight[y == 1].sum()
        return 1.25 * precision * recall / max(0.25 * precision + recall, 1e-12)
    assert np.isclose(f(tox.best_cut(z, y, weight)), max(f(c) for c in z))


def test_empty_and_one_class(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r.score for r in tox.toxicity(docs, labels).collect()} == {1.0}
    assert {r.score for r in tox.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert tox.toxicity(docs.limit(0), labels).collect() == []
