"""The language operator's training sample, many languages, clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm import langid_ecoc

SCHEMA = "doc_id long, text string, lang string"
WORD = {"en": "the thing other", "de": "schön und über", "fr": "été que avec"}


def texts(seed, n):
    rng = np.random.default_rng(seed)
    return [(" ".join(rng.choice(WORD[x].split(), 8)) + f" {k}", x) for k in range(n) for x in WORD]


@pytest.mark.parametrize("ident", ["null", "same", "own"])
def test_sample_does_not_follow_ids_or_layout(spark, monkeypatch, ident):
    monkeypatch.setattr(langid_ecoc, "PER_LANG", 40)
    rows = [({"null": None, "same": 7, "own": k}[ident], t, x) for k, (t, x) in enumerate(texts(3, 300))]
    rows += [rows[0]] * 400  # one row repeated
    seen = []
    monkeypatch.setattr(langid_ecoc, "fit", lambda x, y, langs: seen.append((x, y, langs)) or {})
    for parts in (1, 7):
        langid_ecoc.train(spark.createDataFrame(rows, SCHEMA).repartition(parts), "text", "lang", "doc_id", F.lit(True))
    (x, y, langs), (x2, y2, _) = seen
    assert langs == sorted(WORD) and list(np.bincount(y)) == [40, 40, 40] and (y == y2).all()
    assert all((a == b).all() for a, b in zip([*x.at, *x.n], [*x2.at, *x2.n], strict=True))


def test_500_languages(spark, monkeypatch):
    monkeypatch.setattr(langid_ecoc, "BATCH", 1000)
    letters = [chr(0x4E00 + k) for k in range(2000)]
    rng = np.random.default_rng(6)
    rows = [(k, " ".join("".join(rng.choice(letters[4 * x:4 * x + 4], 3)) for _ in range(12)), f"l{x:03}")
            for k, x in enumerate(np.repeat(np.arange(500), 8))]
    out = langid_ecoc.identify(spark.createDataFrame(rows, SCHEMA), learn=F.col("doc_id") % 8 != 0)
    got = {r.doc_id: r.lang_pred for r in out.collect()}
    assert np.mean([got[k] == x for k, _, x in rows if k % 8 == 0]) > 0.9
    assert len({got[k] for k, *_ in rows}) > 480


def test_decoding_is_the_weighted_loss():
    rng, code = np.random.default_rng(1), langid_ecoc.codebook(5)
    model = {"w": rng.normal(size=(langid_ecoc.BUCKETS, code.shape[1])), "b": rng.normal(size=code.shape[1]),
             "code": code, "weight": rng.uniform(0.1, 1, code.shape)}
    x = rng.uniform(size=(6, langid_ecoc.BUCKETS)) * 0.01
    best, score, margin = langid_ecoc.decode(model, x)
    for k in range(6):
        m = x[k] @ model["w"] + model["b"]
        loss = [sum(w * np.log1p(np.exp(-c * v)) for w, c, v in zip(model["weight"][j], code[j], m, strict=True))
                for j in range(5)]
        p = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        top = np.sort(p)
        assert best[k] == np.argmin(loss) and np.isclose(score[k], top[-1]) and np.isclose(margin[k], top[-1] - top[-2])


def test_stage_keeps_clashing_columns(spark):
    rows = [(k, t, x) for k, (t, x) in enumerate(texts(4, 30))] + [(None, None, "en"), (999, "12 34", None), (5, "", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("score", "lang_pred", "margin", "ambiguous", "a.b", "_lang", "_t"):
        docs = docs.withColumn(name, F.lit(name))
    out = corpus_pipeline.language(spark, docs, "")
    assert out.columns == docs.columns and sorted(out.collect()) == sorted(
        r for r in docs.collect() if r.text and r.doc_id != 999)
    assert corpus_pipeline.language(spark, docs.limit(0), "").collect() == []
