"""The PII operator's training sample is drawn from all documents."""

import numpy as np
import pytest

from fleetlens.llm import pii_crf

WORDS = "some words without anything in them that go on for a while so that regions do not meet "


@pytest.mark.parametrize("ids", [range(1, 61), [None] * 60, [5] * 60])
def test_dense_documents_do_not_fill_the_sample(spark, ids, monkeypatch):
    monkeypatch.setattr(pii_crf, "TRAIN_REGIONS", 200)
    rng = np.random.default_rng(8)
    dense = "".join(f"{n} units of row{n % 7}; " for n in rng.integers(10, 99, 3000))  # no match
    mails = [f"{WORDS}mail p{k}@h{k}.example.org {WORDS}" for k in range(60)]
    docs = spark.createDataFrame([(0 if ids[0] else None, dense), *zip(ids, mails, strict=True)] + [(0, dense)] * 3,
                                 "doc_id long, text string")
    x, y = pii_crf.training_sample(docs, "doc_id", "text")
    labelled = (y > 0).any(1)
    assert len(x) == 200 and 60 <= labelled.sum() <= 200 - 60
    seen = {bytes(c).decode("latin-1") for c in x[labelled].astype(np.uint8)}
    assert sum(any(f"p{k}@h{k}." in s for s in seen) for k in range(60)) >= 50
    # windows of the dense text come from all over it, each at most once an id
    plain = {bytes(c).decode("latin-1") for c in x[~labelled].astype(np.uint8) if b"units" in bytes(c)}
    at = sorted(dense.find(s.rstrip("\x81")) for s in plain)
    assert len(at) > 40 and at[0] < 20_000 < 40_000 < at[-1]


def test_the_sample_is_whole_where_it_fits(spark):
    docs = spark.createDataFrame([(i, f"{WORDS} 10.0.0.{i} {WORDS} {i} {WORDS}") for i in range(20)],
                                 "doc_id long, text string")
    x, y = pii_crf.training_sample(docs, "doc_id", "text")
    rows = [r for d in docs.collect() for r in pii_crf.training_windows(str(d.doc_id), d.text)]
    assert len(x) == len(rows) and (y > 0).any(1).sum() == sum(r[1] for r in rows) >= 20
    assert sorted(bytes(c) for c in x.astype(np.uint8)) == sorted(r[2] for r in rows)
