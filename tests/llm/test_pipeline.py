"""The pipeline's stages against what each of them must keep."""

import corpus_pipeline as P
from tests.conftest import SF_SMALL


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    for _, stage in P.STAGES[:3]:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.columns == columns
    kept = docs.collect()
    texts = {r.text for r in rows}
    assert len({r.text for r in kept}) == len(kept) <= len(texts)
    last = {r.text: max(x.doc_id for x in rows if x.text == r.text) for r in kept}
    assert all(last[r.text] == r.doc_id for r in kept)
    pieces = P.STAGES[4][1](spark, P.STAGES[3][1](spark, docs, SF_SMALL), SF_SMALL)
    assert "sequence_id" in pieces.columns and pieces.count() > 0
