"""Jaccard components and near-duplicate removal where ids repeat."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from fleetlens.llm import jaccard_groups
from tests.conftest import SF_SMALL

DOCS = "doc_id long, text string, _id string, _d string"


def planted():
    """Rows (id, text): id 7 at several clean texts, one of them near a text of id 3, and more."""
    rng = np.random.default_rng(9)
    a, b, d, e, f = (" ".join(f"{k}{i}" for i in rng.permutation(60)) for k in "abdef")
    near = {t: t.rsplit(" ", 1)[0] + " changed" for t in (b, e, f)}
    return [(7, a), (7, b), (3, near[b]), (7, d),
            (9, e), (9, near[e]),  # near copies under one id
            (5, f), (5, f.upper()), (6, near[f]), (5, a + " " + d),  # one set in two texts
            (None, b), (7, ""), (8, None)]


def brute(rows, words, percent):
    """Component of each row's set, as the index of one of its rows."""
    sets = [set(zip(*[(t or "").lower().split()[k:] for k in range(words)])) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and rows[i][0] is not None and rows[j][0] is not None \
                        and 100 * len(x & y) >= percent * len(x | y):
                    label[i] = label[j] = min(label[i], label[j])
    return label


@pytest.mark.parametrize("collide", [False, True])
def test_repeated_ids_link_nothing(spark, monkeypatch, collide):
    key = jaccard_groups.set_key
    if collide:  # the first salt gives all sets one key
        monkeypatch.setattr(jaccard_groups, "set_key",
                            lambda fp, i, salt: key(fp, i, salt) if salt else F.lit(1).cast("long"))
    rows = planted()
    docs = spark.createDataFrame([(*r, "x", "y") for r in [*rows, *rows[:2]]], DOCS)  # and repeated rows
    got = sorted((str(r.doc_id), str(r.component_id)) for r in jaccard_groups.jaccard_components(
        docs, words=5, percent=80).collect())
    label = brute(rows, 5, 80)
    least = {k: min((i for i, _ in [r for r, m in zip(rows, label) if m == k] if i is not None), default=None)
             for k in set(label)}
    want = [(str(i), str(least[k])) for (i, _), k in zip(rows, label)]
    assert got == sorted(want + want[:2])


def test_near_duplicates_keep_one_row_of_each_component(spark):
    rows = planted()
    got = P.near_duplicates(spark, spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS), SF_SMALL)
    assert got.columns == ["doc_id", "text", "_id", "_d"]
    got = [(r.doc_id, r.text) for r in got.collect()]
    label = brute(rows, 5, 80)
    for k in set(label):
        members = [r for r, m in zip(rows, label) if m == k]
        stay = [r for r in got if r in members]
        assert len(stay) == 1 and stay[0][0] == min((i for i, _ in members), key=lambda i: (i is None, i))
    assert len(got) == len(set(label)) and (7, rows[0][1]) in got and (7, rows[1][1]) not in got
