"""Closed syncmer fingerprints against a plain reading of their definition."""

import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from fleetlens.llm import closed_syncmers as C


def plain_units(text):
    out = []
    for u in text.split(" "):
        if u:
            out += [u] if len(u.encode()) <= C.UNIT_BYTES else re.findall(C.UNIT, u)
    return out


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def plain_places(units):
    """Where anchors begin; inner substrings by a chain of 64-bit hashes, as Spark's xxhash64 does."""
    def h(us):
        seed = 42
        for u in us:
            seed = xxhash.xxh64(u.encode(), seed=seed).intdigest()
        return signed(seed)
    out = []
    for p in range(len(units) - C.K + 1):
        inner = [h(units[p + j:p + j + C.S]) for j in range(C.WINDOW)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(p)
    return out


TEXTS = [(5, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3), (1, None), (2, ""), (3, "one  two three"),
         (4, "x" * 200 + "日本語テキスト" * 20 + " tail é😀 words of the text go on and on until here it ends"),
         (6, "a a a a a a a a a a a a a a a a a a a a"), (7, "   "), (None, "null id text with some more words in it than nine"),
         (8, "same text twice " * 9), (8, "same text twice " * 9), (8, "other text " * 12), (9, "quick brown fox jumps " * 50)]


def expected(rows):
    """Per row in order: id, n, edited text, next id, by the definition."""
    def key(r):
        head = "" if r[0] is None else f"={r[0]}"
        return (r[0] is not None, r[0] or 0, hashlib.sha256((head + "\0" + (r[1] or "")).encode()).digest())
    rows = sorted(rows, key=key)
    out = []
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)]
        e = len(t) // 4
        out.append((d, len(t), t[:len(t) - e] + (nxt[1] or "")[:e], nxt[0], t, nxt[1] or ""))
    return out


def test_anchor_places(spark):
    rows = [(i, t or "") for i, (_, t) in enumerate(TEXTS)]
    got = dict(spark.createDataFrame(rows, "i int, text string").select("i", F.size(C.anchors(F.col("text")))).collect())
    for i, t in rows:
        us = plain_units(t)
        want = len(plain_places(us)) if len(us) >= C.K else int(t != "")
        assert got[i] == want, (i, got[i], want)


def test_rows_edits_and_likeness(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("_h", F.lit(1)).withColumn("fingerprint", F.lit("x"))
    got = sorted(map(str, ((r.doc_id, r.n_chars, r.edited_sha256, r.next_id) for r in C.fingerprints(docs).collect())))
    want = expected(TEXTS)
    assert got == sorted(str((d, n, hashlib.sha256(e.encode()).hexdigest(), x)) for d, n, e, x, _, _ in want)
    prints = {r[0]: r[1] for r in spark.createDataFrame(
        [(s,) for w in want for s in (w[2], w[4])], "t string").distinct().select("t", C.written(C.anchors(F.col("t")))).collect()}
    for r in C.fingerprints(docs).collect():
        same = [w for w in want if w[0] == r.doc_id and w[3] == r.next_id and hashlib.sha256(w[2].encode()).hexdigest() == r.edited_sha256]
        _, _, e, _, t, x = same[0]
        assert (r.fingerprint, r.edited_fingerprint) == (prints[t], prints[e])

        def alike(a, b):
            a, b = set(prints.get(a, "").split()), set(prints[b].split())
            return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
        assert abs(r.near_edited - alike(t, e)) < 1e-12 and abs(r.near_next - alike(t, x)) < 1e-12


def test_anchors_do_not_depend_on_context(spark):
    core = " ".join(f"w{i * 7919 % 97}" for i in range(80))
    a, b = (r[0] for r in spark.createDataFrame([(0, "left side of it " + core,), (1, core + " and what follows after",)], "i int, t string")
            .orderBy("i").select(C.anchors(F.col("t"))).collect())
    inner = len(plain_places(plain_units(core)))
    assert len(set(a) & set(b)) >= min(inner, len(set(a))) - 2


def test_empty_single_and_string_ids(spark):
    assert C.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = C.fingerprints(spark.createDataFrame([("k", "abcdefgh")], "doc_id string, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1.0


def test_many_copies_of_a_row(spark):
    docs = spark.createDataFrame([(1, "t " * 40)] * 2500 + [(2, "u " * 40)], "doc_id long, text string")
    out = C.fingerprints(docs).groupBy("doc_id", "next_id").count().collect()
    assert sorted(tuple(r) for r in out) == [(1, 1, 2499), (1, 2, 1), (2, 1, 1)]
