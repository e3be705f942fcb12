"""Corpus operators against brute force, on small tables with awkward rows."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import (curriculum_mix, cutting_stock, deleted_interp, exact_dedup, host_reputation,
                           jaccard_groups, langid_ecoc, pii_crf, topk_hist, toxicity_subword)

DOCS = "doc_id long, text string, lang string, source string, _id string, _t string"


def frame(spark, texts, langs=None):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, (langs or ["en"] * len(texts))[i], f"s{i % 3}" if i % 7 else None, "x", "y")
                                  for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd_texts():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words, 40)) for _ in range(12)]
    near = [" ".join(b.split()[:-1] + ["changed"]) for b in base[:6]]
    return [None, "", "   ", "one", "Two words", *base, *base[:4], *near, "long " * 5000]


def test_exact_dedup_with_colliding_hash(spark, odd_texts):
    for hashed in (exact_dedup.md5_128, lambda t: F.pmod(F.length(t), F.lit(3)).cast("string").cast("binary")):
        got = exact_dedup.exact_dedup(frame(spark, odd_texts), keep="max", hash128=hashed).collect()
        plain = [t or "" for t in odd_texts]
        for r in got:
            same = [i for i, t in enumerate(plain) if t == plain[r.doc_id]]
            assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))
            assert r.text_sha256 == hashlib.sha256(plain[r.doc_id].encode()).hexdigest()
        assert len(got) == len(plain)
    kept = exact_dedup.keep_documents(frame(spark, odd_texts))
    assert kept.columns == frame(spark, odd_texts).columns
    assert kept.count() == len({t or "" for t in odd_texts})


def test_top_k_with_ties_nulls_and_nan(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 4).round(1)]) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(20)] + [(200, None), (201, [1.0, None, 0.0, 0.0]),
                                                           (202, [float("nan")] * 4), (203, [float("inf")] * 4)]
    got = topk_hist.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"),
                          F.col("vec_id") % 10 == 0, k=5).collect()
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows if i < 200}
    for q in [i for i in good if i % 10 == 0]:
        want = sorted(((-sum(a * b for a, b in zip(good[q], good[c])), c) for c in good if c != q))[:5]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert own == [(k + 1, c, -s) for k, (s, c) in enumerate(want)]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert topk_hist.top_k(few, F.col("vec_id") == 0).count() == 2
    assert topk_hist.top_k(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_lm_scores(spark, odd_texts):
    held = F.col("doc_id") % 4 == 0
    got = {r.doc_id: r for r in deleted_interp.lm_scores(frame(spark, odd_texts), held).collect()}
    tokens = [[*(t or "").encode().lower().split(), b""] for t in odd_texts]
    counts = Counter(w for i, t in enumerate(tokens) if i % 4 for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (i % 4 == 0, len(t), n)
        assert r.n_known == sum(counts[w] > 0 for w in t)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
        assert r.score < 0 and math.isfinite(r.score)
    assert deleted_interp.lm_scores(frame(spark, odd_texts).limit(0), held).count() == 0


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_components(spark, odd_texts, words, percent):
    got = {r.doc_id: r for r in jaccard_groups.jaccard_components(
        frame(spark, odd_texts), words=words, percent=percent).collect()}
    sets = []
    for t in odd_texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id) == (len(s), label[i])


def test_jaccard_many_near_copies(spark, monkeypatch):
    """More near copies than a group holds, some pairs linked and some not."""
    monkeypatch.setattr(jaccard_groups, "GROUP", 8)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(f"x{rng.integers(40)}" if rng.random() < 0.04 else w for w in base) for _ in range(90)]
    got = {r.doc_id: r.component_id for r in jaccard_groups.jaccard_components(
        frame(spark, texts), words=3, percent=80).collect()}
    sets = [set(zip(w, w[1:], w[2:])) for w in (t.split() for t in texts)]
    near = {(i, j) for i in range(90) for j in range(90) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    label = list(range(90))
    for _ in label:
        label = [min(label[j] for j in range(90) if (i, j) in near) for i in range(90)]
    assert [got[i] for i in range(90)] == label and 1 < len(set(label)) < 80


def test_group_links_are_a_forest():
    rng = np.random.default_rng(7)
    keys = [np.sort(rng.choice(40, 28, replace=False)).astype(np.uint64) for _ in range(30)]
    part = np.arange(30), keys
    got = jaccard_groups.group_links(part, part, 60)
    linked = {(i, j) for i in range(30) for j in range(30) if i != j and jaccard_groups.linked(keys[i], keys[j], 60)}
    assert 0 < len(got) < 30 and set(got) <= linked and len(linked) > 60
    label = {}
    for name, edges in (("own", got), ("all", linked)):
        label[name] = list(range(30))
        for _ in range(30):
            for i, j in edges:
                label[name][i] = label[name][j] = min(label[name][i], label[name][j])
    assert label["own"] == label["all"]


def test_pii_patterns_and_model(spark):
    text = "mail a.b@c.example.org now, ip 10.0.0.300 or 10.0.0.3, card 4111 1111 1111 1111, call +1 (555) 555-0100 é"
    spans = pii_crf.base_spans(text)
    assert [(pii_crf.KINDS[k], text[a:b]) for k, a, b in spans] == [
        ("email", "a.b@c.example.org"), ("ip", "10.0.0.3"), ("card", "4111 1111 1111 1111"),
        ("phone", "+1 (555) 555-0100")]
    clean = "nothing private here at all, just words. " * 20
    got = {r.doc_id: r for r in pii_crf.find_pii(frame(spark, [text, clean, None, ""] + [text] * 20)).collect()}
    assert [s.start for s in got[0].base] == [a for _, a, _ in spans]
    assert set(got[0].base) <= set(got[0].spans) and not any(got[i].spans for i in (1, 2, 3))


def test_host_reputation(spark):
    urls = ["https://A.good.org/fr/1"] * 30 + ["https://a.good.org/x", "http://bad.net?q", "http://x.bad.net/y", None,
                                               "nothing", "http://b.example.com/de/a", "http://new.good.org/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = [("block", "net", "/"), ("allow", "org", "/fr/"), ("block", "example.com", "/de/")]
    got = {r.page_id: r for r in host_reputation.judge_urls(pages, rules).collect()}
    assert len(got) == len(urls) and got[0].host == "a.good.org" and got[0].rule == "org/fr/"
    assert got[30].verdict == "allow" and got[31].rule is None and got[32].verdict == "block"
    assert (got[33].host, got[33].path) == ("", "") and got[35].verdict == "block"
    assert host_reputation.judge_urls(pages.limit(0), rules).count() == 0


def test_packing(spark, odd_texts):
    texts = [*odd_texts, "a  b", " lead", "x \n y", "<|endoftext|> z", "日本 語"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = cutting_stock.pack(frame(spark, texts), path, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    from tokenizers import Tokenizer
    tokenizer, filled = Tokenizer.from_file(path), {}
    for i, t in enumerate(texts):
        ids, at = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for p in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            at += p.length
            assert p.ids_crc32 == zlib.crc32(ids[p.start:at].tobytes())
            filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert at == len(ids)
    for s in filled.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert cutting_stock.pack(frame(spark, texts).limit(0), path).count() == 0


def test_packing_plan_is_tight():
    rng = np.random.default_rng(3)
    histogram = dict(Counter(int(x) for x in rng.integers(1, 513, 5000)))
    plan = cutting_stock.packing_plan(histogram, 1024)
    used = Counter()
    for pattern, copies in plan:
        assert sum(k * n for k, n in pattern.items()) <= 1024
        for k, n in pattern.items():
            used[k] += n * copies
    assert used == Counter(histogram)
    assert sum(c for _, c in plan) <= 1.01 * sum(k * n for k, n in histogram.items()) / 1024 + 1


def test_mixing(spark, odd_texts):
    rows = curriculum_mix.plan_mix(frame(spark, odd_texts)).collect()
    assert [r.size for r in sorted(rows, key=lambda r: r.doc_id)] == [len((t or "").split()) for t in odd_texts]
    total = sum(r.size for r in rows)
    targets = {(r.source_size, r.target) for r in rows}
    assert sum(t for _, t in targets) == pytest.approx(total) and all(t <= 3 * s + 1e-6 for s, t in targets)
    assert all(r.taken <= 3 * r.size and len(r.positions) == (r.taken // r.size if r.size else 0) for r in rows)
    mixed = curriculum_mix.mix_documents(frame(spark, odd_texts))
    assert mixed.columns == frame(spark, odd_texts).columns
    assert mixed.count() == sum(len(r.positions) for r in rows)
    # brute force: each whole row at its positions, in their order; a repeated row is a row of its own
    docs = frame(spark, odd_texts).select("*", F.lit(1).alias("_row"), F.lit(2).alias("_pos"))
    docs = docs.unionByName(docs.where("doc_id in (5, 6)"))
    own = {r.doc_id: r for r in docs.collect()}
    want = sorted((p, r.doc_id) for r in curriculum_mix.plan_mix(docs).collect() for p in r.positions)
    assert curriculum_mix.mix_documents(docs).collect() == [own[i] for _, i in want]
    assert curriculum_mix.mix_documents(docs.limit(0)).count() == 0
    assert curriculum_mix.plan_mix(frame(spark, odd_texts).limit(0)).count() == 0


def test_language_id(spark):
    rng = np.random.default_rng(4)
    stems = {"en": ["the", "thing", "other"], "de": ["schön", "und", "über"], "fr": ["été", "que", "avec"]}
    langs = [list(stems)[i % 3] for i in range(150)] + [None, "en"]
    texts = [" ".join(rng.choice(stems[x], 12)) for x in langs[:150]] + [None, "1234 !!"]
    docs = frame(spark, texts, langs)
    got = {r.doc_id: r for r in langid_ecoc.identify(docs, learn=F.col("doc_id") % 5 != 0).collect()}
    assert np.mean([got[i].lang_pred == langs[i] for i in range(0, 150, 5)]) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (150, 151))
    assert langid_ecoc.identify(docs.limit(0)).count() == 0


def test_toxicity_finds_misspellings(spark):
    rng = np.random.default_rng(5)
    calm = ["garden", "river", "music", "letter", "window", "summer", "paper", "silver"]
    toxic = [i % 2 for i in range(200)]
    texts = [" ".join([*rng.choice(calm, 10), *(["horrible", "idiot"] if y else [])]) for y in toxic]
    texts += ["garden river idiotic horribly", "garden river silver music", None, ""]
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity_subword.toxicity(frame(spark, texts), labels).collect()}
    assert got[200] > 0.5 > got[201] and all(0 <= s <= 1 for s in got.values()) and got[202] == got[203]
    assert len(got) == len(texts)
