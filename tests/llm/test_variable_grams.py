"""Spelling variants: bounds, list merging and roots against brute force."""

import itertools
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import variable_grams as V


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def dictionary_of(words, least=2):
    c = Counter()
    for w in words:
        s = V.HEAD + w + V.TAIL
        for q in range(V.Q_MIN, V.Q_MAX + 1):
            c.update(s[i:i + q] for i in range(len(s) - q + 1))
    return V.Dictionary({g: n for g, n in c.items() if len(g) == V.Q_MIN or n >= least})


word = st.text("abcé", min_size=5, max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(word, min_size=2, max_size=25), word, st.integers(1, 4), st.data())
def test_words_one_edit_apart_meet(words, w, least, data):
    i = data.draw(st.integers(0, len(w) - 1))
    c = data.draw(st.sampled_from("abcéz"))
    other = data.draw(st.sampled_from([w[:i] + c + w[i + 1:], w[:i] + c + w[i:], w[:i] + w[i + 1:]]))
    if other == w or len(other) < 5:
        return
    d = dictionary_of([*words, w, other], least)
    a, b = sorted((w, other), key=len)
    roles = ("=", "=") if len(a) == len(b) else ("<", ">")
    keys = [{k for r, k in d.lists(x) if r == role} for x, role in zip((a, b), roles)]
    assert keys[0] & keys[1]


@settings(max_examples=200, deadline=None)
@given(st.lists(word, min_size=1, max_size=25), st.integers(1, 3))
def test_the_bound_leaves_a_gram(words, least):
    d = dictionary_of(words, least)
    for w in words:
        s, q = V.HEAD + w + V.TAIL, V.longest(len(w))
        spans = d.decompose(s, q)
        assert max(d.affected(s, spans, q)) < len(spans)
        # as the definition counts them, edit by edit
        for inserted in (False, True):
            most = 0
            for i in range(1, len(s) if inserted else len(s) - 1):
                behind = i if inserted else i + 1
                first = next((p for p in range(max(0, i - q + 1), i) if s[p:i] in d.begins[q]), i)
                last = next((e for e in range(min(len(s), behind + q - 1), behind, -1) if s[behind:e] in d.ends[q]), behind)
                most = max(most, sum(not ((e <= i and p < first) or (p >= behind and e > last)) for p, e in spans))
            assert d.affected(s, spans, q)[inserted] == most


def test_one_edit_changes_two_letters_at_most():
    for a, b in (("abcde", "abxde"), ("abcde", "abcdéf"[:5]), ("abcde", "abcdef"), ("abcde", "abde")):
        assert bin(V.letters(a) ^ V.letters(b)).count("1") <= 2


def test_near_words_by_brute_force(spark):
    rng = random.Random(7)
    words = {"".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 9))) for _ in range(500)}
    for w in list(words)[:250]:
        i = rng.randrange(len(w))
        words |= {x for x in (w[:i] + w[i + 1:], w[:i] + "x" + w[i:], w[:i] + "z" + w[i + 1:]) if len(x) >= 5}
    rows = [(w, rng.randint(3, 50)) for w in sorted(words)]
    got = {(r.word, r.other) for r in V.near_words(spark.createDataFrame(rows, "word string, n long")).collect()}
    n = sorted(words)
    assert got == {p for a, b in itertools.combinations(n, 2) if one_edit(a, b) for p in ((a, b), (b, a))}


def test_forms_roots_and_defined_cases(spark):
    chain = ["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaabb"] * 12 + ["aabbb"] * 24 + ["qqqqqq"] * 3
    docs = spark.createDataFrame([(None, " ".join(chain)), (1, None), (2, ""), (3, "ab 12 - ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ")],
                                 "doc_id long, text string")
    words = {r.word: r.n for r in V.corpus_words(docs).collect()}
    out = {r.word: r for r in V.spelling_variants(docs).collect()}
    assert set(out) == set(words) and "ÀÉÎÕÜ" in out
    assert out["aaaaa"].form == "aaaab" and out["aaaaa"].root == "aabbb" and out["aabbb"].form is None
    assert out["qqqqqq"].n_near == 0 and out["qqqqqq"].root == "qqqqqq" and out["aaaab"].n_near == 2
    assert V.spelling_variants(docs.where("doc_id = 1")).collect() == []
    assert V.spelling_variants(docs.where("false")).collect() == []
