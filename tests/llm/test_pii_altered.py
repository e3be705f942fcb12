"""The model finds forms that no pattern finds, in texts it has not seen."""

import numpy as np

from fleetlens.llm import pii_crf

WORDS = "the report came on monday and everybody in the office read it before noon so we went on".split()


def sentences(seed, n, alter):
    """(text, hidden spans): each holds one span, rewritten where ``alter``, or harmless numbers."""
    rng = np.random.default_rng(seed)
    for i in range(n):
        d = [str(x) for x in rng.integers(0, 10, 16)]
        card = "".join(d[:15])
        card += next(c for c in "0123456789" if pii_crf.luhn(card + c))
        span = [f"{rng.choice(WORDS)}.{d[0]}{rng.choice(WORDS)}@{rng.choice(WORDS)}.example.org",
                ".".join(map(str, rng.integers(1, 255, 4))), " ".join(card[k:k + 4] for k in range(0, 16, 4)),
                f"+{1 + int(d[0])} {''.join(d[1:4])} {''.join(d[4:8])}{d[8]}{d[9]}"][i % 4]
        left, right = (" ".join(rng.choice(WORDS, 9)) for _ in "ab")
        if i % 3 == 2:
            yield f"{left} in {rng.integers(1900, 2030)} we sold {rng.integers(10, 10**7)} of item {d[0]}.{d[1]} {right}", []
            continue
        text = f"{left} {span} {right}"
        if alter:
            text, _, own = pii_crf.altered(str(i), text, pii_crf.base_spans(text))
            yield text, own
        else:
            yield text, []


def test_altered_spans_are_hidden_from_the_patterns():
    kinds = set()
    for text, own in sentences(1, 300, True):
        for kind, a, b in own:
            kinds.add(kind)
            assert pii_crf.valid(kind, text[a:b])
            assert not any(s < b and a < e for _, s, e in pii_crf.base_spans(text))
            assert pii_crf.hidden_form(text), text
    assert kinds == {0, 1, 2, 3}


def test_model_finds_held_out_forms(spark):
    train = [t for t, _ in sentences(2, 900, False)]
    held = list(sentences(3, 240, True))
    docs = spark.createDataFrame(list(enumerate(train + [t for t, _ in held])), "doc_id long, text string")
    # the held-out texts bring no window of their own: their spans are hidden, so they are no example
    got = {r.doc_id - len(train): r for r in pii_crf.find_pii(docs).collect()}
    right = found = hidden = 0
    for i, (text, own) in enumerate(held):
        base = [(s.kind, s.start, s.end) for s in got[i].base]
        assert base == [(pii_crf.KINDS[k], a, b) for k, a, b in sorted(pii_crf.base_spans(text))]
        added = {(s.kind, s.start, s.end) for s in got[i].spans} - set(base)
        want = {(pii_crf.KINDS[k], a, b) for k, a, b in own}
        right, found, hidden = right + len(added & want), found + len(added), hidden + len(want)
    print(right, found, hidden)
    assert hidden > 100 and right >= hidden / 2 and right >= 0.9 * found
