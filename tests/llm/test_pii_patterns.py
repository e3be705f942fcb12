"""The searches for personal data equal the plain patterns, and long runs cost what they are long."""

import time

import numpy as np
import pytest

from fleetlens.llm import pii_crf


def plain(text):
    out = [(0, m.start(), m.end()) for m in pii_crf.EMAIL.finditer(text)]
    for kind, pattern in ((1, pii_crf.IP), (2, pii_crf.CARD), (3, pii_crf.PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if pii_crf.valid(kind, m.group())]
    return out


@pytest.mark.parametrize("letters", ["a@b.c_", "12.3", "1@.a-é ", "+1 (2).-", "0123456789.", "4111 -.@+"])
def test_searches_equal_the_patterns(letters):
    rng = np.random.default_rng(len(letters))
    for _ in range(4000):
        text = "".join(rng.choice(list(letters), rng.integers(1, 40)))
        assert pii_crf.base_spans(text) == plain(text), text


def test_neighbouring_matches():
    text = "a@b.c_d@e.f x@@y.z @q.r 1.2.3.4.5.6.7.8 1.2.3.4444"
    assert pii_crf.base_spans(text) == plain(text)
    assert [text[a:b] for _, a, b in pii_crf.emails(text)] == ["a@b.c", "_d@e.f"]


@pytest.mark.parametrize("unit", ["7", "1.", "a", "a@", "ab.", "+1 ", "1 ", "@b.", "(", "1.1.1."])
def test_long_runs(unit):
    text = unit * (2_000_000 // len(unit))
    start = time.process_time()
    pii_crf.base_spans(text + "@-")
    assert time.process_time() - start < 10
