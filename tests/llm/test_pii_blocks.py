"""Decoding of long regions of the PII operator: the same in blocks, in bounded memory."""

import tracemalloc

import numpy as np

from fleetlens.llm import pii_crf


def model():
    m = pii_crf.new_model()
    m["move"] = np.random.default_rng(2).normal(0, 1, m["move"].shape)
    return m


def codes(lengths):
    rng = np.random.default_rng(3)
    return [rng.integers(32, 127, n).astype(np.uint8) for n in lengths]


def test_blocks_give_what_one_pass_gives(monkeypatch):
    m, regions = model(), codes([1, 64, 65, 95, 96, 97, 128, 129, 320, 500, 1000, 1023, 1025])
    whole = {i: (t, p) for i, t, p in pii_crf.decode(m, regions)}
    for i, c in enumerate(regions):  # and the dense formula
        e = np.concatenate([pii_crf.blend(m, [c])[0][:, None], pii_crf.END])
        alpha, beta, z = pii_crf.crf(e, m["move"])
        t = whole[i][0].astype(int)
        assert np.allclose(np.exp(alpha + beta - z[None, :, None])[np.arange(len(c)), 0, t], whole[i][1])
        path = e[np.arange(len(c)), 0, t].sum() + m["move"][t[:-1], t[1:]].sum() + m["move"][t[-1], 0]
        assert np.isclose(path, pii_crf.best_paths(e, m["move"])[0].max())
    for block in (64, 96, 320):
        monkeypatch.setattr(pii_crf, "BLOCK", block)
        monkeypatch.setattr(pii_crf, "BATCH_CHARS", 700)
        got = {i: (t, p) for i, t, p in pii_crf.decode(m, regions)}
        assert sorted(got) == list(range(len(regions)))
        for i in got:
            assert (got[i][0] == whole[i][0]).all() and np.allclose(got[i][1], whole[i][1], atol=1e-9)


def test_a_long_region_beside_short_ones_needs_little_memory():
    m, regions = model(), codes([100] * 63 + [20_000])
    tracemalloc.start()
    done = [i for i, *_ in pii_crf.decode(m, regions)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(done) == list(range(64)) and peak < 60e6  # padded to the longest: 92 MB for each of four arrays
