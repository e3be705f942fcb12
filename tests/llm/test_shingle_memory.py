"""Memory that the shingle sets of a block of texts hold after they are made."""

import gc

import numpy as np

from fleetlens.llm import jaccard_groups as J
from fleetlens.llm.jaccard_groups import shingle_sets


def test_vocabulary_of_a_block_is_freed_at_once():
    """The words of every block stayed in a reference cycle, so a worker grew with the texts it had read."""
    shingle_sets(["one two three four"])
    gc.collect()
    gc.disable()
    try:
        for i in range(20):
            shingle_sets([f"alpha{i} beta{i} gamma{i} delta{i}", None, ""])
        assert gc.collect() == 0
    finally:
        gc.enable()


def test_hash_ranges_hold_equal_shares_of_what_is_listed():
    """Ranges were even over the whole hash space, so those of its listed third held three times their keys."""
    hashes = np.random.default_rng(1).integers(0, 2 ** 64, 400_000, np.uint64, endpoint=False)
    for keys in (hashes[hashes < np.uint64(int(J.COUNTED * 2 ** 64))], hashes):  # long sets, sets of one shingle
        edges = J.range_edges(10, 90)
        assert edges[0] == 0 and (np.diff(edges.astype(object)) > 0).all()
        held = np.bincount(np.searchsorted(edges, keys, "right") - 1, minlength=len(edges))
        assert held.max() < 1.2 * len(keys) / 10
