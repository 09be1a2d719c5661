"""Small sets are compared however many of their signs differ."""

import numpy as np

from quarry.llm import jaccard


def test_signs_do_not_part_small_sets():
    n = np.array([4, 5, 40, 40, 41, 41])
    signs = np.zeros((6, jaccard.SIGN_WORDS), np.uint64)
    signs[1::2] = np.uint64((1 << 64) - 1)
    fits = lambda i, j: bool(jaccard._fits(n, signs, np.array([i]), np.array([j]), 80)[0])
    assert fits(0, 1) and fits(2, 3)
    assert not fits(4, 5) and not fits(3, 4) and not fits(1, 2)
