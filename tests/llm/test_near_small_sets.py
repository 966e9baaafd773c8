import numpy as np

from tipoff.llm.near_dedup import links


def test_small_sets_at_the_threshold_are_linked():
    """Sets of 4 and 5 shingles with a similarity of 0.8 exactly, in groups of four sets."""
    rng = np.random.default_rng(11)
    missed = 0
    for _ in range(1000):
        a, b = (np.sort(rng.integers(0, 1 << 64, 5, np.uint64)) for _ in range(2))
        missed += {(0, 1), (2, 3)} != set(links([a, np.delete(a, rng.integers(5)), b, np.delete(b, rng.integers(5))], np.zeros(4, int), 80))
    assert missed == 0
