from collections import Counter

import numpy as np
import pytest

from coclave.llm.phrases import distinct


@pytest.mark.parametrize("most", [(1 << 64) - 1, 50])
def test_distinct_pairs(most):
    rng = np.random.default_rng(5)
    one = rng.integers(0, most, 300, np.uint64, True)[rng.integers(0, 300, 2000)]
    for two in (one + np.uint64(1), rng.integers(0, 3, len(one), np.uint64)):
        first, count = distinct(one, two)
        assert dict(zip(zip(one[first], two[first], strict=True), count, strict=True)) == Counter(zip(one, two, strict=True))
        assert len(first) == len(set(zip(one, two, strict=True)))
    assert [len(x) for x in distinct(one[:0], one[:0])] == [0, 0]
    assert [list(x) for x in distinct(one[:1], one[:1])] == [[0], [1]]
