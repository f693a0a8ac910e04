import numpy as np

from gridloom.llm.decontaminate import Block


def test_many_distinct_words():
    """Above 2,097,151 words the third power of the vocabulary is beyond 64 bits: no shingle may be lost."""
    n = 2_200_000
    block = Block([("ids", b" ".join(b"%x" % i for i in range(n)))])
    assert len(block.codes[3]) == n - 2 and block.codes[3].min() >= 0
    last = np.array([n - 3, n - 2, n - 1, 0, 1, 2, n - 1, n - 3], np.int64)
    found = block.code(last, 3)
    assert np.isin(found, block.codes[3]).tolist() == [True, False, False, True, False, False]
