"""The run-length index against suffixes compared one by one."""

import numpy as np
import pytest

from longitrack.llm import runindex


def longest_elsewhere(strings):
    places = [(s, i) for s, x in enumerate(strings) for i in range(len(x))]
    common = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    return [max((common(strings[s][i:], strings[t][j:]) for t, j in places if (t, j) != (s, i)), default=0) for s, i in places]


@pytest.mark.parametrize(("letters", "n", "size"), [(b"ab", 6, 30), (b"\x00\x01\xff", 5, 40), (b"abcdefgh", 8, 25), (b"a", 3, 30), (b"ab", 1, 1)])
def test_statistics(letters, n, size):
    rng = np.random.default_rng(len(letters) + n)
    strings = [bytes(rng.choice(list(letters), rng.integers(0, size + 1)).astype(np.uint8)) for _ in range(n)]
    strings += [strings[0], b"x" + strings[-1][3:]]
    index = runindex.build([np.frombuffer(x, np.uint8) for x in strings])
    assert index.statistics().tolist() == longest_elsewhere(strings)
    assert index.n == sum(map(len, strings)) and len(index.letters) == len(index.first) == len(index.last)


def test_order_and_runs():
    text = b"abracadabra" * 40
    data = np.frombuffer(text, np.uint8)
    order = runindex.suffix_order(data, len(text) - np.arange(len(text)))
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    index = runindex.build([data])
    # a text of 40 repeats has hardly more runs than one of two
    assert len(index.letters) < 25 and index.statistics().max() == len(text) - 11


def test_nothing():
    for strings in ([], [b""], [b"", b""]):
        assert runindex.build([np.frombuffer(x, np.uint8) for x in strings]).statistics().tolist() == []
