import numpy as np
import pytest

from tabulon.operators import rows as R

N = 50
KEYS = [3, -1, slice(None), slice(10, 2, -3), slice(None, None, 7), slice(45, 300), slice(5, 5), slice(None, None, -1), [7, 7, 1, -2], [], np.arange(N) % 3 == 0]


def pick(rows, n=N):
    a = np.arange(n)
    if isinstance(rows, slice):
        return a[[*range(rows.start, rows.stop, rows.step)]] if R.length(rows, n) else a[:0]
    return a[rows]


@pytest.mark.parametrize("key", KEYS, ids=str)
def test_resolve(key):
    want = np.arange(N)[key] if not (isinstance(key, list) and not key) else np.arange(0)
    assert pick(R.resolve(key, N)).tolist() == np.atleast_1d(want).tolist()


@pytest.mark.parametrize("first", KEYS[2:], ids=str)
@pytest.mark.parametrize("second", [slice(None, None, 2), slice(None, None, -1), slice(3, 1, -1), [0, -1, 0], slice(1, 4)], ids=str)
def test_compose(first, second):
    base = np.arange(N)[first] if not (isinstance(first, list) and not first) else np.arange(0)
    if isinstance(second, list) and not len(base):
        with pytest.raises(IndexError):
            R.compose(R.resolve(first, N), second, N)
        return
    assert pick(R.compose(R.resolve(first, N), second, N)).tolist() == base[second].tolist()


def test_errors():
    for bad in (50, -51, [50], np.ones(3, bool), np.ones((2, 2), int), [0.5]):
        with pytest.raises(IndexError):
            R.resolve(bad, N)
