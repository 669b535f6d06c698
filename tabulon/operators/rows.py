"""Row selections as values: None (all rows), a slice in normal form, or an array of positions; pure index algebra, no data."""

from __future__ import annotations

from typing import Any

import numpy as np


def resolve(key: Any, n: int) -> slice | np.ndarray:
    """A row key over ``n`` rows as range-like slice or int64 positions; negatives fold, out of range is an IndexError."""
    if isinstance(key, (int, np.integer)) and not isinstance(key, (bool, np.bool_)):
        i = int(key) + n if key < 0 else int(key)
        if not 0 <= i < n:
            raise IndexError(f"row {key} of {n}")
        return slice(i, i + 1, 1)
    if isinstance(key, slice):
        return slice(*key.indices(n))
    a = np.asarray(key)
    if a.ndim == 0 and a.dtype.kind in "iu":
        return resolve(int(a), n)
    if a.ndim != 1:
        raise IndexError("rows are selected by a one-dimensional index")
    if a.dtype.kind == "b":
        if len(a) != n:
            raise IndexError(f"a mask of {len(a)} for {n} rows")
        return np.flatnonzero(a)
    if not len(a):
        return np.zeros(0, np.int64)
    if a.dtype.kind not in "iu":
        raise IndexError(f"rows can't be selected by {a.dtype}")
    a = a.astype(np.int64)
    a = np.where(a < 0, a + n, a)
    if a.min() < 0 or a.max() >= n:
        raise IndexError(f"a row out of range 0..{n - 1}")
    return a


def length(rows: slice | np.ndarray | None, n: int) -> int:
    if rows is None:
        return n
    return len(range(rows.start, rows.stop, rows.step)) if isinstance(rows, slice) else len(rows)


def compose(rows: slice | np.ndarray | None, key: Any, n: int) -> slice | np.ndarray:
    """``key`` relative to what ``rows`` selects of ``n`` rows; a slice of a slice stays one."""
    inner = resolve(key, length(rows, n))
    if rows is None:
        return inner
    if isinstance(rows, slice):
        r = range(rows.start, rows.stop, rows.step)
        if isinstance(inner, slice):
            s = r[inner] if inner.stop >= 0 else r[inner.start :: inner.step]
            return slice(s.start, s.stop, s.step)
        return r.start + inner * r.step
    return rows[inner] if not isinstance(inner, slice) or inner.stop >= 0 else rows[inner.start :: inner.step]
