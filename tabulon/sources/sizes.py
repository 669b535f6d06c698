"""Byte sizes in words, and how many rows fit in one."""

from __future__ import annotations

import re

import numpy as np

_UNITS = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12, "ki": 2**10, "mi": 2**20, "gi": 2**30, "ti": 2**40}


def parse_bytes(size: int | str) -> int:
    """'32 MiB' is 2**20-based, '4MB' and '4M' decimal; one byte at least."""
    if isinstance(size, bool) or not isinstance(size, (int, str)):
        raise TypeError("a size is a number of bytes or a string")
    if isinstance(size, int):
        out = size
    else:
        m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kmgt]i?)?b?\s*", size, re.I)
        if not m:
            raise ValueError(f"not a size: {size!r}")
        out = int(float(m[1]) * _UNITS[(m[2] or "").lower()])
    if out < 1:
        raise ValueError("a size is one byte at least")
    return out


def row_bytes(dtypes: dict[str, np.dtype]) -> int:
    return max(1, sum(t.itemsize or 16 for t in dtypes.values()))


def batch_rows(batch_size: int | str | None, dtypes: dict[str, np.dtype]) -> int:
    """Rows of a batch: an int is rows, a string bytes, None the configured memory budget."""
    from ..plans.config import get_default_memory_budget

    if isinstance(batch_size, bool):
        raise TypeError("batch_size is rows or a byte size")
    if isinstance(batch_size, int):
        if batch_size < 1:
            raise ValueError("a batch has one row at least")
        return batch_size
    return max(1, parse_bytes(get_default_memory_budget() if batch_size in (None, "auto") else batch_size) // row_bytes(dtypes))
