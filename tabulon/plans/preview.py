"""Previews of tables and views: the first rows as text or HTML."""

from __future__ import annotations

import html as _html
import warnings
from typing import Any

import numpy as np

from . import config

COLUMNS, CELL = 20, 32


def _cell(v: Any) -> str:
    if isinstance(v, (float, np.floating)):
        s = f"{v:.{config.get_preview_precision()}f}".rstrip("0").rstrip(".") if np.isfinite(v) else str(v)
    else:
        s = str(v)
    return s if len(s) <= CELL else s[: CELL - 1] + "…"


def _cells(view: Any) -> tuple[list[str], list[list[str]]]:
    names = view.columns[:COLUMNS]
    got = view[: config.get_preview_rows()].dict()
    return names, [[_cell(got[n][i]) for n in names] for i in range(len(next(iter(got.values()))))]


def aligned(names: list[str], rows: list[list[str]]) -> str:
    """Cells as lines of text, columns to the right."""
    widths = [max(map(len, c)) for c in zip(names, *rows, strict=True)]
    return "\n".join("  ".join(x.rjust(w) for x, w in zip(r, widths, strict=True)) for r in (names, *rows))


def html_table(names: list[str], rows: list[list[str]]) -> str:
    row = lambda r, t: "<tr>" + "".join(f"<{t}>{_html.escape(x)}</{t}>" for x in r) + "</tr>"
    return "<table>" + row(names, "th") + "".join(row(r, "td") for r in rows) + "</table>"


def _too_large(view: Any) -> bool:
    """Whether the rows of a preview would take more than the limit; says so once if they would."""
    from ..sources.sizes import parse_bytes, row_bytes

    need = row_bytes(view.dtypes) * config.get_preview_rows()
    if need > parse_bytes(config.get_preview_memory_limit()):
        warnings.warn(f"a preview of {need} bytes is over the limit; set preview_rows or preview_memory_limit", ResourceWarning, stacklevel=4)
        return True
    return False


def text(view: Any) -> str:
    kinds = ", ".join(f"{n}: {t}" for n, t in list(view.dtypes.items())[:COLUMNS])
    if view._predicate is not None:
        return f"<lazy selection: {kinds}; evaluate() finds its rows>"
    shape = f"[{view.n_rows} rows x {view.n_columns} columns]"
    return f"<{kinds}> {shape}" if _too_large(view) else f"{aligned(*_cells(view))}\n{shape}"


def html(view: Any) -> str:
    if view._predicate is not None or _too_large(view):
        return f"<pre>{_html.escape(text(view))}</pre>"
    return f"{html_table(*_cells(view))}<p>{view.n_rows} rows, {view.n_columns} columns</p>"
