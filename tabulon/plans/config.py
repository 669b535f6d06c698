"""Settings that mean something on Spark; hardware ones are accepted and do nothing."""

from __future__ import annotations

from typing import Any

_values: dict[str, Any] = {"default_memory_budget": "32 MiB", "preview_rows": 10, "preview_precision": 6, "preview_memory_limit": "256 MiB", "max_workers": None, "convert_auto_workers": 8}
_ignored = ("gather_thread_cap", "gather_binding", "gather_bind_llc_margin", "prefetch_distance", "mask_density_gate", "multifile_mask_density_gate", "default_madvise", "default_backend", "numa_policy", "write_method")


def _pair(name: str, used: bool) -> None:
    def getter() -> Any:
        return _values.get(name)

    def setter(value: Any) -> None:
        if used and name in ("preview_rows", "preview_precision", "convert_auto_workers") and (isinstance(value, bool) or not isinstance(value, int) or value < 0):
            raise ValueError(f"{name} is a number")
        _values[name] = value

    globals()[f"get_{name}"], globals()[f"set_{name}"] = getter, setter


for _n in _values.copy():
    _pair(_n, True)
for _n in _ignored:
    _pair(_n, False)
