"""One owner-free expression tree: what ``col()``, query strings and frame columns build, and what is lowered to Spark columns."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np


class QueryError(ValueError):
    """A predicate that can't be parsed or doesn't fit the columns."""


_SCALARS = (bool, int, float, str, bytes, np.generic)


def as_expr(x: Any) -> Expr:
    if isinstance(x, Expr):
        return x
    if isinstance(x, np.ndarray) and x.ndim == 0:
        x = x[()]
    if isinstance(x, _SCALARS):
        return Lit(x)
    if hasattr(x, "__expr__"):
        return x.__expr__()
    raise TypeError(f"{type(x).__name__} can't be part of an expression; attach arrays with assign()")


class Expr:
    """Base of all nodes; operators and NumPy functions build larger trees, nothing is evaluated."""

    __hash__ = None

    def columns(self) -> set[str]:
        return set().union(*(c.columns() for c in self.children()))

    def children(self) -> tuple[Expr, ...]:
        return ()

    def substitute(self, names: dict[str, Expr]) -> Expr:
        """The tree with columns replaced by the expressions they stand for."""
        return self

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; combine predicates with & | ~")

    def __iter__(self):
        raise TypeError("an expression can't be iterated")

    def __array__(self, *a, **k):
        raise TypeError("an expression holds no data; evaluate it through a frame")

    def __array_ufunc__(self, ufunc: np.ufunc, method: str, *inputs: Any, **kwargs: Any) -> Expr:
        if method != "__call__" or kwargs or ufunc.nout != 1 or ufunc.signature:
            raise TypeError(f"{ufunc.__name__}: only elementwise calls with one result, without keywords")
        return Ufunc(ufunc, tuple(map(as_expr, inputs)))

    def __array_function__(self, func: Any, types: Any, args: tuple, kwargs: dict) -> Expr:
        if func is np.where and len(args) == 3 and not kwargs:
            return Where(*map(as_expr, args))
        if func is np.clip and not set(kwargs) - {"a_min", "a_max", "min", "max"}:
            low = args[1] if len(args) > 1 else kwargs.get("a_min", kwargs.get("min"))
            high = args[2] if len(args) > 2 else kwargs.get("a_max", kwargs.get("max"))
            return as_expr(args[0]).clip(low, high)
        raise TypeError(f"{func.__name__} is not elementwise and can't be part of an expression")

    def isin(self, values: Any) -> Expr:
        return Isin(self, tuple(isin_values(values)))

    def round(self, decimals: int = 0) -> Expr:
        if not decimals:
            return Ufunc(np.rint, (self,))
        scale = Lit(10.0**decimals)
        return Ufunc(np.rint, (self * scale,)) / scale

    def clip(self, low: Any = None, high: Any = None) -> Expr:
        if low is None and high is None:
            raise ValueError("clip needs a bound")
        out = self if low is None else Ufunc(np.maximum, (self, as_expr(low)))
        return out if high is None else Ufunc(np.minimum, (out, as_expr(high)))

    def astype(self, dtype: Any) -> Expr:
        return Cast(self, np.dtype(dtype))

    def where(self, cond: Any, other: Any = np.nan) -> Expr:
        return Where(as_expr(cond), self, as_expr(other))


def isin_values(values: Any) -> list:
    if isinstance(values, (str, bytes)) or not hasattr(values, "__iter__"):
        raise TypeError("isin takes a list, set, tuple or array")
    return [v.item() if isinstance(v, np.generic) and v.dtype.kind in "biufSU" else v for v in values]


def _binary(name: str, ufunc: np.ufunc) -> None:
    setattr(Expr, f"__{name}__", lambda a, b, u=ufunc: Ufunc(u, (a, as_expr(b))))
    setattr(Expr, f"__r{name}__", lambda a, b, u=ufunc: Ufunc(u, (as_expr(b), a)))


for _n, _u in {"add": np.add, "sub": np.subtract, "mul": np.multiply, "truediv": np.true_divide, "floordiv": np.floor_divide, "mod": np.remainder, "pow": np.power, "and": np.bitwise_and, "or": np.bitwise_or, "xor": np.bitwise_xor, "lshift": np.left_shift, "rshift": np.right_shift}.items():
    _binary(_n, _u)
for _n, _u in {"lt": np.less, "le": np.less_equal, "gt": np.greater, "ge": np.greater_equal, "eq": np.equal, "ne": np.not_equal}.items():
    setattr(Expr, f"__{_n}__", lambda a, b, u=_u: Ufunc(u, (a, as_expr(b))))
for _n, _u in {"neg": np.negative, "pos": np.positive, "abs": np.absolute, "invert": np.invert}.items():
    setattr(Expr, f"__{_n}__", lambda a, u=_u: Ufunc(u, (a,)))


@dataclass(eq=False, repr=True)
class Col(Expr):
    name: str

    def columns(self) -> set[str]:
        return {self.name}

    def substitute(self, names: dict[str, Expr]) -> Expr:
        return names.get(self.name, self)


@dataclass(eq=False)
class Lit(Expr):
    value: Any


@dataclass(eq=False)
class Ufunc(Expr):
    ufunc: np.ufunc
    args: tuple[Expr, ...]

    def children(self) -> tuple[Expr, ...]:
        return self.args

    def substitute(self, names: dict[str, Expr]) -> Expr:
        return Ufunc(self.ufunc, tuple(a.substitute(names) for a in self.args))


@dataclass(eq=False)
class Cast(Expr):
    arg: Expr
    dtype: np.dtype

    def children(self) -> tuple[Expr, ...]:
        return (self.arg,)

    def substitute(self, names: dict[str, Expr]) -> Expr:
        return Cast(self.arg.substitute(names), self.dtype)


@dataclass(eq=False)
class Isin(Expr):
    arg: Expr
    values: tuple

    def children(self) -> tuple[Expr, ...]:
        return (self.arg,)

    def substitute(self, names: dict[str, Expr]) -> Expr:
        return Isin(self.arg.substitute(names), self.values)


@dataclass(eq=False)
class Where(Expr):
    cond: Expr
    a: Expr
    b: Expr

    def children(self) -> tuple[Expr, ...]:
        return self.cond, self.a, self.b

    def substitute(self, names: dict[str, Expr]) -> Expr:
        return Where(*(c.substitute(names) for c in self.children()))


@dataclass(eq=False)
class Apply(Expr):
    """A vectorised user function over NumPy batches; ``dtype`` declared or found by calling it on empty arrays."""

    func: Any
    args: tuple[Expr, ...]
    dtype: np.dtype | None = None

    def children(self) -> tuple[Expr, ...]:
        return self.args

    def substitute(self, names: dict[str, Expr]) -> Expr:
        return Apply(self.func, tuple(a.substitute(names) for a in self.args), self.dtype)


def col(name: str) -> Col:
    """A column by name, for predicates and derived columns of any table."""
    return Col(name)


def probe(e: Expr, dtypes: dict[str, np.dtype]) -> np.dtype:
    """NumPy's result dtype: the tree evaluated on empty arrays."""
    return np.asarray(_empty(e, dtypes)).dtype


def _empty(e: Expr, dtypes: dict[str, np.dtype]) -> Any:
    if isinstance(e, Col):
        if e.name not in dtypes:
            raise KeyError(f"no column {e.name!r}")
        return np.empty(0, dtypes[e.name])
    if isinstance(e, Lit):
        return e.value
    if isinstance(e, Ufunc):
        args = [_empty(a, dtypes) for a in e.args]
        if e.ufunc.nin == 2 and e.ufunc in _COMPARE:
            args = _align(args)
        return e.ufunc(*args)
    if isinstance(e, Cast):
        return np.asarray(_empty(e.arg, dtypes)).astype(e.dtype)
    if isinstance(e, Isin):
        _empty(e.arg, dtypes)
        return np.empty(0, bool)
    if isinstance(e, Where):
        cond, a, b = (_empty(c, dtypes) for c in e.children())
        if not any(np.ndim(x) for x in (cond, a, b)):
            raise TypeError("where() of scalars only")
        return np.where(cond, a, b)
    if e.dtype is not None:
        return np.empty(0, e.dtype)
    out = np.asarray(e.func(*(np.atleast_1d(np.asarray(_empty(a, dtypes)))[:0] for a in e.args)))
    if out.ndim != 1 or len(out):
        raise ValueError("the function returned another shape than its arguments'")
    if out.dtype.kind == "O":
        raise TypeError("the function returned objects")
    return out


_COMPARE = {np.less, np.less_equal, np.greater, np.greater_equal, np.equal, np.not_equal}


def _align(args: list) -> list:
    """Text against bytes: the literal takes the column's kind."""
    kinds = [np.asarray(a).dtype.kind for a in args]
    if set(kinds) == {"S", "U"}:
        return [a.encode() if isinstance(a, str) else a.decode() if isinstance(a, bytes) else np.asarray(a).astype("U") if np.asarray(a).dtype.kind == "S" and np.ndim(args[1 - i]) else a for i, a in enumerate(args)]
    return args
