"""Expressions to Spark columns with NumPy's scalar semantics.

Every rule says in built-in functions what NumPy computes where Spark differs: NaN in comparisons, division by zero, floored
modulo, integer power, logarithms outside their domain, NaN in minima, rounding of floats. What has no built-in form becomes
an Arrow-batched call of the ufunc itself.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import _COMPARE, Apply, Cast, Col, Expr, Isin, Lit, Ufunc, Where, probe
from .types import spark_type

NAN, INF = float("nan"), float("inf")


def lower(e: Expr, dtypes: dict[str, np.dtype], leaf: Callable[[str], Column] = F.col) -> Column:
    """The column that computes ``e``; its type is that of NumPy's result."""
    return _Lowering(dtypes, leaf).typed(e)


class _Lowering:
    def __init__(self, dtypes: dict[str, np.dtype], leaf: Callable[[str], Column]):
        self.dtypes, self.leaf = dtypes, leaf

    def kind(self, e: Expr) -> np.dtype:
        return np.dtype(type(e.value)) if isinstance(e, Lit) and not isinstance(e.value, np.generic) and isinstance(e.value, (bool, int, float)) else probe(e, self.dtypes)

    def typed(self, e: Expr) -> Column:
        if isinstance(e, Col):
            return self.leaf(e.name)
        return self.raw(e).cast(spark_type(_storable(probe(e, self.dtypes))))

    def number(self, e: Expr, like: np.dtype) -> Column:
        """An operand in the type that the operation works in."""
        c = self.raw(e)
        return c.cast("int").cast(spark_type(like)) if self.kind(e).kind == "b" and like.kind != "b" else c.cast(spark_type(_storable(like)))

    def raw(self, e: Expr) -> Column:
        if isinstance(e, Col):
            return self.leaf(e.name)
        if isinstance(e, Lit):
            v = e.value.item() if isinstance(e.value, np.generic) else e.value
            return F.lit(bytearray(v)) if isinstance(v, bytes) else F.lit(v)
        if isinstance(e, Cast):
            return self.cast(e)
        if isinstance(e, Isin):
            return self.isin(e)
        if isinstance(e, Where):
            out = _storable(probe(e, self.dtypes))
            return F.when(self.truth(e.cond), self.number(e.a, out)).otherwise(self.number(e.b, out))
        if isinstance(e, Apply):
            return self.python(e.func, e.args, probe(e, self.dtypes), e.dtype is not None)
        return self.ufunc(e)

    def truth(self, e: Expr) -> Column:
        return self.raw(e) if self.kind(e).kind == "b" else self.raw(e) != F.lit(0)

    def cast(self, e: Cast) -> Column:
        have, c = self.kind(e.arg), self.raw(e.arg)
        if have.kind == "f" and e.dtype.kind in "iub":
            c = F.when(F.isnan(c), F.lit(False if e.dtype.kind == "b" else 0)).otherwise(c != 0 if e.dtype.kind == "b" else c.cast(spark_type(e.dtype)))
        elif have.kind == "b" and e.dtype.kind in "iuf":
            c = c.cast("int")
        elif e.dtype.kind == "S" and have.kind == "U":
            c = c.cast("binary")
        return c.cast(spark_type(_storable(e.dtype)))

    def isin(self, e: Isin) -> Column:
        c, have = self.raw(e.arg), self.kind(e.arg)
        values = [v for v in e.values if not (isinstance(v, float) and np.isnan(v))]
        if have.kind in "SU":
            values = [v.encode() if have.kind == "S" and isinstance(v, str) else v.decode() if have.kind == "U" and isinstance(v, bytes) else v for v in values]
        if not values:
            return F.lit(False)
        hit = c.isin([bytearray(v) if isinstance(v, bytes) else v for v in values])
        return F.coalesce(hit & ~F.isnan(c) if have.kind == "f" else hit, F.lit(False))

    def ufunc(self, e: Ufunc) -> Column:
        u, args = e.ufunc, e.args
        kinds = [self.kind(a) for a in args]
        if u in _COMPARE:
            return self.compare(u, args, kinds)
        out = probe(e, self.dtypes)
        if u in (np.logical_and, np.logical_or, np.logical_xor, np.logical_not):
            t = [self.truth(a) for a in args]
            return {"logical_and": lambda: t[0] & t[1], "logical_or": lambda: t[0] | t[1], "logical_xor": lambda: t[0] != t[1], "logical_not": lambda: ~t[0]}[u.__name__]()
        if u in (np.bitwise_and, np.bitwise_or, np.bitwise_xor, np.invert):
            if out.kind == "b":
                t = [self.raw(a) for a in args]
                return ~t[0] if u is np.invert else {"bitwise_and": lambda: t[0] & t[1], "bitwise_or": lambda: t[0] | t[1], "bitwise_xor": lambda: t[0] != t[1]}[u.__name__]()
            x = [self.number(a, out) for a in args]
            return F.bitwise_not(x[0]) if u is np.invert else {"bitwise_and": lambda: x[0].bitwiseAND(x[1]), "bitwise_or": lambda: x[0].bitwiseOR(x[1]), "bitwise_xor": lambda: x[0].bitwiseXOR(x[1])}[u.__name__]()
        if out.kind in "Mm" or any(k.kind in "Mm" for k in kinds):
            x = [self.raw(a) for a in args]
            rule = {"add": lambda: x[0] + x[1], "subtract": lambda: x[0] - x[1], "isnat": lambda: x[0].isNull()}.get(u.__name__)
            return rule() if rule else self.python(u, args, out, True)
        if any(k.kind in "SU" for k in kinds):
            return self.python(u, args, out, True)
        # what the operands are converted to: the inputs' common type, or the result's where that is wider
        if u in (np.isnan, np.isinf, np.isfinite, np.signbit):
            work = kinds[0]
        elif u in (np.left_shift, np.right_shift):
            work = out
        else:
            work = out if out.kind != "b" else np.result_type(*kinds)
        x = [self.number(a, work) for a in args]
        rule = _RULES.get(u)
        if rule is None or work.kind == "u" and work.itemsize == 8:
            return self.python(u, args, out, True)
        if u is np.power and work.kind in "iu" and isinstance(args[1], Lit):
            return self.int_power(x[0], int(args[1].value), out)
        wraps = out.kind in "iu" and u in (np.add, np.subtract, np.multiply, np.negative, np.absolute, np.square, np.left_shift)
        made = rule(work, *(c.cast("long") for c in x) if wraps else x)
        return _wrap(made, out) if wraps else made

    def int_power(self, x: Column, n: int, out: np.dtype) -> Column:
        if n < 0:
            raise ValueError("integers to negative integer powers are not allowed")
        made = F.lit(1).cast("long")
        for _ in range(n):
            made = made * x.cast("long")
        return _wrap(made, out)

    def compare(self, u: np.ufunc, args: tuple[Expr, ...], kinds: list[np.dtype]) -> Column:
        if {k.kind for k in kinds} == {"S", "U"}:
            x = [self.raw(a).cast("binary") for a in args]
        elif "b" in (k.kind for k in kinds) and {k.kind for k in kinds} != {"b"}:
            x = [self.raw(a).cast("int") if k.kind == "b" else self.raw(a) for a, k in zip(args, kinds, strict=True)]
        else:
            x = [self.raw(a) for a in args]
        a, b = x
        test = {"less": lambda: a < b, "less_equal": lambda: a <= b, "greater": lambda: a > b, "greater_equal": lambda: a >= b, "equal": lambda: a == b, "not_equal": lambda: a == b}[u.__name__]()
        for c, k, arg in zip(x, kinds, args, strict=True):
            if k.kind == "f" and not (isinstance(arg, Lit) and not np.isnan(arg.value)):
                test = test & ~F.isnan(c)
        if any(k.kind in "Mm" for k in kinds):
            test = F.coalesce(test, F.lit(False))
        return ~test if u is np.not_equal else test

    def python(self, func: Callable, args: tuple[Expr, ...], out: np.dtype, declared: bool) -> Column:
        kinds = [np.asarray(a.value).dtype if isinstance(a, Lit) else probe(a, self.dtypes) for a in args]
        out = _storable(out)
        # text is as long as it is: widths of empty arrays say nothing
        kinds = [k.kind if k.kind in "SU" else k for k in kinds]
        want = out.kind if out.kind in "SU" else out

        # refers to nothing of this package: workers need not have it
        def call(*series: pd.Series) -> pd.Series:
            arrays = [s.to_numpy().astype(k) for s, k in zip(series, kinds, strict=True)]
            got = np.asarray(func(*arrays))
            if got.shape != (len(series[0]),):
                raise ValueError(f"the function returned shape {got.shape} for {len(series[0])} rows")
            if got.dtype.kind == "O":
                raise TypeError("the function returned objects")
            if not declared and (got.dtype.kind if out.kind in "SU" else got.dtype) != want and got.dtype.str[1:] != "f2":
                raise ValueError(f"the function returned {got.dtype}, on empty arrays {out}")
            return pd.Series(got.astype(want).astype(object) if out.kind in "SU" else got.astype(want))

        return F.pandas_udf(call, spark_type(out))(*(self.typed(a) if not isinstance(a, Lit) else self.raw(a) for a in args))


def _storable(dtype: np.dtype) -> np.dtype:
    return np.dtype("f4") if dtype == np.dtype("f2") else dtype


def _wrap(c: Column, out: np.dtype) -> Column:
    """Integer results of up to 32 bits wrap as NumPy's; of 64 bits as the session's arithmetic does."""
    if out.itemsize == 8:
        return c
    n = 1 << 8 * out.itemsize
    low = 0 if out.kind == "u" else n // 2
    v = F.pmod(c.cast("long") + F.lit(low), F.lit(n))
    return v - F.lit(low)


def _divide(k: np.dtype, x: Column, y: Column) -> Column:
    x, y = x.cast("double"), y.cast("double")
    by_zero = F.when((x == 0) | F.isnan(x), F.lit(NAN)).when(x > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(y == 0, by_zero).otherwise(x / y)


def _mod(k: np.dtype, x: Column, y: Column) -> Column:
    r = x % y
    floored = F.when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r)
    return F.when(y == 0, F.lit(0)).otherwise(floored) if k.kind != "f" else F.when(F.isnan(x) | F.isnan(y) | (y == 0), F.lit(NAN)).otherwise(floored)


def _floor_divide(k: np.dtype, x: Column, y: Column) -> Column:
    if k.kind != "f":
        d = F.call_function("div", x - _mod(k, x, y), y)
        return F.when(y == 0, F.lit(0)).otherwise(d)
    r = x % y
    q = (x - r) / y
    q = F.rint(F.when((r != 0) & ((r < 0) != (y < 0)), q - 1).otherwise(q))
    return F.when(F.isnan(x) | F.isnan(y), F.lit(NAN)).when(y == 0, _divide(k, x, y)).when(F.abs(x) == INF, F.lit(NAN)).otherwise(q)


def _power(k: np.dtype, x: Column, y: Column) -> Column:
    if k.kind != "f":
        return F.pow(x, y)
    return F.when((x == 1) | (y == 0), F.lit(1.0)).when((x == -1) & (F.abs(y) == INF), F.lit(1.0)).otherwise(F.pow(x, y))


def _log(f: Callable) -> Callable:
    return lambda k, x: F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(f(x))


def _floor(k: np.dtype, x: Column) -> Column:
    if k.kind != "f":
        return x
    r = x % F.lit(1.0)
    return F.when(F.isnan(x) | (F.abs(x) == INF), x).when(r < 0, x - r - 1).otherwise(x - r)


def _trunc(k: np.dtype, x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == INF), x).otherwise(x - x % F.lit(1.0)) if k.kind == "f" else x


def _extreme(f: Callable, ignore_nan: bool) -> Callable:
    def rule(k: np.dtype, x: Column, y: Column) -> Column:
        if k.kind != "f":
            return f(x, y)
        if ignore_nan:
            return F.when(F.isnan(x), y).when(F.isnan(y), x).otherwise(f(x, y))
        return F.when(F.isnan(x) | F.isnan(y), F.lit(NAN)).otherwise(f(x, y))

    return rule


def _logaddexp(k: np.dtype, x: Column, y: Column) -> Column:
    return F.when(x == y, x + F.lit(float(np.log(2)))).otherwise(F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y))))


_is_float = lambda k: k.kind == "f"
_RULES: dict[np.ufunc, Callable] = {
    np.add: lambda k, x, y: x + y if k.kind != "b" else x | y, np.subtract: lambda k, x, y: x - y, np.multiply: lambda k, x, y: x * y if k.kind != "b" else x & y,
    np.true_divide: _divide, np.remainder: _mod, np.floor_divide: _floor_divide, np.power: _power, np.float_power: lambda k, x, y: _power(np.dtype("f8"), x.cast("double"), y.cast("double")),
    np.fmod: lambda k, x, y: F.when(y == 0, F.lit(NAN) if k.kind == "f" else F.lit(0)).otherwise(x % y),
    np.negative: lambda k, x: -x, np.positive: lambda k, x: x, np.absolute: lambda k, x: F.abs(x), np.fabs: lambda k, x: F.abs(x), np.sign: lambda k, x: F.signum(x),
    np.left_shift: lambda k, x, y: F.call_function("shiftleft", x.cast("long"), y.cast("int")), np.right_shift: lambda k, x, y: F.call_function("shiftright", x.cast("long"), y.cast("int")),
    np.rint: lambda k, x: F.rint(x), np.floor: _floor, np.ceil: lambda k, x: -_floor(k, -x) if k.kind == "f" else x, np.trunc: _trunc,
    np.maximum: _extreme(F.greatest, False), np.minimum: _extreme(F.least, False), np.fmax: _extreme(F.greatest, True), np.fmin: _extreme(F.least, True),
    np.exp: lambda k, x: F.exp(x), np.exp2: lambda k, x: F.pow(F.lit(2.0), x), np.expm1: lambda k, x: F.expm1(x), np.log: _log(F.ln), np.log2: _log(F.log2), np.log10: _log(F.log10),
    np.log1p: lambda k, x: F.when(x == -1, F.lit(-INF)).when(x < -1, F.lit(NAN)).otherwise(F.log1p(x)), np.sqrt: lambda k, x: F.sqrt(x), np.cbrt: lambda k, x: F.cbrt(x), np.square: lambda k, x: x * x,
    np.reciprocal: lambda k, x: _divide(k, F.lit(1.0), x) if k.kind == "f" else F.when(x == 0, F.lit(0)).otherwise(F.call_function("div", F.lit(1).cast("long"), x)),
    np.sin: lambda k, x: F.sin(x), np.cos: lambda k, x: F.cos(x), np.tan: lambda k, x: F.tan(x), np.arcsin: lambda k, x: F.asin(x), np.arccos: lambda k, x: F.acos(x), np.arctan: lambda k, x: F.atan(x),
    np.arctan2: lambda k, x, y: F.atan2(x, y), np.hypot: lambda k, x, y: F.when((F.abs(x) == INF) | (F.abs(y) == INF), F.lit(INF)).otherwise(F.hypot(x, y)), np.sinh: lambda k, x: F.sinh(x), np.cosh: lambda k, x: F.cosh(x), np.tanh: lambda k, x: F.tanh(x),
    np.arcsinh: lambda k, x: F.asinh(x), np.arccosh: lambda k, x: F.acosh(x), np.arctanh: lambda k, x: F.atanh(x), np.degrees: lambda k, x: F.degrees(x), np.rad2deg: lambda k, x: F.degrees(x), np.radians: lambda k, x: F.radians(x), np.deg2rad: lambda k, x: F.radians(x),
    np.isnan: lambda k, x: F.isnan(x) if _is_float(k) else F.lit(False), np.isinf: lambda k, x: F.abs(x) == INF if _is_float(k) else F.lit(False), np.isfinite: lambda k, x: ~F.isnan(x) & (F.abs(x) != INF) if _is_float(k) else F.lit(True),
    np.logaddexp: _logaddexp, np.heaviside: lambda k, x, y: F.when(F.isnan(x), F.lit(NAN)).when(x == 0, y).otherwise(F.when(x > 0, F.lit(1.0)).otherwise(F.lit(0.0))),
}
