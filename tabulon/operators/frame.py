"""Deferred derivation: a frame is names and the expressions they stand for, a chain of cuts and a row selection; one plan each."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Apply, Cast, Col, Expr, Lit, as_expr, col, probe
from ..functions.lower import lower
from ..functions.query import check_predicate, parse
from .cutflow import Cut, CutflowReport
from .table import ROW, Table, View, hold, numpy_of, typed

NAN = float("nan")


class FrameColumn:
    """A frame's column: lazy in arithmetic, eager in reductions."""

    def __init__(self, frame: Frame, name: str):
        self._frame, self.name = frame, name

    def __expr__(self) -> Expr:
        return Col(self.name)

    @property
    def dtype(self) -> np.dtype:
        return self._frame.dtypes[self.name]

    def array(self) -> np.ndarray:
        return self._frame.array(self.name)

    compute = array

    def __array__(self, dtype: Any = None, copy: bool | None = None) -> np.ndarray:
        out = self.array()
        return out if dtype is None else out.astype(dtype)

    def __getattr__(self, name: str) -> Any:
        if name in ("isin", "round", "clip", "astype", "where"):
            return getattr(Col(self.name), name)
        raise AttributeError(name)

    def __array_ufunc__(self, ufunc: np.ufunc, method: str, *inputs: Any, **kwargs: Any) -> Expr:
        return Col(self.name).__array_ufunc__(ufunc, method, *(as_expr(x) for x in inputs), **kwargs)

    def __array_function__(self, func: Any, types: Any, args: tuple, kwargs: dict) -> Any:
        short = {np.sum: "sum", np.mean: "mean", np.min: "min", np.max: "max", np.var: "var", np.std: "std"}
        if func in short and args and args[0] is self:
            return getattr(self, short[func])(**kwargs)
        return Col(self.name).__array_function__(func, types, tuple(as_expr(a) for a in args), kwargs)


def _column_reduction(name: str) -> Callable:
    def method(self: FrameColumn, axis: Any = None, **k: Any) -> Any:
        ddof = {"ddof": k.pop("ddof")} if "ddof" in k and name in ("var", "std") else {}
        if axis not in (None, 0) or any(v is not None and v is not np._NoValue for v in k.values()):
            raise TypeError(f"{name}() of a column takes no such argument")
        return getattr(self._frame, name)(self.name, **ddof)

    return method


for _n in ("sum", "mean", "min", "max", "var", "std"):
    setattr(FrameColumn, _n, _column_reduction(_n))
for _n in ("add", "sub", "mul", "truediv", "floordiv", "mod", "pow", "and", "or", "xor", "lt", "le", "gt", "ge", "eq", "ne", "radd", "rsub", "rmul", "rtruediv", "rfloordiv", "rmod", "rpow", "rand", "ror", "rxor"):
    setattr(FrameColumn, f"__{_n}__", lambda a, b, n=_n: getattr(Col(a.name), f"__{n}__")(as_expr(b)))
for _n in ("neg", "pos", "abs", "invert"):
    setattr(FrameColumn, f"__{_n}__", lambda a, n=_n: getattr(Col(a.name), f"__{n}__")())
FrameColumn.__hash__ = None


class Frame:
    """Immutable unless ``inplace=True``; resolves names against its current columns and compiles to one DataFrame."""

    def __init__(self, table: Table, rows: Any = None, predicate: Expr | None = None, names: list[str] | None = None):
        self._table, self._rows = table, rows
        self._exprs: dict[str, Expr] = {n: Col(n) for n in names or table._names}
        self._cuts: list[Cut] = [Cut(predicate, None, None)] if predicate is not None else []
        self._base_cuts = len(self._cuts)
        self._side: dict[str, np.ndarray] = {}

    # -- schema
    @property
    def _base_dtypes(self) -> dict[str, np.dtype]:
        return self._table._dtypes | {n: v.dtype for n, v in self._side.items()}

    @property
    def columns(self) -> list[str]:
        return list(self._exprs)

    @property
    def dtypes(self) -> dict[str, np.dtype]:
        return {n: self._dtype(e) for n, e in self._exprs.items()}

    def _dtype(self, e: Expr) -> np.dtype:
        return np.asarray(e.value).dtype if isinstance(e, Lit) else probe(e, self._base_dtypes)

    @property
    def n_rows(self) -> int:
        return self.count()

    def __len__(self) -> int:
        return len(self._exprs)

    def __iter__(self) -> Iterator[str]:
        return iter(self._exprs)

    def __contains__(self, name: object) -> bool:
        return name in self._exprs

    def __getitem__(self, key: Any) -> Any:
        if isinstance(key, str):
            self._known([key])
            return FrameColumn(self, key)
        if isinstance(key, list) and key and all(isinstance(k, str) for k in key):
            return self.select(*key)
        if isinstance(key, Expr):
            return self.where(key)
        raise TypeError("a frame has no rows to pick; select them before edit()")

    def __setitem__(self, name: str, value: Any) -> None:
        self.assign(inplace=True, **{name: value})

    def __delitem__(self, name: str) -> None:
        self.drop(name, inplace=True)

    def copy(self) -> Frame:
        out = Frame.__new__(Frame)
        out.__dict__.update(self.__dict__ | {"_exprs": dict(self._exprs), "_cuts": list(self._cuts), "_side": dict(self._side)})
        return out

    def _changed(self, inplace: bool, exprs: dict[str, Expr]) -> Frame:
        out = self if inplace else self.copy()
        out._exprs = exprs
        return out

    def _known(self, names: Any) -> None:
        for n in names:
            if n not in self._exprs:
                raise KeyError(n)

    def _value(self, v: Any) -> Expr:
        e = as_expr(v).substitute(self._exprs)
        if missing := sorted(as_expr(v).columns() - set(self._exprs)):
            raise KeyError(missing[0])
        return e

    # -- projection and derivation
    def assign(self, *, copy: bool = False, inplace: bool = False, **values: Any) -> Frame:
        out = self if inplace else self.copy()
        made = {}
        for name, v in values.items():
            if isinstance(v, View) and v._single:
                v = v.array()
            if isinstance(v, FrameColumn) and v._frame._table is not self._table:
                v = v.array()
            if isinstance(v, (list, tuple)) or isinstance(v, np.ndarray) and v.ndim:
                made[name] = out._attach(name, np.array(v) if copy else np.asarray(v))
            else:
                made[name] = self._value(v)
                self._dtype(made[name])
        out._exprs = out._exprs | made
        return out

    with_columns = assign

    def _attach(self, name: str, v: np.ndarray) -> Expr:
        if v.ndim != 1 or v.dtype.kind == "O":
            raise TypeError("a one-dimensional array of a storable dtype")
        if self._rows is not None or self._cuts:
            raise ValueError("an array can be attached before rows are selected only")
        if len(v) != self._table._count():
            raise ValueError(f"{len(v)} values for {self._table._count()} rows")
        key = f"__side{len(self._side)}_{name}"
        self._side = self._side | {key: v}
        return Col(key)

    def apply(self, func: Callable, *cols: Any, out_dtype: Any = None) -> Expr:
        """A vectorised function of NumPy arrays as an expression over this frame's columns."""
        if not cols:
            raise TypeError("apply() needs a column")
        e = Apply(func, tuple(col(c) if isinstance(c, str) else as_expr(c) for c in cols), None if out_dtype is None else np.dtype(out_dtype))
        self._dtype(self._value(e))
        return e

    def select(self, *names: str, inplace: bool = False) -> Frame:
        self._known(names)
        if not names or len(set(names)) < len(names):
            raise ValueError("select takes different names, one at least")
        return self._changed(inplace, {n: self._exprs[n] for n in names})

    def drop(self, *names: str, inplace: bool = False) -> Frame:
        self._known(names)
        return self._changed(inplace, {n: e for n, e in self._exprs.items() if n not in names})

    def rename(self, names: dict[str, str], inplace: bool = False) -> Frame:
        self._known(names)
        new = [names.get(n, n) for n in self._exprs]
        if len(set(new)) < len(new):
            raise ValueError("two columns of one name")
        return self._changed(inplace, dict(zip(new, self._exprs.values(), strict=True)))

    def astype(self, dtypes: dict[str, Any], inplace: bool = False) -> Frame:
        self._known(dtypes)
        cast = {n: np.dtype(t) for n, t in dtypes.items()}
        return self._changed(inplace, {n: Cast(e, cast[n]) if n in cast else e for n, e in self._exprs.items()})

    # -- cuts
    def where(self, predicate: Any, label: str | None = None, *, weight: Any = None, params: dict[str, Any] | None = None, inplace: bool = False) -> Frame:
        """Keep rows for which a query string or expression holds; ``weight`` (a name or expression) stays for later cuts."""
        e = parse(predicate, list(self._exprs), params) if isinstance(predicate, str) else as_expr(predicate)
        check_predicate(e, self.dtypes)
        out = self if inplace else self.copy()
        if weight is not None:
            weight = self._value(col(weight) if isinstance(weight, str) else weight)
            if self._dtype(weight).kind not in "iuf":
                raise TypeError("a weight is a number")
        elif self._cuts:
            weight = self._cuts[-1].weight
        out._cuts = [*self._cuts, Cut(e.substitute(self._exprs), label, weight)]
        return out

    filter = where

    def report(self, show: str | None = None) -> CutflowReport:
        """Rows entering and passing each cut, weighted too, in one pass over the base rows."""
        base, aggs, passed = self._base(), [F.count(F.lit(1)).alias("n")], None
        for i, cut in enumerate(self._cuts):
            w = None if cut.weight is None else self._col(cut.weight).cast("double")
            if w is not None:
                aggs.append(F.sum(w if passed is None else F.when(passed, w)).alias(f"wi{i}"))
            c = self._col(cut.predicate)
            passed = c if passed is None else passed & c
            aggs.append(F.count(F.when(passed, 1)).alias(f"n{i}"))
            if w is not None:
                aggs.append(F.sum(F.when(passed, w)).alias(f"w{i}"))
        r = base.agg(*aggs).first()
        return CutflowReport.of(self._cuts, r, show)

    def report_df(self) -> DataFrame:
        """The report as a lazy DataFrame: one row a cut (place, label, entering, passing), from one aggregation."""
        aggs, passed = [F.count(F.lit(1)).alias("n")], None
        for i, cut in enumerate(self._cuts):
            c = self._col(cut.predicate)
            passed = c if passed is None else passed & c
            aggs.append(F.count(F.when(passed, 1)).alias(f"n{i}"))
        rows = [F.struct(F.lit(i).alias("place"), F.lit(c.label or f"#{i}").alias("label"), F.col(f"n{i - 1}" if i else "n").alias("entering"), F.col(f"n{i}").alias("passing")) for i, c in enumerate(self._cuts)]
        return self._base().agg(*aggs).select(F.inline(F.array(*rows)))

    def summary(self, **aggs: tuple) -> DataFrame:
        """Several reductions in one pass as a lazy one-row DataFrame: ``name=("sum", column)`` or ``("var", column, ddof)``."""
        out = self._base()
        for cut in self._cuts:
            out = out.where(self._col(cut.predicate))
        return out.agg(*(self._aggregate(*a).alias(n) for n, a in aggs.items()))

    def _aggregate(self, kind: str, column: Any = None, ddof: float = 0) -> Column:
        if kind == "count":
            return F.count(F.lit(1))
        c, t = self._argument(column, "biufMm" if kind in ("min", "max") else "biuf")
        number = c.cast("int") if t.kind == "b" else c
        if kind == "sum":
            return F.coalesce(F.sum(number), F.lit(0))
        if kind == "mean":
            return F.coalesce(F.avg(number.cast("double")), F.lit(NAN))
        if kind in ("min", "max"):
            value = (F.min if kind == "min" else F.max)(c)
            return F.when(F.max(F.isnan(c).cast("int")) == 1, F.lit(NAN)).otherwise(F.coalesce(value, F.lit(NAN))) if t.kind == "f" else value
        n = F.count(number)
        var = F.when(n - ddof <= 0, F.lit(NAN)).otherwise(F.var_pop(number.cast("double")) * n / (n - ddof))
        return F.sqrt(var) if kind == "std" else var

    # -- plans
    def _base(self, position: bool = False) -> DataFrame:
        t = self._table
        if self._rows is not None:
            out = View(t, self._rows, None, t._names, False)._ordered()
        else:
            out = t._with_rows().withColumn("__pos", F.col(ROW)) if position or self._side else t._df
        for name, v in self._side.items():
            from .table import arrow_of

            side = t.spark.createDataFrame(arrow_of({name: v}).append_column("__at", pa.array(np.arange(len(v)))))
            out = out.join(side, out[ROW] == side["__at"]).drop("__at")
        return out

    def _col(self, e: Expr) -> Column:
        return lower(e, self._base_dtypes, lambda n: F.col(f"`{n}`"))

    def _plan(self, position: bool = False, exprs: dict[str, Expr] | None = None) -> DataFrame:
        out = self._base(position)
        for cut in self._cuts:
            out = out.where(self._col(cut.predicate))
        made = [(self._col(e) if not isinstance(e, Lit) else F.lit(e.value.item() if isinstance(e.value, np.generic) else e.value)).alias(n) for n, e in (exprs or self._exprs).items()]
        return out.select(*made, *(["__pos"] if position else []))

    @property
    def df(self) -> DataFrame:
        return typed(self._plan(), self.dtypes)

    # -- materialisers
    def arrow(self) -> pa.Table:
        return self._plan(position=True).orderBy("__pos").drop("__pos").toArrow()

    def dict(self, copy: bool = True) -> dict[str, np.ndarray]:
        if not copy:
            raise ValueError("Spark holds no memory to point into; call with copy=True")
        held = self._table._held
        if held is not None and self._rows is None and not self._cuts and all(isinstance(e, Col) and e.name in held.column_names for e in self._exprs.values()):
            self._table._open()
            return numpy_of(held.select([e.name for e in self._exprs.values()]).rename_columns(list(self._exprs)), self.dtypes)
        return numpy_of(self.arrow(), self.dtypes)

    def array(self, name: str) -> np.ndarray:
        return self.select(name).dict()[name]

    def recarray(self) -> np.recarray:
        return View.recarray(self)

    def frame(self, copy: bool = True) -> Any:
        return View.frame(self, copy)

    def evaluate(self) -> Frame:
        return self

    def saveas(self, dest: Any, *, format: str | None = None, **how: Any) -> Any:
        from ..sources import formats

        return formats.save(self, dest, format, **how)

    def iter_batches(self, batch_size: Any = None, *, copy: bool = True) -> Iterator[Frame]:
        """Frames over successive rows, in order; sized by rows or bytes. Partitions stream one after the other, as columns."""
        from ..sources.formats import batches
        dtypes = self.dtypes
        for t in batches(self, batch_size):
            if len(t):
                yield hold(numpy_of(t, dtypes)).edit()

    def write(self, path: str, *, memory_budget: Any = None, mode: str = "create") -> Table:
        from ..sources import formats

        return formats.store(self, path, mode=mode)

    # -- reductions
    def count(self) -> int:
        return self._plan().count() if self._cuts or self._rows is not None else self._table._count()

    def _argument(self, column: Any, kinds: str) -> tuple[Column, np.dtype]:
        e = self._value(col(column) if isinstance(column, str) else column)
        t = self._dtype(e)
        if t.kind not in kinds:
            raise TypeError(f"no such reduction of {t}")
        return self._col(e), t

    def _reduce(self, *aggs: Column) -> Any:
        out = self._base()
        for cut in self._cuts:
            out = out.where(self._col(cut.predicate))
        return out.agg(*(a.alias(f"r{i}") for i, a in enumerate(aggs))).first()

    def sum(self, column: Any) -> Any:
        c, t = self._argument(column, "biuf")
        r = self._reduce(F.sum(c.cast("int") if t.kind == "b" else c))[0]
        return np.float64(r or 0.0) if t.kind == "f" else np.uint64(r or 0) if t.kind == "u" else np.int64(r or 0)

    def mean(self, column: Any) -> np.float64:
        c, t = self._argument(column, "biuf")
        r = self._reduce(F.avg((c.cast("int") if t.kind == "b" else c).cast("double")))[0]
        return np.float64(NAN if r is None else r)

    def _extreme(self, column: Any, largest: bool) -> Any:
        c, t = self._argument(column, "biufMm")
        f = F.max if largest else F.min
        bad = F.max(F.isnan(c).cast("int")) if t.kind == "f" else F.max(c.isNull().cast("int"))
        value, wrong = self._reduce(f(c), bad)
        if t.kind in "Mm":
            return np.datetime64("NaT") if wrong or value is None and t.kind == "M" else np.timedelta64("NaT") if value is None else np.asarray(value).astype(t)[()]
        return np.float64(NAN) if value is None or wrong else t.type(value)

    def min(self, column: Any) -> Any:
        return self._extreme(column, False)

    def max(self, column: Any) -> Any:
        return self._extreme(column, True)

    def var(self, column: Any, ddof: float = 0) -> np.float64:
        c, t = self._argument(column, "biuf")
        c = (c.cast("int") if t.kind == "b" else c).cast("double")
        n, v = self._reduce(F.count(c), F.var_pop(c))
        return np.float64(NAN if n - ddof <= 0 else v * n / (n - ddof))

    def std(self, column: Any, ddof: float = 0) -> np.float64:
        return np.sqrt(self.var(column, ddof))
