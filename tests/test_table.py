import numpy as np
import pytest

import tabulon as T
from tabulon import QueryError, col


def data(n=400):
    r = np.random.default_rng(0)
    d = {"a": r.normal(size=n), "i": r.integers(-50, 50, n).astype("i4"), "u": r.integers(0, 60000, n).astype("u2"), "b": r.random(n) < 0.5, "s": np.array([f"k{i % 7}" for i in range(n)]), "z": np.array([b"SR", b"CR"])[np.arange(n) % 2], "f": r.normal(size=n).astype("f4")}
    d["a"][::17] = np.nan
    return d


@pytest.fixture(scope="module")
def d():
    return data()


@pytest.fixture(scope="module")
def t(spark, d, tmp_path_factory):
    return T.store(d, tmp_path_factory.mktemp("t") / "x.parquet")


def test_round_trip(t, d):
    got = t.dict()
    for k, v in d.items():
        assert np.array_equal(got[k], v, equal_nan=v.dtype.kind == "f") and (got[k].dtype == v.dtype)


@pytest.mark.parametrize("key", [5, -1, slice(10, 2, -3), slice(None, None, 7), slice(390, 3000), [7, 7, 1, -1], slice(0, 0), slice(None, None, -1)], ids=str)
def test_rows(t, d, key):
    assert np.array_equal(np.atleast_1d(d["i"][key]), t[key, "i"].array())


def test_views_compose(t, d):
    assert np.array_equal(t[slice(100, 10, -2)][::3]["i"].array(), d["i"][100:10:-2][::3])
    assert np.array_equal(t[d["b"]][::-1]["i"].array(), d["i"][d["b"]][::-1])
    assert t[3:9].n_rows == 6 and t["i"].shape == (400,) and len(t.head()) == 10 and np.array_equal(t.tail(3)["i"].array(), d["i"][-3:])


@pytest.mark.parametrize(
    ("text", "mask"),
    [
        ("a > 0.5 and -10 < i < 20 and s in ['k1', 'k2']", lambda d: (d["a"] > 0.5) & (d["i"] > -10) & (d["i"] < 20) & np.isin(d["s"], ["k1", "k2"])),
        ("not (a < 0.5)", lambda d: ~(d["a"] < 0.5)),
        ("a != a", lambda d: d["a"] != d["a"]),
        ("z == 'SR' or b", lambda d: (d["z"] == b"SR") | d["b"]),
        ("i % 7 == 3 and i // 4 < @q", lambda d: (d["i"] % 7 == 3) & (d["i"] // 4 < 2)),
        ("s not in ['k1'] and 1 >= a", lambda d: (d["s"] != "k1") & (d["a"] <= 1)),
    ],
)
def test_queries(t, d, text, mask):
    assert np.array_equal(t.query(text, params={"q": 2})["i"].array(), d["i"][mask(d)])


@pytest.mark.parametrize("bad", ["a >", "nope > 1", "a + 1", "f(a)", "a.b > 1", "1 < 2", "a > @x", "[1] == a"])
def test_bad_queries(t, bad):
    with pytest.raises(QueryError):
        t.query(bad)


def test_guards(t):
    with pytest.raises(TypeError):
        bool(col("a") > 1)
    with pytest.raises(TypeError):
        np.add.reduce(col("a"))
    with pytest.raises(TypeError):
        np.cumsum(col("a"))
    with pytest.raises(KeyError):
        t["nope"]
    with pytest.raises(ValueError):
        t.dict(copy=False)
    with pytest.raises(TypeError):
        t.edit()[3]
    with pytest.raises(TypeError):
        t.edit().sum("s")


GRID = np.array([np.nan, np.inf, -np.inf, 0.0, 1.0, -1.0, 2.5, -7.0])
INTS = np.array([-128, -7, -1, 0, 1, 3, 127], "i4")


@pytest.fixture(scope="module")
def grid(spark):
    x, y = (v.ravel() for v in np.meshgrid(GRID, GRID))
    return T.from_memory({"x": x, "y": y}), x, y


@pytest.fixture(scope="module")
def ints(spark):
    x, y = (v.ravel() for v in np.meshgrid(INTS, INTS))
    return T.from_memory({"x": x, "y": y}), x, y


BINARY = [np.add, np.subtract, np.multiply, np.true_divide, np.remainder, np.floor_divide, np.power, np.maximum, np.minimum, np.fmax, np.fmin, np.less, np.less_equal, np.greater, np.greater_equal, np.equal, np.not_equal, np.hypot, np.logaddexp]
UNARY = [np.negative, np.absolute, np.sign, np.rint, np.floor, np.ceil, np.trunc, np.exp, np.log, np.log2, np.log10, np.log1p, np.sqrt, np.square, np.sin, np.arcsin, np.arctan, np.isnan, np.isinf, np.isfinite, np.reciprocal, np.cbrt, np.spacing]


@pytest.mark.filterwarnings("ignore")
def test_float_semantics(grid):
    t, x, y = grid
    got = t.edit().assign(**{f"b{i}": u(col("x"), col("y")) for i, u in enumerate(BINARY)}, **{f"u{i}": u(col("x")) for i, u in enumerate(UNARY)}).dict()
    with np.errstate(all="ignore"):
        for i, u in enumerate(BINARY):
            assert np.allclose(got[f"b{i}"].astype(float), u(x, y).astype(float), equal_nan=True, rtol=1e-12), u
        for i, u in enumerate(UNARY):
            assert np.allclose(got[f"u{i}"].astype(float), u(x).astype(float), equal_nan=True, rtol=1e-12), u


@pytest.mark.filterwarnings("ignore")
def test_int_semantics(ints):
    t, x, y = ints
    us = [np.add, np.subtract, np.multiply, np.remainder, np.floor_divide, np.true_divide, np.bitwise_and, np.bitwise_or, np.bitwise_xor, np.maximum, np.minimum, np.less, np.not_equal, np.gcd]
    got = t.edit().assign(**{f"b{i}": u(col("x"), col("y")) for i, u in enumerate(us)}, inv=~col("x"), cube=col("x") ** 3, small=col("x").astype("i1") + np.int8(100), f=col("x").astype("f4") * 2).dict()
    with np.errstate(all="ignore"):
        for i, u in enumerate(us):
            want = u(x, y)
            assert got[f"b{i}"].dtype == want.dtype and np.allclose(got[f"b{i}"].astype(float), want.astype(float), equal_nan=True), u
        assert np.array_equal(got["inv"], ~x) and np.array_equal(got["cube"], x**3) and np.array_equal(got["small"], x.astype("i1") + np.int8(100))
        assert got["f"].dtype == np.float32


def test_frame(t, d):
    f = t.edit().assign(q=col("i") * 2, w=np.where(col("b"), col("a"), 0.0), x=np.arange(400)).rename({"i": "a", "a": "i"}).where("a > 0")
    got = f.dict()
    assert np.array_equal(got["q"], d["i"][d["i"] > 0] * 2) and np.array_equal(got["x"], np.arange(400)[d["i"] > 0])
    assert len(f) == len(f.columns) and f.count() == (d["i"] > 0).sum()
    assert np.array_equal(t.edit().assign(y=t.edit().apply(lambda a, b: a * b, "f", "i")).array("y"), d["f"] * d["i"])
    with pytest.raises(ValueError):
        t.edit().assign(x=np.arange(3))


def test_reductions(t, d):
    e = t.edit()
    assert e.sum("i") == d["i"].sum() and e.sum("b") == d["b"].sum() and np.isnan(e.mean("a")) and np.isnan(e.min("a")) and e.max("i") == d["i"].max()
    assert np.isclose(e.var("f", 1), d["f"].astype("f8").var(ddof=1)) and np.isclose(np.std(t["f"]), d["f"].astype("f8").std())
    none = e.where("i > 1000")
    assert none.sum("i") == 0 and np.isnan(none.mean("i")) and np.isnan(none.min("f")) and np.isnan(e.where("i == 49").var("f", 500))


def test_cutflow(t, d):
    r = t.edit().where("i > 0", "pos", weight="f").where("a > 0", "up").report()
    p, q = d["i"] > 0, (d["i"] > 0) & (d["a"] > 0)
    assert (r["pos"].entering, r[0].passing, r["up"].passing) == (400, p.sum(), q.sum())
    assert np.isclose(r["up"].weighted_passing, d["f"][q].astype("f8").sum(), rtol=1e-6) and "up" in repr(r)
    assert [x["passing"] for x in t.edit().where("i > 0").where("a > 0").report_df().orderBy("place").collect()] == [p.sum(), q.sum()]


def test_eager_columns(t, d):
    assert np.array_equal(t["i"] * 2, d["i"] * 2) and np.array_equal(t["i"] > 0, d["i"] > 0) and np.array_equal(t["s"].isin(["k1"]), d["s"] == "k1")
