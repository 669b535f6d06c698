import numpy as np
import pytest

import tabulon as T
from tabulon.operators import table
from tabulon.operators.table import hold, union

N = 600
D = {
    "i": np.arange(N),
    "u": np.arange(N, dtype="u8") + np.uint64(2**63),
    "h": (np.arange(N) % 7).astype("f2"),
    "f": np.where(np.arange(N) % 5, np.arange(N) / 3, np.nan),
    "s": np.array(["x" * (k // 50) + str(k) for k in range(N)]),
    "b": np.array([b"y" * (k // 60 + 1) for k in range(N)]),
    "t": np.datetime64("2020-01-01T00:00:00.000001", "us") + np.arange(N) * np.timedelta64(7, "h"),
    "d": np.datetime64("2020-01-01", "D") + np.arange(N),
    "m": np.arange(N) * np.timedelta64(3, "s").astype("m8[us]"),
    "ok": np.arange(N) % 2 == 0,
}
D["t"][3] = np.datetime64("NaT")


def same(got, want):
    assert list(got) == list(want)
    for k, v in want.items():
        assert np.array_equal(got[k], v, equal_nan=v.dtype.kind in "fMm"), k


def leaves(df):
    return df._jdf.queryExecution().analyzed().collectLeaves().size()


def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def test_batches_join_up_as_one_relation(spark):
    parts = [b._table for b in T.from_memory({"i": D["i"], "f": D["f"]}).edit().where("i >= 100").iter_batches(4)]
    before = jobs(spark)
    u = union(parts)
    assert len(parts) == 125 and u.n_rows == 500 and leaves(u.df) == 1 and jobs(spark) == before
    same(u.dict(), {"i": D["i"][100:], "f": D["f"][100:]})
    assert u[[499, 0, 7], "i"].array().tolist() == [599, 100, 107]


@pytest.mark.parametrize("most", [8 << 20, 3000])
def test_gathered_columns_keep_values_and_order(spark, monkeypatch, most):
    monkeypatch.setattr(table, "GATHERED_BYTES", most)
    u = union(b._table for b in T.from_memory(D).edit().iter_batches(25))
    assert leaves(u.df) == 1
    same(u.dict(), D)
    assert u["i"].sum() == D["i"].sum() and u[3:590:90, "s"].array().tolist() == D["s"][3:590:90].tolist()
    assert u.df.schema == union([T.from_memory(D)]).df.schema


def test_gathered_without_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(table, "GATHERED_BYTES", 3000)
    monkeypatch.setattr(table, "shared_folder", lambda: None)
    same(union(b._table for b in T.from_memory(D).edit().iter_batches(25)).dict(), D)


@pytest.mark.parametrize("most", [8 << 20, 100])
def test_held_between_others(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(table, "GATHERED_BYTES", most)
    piece = lambda a, b: {k: D[k][a:b] for k in ("i", "s")}
    stored = T.store(piece(20, 40), tmp_path / "a.parquet")
    turned = hold(dict(reversed(piece(40, 60).items())))
    u = union([hold(piece(0, 10)), hold(piece(10, 20)), stored, turned, hold(piece(60, 70)), T.from_memory(piece(70, 80))])
    same(u.dict(), piece(0, 80))
    assert u[75:5:-10, "i"].array().tolist() == [75, 65, 55, 45, 35, 25, 15]
    with pytest.raises(ValueError):
        union([hold(piece(0, 10)), hold({"i": D["i"]}), stored])
    with pytest.warns(RuntimeWarning):
        assert union([hold(piece(0, 10)), hold({"i": D["i"][10:12]})], "drop").dict()["i"].tolist() == list(range(12))


def test_unions_keep_long_texts(spark):
    a, b = {"s": np.array(["a", "b"])}, {"s": np.array(["long text"])}
    for make in (T.from_memory, hold):
        u = union([make(a), make(b)])
        assert u.dict()["s"].tolist() == ["a", "b", "long text"] == T.open(u.df)["s"].array().tolist()


def test_held_tables_grow_and_close(spark):
    t = hold({"i": D["i"][:3]})
    assert t.df.count() == 3
    t.append(hold({"i": D["i"][3:5]})).append({"i": D["i"][5:6]})
    assert t["i"].array().tolist() == list(range(6)) and t.n_rows == 6 == t.df.count()
    t = hold({"i": D["i"][:3]})
    t.close()
    for use in (lambda: union([t]), lambda: t.edit().dict()):
        with pytest.raises(ValueError):
            use()


def test_batches_are_read_without_jobs(spark):
    bs = list(T.from_memory(D).edit().iter_batches(100))
    before = jobs(spark)
    got = [b.assign(k=b["i"]).rename({"i": "j"}).select("s", "j", "k").dict() for b in bs]
    assert [list(g) for g in got] == [["s", "j", "k"]] * 6 and np.array_equal(np.concatenate([g["k"] for g in got]), D["i"])
    assert sum(b.count() for b in bs) == N and jobs(spark) == before
    got[0]["j"][0] = 9
    assert bs[0].dict()["i"][0] == 0 and bs[1].where("i > 150").assign(k=T.col("i") + 1).dict()["k"].tolist() == list(range(152, 201))
