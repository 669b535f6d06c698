import numpy as np
import pytest

import tabulon as T
from tabulon.sources import formats, paths
from tabulon.sources.sizes import parse_bytes
from tabulon.streaming import growing

D = {"i": np.arange(30, dtype="i8"), "f": np.linspace(0, 1, 30).astype("f4"), "s": np.array([f"v{i}" for i in range(30)]), "ok": np.arange(30) % 2 == 0}


@pytest.mark.parametrize("ext", ["parquet", "feather", "json", "npz"])
def test_formats(spark, tmp_path, ext):
    p = tmp_path / f"x.{ext}"
    T.from_memory(D)[5:25].saveas(p)
    got = formats.read(p).dict()
    assert np.array_equal(got["i"], D["i"][5:25]) and list(got["s"]) == list(D["s"][5:25]) and np.allclose(got["f"], D["f"][5:25])


def test_shards_and_unions(spark, tmp_path):
    ds = tmp_path / "ds"
    for a in range(0, 30, 10):
        T.append(ds, {k: v[a : a + 10] for k, v in D.items()})
    t = T.open(ds)
    assert np.array_equal(t["i"].array(), D["i"]) and np.array_equal(t[25:3:-4, "i"].array(), D["i"][25:3:-4]) and len(t.paths) == 3
    u = t | T.from_memory(D)
    assert u.n_rows == 60 and u[[31, 0, 31], "i"].array().tolist() == [1, 0, 1]
    with pytest.raises(ValueError):
        T.append(ds, {"i": D["i"]})
    with pytest.raises(ValueError):
        T.open([t, T.from_memory({"i": D["i"]})])
    with pytest.warns(RuntimeWarning):
        assert T.open([t, T.from_memory({"i": D["i"]})], on_mismatch="drop").columns == ["i"]
    T.compact(ds)
    assert np.array_equal(T.open(ds)["i"].array(), D["i"]) and not T.info(ds)["needs_compaction"]


def test_globs(spark, tmp_path):
    for i in (10, 2, 1):
        T.from_memory({"i": np.array([i])}).saveas(tmp_path / f"run_{i}.parquet")
    assert T.open(str(tmp_path / "run_*.parquet"))["i"].array().tolist() == [1, 2, 10]
    with pytest.raises(FileNotFoundError):
        paths.expand(str(tmp_path / "no_*"))


def test_writers(spark, tmp_path):
    p = tmp_path / "w.parquet"
    with T.create(p) as w:
        w.write({"i": D["i"][:4]})
        w.write({})
        w.write({"i": D["i"][4:9]})
        with pytest.raises(ValueError):
            w.write({"j": D["i"]})
    with T.update(p) as w:
        w.write({"i": D["i"][9:12]})
    assert np.array_equal(T.open(p)["i"].array(), D["i"][:12])
    with pytest.raises(FileExistsError):
        T.create(p)
    with T.appender(tmp_path / "a", shard_size=10) as a:
        for k in range(0, 30, 6):
            a.write({"i": D["i"][k : k + 6]})
    assert np.array_equal(T.open(tmp_path / "a")["i"].array(), D["i"]) and len(T.open(tmp_path / "a").paths) == 3


def test_convert_and_batches(spark, tmp_path):
    np.savez(tmp_path / "x.npz", **D)
    assert T.convert(tmp_path / "x.npz", tmp_path / "y.feather") == str(tmp_path / "y.feather")
    assert T.convert(str(tmp_path / "*.npz"), format="parquet", dtypes={"i": "f8"})
    assert T.open(tmp_path / "x.parquet").dtypes["i"] == np.float64
    sizes = [f.count() for f in T.from_memory(D).edit().where("i > 4").iter_batches(10)]
    assert sizes == [10, 10, 5]
    assert T.store({"a": np.array([1.0])}, tmp_path / "z.parquet").n_rows == 1
    assert [parse_bytes(x) for x in ("4M", "4MiB", "1 kB", 7)] == [4_000_000, 4 << 20, 1000, 7]


def test_bad_memory(spark):
    for bad, why in (({}, ValueError), ({"a": np.array([object()])}, TypeError), ({"a": np.ones(2), "b": np.ones(3)}, ValueError), (np.ones(3), TypeError)):
        with pytest.raises(why):
            T.from_memory(bad)


def test_growing(spark, tmp_path):
    T.append(tmp_path / "in", D)
    q = growing.append_to(growing.filtered(growing.follow(tmp_path / "in"), "i >= 20"), tmp_path / "out", str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(T.open(tmp_path / "out")["i"].array()) == list(range(20, 30))
