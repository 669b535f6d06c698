import math
import threading

import numpy as np
import pytest

from tabulon.plans.profiling import ProfileResult, peak_thread_watcher, profile, profile_interleaved
from tabulon.sources import synthetic


def test_columns_repeat_and_fill_their_types():
    a, b = (synthetic.make_columns(2000, 3, dtype=("f8", "i2", "u1"), seed=3) for _ in range(2))
    assert [v.dtype.str for v in a.values()] == ["<f8", "<i2", "|u1"]
    assert all(np.array_equal(a[n], b[n]) for n in a)
    assert abs(a["c0"].mean()) < 0.1 and a["c1"].min() >= -16384 and a["c1"].max() < 16383 and a["c2"].max() < 127
    rng = np.random.default_rng(5)
    assert not np.array_equal(synthetic.make_columns(9, 1, rng=rng)["c0"], synthetic.make_columns(9, 1, rng=rng)["c0"])


@pytest.mark.parametrize("how", [{"cols": 0}, {"rows": -1}, {"names": ["a", "a"]}, {"names": ["a"]}, {"dtype": []}, {"dtype": "S3"}])
def test_columns_refuse(how):
    with pytest.raises(ValueError):
        synthetic.make_columns(**({"rows": 2, "cols": 2} | how))


def test_records():
    assert synthetic.uniform_record_rows(10, 3) == [3, 3, 4]
    assert synthetic.uniform_record_rows(1, 3) == [0, 0, 1]
    with pytest.raises(ValueError):
        synthetic.uniform_record_rows(1, 0)


def test_store(spark, tmp_path):
    t = synthetic.make_store(tmp_path / "a.parquet", rows=10, cols=2, records=[4, 0, 6], dtype=("f4", "i8"))
    want = synthetic.make_columns(10, 2, dtype=("f4", "i8"))
    assert t.shape == (10, 2) and all(np.array_equal(t.dict()[n], v) for n, v in want.items())
    with pytest.raises(ValueError):
        synthetic.write_columns(tmp_path / "b.parquet", want, records=[1, 2])
    with pytest.raises(ValueError):
        synthetic.write_columns(tmp_path / "b.parquet", {"a": np.zeros(2), "b": np.zeros(3)})


def test_table_does_not_depend_on_partitions(spark):
    a, b = (synthetic.make_table(3000, 3, dtype=("f8", "i4", "u8"), seed=1, partitions=p).dict() for p in (1, 7))
    assert all(np.array_equal(a[n], b[n]) for n in a)
    assert abs(a["c0"].mean()) < 0.1 and abs(a["c0"].std() - 1) < 0.1
    assert a["c1"].dtype == np.int32 and a["c2"].dtype == np.uint64 and len(np.unique(a["c1"])) > 2900
    assert synthetic.make_table(0, 1).n_rows == 0


def test_profile():
    calls = []
    r = profile(lambda: calls.append(1), repeat=3, warmup=2, setup=lambda: calls.append(0), label="x")
    assert calls == [0, 1] * 5 and r.repeat == 3 and r.wall_ms >= 0 and r.report().startswith("x, ") and " jobs" in r.report()
    order = []
    got = profile_interleaved(["a", "b"], [lambda: order.append("a"), lambda: order.append("b")], repeat=2, warmup=0)
    assert order == ["a", "b"] * 2 and [g.label for g in got] == ["a", "b"]
    for bad in ({"repeat": 0}, {"warmup": -1}):
        with pytest.raises(ValueError):
            profile(lambda: None, **bad)
    with pytest.raises(ValueError):
        profile_interleaved(["a"], [])


def test_profile_figures():
    r = ProfileResult("", 0.0, 1.0, 1, None, None, 1)
    assert math.isnan(r.cpu_wall_ratio) and r.throughput(5) == math.inf and "faults" not in r.report()
    assert ProfileResult("", 500.0, 250.0, 1, 0, 0, 1).throughput(10) == 20


def test_thread_watcher():
    stop = threading.Event()
    with peak_thread_watcher() as peak:
        before = peak()
        t = threading.Thread(target=stop.wait)
        t.start()
        threading.Event().wait(0.2)
        assert peak() == before + 1
        stop.set()
        t.join()


def test_profile_counts_jobs(spark):
    assert profile(lambda: spark.range(10).count(), repeat=1, warmup=0).spark.jobs >= 1
    assert profile(lambda: None, repeat=1, warmup=0).spark.jobs == 0
