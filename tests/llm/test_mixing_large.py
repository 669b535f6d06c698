import pytest

from tabulon.llm import mixing


@pytest.mark.parametrize("total", [300_000_000, 600_000_000, 1_500_000_000, 6_000_000_000, 1 << 60])
def test_targets_of_many_words(spark, total):
    # by place: a (5), b (2), c (1), null (5); c and null stop at three times their size, a and b share the rest as 5 to 2
    size = {"a": total // 2, "c": total // 100, None: total // 50}
    size["b"] = total - sum(size.values())
    got = mixing.targets(spark.createDataFrame([("n" if s is None else f"s{s}", s, n) for s, n in size.items()], "skey string, source string, source_size long"))
    target = {r.skey: r.target for r in got.collect()}
    rest = total - 3 * size["c"] - 3 * size[None]
    assert target == {"sa": float(5 * rest) / 7.0, "sb": float(2 * rest) / 7.0, "sc": float(3 * size["c"]), "n": float(3 * size[None])}


def test_targets_of_many_sources(spark):
    # a cap times the sum of weights is beyond a long: 3 * 2**54 words times 800 for 300 sources of one size
    n, size = 300, 1 << 54
    rows = [(f"s{i:03}", f"{i:03}", size) for i in range(n)]
    got = mixing.targets(spark.createDataFrame(rows, "skey string, source string, source_size long"))
    assert {r.skey: r.target for r in got.collect()} == {s: float((5, 2, 1)[i % 3] * n * size) / 800.0 for i, (s, _, _) in enumerate(rows)}
