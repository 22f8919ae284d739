"""Order statistics of large groups, found by counting, against sorted lists."""

import math
import random

import pytest

from mnemospark.operators import quantiles

NAN = float("nan")


def order(x):
    return (x != x, x if x == x else 0)


def lists(rows):
    out = {}
    for g, v in rows:
        if v is not None:
            out.setdefault(g, []).append(v)
    return {g: sorted(v, key=order) for g, v in out.items()}


def same(a, b):
    return a is None and b is None or a == b or (a != a and b != b)


@pytest.mark.parametrize("few", [20, 10**6])
def test_places_of_groups_of_all_kinds(spark, few):
    rnd = random.Random(few)
    rows = [("flat", rnd.random()) for _ in range(900)] + [("equal", 5.0)] * 300 + [("two", float(i % 2)) for i in range(301)] + [("steep", 10.0 ** rnd.uniform(-9, 9) * rnd.choice([1, -1])) for _ in range(500)]
    rows += [("odd", x) for x in [NAN, float("inf"), float("-inf"), 1e308, -1e308, 0.0, 5e-324] * 40] + [(None, float(i)) for i in range(100)] + [("one", 3.5), ("none", None), ("flat", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in quantiles.nearest_rank(d, ["g"], "v", {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}, few).collect()}
    want = lists(rows)
    assert got.keys() == want.keys()
    for g, v in want.items():
        for name, q in (("a", 0.0), ("b", 0.5), ("c", 0.95), ("d", 1.0)):
            assert same(got[g][name], v[min(len(v) - 1, int(len(v) * q))]), (g, name)


def test_long_values_that_a_double_cannot_tell(spark):
    rows = [(2**60 + i % 50,) for i in range(400)]
    d = spark.createDataFrame(rows, "v long").repartition(3)
    got = quantiles.nearest_rank(d, [], "v", {"m": 0.5, "p": 0.9}, few=10).first()
    s = sorted(v for v, in rows)
    assert (got.m, got.p) == (s[200], s[360])


def test_interpolated(spark):
    d = spark.createDataFrame([("a", float(x)) for x in (10, 20, 30, 40)] + [("b", 1.0), ("c", None)], "g string, v double")
    for few in (2, 100):
        got = {r.g: (r.m, r.q) for r in quantiles.interpolated(d, ["g"], "v", {"m": 0.5, "q": 0.9}, few).collect()}
        assert got["a"][0] == 25.0 and math.isclose(got["a"][1], 37.0) and got["b"] == (1.0, 1.0) and set(got) == {"a", "b"}
    assert quantiles.interpolated(d.limit(0), ["g"], "v", {"m": 0.5}).count() == 0
