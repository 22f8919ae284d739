"""Exact top-k against brute force: ties, repeated keys, odd vectors, several shards and blocks, early stops."""

import random

import numpy as np

from mnemospark.llm import topk_index

DDL = "vec_id long, embedding array<double>, label int, rank int, score long"


def plain(rows, every=100, k=10):
    ints = [None if e is None or any(x is None or not np.isfinite(x) for x in e) else [int(np.floor(1024 * x)) for x in e] for _, e, *_ in rows]
    out = []
    for i, (q, *_) in enumerate(rows):
        if ints[i] is None or q is None or q % every:
            continue
        found = [(-sum(a * b for a, b in zip(ints[i], ints[j])), rows[j][0] is None, rows[j][0] or 0) for j in range(len(rows)) if j != i and ints[j] is not None and len(ints[j]) == len(ints[i])]
        out += [(q, n, None if none else key, -s) for n, (s, none, key) in enumerate(sorted(found)[:k], 1)]
    return sorted(map(str, out))


def rows_of(df):
    return sorted(str((r.query_id, r["rank"], r.vec_id, r.score)) for r in df.collect())


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 0.1) for _ in range(12)], 1, 1, 1) for i in range(700)]
    rows += [(10_000 + i, rows[7][1], 1, 1, 1) for i in range(30)]  # ties
    rows += [rows[100], (200, rows[3][1], 1, 1, 1), (None, rows[100][1], 1, 1, 1), (None, rows[5][1], 1, 1, 1)]  # repeated and null keys
    rows += [(300, None, 1, 1, 1), (900, [0.1, None] * 6, 1, 1, 1), (1000, [float("nan")] * 12, 1, 1, 1), (1100, [float("inf")] * 12, 1, 1, 1), (1200, [], 1, 1, 1), (1300, [0.5] * 5, 1, 1, 1), (1301, [0.25] * 5, 1, 1, 1), (-100, [0.0] * 12, 1, 1, 1)]
    d = spark.createDataFrame(rows, DDL).repartition(5)
    assert rows_of(topk_index.top_k(d)) == plain(rows)
    assert rows_of(topk_index.top_k(d, every=150, k=3)) == plain(rows, 150, 3)
    monkeypatch.setattr(topk_index, "QUERY_BYTES", 300)  # several blocks
    assert rows_of(topk_index.top_k(d)) == plain(rows)


def test_small_shards_are_searched_together():
    rnd = np.random.default_rng(5)
    ints = rnd.integers(-300, 300, (900, 16)).astype(np.int32)
    whole = topk_index.Shard.of(np.arange(900), np.arange(900), ints)
    parts = [topk_index.Shard.of(np.arange(a, a + 90), np.arange(a, a + 90), ints[a : a + 90]) for a in range(0, 900, 90)]
    for i in range(0, 900, 45):
        q = ints[i].astype(np.int64)
        exact = ints.astype(np.int64) @ q
        want = [j for j in np.lexsort((np.arange(900), -exact)) if j != i][:10]
        assert whole.best(q, 10, topk_index.LEAST, i)[1].tolist() == want
        found, floor = [], topk_index.LEAST
        for p in parts:
            own = i - p.rows[0] if p.rows[0] <= i < p.rows[0] + 90 else None
            found = sorted(found + list(zip(*(x.tolist() for x in p.best(q, 10, floor, own)))), key=lambda x: (-x[0], x[1]))[:10]
            floor = found[-1][0] if len(found) == 10 else floor
        assert [x[1] for x in found] == want


def test_stops_before_the_end_and_only_on_proof():
    rnd = np.random.default_rng(6)
    ints = np.floor(1024 * rnd.normal(0, 0.125, (4000, 64))).astype(np.int32)
    shard = topk_index.Shard.unpacked(*topk_index.Shard.of(np.arange(4000), np.arange(4000), ints).packed())
    processed = 0
    for i in range(0, 4000, 200):
        q = ints[i].astype(np.int64)
        exact = ints.astype(np.int64) @ q
        tenth = np.sort(np.delete(exact, i))[-10]
        may, n = shard.possible(q, 10, topk_index.LEAST, i)
        assert set(np.flatnonzero(exact >= tenth)) - {i} <= set(may.tolist())
        processed += n
    assert processed < 0.8 * 20 * 4000 * 64


def test_values_without_room_for_bounds(spark):
    rows = [(i, [3e4 * (i % 5), -1e300, float(i)], 1, 1, 1) for i in range(0, 400, 50)]
    d = spark.createDataFrame(rows, DDL)
    limit = topk_index.INTEGER_LIMIT
    ints = {r[0]: [max(-limit, min(limit, int(np.floor(1024 * x)))) for x in r[1]] for r in rows}
    want = {q: sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q) for q in ints if q % 100 == 0}
    got = topk_index.top_k(d).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted((q, n, c, -s) for q, x in want.items() for n, (s, c) in enumerate(x, 1))


def test_empty(spark):
    d = spark.createDataFrame([(1, None, 1, 1, 1)], DDL)
    assert topk_index.top_k(d).count() == 0 and topk_index.top_k(d.limit(0)).count() == 0
