"""Vector search over cells against brute force: pruning, allow-lists, zero vectors, ties, odd vectors."""

import random

import numpy as np
from pyspark.sql import functions as F

from mnemospark.operators import cells


def plain(rows, queries, k, allowed=None):
    unit = lambda e: np.array(e) / max(np.sqrt(np.dot(e, e)), 1e-300)
    out = []
    for q, e in queries:
        found = sorted((-(round(float(unit(e) @ unit(x)), 6) + 0.0), i) for i, x in rows if i != q and (allowed is None or i in allowed))
        out += [(q, i, -s + 0.0, n) for n, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.query, r.key, r.similarity, r["rank"]) for r in df.collect())


def clustered(n, seed=1):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    return [(i, [x + rnd.gauss(0, 0.02) for x in centres[i % 12]]) for i in range(n)]


def test_exact_with_and_without_an_allow_list(spark, monkeypatch):
    rows = clustered(700)
    rows += [(900 + i, rows[5][1]) for i in range(30)] + [(950, [0.0] * 6), (1000, [0.0] * 6)]  # ties and zero vectors
    odd = [(2000, None), (2001, []), (2002, [1.0, None] * 3), (2003, [float("nan")] * 6), (None, rows[1][1]), (2004, [1.0] * 5)]
    d = spark.createDataFrame(rows + odd, "key long, embedding array<double>").repartition(4)
    monkeypatch.setattr(cells, "SAMPLE", 100)
    index = cells.build(d, "key")
    queries = [r for r in rows if r[0] % 100 == 0]
    asked = d.where("key % 100 = 0")
    assert rows_of(cells.search(index, asked, k=7)) == plain(rows, queries, 7)
    few = d.where("key % 9 = 4").select("key")
    assert rows_of(cells.search(index, asked, k=7, allowed=few)) == plain(rows, queries, 7, {i for i, _ in rows if i % 9 == 4})
    monkeypatch.setattr(cells, "QUERY_BYTES", 100)
    assert rows_of(cells.search(index, asked, k=3)) == plain(rows, queries, 3)
    assert cells.search(index, asked, allowed=few.limit(0)).count() == 0


def test_cells_far_from_a_query_are_not_read(spark):
    rows = clustered(1200, seed=3)
    index = cells.build(spark.createDataFrame(rows, "key long, embedding array<double>").repartition(3), "key")
    asked = spark.createDataFrame(rows[:1], "key long, embedding array<double>")
    assert rows_of(cells.search(index, asked, k=5)) == plain(rows, rows[:1], 5)
    assert 0 < index.read < index.rows.where("cell >= 0").select("cell").distinct().count() / 2


def test_stale_chunks_are_dropped_before_ranking(spark):
    rows = [(i, f"s{i % 5}", i // 5, f"r{i % 2}", v) for i, v in clustered(60)]
    chunks = spark.createDataFrame(rows, "key long, source string, line long, revision string, embedding array<double>")
    pages = spark.createDataFrame([(f"s{i}", "r1") for i in range(4)], "source string, revision string")
    index = cells.build(chunks, "key", keep=("source", "line"))
    hits = cells.source_hits(index, rows[0][4], 3, cells.fresh(chunks, pages).select("key")).collect()
    ok = [(i, v) for i, s, _, r, v in rows if r == "r1" and s != "s4"]
    near = plain(ok, [(-1, rows[0][4])], 30)
    best = {}
    for _, i, s, rank in sorted(near, key=lambda x: x[3]):
        best.setdefault(rows[i][1], (i, s))
    assert [(h.key, h.similarity, h.score) for h in hits] == [(i, s, round(1 / (60 + n), 5)) for n, (i, s) in enumerate(list(best.values())[:3])]


def test_nothing_indexed(spark):
    d = spark.createDataFrame([(1, None)], "key long, embedding array<double>")
    index = cells.build(d, "key")
    assert cells.search(index, d).count() == 0
    assert index.rows.agg(F.count(F.lit(1))).first()[0] == 0
