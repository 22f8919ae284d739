"""Vector codes against a plain version: nearest entries, rounds, dropped and repeated rows, labels."""

import hashlib
import random

import numpy as np

from mnemospark.llm import vector_codes

DDL = "vec_id long, embedding array<float>, label string, code string, error int"


def plain(rows, parts, entries, rounds, scale=256):
    ok = [(k, e, lab) for k, e, lab, *_ in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    ints = [[int(np.floor(scale * float(np.float32(x)))) for x in e] for _, e, _ in ok]
    order = sorted(range(len(ok)), key=lambda i: (ok[i][0] is None, ok[i][0] or 0, ints[i]))
    width = next((len(ints[i]) for i in order if ints[i] and len(ints[i]) % parts == 0), 0)
    keep = [i for i in order if width and len(ints[i]) == width]
    w = width // parts
    cut = {i: [tuple(ints[i][j * w : (j + 1) * w]) for j in range(parts)] for i in keep}
    books = [[cut[i][j] for i in keep[:entries]] for j in range(parts)]
    near = lambda book, x: min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(book))
    for _ in range(rounds):
        for j in range(parts):
            mine = {}
            for i in keep:
                mine.setdefault(near(books[j], cut[i][j])[1], []).append(cut[i][j])
            books[j] = [tuple(sum(c) // len(mine[n]) for c in zip(*mine[n])) if n in mine else c for n, c in enumerate(books[j])]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = [(ok[i][0], "".join(f"{near(books[j], cut[i][j])[1]:02x}" for j in range(parts)), sum(near(books[j], cut[i][j])[0] for j in range(parts)), ok[i][2]) for i in keep]
    total = {}
    for *_, error, label in out:
        total[label] = total.get(label, 0) + error
    return sorted((str(k), code, error, total[label], digest) for k, code, error, label in out)


def rows_of(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def sample(n, width, seed, grid):
    rnd = random.Random(seed)
    return [(i, [rnd.randint(-grid, grid) / 256 + rnd.choice([0, 0.001]) for _ in range(width)], rnd.choice(["a", "a", "b", None]), "x", 1) for i in rnd.sample(range(10 * n), n)]


def test_nearest_is_the_lowest_of_equally_near():
    rnd = np.random.default_rng(3)
    for n, width, grid in ((1, 1, 3), (5, 2, 1), (64, 4, 2), (64, 4, 200), (200, 3, 5), (64, 1, 0)):
        book, points = rnd.integers(-grid, grid + 1, (n, width)), rnd.integers(-grid - 2, grid + 3, (700, width))
        square = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        found, best = vector_codes.Tree(book).nearest(points)
        assert (found == square.argmin(axis=1)).all() and (best == square.min(axis=1)).all()


def test_rounds_by_brute_force(spark):
    for n, width, parts, entries, rounds, grid in ((90, 8, 4, 16, 2, 3), (60, 4, 2, 64, 3, 100), (10, 6, 3, 16, 1, 1)):
        rows = sample(n, width, n, grid)
        rows += [(rows[0][0], rows[1][1], "b", "x", 1)] + rows[:3] + [(10**6, rows[0][1], None, "x", 1)] * 40  # repeated keys, rows and vectors
        rows += [(None, rows[2][1], "c", "x", 1), (1, None, "a", "x", 1), (2, [], "a", "x", 1), (3, [0.5] * (width - 1) + [None], "a", "x", 1), (4, [0.5] * (width - 1) + [float("nan")], "a", "x", 1), (5, [float("-inf")] * width, "a", "x", 1), (10**7, [0.1] * (2 * width), None, "x", 1)]
        d = spark.createDataFrame(rows, DDL).repartition(3)
        got = vector_codes.compressed(d, parts=parts, entries=entries, rounds=rounds)
        assert rows_of(got) == plain(rows, parts, entries, rounds)


def test_one_label_for_most_rows_and_many_small_ones(spark):
    rows = [(i, [i % 7 / 10, -(i % 5) / 10], "hot" if i % 3 else f"l{i}", "x", 1) for i in range(400)]
    d = spark.createDataFrame(rows, DDL).repartition(4)
    assert rows_of(vector_codes.compressed(d, parts=2, entries=8)) == plain(rows, 2, 8, 2)


def test_no_vectors(spark):
    d = spark.createDataFrame([(1, None, "a", "x", 1), (2, [], None, "x", 1)], DDL)
    assert vector_codes.compressed(d).count() == 0 and vector_codes.compressed(d.limit(0)).count() == 0


def test_decoded_and_saturated(spark):
    rows = [(1, [0.0, 1.0], "a", "x", 1), (2, [1e30, -1e30], "a", "x", 1)]
    d = spark.createDataFrame(rows, DDL)
    books = vector_codes.train(d, parts=2, entries=2)
    limit = vector_codes.INTEGER_LIMIT
    out = vector_codes.encoded(d, books, ["vec_id"]).select("vec_id", "error", vector_codes.decoded("code", books).alias("back"))
    assert sorted(map(tuple, out.collect())) == [(1, 0, [0, 256]), (2, 0, [limit, -limit])]
