"""Fill-in-the-middle: rank and select against plain counting, forms and round trips against a plain version."""

import hashlib
import random

from pyspark.sql import functions as F

from mnemospark.llm import fill_middle

TEXTS = [None, "", "a", "é", "漢字かな", "😀" * 700, "a" * 511 + "é" + "b" * 600, "<", "<P", "P>", "<<P", "x<S>y", "tail<", "S>M>", "ab\ńc", "word " * 40_000, "同" * 100_000]


def plain(doc_id, text, plain_from=90, spm_below=20):
    t = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= plain_from:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = t[:a], t[a:b], t[b:]
    return (n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}") if h[3] % 100 < spm_below else (n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}")


def test_rank_and_select():
    rnd = random.Random(1)
    for _ in range(60):
        text = "".join(rnd.choice("aé漢😀\n") for _ in range(rnd.choice([0, 1, 63, 64, 65, 170, 512, 513, 3000])))
        data = text.encode()
        b = fill_middle.Boundaries(data)
        at = [len(text[:k].encode()) for k in range(len(text) + 1)]
        assert b.total == len(text)
        assert [b.select(k) for k in range(len(text) + 1)] == at
        for k in rnd.sample(range(len(text) + 1), min(len(text) + 1, 40)):
            assert b.rank(at[k]) == k


def test_forms_and_round_trip(spark):
    rnd = random.Random(2)
    texts = TEXTS + ["".join(rnd.choice("<PSM> aé漢") for _ in range(rnd.randint(0, 12))) for _ in range(600)]
    rows = [(i if i != 5 else None, t, "x", "y", 1) for i, t in enumerate(texts)] + [(7, "twice", "x", "y", 1)] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string, output string, form string, n int").repartition(3)
    out = fill_middle.transformed(d)
    got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.withColumn("back", fill_middle.restored()).collect())
    want = sorted((str(i), *plain(i, t), t or "") for i, t, *_ in rows)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transformed(d.limit(0)).count() == 0


def test_every_split_of_a_form_is_undone(spark):
    """Sentinels at every cut, whatever stands beside them."""
    parts = ["", "<", ">", "<P", "S>", "M", "P><", "<<", "é<"]
    rows = [(f, x + y + z, {"psm": f"<P>{x}<S>{z}<M>{y}", "spm": f"<S>{z}<P>{x}<M>{y}"}[f]) for f in ("psm", "spm") for x in parts for y in parts for z in parts]
    rows = [r for r in rows if not any(m in r[1] for m in ("<P>", "<S>", "<M>"))]
    d = spark.createDataFrame(rows, "form string, text string, output string")
    assert d.where(fill_middle.restored() != F.col("text")).count() == 0
