"""fts_postings: words are counted where their row is read; only a chunk of several rows is summed elsewhere."""

import pyarrow as pa
from oracle import duck, rows

from mnemospark.operators import bm25
from mnemospark.plans.catalogue import ORACLES

TEXTS = [
    (1, "Straße strasse a-b a.b_c 12,5 ½"), (2, "naïve Ñandú ÉÉ éé 漢字 漢字 𝒳x éte"), (3, None), (4, ""), (5, " .-\n\t"), (6, "one " * 5000 + "two"), (7, "\n x\r\ny x  y"),
]
MORE = [(1, "b a strasse x y z q 9"), (1, "a"), (None, "lost words"), (None, "found words"), (None, "words"), (8, "alone")]


def test_one_row_a_chunk_needs_no_exchange(spark):
    d = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    plan = bm25.postings(d.localCheckpoint(), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_postings_of_odd_and_repeated_rows(spark, tmp_path):
    for name, given in (("once", TEXTS), ("again", TEXTS + MORE)):
        spark.createDataFrame(given, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}/raw")
        next((tmp_path / name / "raw").glob("*.parquet")).rename(tmp_path / name / "documents.parquet")
        got = bm25.postings(spark.read.parquet(f"{tmp_path}/{name}/documents.parquet"), "doc_id", "text")
        assert got.dtypes == [("term", "string"), ("doc_id", "bigint"), ("n", "bigint"), ("tf", "bigint")]
        assert rows(got.toPandas()) == rows(duck(ORACLES["fts_postings"], f"{tmp_path}/{name}"))


def test_counts_are_the_same_in_slices_of_any_size(monkeypatch):
    given = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c", None, "e"]), pa.array(["x y x", None, "", "y", "z z z z y"])], names=["k", "w"])
    want = {("x", "a", 3, 2), ("y", "a", 3, 1), ("y", None, 1, 1), ("z", "e", 5, 4), ("y", "e", 5, 1)}
    for size in (1, 6, 1 << 20):
        monkeypatch.setattr(bm25, "COUNT_BYTES", size)
        got = [tuple(r.values()) for b in bm25._counts(iter([given, given.slice(2, 3)])) for r in b.to_pylist()]
        assert len(got) == 8 and set(got) == want
