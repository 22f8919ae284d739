"""The pipeline's stages against brute force on a small table."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer
import public_tokenizers

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "decontamination", "bpe"]
    before = {r.doc_id: r.text for r in docs.collect()}
    steps = [before]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        steps.append({r.doc_id: r.text for r in docs.collect()})
        assert set(steps[-1]) <= set(steps[-2])
    known, exact, near, clean = steps[1:]
    assert len(known) >= 0.99 * len(before)
    assert set(exact) == {max(i for i, t in known.items() if t == text) for text in set(known.values())}
    items = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = {i: f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} " for i, t in near.items()}
    assert {i for i in near if any(x in plain[i] for x in items)} <= set(near) - set(clean)
    tokens = {r.doc_id: r.n_tokens for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in clean.items()}


def test_run(spark):
    assert 0 < corpus_pipeline.run(spark, SF).count() < spark.read.parquet(f"{SF}/documents.parquet").count()


def test_stages_on_nulls_ties_repeats_and_clashing_columns(spark, tmp_path):
    corpus = spark.read.parquet(f"{SF}/documents.parquet")
    long = [r.text.split() for r in corpus.where("lang = 'en' and n_chars between 600 and 3000").orderBy("doc_id").limit(6).collect()]
    one, two, three = (" ".join(w[:40]) for w in (long[0], long[2], long[4]))
    rows = [(1, one), (2, one), (2, one), (3, None), (4, ""), (5, "12345 67890"), (None, one + " " + long[0][40]), (None, two), (6, three)]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, rejected string, component_id long, kept string, row string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7.0, "mine", "no", 5, "k", "r") for i, t in rows], names)
    spark.createDataFrame([(1, " ".join(long[4][5:30]).upper())], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    known, exact, near, clean, encoded = (stage for _, stage in corpus_pipeline.STAGES)
    told = lambda df: sorted((r.doc_id or -1, r.text) for r in df.collect())
    others = corpus.withColumn("doc_id", F.col("doc_id") + 1000)
    for name, value in (("score", 7.0), ("lang_pred", "mine"), ("rejected", "no"), ("component_id", 5), ("kept", "k"), ("row", "r")):
        others = others.withColumn(name, F.lit(value).cast(docs.schema[name].dataType))
    a = known(spark, docs.unionByName(others), str(tmp_path)).where("coalesce(doc_id, 0) < 1000")
    assert a.columns == docs.columns and {(r.score, r.lang_pred, r.rejected) for r in a.collect()} == {(7.0, "mine", "no")}
    lettered = [(i, t) for i, t in rows if t and any(map(str.isalpha, t))]
    assert told(a) == sorted((i or -1, t) for i, t in lettered)
    b = exact(spark, a, str(tmp_path))
    assert b.columns == docs.columns and told(b) == sorted({(-1 if i is None else 2 if t == one else i, t) for i, t in lettered})
    c = near(spark, b, str(tmp_path))
    assert c.columns == docs.columns and told(c) == [(-1, two), (2, one), (6, three)]
    e = clean(spark, c, str(tmp_path))
    assert e.columns == docs.columns and told(e) == [(-1, two), (2, one)]
    assert encoded(spark, e, str(tmp_path)).count() == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
