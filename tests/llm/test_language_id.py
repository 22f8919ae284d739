"""The sample of the language model: repeated identifiers, copies, missing labels, many labels."""

import collections

from mnemospark.llm import language_id

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string"


def labelled(spark):
    return [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect() if r.text and r.lang]


def test_one_identifier_for_all_rows_learns_every_language(spark):
    rows = labelled(spark)
    for doc_id in range(1, 8):
        d = spark.createDataFrame([(doc_id, f"{t} {i}", lang) for i, (t, lang) in enumerate(rows * 5)], DDL)
        assert set(language_id.fit(d).languages) == {lang for _, lang in rows}


def test_the_sample_is_bounded_and_has_each_copy_once(spark, monkeypatch):
    seen = []
    fit = language_id.fit_texts
    monkeypatch.setattr(language_id, "fit_texts", lambda x: seen.append(list(x)) or fit(seen[-1]))
    rows = [(i % 3, f"word number {i}", "a") for i in range(900)] + [(1, "the same text", "b")] * 700 + [(i, f"wort {i}", "c") for i in range(5)]
    language_id.fit(spark.createDataFrame(rows, DDL).repartition(4))
    assert collections.Counter(lang for lang, _ in seen[0]) == {"a": language_id.SAMPLE, "b": 1, "c": 5}


def test_nothing_learned_keeps_all_rows(spark):
    d = spark.createDataFrame([(i, f"text {i}", None) for i in range(20)] + [(None, None, None)], DDL)
    model = language_id.fit(d)
    assert not model.languages and language_id.known(d, model).count() == 21
    assert {(r.lang_pred, r.score) for r in language_id.language_id(d).collect()} == {("und", 0.0)}


def test_many_labels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LABELS", 3)
    d = spark.createDataFrame([(10 * i + k, f"text {'xyz'[k % 3] * i} {k}", f"l{i}") for i in range(1, 8) for k in range(i)], DDL)
    assert language_id.fit(d).languages == ["l5", "l6", "l7"]


def test_ties_go_to_the_first_language_by_name():
    model = language_id.fit_texts([("b", "same words here"), ("a", "same words here")])
    assert model.predict(["same words here"])[0] == ["a"]
