"""lm_base_scores: op9's rows as far as SQL states them, without the sequences that only its score needs."""

from oracle import duck, rows

from mnemospark.llm import lm_score, queries

SF = "/root/testdata/sf0.001"
NAMES = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score")


def test_base_scores_write_no_sequences(spark, monkeypatch):
    names, write = [], lm_score.written
    monkeypatch.setattr(lm_score, "written", lambda df, name: names.append(name) or write(df, name))
    assert rows(queries.lm_base_scores(spark, SF).toPandas()) == rows(duck(queries.ORACLES["lm_base_scores"], SF))
    assert names == ["lm-counts", "lm-scores"]


def test_base_scores_are_those_of_the_model(spark):
    d = spark.createDataFrame([(1, "a b c a b c"), (1, "a b c"), (None, "a b Z"), (2, None), (3, ""), (7, "new words " * 30)], "doc_id long, text string").repartition(3)
    base, whole = lm_score.base_scores(d), lm_score.language_model_scores(d)
    assert base.columns == [c for c in whole.columns if c != "score"]
    assert rows(base.toPandas()) == rows(whole.drop("score").toPandas())
