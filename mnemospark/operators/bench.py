"""Measures of retrieval quality over runs of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWERED = ("identifier", "prose")


def bench_rank(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Each case's first rank whose page is the expected one or lies above or below it, and the top score."""
    path = (F.col("source") == F.col("expected")) | F.expr("startswith(source, expected)") | F.expr("startswith(expected, source)")
    joined = cases.join(results, "id", "left")
    return joined.groupBy(*cases.columns).agg(F.min(F.when(path, F.col("rank"))).alias("rank"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"))


def bench_summary(ranked: DataFrame, floor: float) -> DataFrame:
    asked, absent = F.col("kind").isin(*ANSWERED), F.col("kind") == "absent"
    share = lambda hit, of: F.round(F.count_if(of & hit) / F.nullif(F.count_if(of), F.lit(0)), 4)
    return ranked.agg(share(F.col("rank") == 1, asked).alias("recall_1"), share(F.col("rank") <= 5, asked).alias("recall_5"), share(F.coalesce("top_score", F.lit(0.0)) < floor, absent).alias("absent_ok"), F.count(F.lit(1)).alias("cases"))


def recall_drop(old: DataFrame, new: DataFrame, k: int = 5) -> DataFrame:
    """Recall before and after over the cases that both runs have."""
    hit = lambda c: F.avg(F.coalesce((F.col(c) <= k).cast("int"), F.lit(0)))
    both = old.select("id", F.col("rank").alias("o")).join(new.select("id", F.col("rank").alias("n")), "id")
    return both.agg(hit("o").alias("before"), hit("n").alias("after"), F.count(F.lit(1)).alias("shared"))
