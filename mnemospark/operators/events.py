"""Analytics of usage events: recalls, latencies, engagement, feedback, references, as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import nearest_rank

#: A usage event, whatever its kind; fields that a kind lacks are null.
SCHEMA = """at string, event string, request_id string, session string, query_hash string, scope string, collection string, engine string, origin string,
elapsed_ms long, injected_bytes long, result_id string, outcome string, automatic boolean, file_path string, refs array<string>, hit_ids array<string>,
hits array<struct<id: string, source: string, line: long, score: double, matched_terms: array<string>, own: boolean, blocks: array<string>, revision: string>>"""


def recall_stats(events: DataFrame, since: str) -> DataFrame:
    """Recalls since then, those that injected a hit, their rate, and latencies at the median and 95 percent."""
    r = events.where((F.col("event") == "recall") & (F.col("at") >= since))
    injected = F.count_if(F.coalesce(F.size("hit_ids"), F.lit(0)) > 0)
    counts = r.agg(F.count(F.lit(1)).alias("recalls"), injected.alias("injected"), F.round(injected / F.nullif(F.count(F.lit(1)), F.lit(0)), 3).alias("injection_rate"))
    p = nearest_rank(r.withColumn("one", F.lit(1)), ["one"], "elapsed_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    return counts.withColumn("one", F.lit(1)).join(p, "one", "left").drop("one")


def recall_rows(events: DataFrame, since: str) -> DataFrame:
    """Each recall with its last search: the search's top hit, the hit it opened with, whether it injected."""
    searches = events.where((F.col("event") == "search") & (F.size("hits") > 0)).groupBy("request_id").agg(F.max_by(F.struct("query_hash", "hits"), "at").alias("s"))
    r = events.where((F.col("event") == "recall") & (F.col("at") >= since)).select("request_id", "at", "hit_ids").join(searches, "request_id")
    r = r.withColumn("top", F.element_at(F.array_sort("s.hits", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)), 1))
    injected = F.coalesce(F.size("hit_ids"), F.lit(0)) > 0
    r = r.withColumn("injected", injected).withColumn("opened", F.get(F.filter("s.hits", lambda h: h["id"] == F.get("hit_ids", F.lit(0))), F.lit(0)))
    shown = F.when(F.col("injected"), F.coalesce("opened", "top")).otherwise(F.col("top"))
    found = ~F.col("injected") | F.col("opened").isNotNull()
    return r.select("request_id", F.col("s.query_hash").alias("hash"), F.col("top.score").alias("top_score"), shown["source"].alias("source"), shown["line"].alias("line"), "injected", found.alias("opener_found"))


def usage_report(events: DataFrame) -> DataFrame:
    """Distinct searches, and those with at least one opened hit."""
    hits = events.where("event = 'search'").select("request_id", F.explode_outer("hits.id").alias("id"))
    opened = events.where("event = 'open'").select("request_id", F.col("result_id").alias("id")).distinct()
    with_open = hits.join(opened, ["request_id", "id"], "left_semi").agg(F.countDistinct("request_id").alias("with_open"))
    return events.where("event = 'search'").agg(F.countDistinct("request_id").alias("searches")).join(with_open)


def searches_with_open(events: DataFrame) -> DataFrame:
    hits = events.where("event = 'search'").select("request_id", F.explode("hits.id").alias("id"))
    opened = events.where("event = 'open'").select("request_id", F.col("result_id").alias("id"))
    return hits.join(opened, ["request_id", "id"], "left_semi").select("request_id").distinct()


def rag_report(events: DataFrame) -> DataFrame:
    rags = events.where("event = 'rag_edit'")
    some = rags.where("injected_bytes > 0")
    p50 = nearest_rank(some.withColumn("one", F.lit(1)), ["one"], "injected_bytes", {"injected_bytes_p50": 0.5})
    auto = events.where("event = 'feedback' and automatic")
    failed, judged = F.count_if(F.col("outcome") == "code_failed"), F.count_if(F.col("outcome").isin("code_passed", "code_failed"))
    one = lambda df: df.withColumn("one", F.lit(1))
    share = one(auto.agg(F.round(failed / F.nullif(judged, F.lit(0)), 3).alias("code_failed_share")))
    counts = one(rags.agg(F.count(F.lit(1)).alias("fired"), F.count_if(F.col("injected_bytes") > 0).alias("injected")))
    return counts.join(p50, "one", "left").join(share, "one").drop("one")


def resolve_refs(refs: DataFrame, hits: DataFrame) -> DataFrame:
    """Each reference (request_id, id) to its hit: that of the same request, else the last one with the id.

    hits: request_id, id, at, source."""
    exact = hits.groupBy("request_id", "id").agg(F.max_by("source", F.struct("at", "source")).alias("exact"))
    any_ = hits.groupBy("id").agg(F.max_by("source", F.struct("at", "request_id", "source")).alias("any"))
    return refs.join(exact, ["request_id", "id"], "left").join(any_, "id", "left").select("request_id", "id", F.coalesce("exact", "any").alias("source"))


def score_bins(df: DataFrame, score: str, floor: float, width: float) -> DataFrame:
    s = F.col(score)
    name = F.when((s >= 0) & (s < floor), "below").when((s >= floor) & (s < floor + width), "near").when(s >= floor + width, "above")
    return df.select(name.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def stratified(df: DataFrame, score: str, floor: float, width: float, per_bin: int, seed: int, key: str) -> DataFrame:
    """At most per_bin rows of each score bin, by a seeded hash of the key: the sampling operator."""
    s = F.col(score)
    name = F.when((s >= 0) & (s < floor), "below").when((s >= floor) & (s < floor + width), "near").when(s >= floor + width, "above")
    w = Window.partitionBy("bin").orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return df.withColumn("bin", name).where("bin is not null").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_bin).drop("__n")


def asof(left: DataFrame, right: DataFrame, on: str, at: str, seconds: int, value: str) -> DataFrame:
    """left with the latest value of right at or before its time, no older than so many seconds.

    A union in time order with the last seen value: no range join.
    """
    r = right.select(on, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.struct(F.col(at).alias("t"), F.col(value).alias("v")).alias("__seen"))
    l = left.select("*", F.col(at).alias("__at"), F.lit(1).alias("__side"))  # noqa: E741
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(on).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last("__seen", ignorenulls=True).over(w)
    near = F.unix_micros(F.col("__at").cast("timestamp")) - F.unix_micros(F.col("__last.t").cast("timestamp")) <= seconds * 1_000_000
    return both.withColumn("__last", seen).where("__side = 1").withColumn(f"last_{value}", F.when(near, F.col("__last.v"))).drop("__at", "__side", "__seen", "__last")


def activation(uses: DataFrame, key: str, days: Column, weight: Column) -> DataFrame:
    """Base-level activation: the logarithm of the weighted sum of ages (in days, half a day at least) to the power -1/2."""
    return uses.groupBy(key).agg(F.round(F.log(F.sum(weight * F.pow(F.greatest(F.lit(0.5), days), F.lit(-0.5)))), 6).alias("activation"))


def distinct_uses(events: DataFrame) -> DataFrame:
    """session, query, block: each prompt talks about a block once, whatever its search legs; none without a session."""
    s = events.where("event = 'search' and session is not null").select("session", F.coalesce("query_hash", "request_id").alias("query"), F.explode("hits").alias("h"))
    return s.where(F.coalesce("h.own", F.lit(True))).select("session", "query", F.explode("h.blocks").alias("block")).distinct()


def telemetry(hits: DataFrame) -> DataFrame:
    """What is logged of a search: the hits without content, the query as a digest."""
    bare = F.transform("hits", lambda h: F.struct(h["id"].alias("id"), h["source"].alias("source"), h["score"].alias("score")))
    return hits.select("request_id", F.sha2("query", 256).alias("query_hash"), bare.alias("hits"))
