"""Upkeep of a store: sections to move out of a full page, facts worth keeping, batches of proposed saves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import HORIZON_DAYS, SOURCE_CAP
from ..functions import text as T


def section_moves(pages: DataFrame, key: str, text: str, cap: int, reserve: int = 0) -> DataFrame:
    """key, section, chars of the ``## `` sections that move to hubs: the largest first, until the page fits its cap.

    A page's sections and the running choice stay in its row.
    """
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"(?=\n## )")
    sections = F.transform(F.filter(parts, lambda s: F.startswith(s, F.lit("\n## "))), lambda s: F.struct((-F.length(s)).alias("n"), F.regexp_extract(s, r"^\n(## [^\n]*)", 1).alias("section")))
    over = F.length(text) + reserve - cap

    def step(a, s):
        take = a["left"] > 0
        return F.struct(F.when(take, a["left"] + s["n"]).otherwise(a["left"]).alias("left"), F.when(take, F.concat(a["out"], F.array(s))).otherwise(a["out"]).alias("out"))

    start = F.struct(over.cast("int").alias("left"), F.array().cast("array<struct<n:int,section:string>>").alias("out"))
    moved = F.aggregate(F.array_sort(sections), start, step, lambda a: a["out"])
    return pages.where(F.length(text) + reserve > cap).select(key, F.explode(moved).alias("m")).select(key, "m.section", (-F.col("m.n")).cast("long").alias("chars"))


def facts(candidates: DataFrame, done: DataFrame, most: int = 12) -> DataFrame:
    """Candidates (source, text, quote, body) whose quote is in the body and that hold no secret: new ones, each
    text once, at most so many for a source."""
    ok = candidates.where((F.trim("text") != "") & T.quote_supported(F.col("quote"), F.col("body")) & ~T.has_secret(F.col("text")))
    marked = ok.withColumn("marker", T.digest(T.squeeze(F.col("text"))))
    first = Window.partitionBy("marker").orderBy("source", "text")
    new = marked.withColumn("n", F.row_number().over(first)).where("n = 1").join(done, "marker", "left_anti")
    place = Window.partitionBy("source").orderBy("text")
    return new.withColumn("n", F.row_number().over(place)).where(F.col("n") <= most).select("source", "text", "marker")


def plan_rejects(changes: DataFrame, pages: DataFrame, store: str, cap: int) -> DataFrame:
    """path and the first reason why a proposed change goes back whole: outside, secret, stale, over_cap, unlinked."""
    j = changes.join(pages.select("path", F.col("revision").alias("now")), "path", "left")
    linked = F.exists(F.col("linked_from"), lambda x: x == F.col("path")) if "linked_from" in changes.columns else F.lit(True)
    reason = (
        F.when(~F.col("path").rlike(rf"^projects/{store}/context/(?:[A-Za-z0-9._-]+/)*[A-Za-z0-9._-]+\.md$"), "outside").when(T.has_secret(F.col("text")), "secret")
        .when(~F.col("before").eqNullSafe(F.col("now")), "stale").when(F.length("text") > cap, "over_cap").when(F.col("path").contains("/topics/") & ~linked, "unlinked")
    )
    return j.select("path", reason.alias("reason")).where("reason is not null")


def to_summarise(sources: DataFrame, receipts: DataFrame, today: str, limit: int = 40) -> DataFrame:
    """Sources of the last days before today, not oversize and without a receipt for their content: newest first."""
    day = F.to_date(F.col("mtime"))
    fresh = sources.where((day < F.lit(today).cast("date")) & (day >= F.date_sub(F.lit(today).cast("date"), HORIZON_DAYS)) & (F.char_length("text") <= SOURCE_CAP))
    return fresh.withColumn("sha", T.digest(F.col("text"))).join(receipts, ["path", "sha"], "left_anti").orderBy(F.desc("mtime"), "path").limit(limit).select("path", "sha")


def salient_stores(transcripts: DataFrame, now: str, days: int) -> DataFrame:
    """Stores whose newest transcript is recent."""
    return transcripts.groupBy("store").agg(F.max("mtime").alias("newest")).where(F.col("newest") >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days))).select("store")
