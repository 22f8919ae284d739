"""Queries of upkeep, on stores made of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upkeep
from .base import query, shared, table

_PLAIN = "replace(coalesce(text, ''), '#', ' ')"
FULL = shared("full_pages", "documents", page="doc_id", body=f"'# T' || chr(10) || '## Small' || chr(10) || 'x' || chr(10) || '## Big' || chr(10) || {_PLAIN} || chr(10) || '## Mid' || chr(10) || left({_PLAIN}, 900)")


@query(f"""WITH p AS (SELECT doc_id AS page, {_PLAIN} AS t FROM documents), s AS (SELECT page, 28 + length(t) + least(900, length(t)) AS total, unnest([{{'section': '## Small', 'n': 11::BIGINT}}, {{'section': '## Big', 'n': 8 + length(t)}}, {{'section': '## Mid', 'n': 8 + least(900, length(t))}}]) AS x FROM p),
o AS (SELECT page, total, x.section AS section, x.n AS n, coalesce(sum(x.n) OVER (PARTITION BY page ORDER BY x.n DESC, x.section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM s)
SELECT page, section, n AS chars FROM o WHERE total > 2000 AND total - 2000 - gone > 0""".replace("28 + length(t)", "30 + length(t)"))
def section_moves(spark, sf):
    return upkeep.section_moves(FULL.df(spark, sf), "page", "body", 2000)


_SAID = "CASE doc_id % 5 WHEN 0 THEN 'the index keeps its strongest lines' WHEN 1 THEN 'this was never written down ' || doc_id WHEN 2 THEN 'the index keeps ... the last part of it' WHEN 3 THEN 'short' ELSE 'its strongest lines' END"
CANDIDATES = shared("candidates", "documents", source="'s' || doc_id % 20", n="doc_id", text="CASE WHEN doc_id % 10 = 4 THEN 'DB_PASS=x' || doc_id ELSE 'fact  number ' || doc_id % 150 END", quote=_SAID, body="coalesce(text, '') || ' So *the index* keeps its strongest lines, then the last part of it.'")


@query(f"""WITH {CANDIDATES.sql}, ok AS (SELECT source, 'fact number ' || n % 150 AS plain, text FROM candidates WHERE n % 5 IN (0, 2, 4) AND n % 10 <> 4),
one AS (SELECT plain, text, min(source) AS source FROM ok GROUP BY plain, text) SELECT source, text, sha256(plain) AS marker FROM one WHERE plain <> 'fact number 7' AND plain <> 'fact number 20' QUALIFY row_number() OVER (PARTITION BY source ORDER BY text) <= 5""")
def fact_candidates(spark, sf):
    done = spark.createDataFrame([("fact number 7",), ("fact number 20",)], "t string").select(F.sha2("t", 256).alias("marker"))
    return upkeep.facts(CANDIDATES.df(spark, sf), done, most=5).select("source", F.regexp_replace("text", "^(fact) +", "fact  ").alias("text"), "marker")


CHANGES = shared(
    "proposed", "documents", n="doc_id", path="CASE WHEN doc_id % 9 = 0 THEN 'projects/q/context/' WHEN doc_id % 9 = 1 THEN 'projects/p/context/topics/' ELSE 'projects/p/context/' END || doc_id || '.md'", before="CASE WHEN doc_id % 4 = 0 THEN 'old' WHEN doc_id % 4 < 3 THEN 'r' || doc_id END",
    text="CASE WHEN doc_id % 6 = 5 THEN 'DB_PASS=abc' || doc_id WHEN doc_id % 7 = 3 THEN 'a page of more than forty characters, which is its cap' ELSE 'fine ' || doc_id END",
)


@query("""WITH c AS (SELECT doc_id AS n, CASE WHEN doc_id % 9 = 0 THEN 'projects/q/context/' WHEN doc_id % 9 = 1 THEN 'projects/p/context/topics/' ELSE 'projects/p/context/' END || doc_id || '.md' AS path FROM documents), r AS (SELECT path, CASE WHEN n % 9 = 0 THEN 'outside' WHEN n % 6 = 5 THEN 'secret'
WHEN n % 4 = 0 OR n % 4 = 3 THEN 'stale' WHEN n % 7 = 3 THEN 'over_cap' WHEN n % 9 = 1 AND n % 2 = 1 THEN 'unlinked' END AS reason FROM c) SELECT path, reason FROM r WHERE reason IS NOT NULL""")
def plan_rejects(spark, sf):
    c = CHANGES.df(spark, sf)
    pages = c.select("path", F.concat(F.lit("r"), F.col("n").cast("string")).alias("revision"))
    linked = F.when(F.col("n") % 2 == 0, F.array("path")).otherwise(F.array().cast("array<string>"))
    return upkeep.plan_rejects(c.withColumn("linked_from", linked), pages, "p", 40)


@query("""SELECT 'p' || doc_id AS path FROM documents WHERE text IS NOT NULL AND doc_id % 60 BETWEEN 1 AND 35 AND doc_id % 3 <> 0 ORDER BY doc_id % 60, 'p' || doc_id LIMIT 40""")
def to_summarise(spark, sf):
    """The newest 40 sources of the last 35 days without a receipt for their content."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), "text")
    sources = d.withColumn("mtime", F.timestamp_add("DAY", (-(F.col("doc_id") % 60)).cast("int"), F.lit("2026-03-10 08:00:00").cast("timestamp")))
    receipts = d.where("doc_id % 3 < 2").select("path", F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).otherwise("an older one").alias("sha"))
    return upkeep.to_summarise(sources, receipts, "2026-03-10").select("path")


@query("SELECT 's' || user_id AS store FROM events WHERE event_type = 'error' GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY")
def salient_stores(spark, sf):
    t = table(spark, sf, "events").where("event_type = 'error'").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("store"), F.col("ts").cast("timestamp").alias("mtime"))
    return upkeep.salient_stores(t, "2024-01-30 00:00:00", 7)
