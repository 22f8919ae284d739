"""Queries of the functions that need Python, with their results stated where they are short."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import python_text as P
from ..functions import text as T
from ..operators import maintenance, salience
from .base import Fixture, query, shared, table
from .event_queries import _FSM, ALERTS, HITS, LOG, SHOWN, _log


@query("SELECT doc_id, strip_accents(replace(lower(text), 'ß', 'ss')) AS folded FROM documents")
def fold_any(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.fold_column()("text").alias("folded"))


@query("SELECT doc_id, left(text, list_max(list_filter(range(0, 61), lambda k: strlen(left(text, k)) <= 60))::BIGINT) AS cut FROM documents")
def bounded(spark, sf):
    """The first sixty bytes of each text, with no torn character."""
    return table(spark, sf, "documents").select("doc_id", P.bounded_column(60)("text").alias("cut"))


@query()
def excerpt(spark, sf):
    """At most 200 bytes of each page that show the terms it can."""
    d = table(spark, sf, "documents").where(F.arrays_overlap(T.tokens(F.col("text")), F.array(F.lit("license"), F.lit("apache"), F.lit("onre"))))
    return d.select("doc_id", P.excerpt_column(200)("text", F.array(F.lit("license"), F.lit("apache"), F.lit("onre"))).alias("cut"))


INDEX = Fixture("indexes", "id int, body string", [(1, "# T\n\n## A\n- one\n  more\n- two\n\npara\ngoes on\n\n## B\n<!-- c\nd -->\n```\ncode\n\n```\nend\n")])


@query("""SELECT 1 AS id, CAST(pos AS INTEGER) AS pos, section, kind FROM (VALUES (0, '', 'fixed'), (1, '', 'blank'), (2, '## A', 'fixed'), (3, '## A', 'block'), (4, '## A', 'block'), (5, '## A', 'blank'), (6, '## A', 'block'), (7, '## A', 'blank'), (8, '## B', 'fixed'), (9, '## B', 'fixed'), (10, '## B', 'block')) AS v(pos, section, kind)""")
def block_units(spark, sf):
    return INDEX.df(spark).select("id", F.posexplode(P.units_column()("body")).alias("pos", "u")).select("id", "pos", "u.section", "u.kind")


MOVES = shared("moves", "documents", id="doc_id", body="'see [a](topics/' || doc_id || '.md#x) and `[a](topics/' || doc_id || '.md)` [gone](topics/no.md) [w](https://x.y) ' || coalesce(text, '')")


@query("SELECT doc_id AS id, 'see [a](' || CASE WHEN doc_id % 2 = 0 THEN '../topics/' ELSE 'topics/' END || doc_id || '.md#x) and `[a](topics/' || doc_id || '.md)` [gone](topics/no.md) [w](https://x.y) ' || coalesce(text, '') AS body FROM documents")
def rebase_links(spark, sf):
    """Links of pages that move to a folder below, where their targets are among the pages (every second one is)."""
    moves = MOVES.df(spark, sf).withColumns({"source": F.lit("c"), "target": F.lit("c/sub")})
    pages = moves.where("id % 2 = 0").select(F.concat(F.lit("c/topics/"), F.col("id").cast("string"), F.lit(".md")).alias("page"))
    return maintenance.rebased(moves, pages, "id", "body").select("id", "body")


@query()
def salience_tiers(spark, sf):
    """The documents as blocks of their source's index: a third of its characters may stay warm."""
    d = table(spark, sf, "documents")
    blocks = d.selectExpr("source AS ctx", "doc_id AS pos", "concat('fp', doc_id) AS fp", "n_chars AS chars", "doc_id * 37 % 101 / 10.0D AS strength", "doc_id % 4 = 0 AS cold", "doc_id % 23 = 1 AS protected", "doc_id % 8 <> 0 AS open")
    return salience.tiers(blocks, 20_000, pointer=salience.POINTER_CHARS)


@query(f"""WITH {LOG.sql}, {HITS.sql}, {SHOWN.sql},
s AS (SELECT l."at", l.request_id, l.session, l.query_hash, h.id, h.source, h.block FROM log l JOIN hits h ON h.request_id = l.request_id AND h."at" = l."at" WHERE l.event = 'search'),
refs AS (SELECT l."at", l.request_id, s.id FROM log l JOIN shown s USING (request_id) WHERE l.event = 'recall' AND l.session IS NOT NULL UNION ALL SELECT "at", request_id, result_id FROM log WHERE event = 'open' AND session IS NOT NULL),
e AS (SELECT request_id, id, arg_max(source, "at") AS source FROM s GROUP BY request_id, id), a AS (SELECT id, arg_max(source, "at") AS source FROM s GROUP BY id),
seen AS (SELECT r."at", coalesce(e.source, a.source) AS source FROM refs r LEFT JOIN e USING (request_id, id) LEFT JOIN a ON a.id = r.id)
SELECT source, count(*) AS shown FROM seen WHERE source IS NOT NULL GROUP BY source""")
def shown_pages(spark, sf):
    """How often readers were shown each page, by whatever way."""
    log = _log(spark, sf).withColumns({"origin": F.lit(None).cast("string"), "refs": F.lit(None).cast("array<string>")})
    return salience.shown_hits(log).groupBy("source").agg(F.count(F.lit(1)).alias("shown"))


@query(f"""WITH {LOG.sql}, {HITS.sql}, {SHOWN.sql},
s AS (SELECT l."at", l.request_id, l.session, l.query_hash, h.id, h.source, h.block FROM log l JOIN hits h ON h.request_id = l.request_id AND h."at" = l."at" WHERE l.event = 'search'),
refs AS (SELECT l."at", l.request_id, s.id FROM log l JOIN shown s USING (request_id) WHERE l.event = 'recall' AND l.session IS NOT NULL UNION ALL SELECT "at", request_id, result_id FROM log WHERE event = 'open' AND session IS NOT NULL),
e AS (SELECT request_id, id, arg_max(source, "at") AS source FROM s GROUP BY request_id, id), a AS (SELECT id, arg_max(source, "at") AS source FROM s GROUP BY id),
seen AS (SELECT r."at", coalesce(e.source, a.source) AS source FROM refs r LEFT JOIN e USING (request_id, id) LEFT JOIN a ON a.id = r.id),
talked AS (SELECT block, session, query_hash, min("at") AS "at" FROM s WHERE session IS NOT NULL AND block IS NOT NULL GROUP BY block, session, query_hash),
u AS (SELECT block AS fp, "at" FROM talked UNION ALL SELECT 'b' || p, seen."at" FROM range(0, 30) AS r(p) JOIN seen ON seen.source = 'p/' || p || '.md'),
t AS (SELECT 'b' || p AS fp, TIMESTAMP '2023-12-01' AS t FROM range(0, 30) AS r(p) UNION ALL SELECT fp, CAST("at" AS TIMESTAMP) FROM u)
SELECT fp, round(ln(sum(power(greatest(0.5::DOUBLE, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(t)) / 86400000000.0), -0.5::DOUBLE))), 6) AS strength FROM t GROUP BY fp""")
def block_strengths(spark, sf):
    """Thirty blocks of one store, each linking to a page: their births, prompts that talked about them, and readers who
    were shown their page."""
    log = _log(spark, sf).withColumns({"origin": F.lit(None).cast("string"), "refs": F.lit(None).cast("array<string>")})
    n = spark.range(30).select(F.lit("p").alias("ctx"), F.concat(F.lit("b"), "id").alias("fp"), F.lit("p/MEMORY.md").alias("index"), F.lit("2023-12-01").alias("first_seen"), F.concat(F.lit("p/"), "id", F.lit(".md")).alias("page"))
    used = salience.uses(log, n.select("ctx", "fp", "index"), n.select("ctx", "fp", "page"))
    return salience.strengths(n, used, "2024-02-01").select("fp", "strength")


@query(_FSM + " SELECT n, marker, state FROM step WHERE written")
def alert_stream(spark, sf):
    """The streaming state machine over the same calls as its batch twin; calls, states and what is told lie in the shared folder."""
    import uuid

    from ..session import shared_folder
    from ..streaming.jobs import ALERT_OUT
    from ..streaming.jobs import alert_stream as stream

    folder = f"{shared_folder(spark)}/alert-calls-{uuid.uuid4().hex}"
    ALERTS.df(spark, sf).write.parquet(f"{folder}/calls")
    calls = spark.readStream.schema("n long, day string, marker string, call string").parquet(f"{folder}/calls")
    told = stream(calls).writeStream.format("parquet").option("path", f"{folder}/told").option("checkpointLocation", f"{folder}/state")
    told.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(ALERT_OUT).parquet(f"{folder}/told")


@query("SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY start, event_type".replace("AS start", 'AS "start"').replace("GROUP BY start", "GROUP BY 1"))
def tumbling_week(spark, sf):
    """An extension: event-time windows of a week."""
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "7 days").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
