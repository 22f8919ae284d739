"""Queries of sessions, maintenance, identity and graphs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import deltas, graph, maintenance, quality, sessions
from .base import query, shared, table


def _conv(spark, sf):
    return table(spark, sf, "conversations")


@query("SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' AND NOT regexp_matches(text, '^(<system-reminder>|<command-name>|<command-message>|<command-args>|<local-command-stdout>|<local-command-caveat>|<user-prompt-submit-hook>)')")
def conversation_filter(spark, sf):
    return sessions.conversation(_conv(spark, sf)).select("conv_id", "turn", "role")


def _line(**x):
    return json.dumps(x)


def _raw_lines(spark, sf):
    """Session logs made of the conversations: a file for each, a line for each turn. Odd turns have block content, some
    lines are meta, synthetic, sidechains or broken."""
    c = _conv(spark, sf).withColumn("n", F.col("conv_id") + F.col("turn"))
    said = F.when(F.col("n") % 13 == 4, F.concat(F.lit("<bash-stdout>"), "text")).otherwise(F.col("text"))
    quoted = F.regexp_replace(F.to_json(F.struct(said.alias("x"))), r'(?s)^\{"x":(.*)\}$', "$1")
    blocks = F.concat(F.lit('[{"type":"text","text":'), quoted, F.lit('},{"type":"tool_use","name":"x"}]'))
    flag = lambda name, when: F.when(when, F.lit(f'"{name}":true,')).otherwise("")
    line = F.concat(
        F.lit('{"type":"'), "role", F.lit('",'), flag("isMeta", F.col("n") % 7 == 3), flag("isSidechain", F.col("n") % 17 == 5), F.lit('"timestamp":"'), _stamp(), F.lit('Z","cwd":"/home/c'), F.col("conv_id").cast("string"),
        F.lit('","message":{"role":"'), "role", F.lit('","content":'), F.when(F.col("turn") % 2 == 1, blocks).otherwise(quoted), F.lit("}}"),
    )
    value = F.when(F.col("n") % 19 == 6, F.substring(line, 1, 30)).otherwise(line)
    return c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file"), F.col("turn").cast("long").alias("line_no"), value.alias("value"))


def _stamp():
    """Turns are a minute apart, conversations seven hours."""
    return F.date_format(F.timestamp_add("MINUTE", (420 * F.col("conv_id") + F.col("turn")).cast("int"), F.lit("2026-01-01T00:00:00").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss")


_N = "(conv_id + turn)"
_SAID = f"CASE WHEN {_N} % 13 = 4 THEN '<bash-stdout>' || text ELSE text END"
_TS = "(TIMESTAMP '2026-01-01' + to_minutes((420 * conv_id + turn)::INTEGER))"
#: What the lines say, from the table itself.
_SPOKEN = f"""spoken AS (SELECT conv_id, turn, role, {_TS} AS ts, CASE WHEN turn % 2 = 1 THEN trim({_SAID}, ' ') ELSE {_SAID} END AS said FROM conversations
WHERE {_N} % 19 <> 6 AND {_N} % 7 <> 3 AND {_N} % 17 <> 5 AND role IN ('user', 'assistant') AND trim(text) <> '')"""


@query(f"SELECT 'c' || conv_id || '.jsonl' AS file, count(*) AS turns FROM conversations WHERE role = 'user' AND {_N} % 19 <> 6 AND {_N} % 7 <> 3 AND {_N} % 17 <> 5 AND {_N} % 13 <> 4 GROUP BY conv_id")
def user_turn_counts(spark, sf):
    e = sessions.parse_lines(_raw_lines(spark, sf))
    return e.where(sessions.is_user_turn(e)).groupBy("file").agg(F.count(F.lit(1)).alias("turns"))


def _days(spark, sf):
    m = sessions.conversation(sessions.parse_lines(_raw_lines(spark, sf))).where("ts is not null")
    return m.select(F.lit("p").alias("store"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "file", "line_no", "role", "text")


_ENTRY = "chr(10) || '## ' || strftime(ts, '%H:%M:%S') || chr(10) || '**' || role || ':** ' || said"
_HEAD = "'<!-- auto-extracted from native session jsonl -->'"


@query(f"""WITH {_SPOKEN}, e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, ts, {_ENTRY} AS entry FROM spoken), u AS (SELECT *, sum(length(entry)) OVER (PARTITION BY day ORDER BY ts) <= 6000 AS fits FROM e)
SELECT day, {_HEAD} || coalesce(chr(10) || string_agg(entry, chr(10) ORDER BY ts) FILTER (WHERE fits), '') || CASE WHEN bool_and(fits) THEN '' ELSE chr(10) || chr(10) || '<!-- truncated at 6000 chars -->' END || chr(10) AS body FROM u WHERE day <> '2026-01-03' GROUP BY day""")
def transcript_day(spark, sf):
    """Every day but the one that is today, cut at 6,000 characters."""
    return sessions.transcript_days(_days(spark, sf), cap=6000, today="2026-01-03").select("day", F.col("text").alias("body"))


@query(f"""WITH e AS (SELECT conv_id, turn, chr(10) || '## ' || strftime({_TS}, '%H:%M:%S') || chr(10) || '**' || role || ':** ' || text AS entry FROM conversations), u AS (SELECT *, sum(length(entry)) OVER (PARTITION BY conv_id ORDER BY turn) <= 4000 AS fits FROM e)
SELECT conv_id, {_HEAD} || coalesce(chr(10) || string_agg(entry, chr(10) ORDER BY turn) FILTER (WHERE fits), '') || CASE WHEN bool_and(fits) THEN '' ELSE chr(10) || chr(10) || '<!-- truncated at 4000 chars -->' END || chr(10) AS body FROM u GROUP BY conv_id""")
def conversation_transcripts(spark, sf):
    m = _conv(spark, sf).select(F.col("conv_id").alias("store"), F.lit("d").alias("day"), _stamp().cast("timestamp").alias("ts"), F.lit("").alias("file"), F.col("turn").alias("line_no"), "role", "text")
    return sessions.transcript_days(m, cap=4000).select(F.col("store").alias("conv_id"), F.col("text").alias("body"))


def _second_lines(spark, sf):
    """Logs of the second kind made of the conversations: a session's directory, its messages, and counts between."""
    c = _conv(spark, sf).where("role <> 'system'")
    kind = F.when(F.col("role") == "user", "user_message").otherwise("agent_message")
    said = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(kind.alias("type"), F.col("text").alias("message")).alias("payload")))
    noise = F.lit('{"type":"event_msg","payload":{"type":"token_count"}}')
    moved = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("/w/"), (F.col("conv_id") % 5).cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("cwd")).alias("payload")))
    lines = c.select("conv_id", "turn", F.posexplode(F.array(moved, said, noise)).alias("i", "value"))
    return lines.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("file"), (3 * F.col("turn") + F.col("i")).cast("long").alias("line_no"), "value")


@query("SELECT 'c' || conv_id AS file, role, text AS body, '/w/' || conv_id % 5 || '/' || max(turn) OVER (PARTITION BY conv_id) AS cwd FROM conversations WHERE role <> 'system'")
def second_source(spark, sf):
    return sessions.parse_event_lines(_second_lines(spark, sf)).select("file", "role", F.col("text").alias("body"), "cwd")


@query(f"SELECT conv_id % 5 AS dir, arg_min('/home/c' || conv_id, 'c' || conv_id || '.jsonl') AS cwd FROM conversations WHERE {_N} % 19 <> 6 GROUP BY 1")
def first_value_per_group(spark, sf):
    """A directory's first recorded working directory, in the order of its files."""
    e = sessions.parse_lines(_raw_lines(spark, sf)).withColumn("dir", F.regexp_extract("file", "[0-9]+", 0).cast("long") % 5)
    return sessions.first_value(e, "dir", "cwd").select("dir", "cwd")


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before")
def consecutive_dedupe(spark, sf):
    return sessions.consecutive_dedupe(table(spark, sf, "events"), "user_id", "event_id", "event_type").select("event_id")


@query("""WITH p AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS prompt FROM conversations)
SELECT conv_id, prompt, text AS reply FROM p WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""")
def prompt_reply_pairs(spark, sf):
    return sessions.prompt_reply_pairs(_conv(spark, sf), "conv_id", "turn")


# Days that are there (some without the mark of a complete one, some shorter) and days that come, from the documents.
_HAVE = "have AS (SELECT source, doc_id, CASE WHEN doc_id % 3 = 0 THEN left(text, 50) ELSE 'DONE ' || CASE WHEN doc_id % 3 = 1 THEN left(text, 100) ELSE text || '!' END END AS body FROM documents WHERE doc_id % 5 <> 0)"
_GOT = "got AS (SELECT source, doc_id, 'DONE ' || text AS body FROM documents WHERE doc_id % 7 <> 0)"


@query(f"""WITH {_HAVE}, {_GOT} SELECT coalesce(h.source, g.source) AS store, coalesce(h.doc_id, g.doc_id) AS day, CASE WHEN g.body IS NULL THEN 'keep' WHEN h.body IS NULL THEN 'write' WHEN NOT contains(h.body, 'DONE') THEN 'overwrite'
WHEN length(g.body) > length(h.body) THEN 'rewrite' ELSE 'skip' END AS action FROM have h FULL JOIN got g ON h.source = g.source AND h.doc_id = g.doc_id""")
def transcript_merge(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("store"), F.col("doc_id").alias("day"), "text")
    n, done = F.col("day"), lambda x: F.concat(F.lit("DONE "), x)
    have = F.when(n % 3 == 0, F.substring("text", 1, 50)).when(n % 3 == 1, done(F.substring("text", 1, 100))).otherwise(done(F.concat("text", F.lit("!"))))
    return sessions.transcript_merge(d.where(n % 5 != 0).withColumn("text", have), d.where(n % 7 != 0).withColumn("text", done(F.col("text"))), "DONE").select("store", "day", "action")


@query("SELECT l_orderkey, l_linenumber, CAST(used AS BIGINT) AS used FROM (SELECT l_orderkey, l_linenumber, sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS used FROM (SELECT l_orderkey, l_linenumber, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber)) WHERE used <= 60")
def running_budget(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("q"))  # noqa: E741
    return sessions.running_budget(l, "l_orderkey", ["l_linenumber"], F.col("q"), 60).select("l_orderkey", "l_linenumber", "used")


@query("""WITH RECURSIVE o AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
f AS (SELECT l_orderkey, l_linenumber, k, q <= 50 AS kept, CASE WHEN q <= 50 THEN q ELSE 0 END AS used FROM o WHERE k = 1
UNION ALL SELECT o.l_orderkey, o.l_linenumber, o.k, f.used + o.q <= 50, CASE WHEN f.used + o.q <= 50 THEN f.used + o.q ELSE f.used END FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.k = f.k + 1)
SELECT l_orderkey, l_linenumber FROM f WHERE kept""".replace("GROUP BY ALL", "GROUP BY l_orderkey, l_linenumber"))
def budget_fill(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))  # noqa: E741
    return sessions.budget_fill(l, "l_orderkey", "l_linenumber", "q", "l_linenumber", 50)


_KNOWN = "known AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END AS revision FROM documents WHERE doc_id % 5 <> 0), seen AS (SELECT doc_id, sha256(text) AS revision FROM documents WHERE doc_id % 11 <> 0)"


def _revisions(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("revision"))
    known = d.where("doc_id % 5 <> 0").withColumn("revision", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("revision")))
    return known, d.where("doc_id % 11 <> 0")


@query(f"WITH {_KNOWN} SELECT coalesce(k.doc_id, s.doc_id) AS doc_id, CASE WHEN k.doc_id IS NULL THEN 'added' WHEN s.doc_id IS NULL THEN 'removed' WHEN k.revision <> s.revision THEN 'changed' ELSE 'same' END AS change FROM known k FULL JOIN seen s ON k.doc_id = s.doc_id")
def index_delta(spark, sf):
    return maintenance.index_delta(*_revisions(spark, sf), "doc_id")


@query(f"WITH {_KNOWN} SELECT (SELECT count(*) FROM seen) AS indexed, (SELECT count(*) FROM seen s LEFT JOIN known k USING (doc_id) WHERE k.revision IS DISTINCT FROM s.revision) AS changed, (SELECT count(*) FROM known WHERE doc_id NOT IN (SELECT doc_id FROM seen)) AS removed")
def index_counts(spark, sf):
    return maintenance.delta_counts(maintenance.index_delta(*_revisions(spark, sf), "doc_id"))


@query(f"WITH {_KNOWN} SELECT k.doc_id FROM known k JOIN seen s ON k.doc_id = s.doc_id AND k.revision = s.revision")
def stale_revision(spark, sf):
    known, seen = _revisions(spark, sf)
    return maintenance.fresh_hits(known, seen, "doc_id").select("doc_id")


@query("""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id % 3 <> 0)
SELECT line FROM (SELECT rtrim(line) AS line FROM l WHERE trim(line) <> '') EXCEPT ALL SELECT rtrim(line) FROM m WHERE trim(line) <> ''""")
def lossless_move(spark, sf):
    d = table(spark, sf, "documents")
    return maintenance.lost_lines(d, d.where("doc_id % 3 <> 0"))


MEMORIES = shared(
    "memories", "customer", id="CAST(c_custkey AS STRING)", n="c_custkey", project="'Ação ' || c_mktsegment || ' ' || c_nationkey", slug="'acao-' || lower(c_mktsegment) || '-' || c_nationkey",
    scope="CASE WHEN c_custkey % 3 = 0 THEN 'global' ELSE 'project' END", title="c_name", status="CASE WHEN c_custkey % 4 = 3 THEN 'archived' ELSE 'active' END",
)


@query(f"WITH {MEMORIES.sql} SELECT id, CASE WHEN scope = 'global' THEN 'context/MEMORY.md' ELSE 'projects/' || slug || '/context/MEMORY.md' END AS target FROM memories WHERE status = 'active' AND n % 7 <> 0")
def import_active(spark, sf):
    m, fields = MEMORIES.df(spark, sf), ["id", "project", "scope", "title", "status"]
    done = m.where("n % 7 = 0").select(F.sha2(F.to_json(F.struct(*fields)), 256).alias("marker"))
    return maintenance.import_active(m, done, fields).select("id", "target")


@query("SELECT d.doc_id, length(d.text) AS chars, coalesce(c.cap, 2500) AS cap FROM documents d LEFT JOIN (SELECT vec_id AS doc_id, 4000 AS cap FROM embeddings WHERE label = 1) c USING (doc_id) WHERE length(d.text) > coalesce(c.cap, 2500)")
def over_cap(spark, sf):
    caps = table(spark, sf, "embeddings").where("label = 1").select(F.col("vec_id").alias("doc_id"), F.lit(4000).alias("cap"))
    return quality.over_cap(table(spark, sf, "documents"), caps, "doc_id", F.length("text").cast("long"), 2500).select("doc_id", "chars", "cap")


@query("WITH e AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst FROM pages), t AS (SELECT DISTINCT '/' || regexp_extract(url, '^[a-z]+://[^/]+/([^/]*)', 1) AS page FROM pages) SELECT page_id AS src, dst FROM e WHERE dst NOT IN (SELECT page FROM t)")
def broken_links(spark, sf):
    p = table(spark, sf, "pages")
    edges = p.select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst")).distinct()
    targets = p.select(F.concat(F.lit("/"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^/]*)", 1)).alias("page")).distinct()
    return quality.broken_links(edges, targets)


@query("WITH a AS (SELECT o_orderkey AS path, sha256(o_orderpriority) AS sha FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS path, sha256(CASE WHEN o_orderkey % 6 = 0 THEN 'x' ELSE o_orderpriority END) AS sha FROM orders WHERE o_orderkey % 4 = 0) SELECT CASE WHEN b.path IS NULL THEN 'moved' WHEN a.sha = b.sha THEN 'identical' WHEN a.path % 12 = 0 THEN 'append' ELSE 'collision' END AS class, count(*) AS n FROM a LEFT JOIN b USING (path) GROUP BY class")
def merge_plan(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("p"))
    a = o.where("path % 2 = 0").select("path", F.sha2("p", 256).alias("sha"))
    b = o.where("path % 4 = 0").select("path", F.sha2(F.when(F.col("path") % 6 == 0, "x").otherwise(F.col("p")), 256).alias("sha"))
    return maintenance.merge_plan(a, b, F.col("path") % 12 == 0).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


# Stores, directories and their remotes, made of the customers; bindings of the nations' directories.
REGISTRY = shared("registry", "customer", remote="'r' || c_nationkey", name="'n' || c_custkey % 40", store="'s' || c_custkey")
ASKED = shared("asked", "customer", dir="'/w/' || c_nationkey || '/' || c_mktsegment || '/c.' || c_custkey", remote="CASE WHEN c_custkey % 5 > 0 THEN 'r' || c_custkey % 30 END", name="'n' || c_custkey % 50", n="c_custkey")
BINDINGS = shared("bindings", "nation", prefix="CASE WHEN n_nationkey % 3 = 0 THEN '/w/' || n_nationkey ELSE '/w/' || n_nationkey || '/MACHINERY' END", value="'b' || n_nationkey")
STORES = shared("stores", "customer", store="'-w-' || c_nationkey || '-' || c_mktsegment || '-c-' || c_custkey * 2")
_FOUND = f"""{REGISTRY.sql}, {ASKED.sql}, exact AS (SELECT remote, name, min(store) AS store FROM registry GROUP BY remote, name), others AS (SELECT remote, list(DISTINCT store ORDER BY store) AS all_stores FROM registry GROUP BY remote)"""


@query(f"WITH {_FOUND} SELECT DISTINCT a.remote, a.name, e.store, CASE WHEN e.store IS NULL THEN coalesce(o.all_stores, []) ELSE [] END AS candidates FROM asked a LEFT JOIN exact e ON e.remote = a.remote AND e.name = a.name LEFT JOIN others o ON o.remote = a.remote")
def registry_lookup(spark, sf):
    return maintenance.registry_lookup(ASKED.df(spark, sf).select("remote", "name").distinct(), REGISTRY.df(spark, sf))


@query(f"WITH {ASKED.sql}, {BINDINGS.sql} SELECT a.dir AS path, arg_max(b.value, length(b.prefix)) AS value FROM asked a LEFT JOIN bindings b ON a.dir = b.prefix OR starts_with(a.dir, b.prefix || '/') GROUP BY a.dir")
def longest_prefix_join(spark, sf):
    return maintenance.longest_prefix(ASKED.df(spark, sf).select(F.col("dir").alias("path")), BINDINGS.df(spark, sf)).select("path", "value")


@query(f"""WITH {_FOUND}, {BINDINGS.sql}, {STORES.sql}, b AS (SELECT a.dir, arg_max(b.value, length(b.prefix)) AS value FROM asked a JOIN bindings b ON a.dir = b.prefix OR starts_with(a.dir, b.prefix || '/') GROUP BY a.dir),
p AS (SELECT DISTINCT a.dir, s.store FROM asked a JOIN stores s ON s.store = regexp_replace(a.dir, '[^A-Za-z0-9-]', '-', 'g'))
SELECT a.dir, coalesce(b.value, p.store, e.store, regexp_replace(a.dir, '[^A-Za-z0-9-]', '-', 'g')) AS store, CASE WHEN b.value IS NOT NULL THEN 'binding' WHEN p.store IS NOT NULL THEN 'path' WHEN e.store IS NOT NULL THEN 'remote' ELSE 'new' END AS identity
FROM asked a LEFT JOIN b USING (dir) LEFT JOIN p USING (dir) LEFT JOIN exact e ON e.remote = a.remote AND e.name = a.name""")
def identity_cascade(spark, sf):
    return maintenance.identity_cascade(ASKED.df(spark, sf).drop("n"), BINDINGS.df(spark, sf), STORES.df(spark, sf).distinct(), REGISTRY.df(spark, sf)).select("dir", "store", "identity")


DEMANDS = shared("demands", "nation", name="n_name", workdir="CASE n_nationkey % 3 WHEN 0 THEN '/w/' || n_nationkey WHEN 1 THEN '/w/' || n_nationkey || '/BUILDING' ELSE '/wx/' || n_nationkey END")


@query(f"WITH {DEMANDS.sql}, {ASKED.sql} SELECT DISTINCT d.name, a.dir AS anchor FROM demands d JOIN asked a ON d.workdir = a.dir OR starts_with(d.workdir, a.dir || '/') OR starts_with(a.dir, d.workdir || '/')")
def demands_served(spark, sf):
    return maintenance.serving(DEMANDS.df(spark, sf), ASKED.df(spark, sf).select(F.col("dir").alias("anchor")))


@query("SELECT p_brand AS section, min(p_partkey) AS pos FROM part GROUP BY p_brand")
def first_per_section(spark, sf):
    b = table(spark, sf, "part").select(F.lit("c").alias("ctx"), F.col("p_brand").alias("section"), F.col("p_partkey").alias("pos"), F.lit("block").alias("kind"))
    return quality.first_per_section(b).select("section", "pos")


@query("""WITH RECURSIVE edges AS (SELECT c_custkey AS src, c_custkey * 3 AS dst FROM customer UNION SELECT c_custkey, c_custkey * 3 + 1 FROM customer UNION SELECT c_custkey, 1 FROM customer),
r AS (SELECT 1::BIGINT AS node UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.node) SELECT node FROM r""")
def reachable_nodes(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("src"))
    edges = c.select("src", (F.col("src") * 3).alias("dst")).union(c.select("src", F.col("src") * 3 + 1)).union(c.select("src", F.lit(1).cast("long"))).distinct()
    return graph.reachable(edges, spark.range(1, 2).select(F.col("id").alias("node")))


LINKS = shared("links", "documents", node="doc_id", next="CASE WHEN doc_id % 9 = 8 THEN doc_id - 6 WHEN doc_id % 3 = 2 THEN doc_id + 3 WHEN doc_id % 3 = 1 THEN CAST(floor(doc_id / 2) AS BIGINT) WHEN doc_id % 3000 > 0 THEN doc_id - 3 END")


@query(f"""WITH RECURSIVE {LINKS.sql}, one AS (SELECT node, next FROM links WHERE node IS NOT NULL AND next IS NOT NULL),
r AS (SELECT node, next AS last, 1::BIGINT AS hops FROM one WHERE next NOT IN (SELECT node FROM one) UNION ALL SELECT o.node, r.last, r.hops + 1 FROM one o JOIN r ON o.next = r.node)
SELECT o.node, r.last, r.hops, r.last IS NULL AS cyclic FROM one o LEFT JOIN r USING (node)""")
def archive_chain_ends(spark, sf):
    """Chains of a thousand links, branches into them, cycles and what leads into cycles: each node's end in one hop."""
    return graph.chain_ends(LINKS.df(spark, sf))


SAID = shared("said", "conversations", session="'s' || conv_id % 3", line="conv_id * 1000 + turn", said="CASE WHEN conv_id % 11 = 3 THEN '' ELSE '## ' || role || chr(10) || coalesce(text, '') END")


@query(f"""WITH RECURSIVE {SAID.sql}, o AS (SELECT *, length(said) + 2 AS n, row_number() OVER (PARTITION BY session ORDER BY line) AS k FROM said),
g AS (SELECT session, k, line, said, 1::BIGINT AS part, n AS total FROM o WHERE k = 1 UNION ALL
SELECT o.session, o.k, o.line, o.said, CASE WHEN g.total + o.n > 6000 THEN g.part + 1 ELSE g.part END, CASE WHEN g.total + o.n > 6000 THEN o.n ELSE g.total + o.n END FROM g JOIN o ON o.session = g.session AND o.k = g.k + 1),
p AS (SELECT session, part, min(line) AS first, max(line) + 1 AS next, coalesce(string_agg(said, chr(10) || chr(10) ORDER BY line) FILTER (WHERE said <> ''), '') AS text FROM g GROUP BY session, part)
SELECT session, part, first, next, length(left(text, 6000)) AS chars, greatest(0, length(text) - 6000) AS clipped, sha256(left(text, 6000)) AS text_sha256 FROM p""")
def session_parts(spark, sf):
    """Three long sessions made of all conversations, cut into parts."""
    got = deltas.parts(SAID.df(spark, sf), "session", "line", cap=6000)
    return got.select("session", "part", "first", "next", F.length("text").alias("chars"), "clipped", F.sha2("text", 256).alias("text_sha256"))


# A store of pages made of the documents: its links, archives, journal and installed files.
_STORE = """pages_ AS (SELECT 'p' || doc_id AS page, doc_id AS n, text, doc_id % 97 = 5 AS link FROM documents),
edges AS (SELECT 'p' || doc_id AS src, 'p' || doc_id * 2 AS dst FROM documents WHERE doc_id % 13 <> 0 UNION ALL SELECT 'p' || doc_id, 'p' || (doc_id * 2 + 1) FROM documents WHERE doc_id % 13 <> 0
UNION ALL SELECT 's' || doc_id % 3 || '/MEMORY.md', 'p' || doc_id FROM documents WHERE doc_id % 18 = 0)"""


@query(f"""WITH RECURSIVE {_STORE}, r AS (SELECT 'p1' AS node UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.node)
SELECT 'over_cap' AS type, page, length(text) || '/' || CASE WHEN n % 5 = 0 THEN 900 ELSE 2500 END AS detail FROM pages_ WHERE length(text) > CASE WHEN n % 5 = 0 THEN 900 ELSE 2500 END
UNION ALL SELECT 'broken_link', src, dst FROM edges WHERE dst NOT IN (SELECT page FROM pages_) UNION ALL SELECT 'orphan_page', page, '' FROM pages_ WHERE page NOT IN (SELECT node FROM r)
UNION ALL SELECT 'archive_not_in_index', page, '' FROM pages_ WHERE n % 9 = 0 AND NOT n % 18 = 0 UNION ALL SELECT 'symlink_in_store', page, '' FROM pages_ WHERE link
UNION ALL SELECT 'pending_transaction', 'j' || n, 'prepared' FROM pages_ WHERE n % 50 = 7 UNION ALL SELECT 'installation_drift', 'f' || n, '' FROM pages_ WHERE n % 40 = 3""")
def corpus_issues(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("n"), "text")
    name = lambda head, n=F.col("n"): F.concat(F.lit(head), n.cast("string"))
    pages = d.select(name("p").alias("page"), "n", "text", (F.col("n") % 97 == 5).alias("link"))
    linked = d.where("n % 13 <> 0").select(name("p").alias("src"), F.explode(F.array(2 * F.col("n"), 2 * F.col("n") + 1)).alias("to")).select("src", name("p", F.col("to")).alias("dst"))
    store = name("s", F.col("n") % 3)
    edges = linked.unionByName(d.where("n % 18 = 0").select(F.concat(store, F.lit("/MEMORY.md")).alias("src"), name("p").alias("dst")))
    installed = d.select(name("f").alias("path"), F.sha2("text", 256).alias("digest"))
    files = d.where("n % 80 <> 43").select(name("f").alias("path"), F.when(F.col("n") % 80 == 3, "other").otherwise(F.sha2("text", 256)).alias("digest"))
    return quality.corpus_issues(
        pages, pages.where("n % 5 = 0").select("page", F.lit(900).alias("cap")), edges, spark.createDataFrame([("p1",)], "page string"), 2500,
        archives=d.where("n % 9 = 0").select(name("p").alias("page"), store.alias("store")), journal=d.where("n % 25 = 7").select(name("j").alias("path"), F.when(F.col("n") % 50 == 7, "prepared").otherwise("committed").alias("status")),
        installed=installed, files=files,
    )
