"""Queries of lexical, full-text and vector retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text as T
from ..operators import bm25, cells, lexical, segments, vector
from ..session import shared_folder
from .base import Derived, Fixture, query, shared, table
from .text_queries import TOKENS

PROMPT = "license version onre thble apache"
TERMS = sorted(PROMPT.split())
_LINES = "SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"
_LIST = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
#: Windows with their words, as a chain of common table expressions.
WINDOWS = f"""lines AS ({_LINES}), toks AS (SELECT doc_id, list_transform(ls, lambda l: {TOKENS.format(x='l')}) AS ws FROM lines WHERE len(ls) > 0),
wins AS (SELECT doc_id, ws, unnest(range(0, len(ws), 24)) AS s FROM toks),
w AS (SELECT doc_id, s + 1 AS line, least(s + 32, len(ws)) AS end_line, flatten(ws[s + 1:s + 32]) AS words FROM wins),
t AS (SELECT unnest({_LIST}) AS term),
tf AS (SELECT doc_id, line, end_line, len(words) AS n_words, term, len(list_filter(words, lambda x: x = term)) AS tf FROM w, t),
n AS (SELECT count(*) AS n FROM documents WHERE trim(text) <> ''),
df AS (SELECT term, count(DISTINCT doc_id) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY term),
idf AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, n),
scored AS (SELECT doc_id, line, end_line, round(sum(idf * (1 + ln(1 + tf))) / sqrt(greatest(1, any_value(n_words)) / 50.0) * count(*) / {len(TERMS)}, 4) AS score, list_sort(list(term)) AS matched_terms
FROM tf JOIN idf USING (term) WHERE tf > 0 GROUP BY doc_id, line, end_line),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line) = 1)"""


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


_INDEXES: dict[tuple[str, str], tuple[segments.Index, tuple]] = {}


def _files(spark, path: str) -> tuple:
    """Names, lengths and times of a table's files: whether the table is still what an index has read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}{{,/*}}"))
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found or ()))


def _index(spark, sf) -> segments.Index:
    """The documents' index in the shared folder: built by the first query of an application that asks for it, and
    refreshed if the table's files have changed since."""
    key, files = (spark.sparkContext.applicationId, sf), _files(spark, f"{sf}/documents.parquet")
    index, seen = _INDEXES.get(key) or (segments.Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"), None)
    if seen != files:
        index.refresh(_docs(spark, sf), "doc_id", group="source")
        _INDEXES[key] = index, files
    return index


_BEST = f"WITH {WINDOWS} SELECT doc_id, line, end_line, score, matched_terms FROM best ORDER BY score DESC, doc_id, line LIMIT 20"


@query(_BEST)
def lexical_search(spark, sf):
    """From the index: its best blocks, then the pages that can be among the best; no text is read."""
    return _index(spark, sf).search(PROMPT, 20).withColumnRenamed("page", "doc_id")


@query(_BEST)
def indexed_search(spark, sf):
    """The same rows from every posting of the index."""
    return lexical.best_per_source(_index(spark, sf).scored_windows(PROMPT), "page", 20).withColumnRenamed("page", "doc_id")


@query(f"WITH t AS (SELECT doc_id, unnest(list_distinct({TOKENS.format(x='text')})) AS term FROM documents WHERE trim(text) <> '') SELECT term, count(*) AS pages FROM t GROUP BY term")
def index_terms(spark, sf):
    """How many pages hold each term, from the index."""
    return _index(spark, sf).terms().withColumnRenamed("df", "pages")


def _earlier(d):
    """The documents in other revisions: some changed, some not there yet."""
    return d.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x "), "text")).otherwise(F.col("text")))


@query("""WITH known AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x ' || text ELSE text END AS t FROM documents WHERE doc_id % 5 <> 0), seen AS (SELECT doc_id, text AS t FROM documents WHERE doc_id % 11 <> 0)
SELECT count(*) FILTER (WHERE s.doc_id IS NOT NULL) AS indexed, count(*) FILTER (WHERE s.doc_id IS NOT NULL AND (k.doc_id IS NULL OR s.t IS DISTINCT FROM k.t)) AS changed, count(*) FILTER (WHERE s.doc_id IS NULL) AS removed FROM known k FULL JOIN seen s USING (doc_id)""")
def index_refresh(spark, sf):
    """An index of other revisions is brought up to date; the counts of what changed."""
    d, index = _docs(spark, sf), segments.Index(spark, f"{shared_folder(spark)}/refresh-{uuid.uuid4().hex}")
    index.refresh(_earlier(d), "doc_id")
    return index.refresh(d.where("doc_id % 11 <> 0"), "doc_id")


@query(_BEST)
def refreshed_search(spark, sf):
    """Earlier revisions are indexed, brought up to the whole table in a second segment, and searched together."""
    d, index = _docs(spark, sf), segments.Index(spark, f"{shared_folder(spark)}/refresh-{uuid.uuid4().hex}")
    index.refresh(_earlier(d), "doc_id")
    index.refresh(d, "doc_id")
    return index.search(PROMPT, 20).withColumnRenamed("page", "doc_id")


@query(f"WITH t AS (SELECT doc_id, unnest(list_distinct({TOKENS.format(x='text')})) AS term FROM documents WHERE trim(text) <> '') SELECT term, count(*) AS pages FROM t GROUP BY term")
def merged_terms(spark, sf):
    """The frequencies of an index whose two segments were merged into one: those of the table as it is."""
    d, index = _docs(spark, sf), segments.Index(spark, f"{shared_folder(spark)}/refresh-{uuid.uuid4().hex}")
    index.refresh(_earlier(d), "doc_id")
    index.refresh(d, "doc_id")
    index.merge(like=1_000_000)
    return index.terms().withColumnRenamed("df", "pages")


@query(f"WITH l AS ({_LINES}), p AS (SELECT doc_id, unnest(range(0, len(ls))) AS line FROM l), k AS (SELECT doc_id, line, unnest(range(0, line // 24 + 1)) AS k FROM p) SELECT doc_id, k, line FROM k WHERE line >= 24 * k AND line < 24 * k + 32")
def line_windows(spark, sf):
    return lexical.line_windows(_docs(spark, sf), "doc_id", "text").select("doc_id", "k", F.col("line").cast("long").alias("line"))


@query(f"WITH {WINDOWS} SELECT doc_id, line, term, tf::BIGINT AS tf, n_words::BIGINT AS n_words FROM tf WHERE tf > 0")
def term_tf(spark, sf):
    stops = EngineConfig().stop_words
    w = lexical.page_windows(_docs(spark, sf), "text", TERMS, stops).select("doc_id", F.explode_outer("windows").alias("w")).where("w is not null")
    pairs = F.explode(F.zip_with(F.array(*[F.lit(t) for t in TERMS]), "w.tf", lambda t, n: F.struct(t.alias("term"), n.alias("tf"))))
    return w.select("doc_id", "w.line", "w.n_words", pairs.alias("p")).where("p.tf > 0").select("doc_id", "line", "p.term", F.col("p.tf").cast("long").alias("tf"), "n_words")


def _stats(spark, sf):
    n, df = lexical.term_stats(_docs(spark, sf), "text", TERMS, EngineConfig().stop_words, "doc_id")
    return [(t, df[t], n, lexical.idf(n, df[t])) for t in TERMS]


@query(f"WITH {WINDOWS} SELECT term, df FROM df")
def term_df(spark, sf):
    return spark.createDataFrame([(t, df) for t, df, _, _ in _stats(spark, sf)], "term string, df long")


@query(f"WITH {WINDOWS} SELECT term, round(idf, 6) AS idf FROM idf")
def term_idf(spark, sf):
    return spark.createDataFrame([(t, i) for t, _, _, i in _stats(spark, sf)], "term string, idf double").select("term", F.round("idf", 6).alias("idf"))


@query(f"WITH {WINDOWS}, two AS (SELECT * FROM scored WHERE len(matched_terms) >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line) = 1) SELECT doc_id, line, end_line, score, matched_terms FROM two ORDER BY score DESC, doc_id, line LIMIT 10")
def min_terms_before_limit(spark, sf):
    return _index(spark, sf).search(PROMPT, 10, min_terms=2).withColumnRenamed("page", "doc_id")


@query(f"WITH {WINDOWS} SELECT doc_id, line, end_line, score, matched_terms FROM best")
def best_per_source(spark, sf):
    return lexical.best_per_source(lexical.scored_windows(_docs(spark, sf), PROMPT, "doc_id"), "doc_id")


@query("WITH " + WINDOWS.replace("FROM documents)", "FROM documents WHERE source = 'src0')").replace("FROM documents WHERE trim", "FROM documents WHERE source = 'src0' AND trim") + " SELECT doc_id, line, end_line, score, matched_terms FROM best")
def scoped_search(spark, sf):
    """The scope is a filter before the frequencies are counted."""
    return lexical.best_per_source(lexical.scored_windows(_docs(spark, sf).where("source = 'src0'"), PROMPT, "doc_id"), "doc_id")


LONG = "sap connector keeps losing its session token after midnight restart zebra quokka marmot arrived"
SPANS = Fixture("spans", "source string, body string", [
    ("chatty.md", "sap connector keeps losing its session token after midnight restart"), ("target.md", "zebra quokka marmot notes " + "lorem " * 100), *[(f"p{i:02}.md", f"sap connector keeps losing its session token after midnight restart page{i}") for i in range(20)],
])


@query(f"WITH {SPANS.sql} SELECT source FROM spans WHERE source = 'target.md'")
def span_discount(spark, sf):
    """A long prompt's best short span lifts the page that answers one topic of it."""
    return lexical.search(SPANS.df(spark), LONG, limit=1, text="body", config=EngineConfig(span_discount=0.84)).select("source")


@query(f"WITH {WINDOWS} SELECT doc_id, score FROM best WHERE len(matched_terms) >= 3 OR len(list_filter(matched_terms, lambda t: regexp_matches(t, '[0-9]'))) > 0")
def plain_terms_gate(spark, sf):
    hits = lexical.best_per_source(lexical.scored_windows(_docs(spark, sf), PROMPT, "doc_id"), "doc_id")
    return hits.where((F.size("matched_terms") >= 3) | F.exists("matched_terms", lambda t: t.rlike("[0-9]"))).select("doc_id", "score")


@query(f"WITH {WINDOWS}, m AS (SELECT doc_id, unnest(matched_terms) AS term FROM best), r AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY idf DESC, term) AS k FROM m JOIN idf USING (term)) SELECT doc_id, list(term ORDER BY k) AS rarest FROM r WHERE k <= 3 GROUP BY doc_id")
def rarest_terms(spark, sf):
    hits = lexical.best_per_source(lexical.scored_windows(_docs(spark, sf), PROMPT, "doc_id"), "doc_id")
    order = [t for t, *_ in sorted(_stats(spark, sf), key=lambda x: (-x[3], x[0]))]
    ranked = F.filter(F.array(*[F.lit(t) for t in order]), lambda t: F.array_contains("matched_terms", t))
    return hits.select("doc_id", F.slice(ranked, 1, 3).alias("rarest"))


@query(f"""WITH {WINDOWS}, top AS (SELECT max(score) AS top FROM best), alt AS (SELECT doc_id, 0.0 AS score FROM documents WHERE contains(lower(text), 'apache') ORDER BY doc_id LIMIT 5), floors AS (SELECT unnest([1.0::DOUBLE, 1000.0::DOUBLE]) AS floor)
SELECT floor, doc_id, score::DOUBLE AS score, 'lexical' AS engine FROM floors, (SELECT * FROM best ORDER BY score DESC, doc_id, line LIMIT 5) WHERE (SELECT top FROM top) >= floor
UNION ALL SELECT floor, doc_id, score::DOUBLE, 'fallback' FROM floors, alt WHERE coalesce((SELECT top FROM top) < floor, TRUE)""")
def auto_cascade(spark, sf):
    """Lexical hits, unless the best is below the floor: then the fallback's. One floor that the hits reach, one that none does."""
    hits = [(r["doc_id"], r["score"]) for r in lexical.search(_docs(spark, sf), PROMPT, limit=5, key="doc_id").select("doc_id", "score").collect()]
    other = _docs(spark, sf).where(F.contains(F.lower("text"), F.lit("apache"))).orderBy("doc_id").limit(5).select("doc_id", F.lit(0.0).alias("score"), F.lit("fallback").alias("engine"))
    out = None
    for floor in (1.0, 1000.0):
        found = spark.createDataFrame([(*h, "lexical") for h in hits], "doc_id long, score double, engine string") if hits and hits[0][1] >= floor else other
        found = found.withColumn("floor", F.lit(floor))
        out = found if out is None else out.unionByName(found)
    return out


_WORDS = "regexp_extract_all(strip_accents(replace(lower(text), 'ß', 'ss')), '[\\p{L}\\p{N}]+')"
FTS = f"""WITH c AS (SELECT doc_id, source, {_WORDS} AS w FROM documents), t AS (SELECT unnest(['license', 'apache', 'onre']) AS term),
f AS (SELECT doc_id, source, len(w) AS n, term, len(list_filter(w, lambda x: x = term)) AS tf FROM c, t),
a AS (SELECT count(*) AS docs, avg(len(w)) AS av FROM c), d AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM f GROUP BY term),
s AS (SELECT doc_id, source, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / av))), 6) AS score FROM f JOIN d USING (term), a WHERE tf > 0 GROUP BY doc_id, source)
"""


_TERMS = ["license", "apache", "onre"]


@query(FTS + "SELECT source, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) = 1")
def fts_bm25(spark, sf):
    """The best page of every source, from the postings of the words."""
    return _index(spark, sf).bm25(_TERMS, by_group=True).select(F.col("grp").alias("source"), F.col("page").alias("doc_id"), "score")


@query(FTS + "SELECT source, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) = 1 ORDER BY score DESC, source LIMIT 5")
def fts_sources(spark, sf):
    """The five best sources with their best pages, from the blocks that can hold them."""
    return _index(spark, sf).bm25(_TERMS, 5, by_group=True).select(F.col("grp").alias("source"), F.col("page").alias("doc_id"), "score")


@query(FTS + "SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 20")
def fts_topk(spark, sf):
    """The twenty best pages, from the blocks that can hold them."""
    return _index(spark, sf).bm25(_TERMS, 20).select(F.col("page").alias("doc_id"), "score")


@query(FTS + "SELECT source, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) = 1")
def fts_scan(spark, sf):
    """The same as fts_bm25 of texts that no index has."""
    hits = bm25.bm25(_docs(spark, sf), _TERMS, "doc_id", "text", ["source"])
    return bm25.best_chunk_per_source(hits, "source", chunk="doc_id").select("source", "doc_id", "score")


@query(_BEST)
def lexical_scan(spark, sf):
    """The same as lexical_search of texts that no index has."""
    return lexical.search(_docs(spark, sf), PROMPT, limit=20, key="doc_id")


@query(f"SELECT term, doc_id, tf, n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM (SELECT doc_id, {_WORDS} AS w FROM documents)) GROUP BY ALL".replace("term, doc_id, tf, n", "term, doc_id, count(*) AS tf, n").replace("GROUP BY ALL", "GROUP BY term, doc_id, n"))
def fts_postings(spark, sf):
    return bm25.postings(_docs(spark, sf), "doc_id", "text")


_BIG = "\n".join(f"line {i}" for i in range(100))
CHUNKS = Fixture("chunks", "source string, body string", [
    ("a.md", "---\nname: x\n---\n# Documents\nintro text\n## Methods\n- Add\n- GetByKey\n## Props\n- p"), ("b.md", f"# Big\n## Long\n{_BIG}"), ("c.md", "# Only title\n\n"), ("d.md", "no heading\ntext"),
])


@query("""SELECT * FROM (VALUES ('a.md', 4, 5, 'Documents'), ('a.md', 6, 8, 'Documents > Methods'), ('a.md', 9, 10, 'Documents > Props'), ('b.md', 2, 41, 'Big > Long'), ('b.md', 38, 77, 'Big > Long'), ('b.md', 74, 102, 'Big > Long'), ('d.md', 1, 2, '')) AS v(source, line, end_line, heading)""".replace("SELECT *", "SELECT source, CAST(line AS BIGINT) AS line, CAST(end_line AS BIGINT) AS end_line, heading"))
def section_chunks(spark, sf):
    from ..operators.sections import section_chunks as chunks

    return chunks(CHUNKS.df(spark), "source", "body").select("source", "line", "end_line", "heading")


@query()
def section_chunks_of_documents(spark, sf):
    """All documents, whole, beside the fixture; its rows have a null doc_id."""
    from ..operators.sections import section_chunks as chunks

    pages = _docs(spark, sf).select("doc_id", F.lit(None).cast("string").alias("source"), F.col("text").alias("body"))
    both = pages.unionByName(CHUNKS.df(spark).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("page", F.struct("doc_id", "source"))
    return chunks(both, "page", "body").select("page.doc_id", "page.source", "line", "end_line", "heading", F.sha2("content", 256).alias("content_sha256"))


@query(f"WITH {WINDOWS}, b AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos FROM lines) SELECT w.doc_id, w.line, count(*) AS blocks FROM w JOIN b ON b.doc_id = w.doc_id AND b.pos < w.end_line AND b.pos + 1 > w.line - 1 GROUP BY w.doc_id, w.line")
def interval_overlap(spark, sf):
    from ..operators.sections import overlapping

    lines = _docs(spark, sf).select("doc_id", T.lines(F.col("text")).alias("ls")).where(F.size("ls") > 0)
    blocks = lines.select("doc_id", F.explode(F.transform("ls", lambda x, i: i.cast("long"))).alias("start")).withColumn("end", F.col("start") + 1)
    starts = F.sequence(F.lit(0).cast("long"), F.floor((F.size("ls") - 1) / 24).cast("long"))
    windows = lines.select("doc_id", F.size("ls").alias("n"), F.explode(starts).alias("k")).select("doc_id", (F.col("k") * 24).alias("w_start"), F.least(F.col("k") * 24 + 32, F.col("n")).cast("long").alias("w_end"))
    return overlapping(blocks, windows, "doc_id", 24, 32).groupBy("doc_id", (F.col("w_start") + 1).alias("line")).agg(F.count(F.lit(1)).alias("blocks"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'")
def set_intersect(spark, sf):
    e = table(spark, sf, "events")
    return e.where("event_type = 'view'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id"))


@query("SELECT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 90")
def set_except(spark, sf):
    e = table(spark, sf, "events")
    return e.where("event_type = 'view'").select("user_id").subtract(e.where("event_type = 'error' and value > 90").select("user_id"))


CASES = shared(
    "cases", "documents", id="'t' || doc_id", kind="CASE doc_id % 4 WHEN 0 THEN 'identifier' WHEN 1 THEN 'prose' WHEN 2 THEN 'absent' ELSE 'scope' END", expected="CASE WHEN doc_id % 4 <> 2 THEN 'projects/p' || doc_id % 7 || '/notes' END", held_out="doc_id % 5 = 0"
)
RESULTS = Derived("results", "SELECT 't' || doc_id AS id, k AS rank, 'projects/p' || (doc_id * k) % 7 || CASE WHEN k % 2 = 0 THEN '' ELSE '/notes/x' || k || '.md' END AS source, (doc_id * 13 % 90) / 10.0::DOUBLE + 1.0::DOUBLE / k AS score FROM (SELECT doc_id, unnest(range(1, 8)) AS k FROM documents WHERE doc_id % 11 <> 0)", lambda spark, sf: (
    _docs(spark, sf).where("doc_id % 11 <> 0").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))).alias("k"))
    .selectExpr("'t' || doc_id AS id", "k AS rank", "'projects/p' || (doc_id * k) % 7 || CASE WHEN k % 2 = 0 THEN '' ELSE '/notes/x' || k || '.md' END AS source", "(doc_id * 13 % 90) / 10.0D + 1.0D / k AS score")
))
_RANKED = f"""WITH {CASES.sql}, {RESULTS.sql}, r AS (SELECT c.id, c.kind, c.held_out, max(score) FILTER (WHERE r.rank = 1) AS top_score,
min(r.rank) FILTER (WHERE r.source = c.expected OR starts_with(r.source, c.expected) OR starts_with(c.expected, r.source)) AS rank FROM cases c LEFT JOIN results r USING (id) GROUP BY c.id, c.kind, c.held_out)"""


@query(_RANKED + " SELECT id, kind, rank, top_score FROM r")
def bench_rank(spark, sf):
    from ..operators.bench import bench_rank as rank

    return rank(CASES.df(spark, sf), RESULTS.df(spark, sf)).select("id", "kind", "rank", "top_score")


@query(_RANKED + """ SELECT round(count(*) FILTER (WHERE kind IN ('identifier', 'prose') AND rank = 1) / nullif(count(*) FILTER (WHERE kind IN ('identifier', 'prose')), 0)::DOUBLE, 4) AS recall_1,
round(count(*) FILTER (WHERE kind IN ('identifier', 'prose') AND rank <= 5) / nullif(count(*) FILTER (WHERE kind IN ('identifier', 'prose')), 0)::DOUBLE, 4) AS recall_5,
round(count(*) FILTER (WHERE kind = 'absent' AND coalesce(top_score, 0) < 7.17) / nullif(count(*) FILTER (WHERE kind = 'absent'), 0)::DOUBLE, 4) AS absent_ok, count(*) AS cases FROM r WHERE NOT held_out""")
def bench_summary(spark, sf):
    from ..operators.bench import bench_rank as rank
    from ..operators.bench import bench_summary as summary

    return summary(rank(CASES.df(spark, sf), RESULTS.df(spark, sf)).where("not held_out"), 7.17)


OLD = shared("old", "documents", id="doc_id", rank="nullif(doc_id % 9, 0)")
NEW = Derived("new", "SELECT doc_id AS id, nullif(doc_id * 7 % 11, 0) AS rank FROM documents WHERE doc_id % 5 <> 0", lambda spark, sf: _docs(spark, sf).where("doc_id % 5 <> 0").selectExpr("doc_id AS id", "nullif(doc_id * 7 % 11, 0) AS rank"))


@query(f"WITH {OLD.sql}, {NEW.sql} SELECT avg(coalesce(o.rank <= 5, FALSE)::INT) AS before, avg(coalesce(n.rank <= 5, FALSE)::INT) AS after, count(*) AS shared FROM old o JOIN new n USING (id)")
def recall_drop(spark, sf):
    from ..operators.bench import recall_drop as drop

    return drop(OLD.df(spark, sf), NEW.df(spark, sf))


_QUERY0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_COS = "round(list_dot_product(a::DOUBLE[], b::DOUBLE[]) / (sqrt(list_dot_product(a::DOUBLE[], a::DOUBLE[])) * sqrt(list_dot_product(b::DOUBLE[], b::DOUBLE[]))), 6)"


def _query0(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@query(f"SELECT vec_id, {_COS.replace('a::', 'embedding::').replace('b::', '(' + _QUERY0 + ')::')} AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 20")
def vector_topk(spark, sf):
    return vector.rank(table(spark, sf, "embeddings"), _query0(spark, sf), "vec_id", limit=20)


@query(f"""SELECT x.vec_id AS query, y.vec_id, {_COS.replace('a::', 'x.embedding::').replace('b::', 'y.embedding::')} AS similarity FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 100 = 0
QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY similarity DESC, y.vec_id) <= 10""")
def cosine_pairs(spark, sf):
    """The stated query set (ids divisible by 100) against all rows, from cells: the ten nearest of each."""
    e = table(spark, sf, "embeddings")
    found = cells.search(cells.build(e, "vec_id"), e.where("vec_id % 100 = 0"), "vec_id")
    return found.select("query", F.col("key").alias("vec_id"), "similarity")


_PAIR = _COS.replace("a::", "x.embedding::").replace("b::", "y.embedding::")


@query(f"""SELECT x.vec_id AS query, y.vec_id, {_PAIR} AS similarity, (row_number() OVER (PARTITION BY x.vec_id ORDER BY {_PAIR} DESC, y.vec_id))::INTEGER AS rank
FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id AND y.label > 2 WHERE x.vec_id % 100 = 0 QUALIFY rank <= 5""")
def allowed_neighbours(spark, sf):
    """The same queries against the rows that an allow-list leaves, which applies before anything is ranked."""
    e = table(spark, sf, "embeddings")
    found = cells.search(cells.build(e, "vec_id"), e.where("vec_id % 100 = 0"), "vec_id", k=5, allowed=e.where("label > 2").select("vec_id"))
    return found.select("query", F.col("key").alias("vec_id"), "similarity", "rank")


VECTOR_CHUNKS = shared("vector_chunks", "embeddings", vec_id="vec_id", embedding="embedding", label="label", source="'p' || vec_id % 97", line="CAST(floor(vec_id / 97) AS BIGINT)", revision="'r' || vec_id % 4")
VECTOR_PAGES = shared("vector_pages", "(SELECT DISTINCT vec_id % 97 AS m FROM embeddings)", source="'p' || m", revision="'r' || m % 4")


@query(f"""WITH {VECTOR_CHUNKS.sql}, {VECTOR_PAGES.sql}, s AS (SELECT c.vec_id, c.source, c.line, {_COS.replace('a::', 'c.embedding::').replace('b::', '(' + _QUERY0 + ')::')} AS similarity FROM vector_chunks c JOIN vector_pages p ON c.source = p.source AND c.revision = p.revision WHERE label <> 3),
d AS (SELECT * FROM s ORDER BY similarity DESC, vec_id LIMIT 100), b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY source ORDER BY similarity DESC, vec_id) = 1)
SELECT vec_id, source, line, similarity, (row_number() OVER (ORDER BY similarity DESC, vec_id) - 1)::INTEGER AS rank, round(1 / (60.0::DOUBLE + row_number() OVER (ORDER BY similarity DESC, vec_id) - 1), 5) AS score FROM b ORDER BY similarity DESC, vec_id LIMIT 10""")
def vector_hits(spark, sf):
    """The best chunks of ten sources for one query: of the allowed collection and of their pages' present revision."""
    chunks = VECTOR_CHUNKS.df(spark, sf)
    pages = chunks.select("source").distinct().withColumn("revision", F.concat(F.lit("r"), (F.substring("source", 2, 9).cast("long") % 4).cast("string")))
    index = cells.build(chunks, "vec_id", keep=("source", "line"))
    hits = cells.source_hits(index, _query0(spark, sf), 10, cells.fresh(chunks.where("label <> 3"), pages).select("vec_id"))
    return hits.withColumnRenamed("key", "vec_id")


_LEGS = f"""WITH q AS (SELECT vec_id, {_COS.replace('a::', 'embedding::').replace('b::', '(' + _QUERY0 + ')::')} AS s FROM embeddings),
v AS (SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id) - 1 AS rank FROM (SELECT * FROM q ORDER BY s DESC, vec_id LIMIT 50)),
l AS (SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) - 1 AS rank FROM (SELECT * FROM embeddings ORDER BY label, vec_id LIMIT 50)),
f AS (SELECT vec_id, l.rank AS l, v.rank AS r, round(coalesce(1 / (60.0::DOUBLE + l.rank), 0) + coalesce(1 / (60.0::DOUBLE + v.rank), 0), 6) AS fused FROM l FULL JOIN v USING (vec_id))"""


def _legs(spark, sf):
    e = table(spark, sf, "embeddings")
    v = vector.ranks(vector.rank(e, _query0(spark, sf), "vec_id", limit=50), [F.desc("similarity"), "vec_id"])
    return vector.ranks(e.orderBy("label", "vec_id").limit(50), ["label", "vec_id"]), v


@query(_LEGS + " SELECT vec_id, fused FROM f")
def rrf_fusion(spark, sf):
    left, v = _legs(spark, sf)
    return vector.fuse(left, v, "vec_id").select("vec_id", "fused")


@query(_LEGS + " SELECT vec_id, CASE WHEN l IS NOT NULL THEN 'lexical' ELSE 'vector' END AS leg, fused FROM f ORDER BY coalesce(l = 0, FALSE) DESC, fused DESC, vec_id LIMIT 10")
def hybrid_pick(spark, sf):
    left, v = _legs(spark, sf)
    return vector.hybrid_pick(left, v, "vec_id", 10)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label > 2)")
def missing_vectors(spark, sf):
    v = table(spark, sf, "embeddings").where("label > 2").select(F.col("vec_id").alias("doc_id"), F.lit("m").alias("model"))
    return vector.missing(table(spark, sf, "documents").select("doc_id"), v, "doc_id", "m")


@query("""WITH RECURSIVE o AS (SELECT doc_id, source, n_chars AS n, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS k FROM documents),
g AS (SELECT k, doc_id, source, 1 AS batch, 1 AS size FROM o WHERE k = 1 UNION ALL
SELECT o.k, o.doc_id, o.source, CASE WHEN g.size + 1 > 64 OR (g.size + 1) * least(1024, o.n) > 8192 THEN g.batch + 1 ELSE g.batch END, CASE WHEN g.size + 1 > 64 OR (g.size + 1) * least(1024, o.n) > 8192 THEN 1 ELSE g.size + 1 END
FROM g JOIN o ON o.source = g.source AND o.k = g.k + 1) SELECT doc_id, source, batch::BIGINT AS batch FROM g""")
def padded_batches(spark, sf):
    """All documents; each source is an embedding job."""
    return vector.padded_batches(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "doc_id", "n_chars", "source")
