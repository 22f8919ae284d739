"""Lexical retrieval: overlapping line windows, corpus-scoped document frequencies, ranked hits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KNOWLEDGE_BOOST, SPAN_TERMS, SPAN_WIDTH, WINDOW_LINES, WINDOW_STRIDE, EngineConfig
from ..functions import text as T


def query_terms(spark, query: str, stop_words: Sequence[str]) -> list[str]:
    """The query's search words in order, by the same function that reads pages."""
    return spark.range(1).select(T.tokens(F.lit(query), stop_words).alias("t")).first()["t"]


def window_starts(position: Column) -> Column:
    """Numbers k of the windows [24k, 24k + 32) that hold a 0-based line: an equi-join key instead of a range."""
    low = F.greatest(F.lit(0), F.ceil((position - (WINDOW_LINES - 1)) / WINDOW_STRIDE)).cast("long")
    return F.sequence(low, F.floor(position / WINDOW_STRIDE).cast("long"))


def line_windows(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, k, line for each line and window that holds it."""
    lines = pages.select(key, F.posexplode(T.lines(F.col(text))).alias("line", "body"))
    return lines.select(key, "line", F.explode(window_starts(F.col("line"))).alias("k"))


def page_windows(pages: DataFrame, text: str, terms: Sequence[str], stop_words: Sequence[str]) -> DataFrame:
    """pages with ``windows`` (k, start, end_line, n_words, tf by term) of those that hold a term.

    Everything stays inside the page's row: a page that does not hold a term's letters is not read into words;
    of the others, folded as a whole, lines are read once and windows slice them.
    """
    # a condition, not a filter: Catalyst would push a filter below the folding and fold again for it
    pages = pages.withColumn("__folded", F.when(_may_hold_any(text, terms), T.fold(F.col(text))))
    words = F.when(_holds_any("__folded", terms), F.transform(T.lines(F.col("__folded")), lambda x: T.folded_tokens(x, stop_words)))
    wanted = F.array(*[F.lit(t) for t in terms])

    def window(k):
        inside = F.flatten(F.slice("__words", (k * WINDOW_STRIDE + 1).cast("int"), WINDOW_LINES))
        tf = F.transform(wanted, lambda t: F.size(F.filter(inside, lambda w: w == t)))
        return F.struct(
            (k * WINDOW_STRIDE + 1).cast("long").alias("line"),
            F.least(k * WINDOW_STRIDE + WINDOW_LINES, F.size("__words")).cast("long").alias("end_line"),
            F.size(inside).cast("long").alias("n_words"),
            tf.alias("tf"),
        )

    last = F.floor((F.size("__words") - 1) / WINDOW_STRIDE).cast("long")
    found = F.when(F.exists("__words", lambda ws: F.arrays_overlap(ws, wanted)), F.transform(F.sequence(F.lit(0).cast("long"), last), window))
    out = pages.withColumn("__words", words).withColumn("windows", F.filter(F.coalesce(found, F.array()), lambda w: F.exists(w["tf"], lambda n: n > 0)))
    return out.drop("__words", "__folded")


def _may_hold_any(text: str, terms: Sequence[str]) -> Column:
    """Whether a text can hold a term once it is folded: folding changes letters outside ASCII alone, so one within
    ASCII must hold the term as it is."""
    low = F.lower(F.col(text))
    found = F.octet_length(F.col(text)) > F.length(F.col(text))
    for t in terms:
        found = found | F.contains(low, F.lit(t))
    return found


def _holds_any(column: str, terms: Sequence[str]) -> Column:
    """Whether a text holds the letters of a term: a cheap test before it is read into words."""
    return F.col(column).rlike("|".join(rf"\Q{t}\E" for t in terms))


def term_stats(pages: DataFrame, text: str, terms: Sequence[str], stop_words: Sequence[str], key: str = "source") -> tuple[int, dict[str, int]]:
    """Pages with text in scope, and how many of them hold each term; one row back."""
    row = _frequencies(found_windows(pages, [key], text, terms, stop_words), key, len(terms)).crossJoin(_scope(pages, text)).first()
    return row["n"], {t: row["df"][i] for i, t in enumerate(terms)}


def found_windows(pages: DataFrame, keep: list[str], text: str, terms: Sequence[str], stop_words: Sequence[str]) -> DataFrame:
    """The columns to keep (the key first) and w, for each window that holds a term, dealt by key.

    explode_outer: explode would add a filter on the windows, pushed below, that computes them again.
    """
    w = page_windows(pages, text, terms, stop_words).select(*keep, F.explode_outer("windows").alias("w")).where("w is not null")
    return w.repartition(keep[0])


def _frequencies(found: DataFrame, key: str, terms: int) -> DataFrame:
    """df: how many pages hold each term; a page's windows have all of its lines, and lie in one task already."""
    has = found.groupBy(key).agg(*[F.max(F.get("w.tf", F.lit(i)) > 0).alias(f"has{i}") for i in range(terms)])
    return has.agg(F.array(*[F.count_if(F.col(f"has{i}")) for i in range(terms)]).alias("df"))


def _scope(pages: DataFrame, text: str) -> DataFrame:
    """n, the pages with text: a count that folds nothing."""
    return pages.where(F.trim(text) != "").agg(F.count(F.lit(1)).alias("n"))


def idf(n_docs: int, df: int) -> float:
    return math.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def best_span(sequence: Sequence[str], gain: Column, terms: Sequence[str]) -> Column:
    """The best sum of gains x share of matched terms over spans of at most SPAN_WIDTH query words with at
    least SPAN_TERMS matched; gain: by term, 0 for those that the window lacks."""
    at = {t: i for i, t in enumerate(terms)}
    spans = {frozenset(sequence[a:b]) for a in range(len(sequence)) for b in range(a + SPAN_TERMS, min(len(sequence), a + SPAN_WIDTH) + 1)}
    scores = []
    for span in sorted(spans, key=sorted):
        own = [gain[at[t]] for t in sorted(span)]
        matched = sum((F.when(g > 0, 1).otherwise(0) for g in own), F.lit(0))
        scores.append(F.when(matched >= SPAN_TERMS, sum(own, F.lit(0.0)) * matched / len(span)).otherwise(0.0))
    return F.greatest(*scores, F.lit(0.0), F.lit(0.0))


def scored_windows(pages: DataFrame, query: str, key: str = "source", text: str = "text", kind: str | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """key, line, end_line, score, matched_terms of every window that holds a query word. The scope is pages
    itself: document frequencies are its own."""
    sequence = query_terms(pages.sparkSession, query, config.stop_words)
    terms = sorted(set(sequence))
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, line long, end_line long, score double, matched_terms array<string>"
    if not terms:
        return pages.sparkSession.createDataFrame([], schema)
    # pages are folded once: the exchange of their windows serves both the frequencies and the ranking
    kept = [key, *([kind] if kind else [])]
    found = found_windows(pages, kept, text, terms, config.stop_words)
    weights = _frequencies(found, key, len(terms)).crossJoin(_scope(pages, text)).select(F.transform("df", lambda d: F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5))).alias("weights"))
    w = found.crossJoin(F.broadcast(weights))
    gain = F.zip_with("weights", F.col("w.tf"), lambda i, tf: F.when(tf > 0, i * (1 + F.log1p(tf))).otherwise(0.0))
    w = w.withColumn("gain", gain).withColumn("matched", F.size(F.filter("gain", lambda g: g > 0)))
    norm = F.sqrt(F.greatest(F.lit(1), F.col("w.n_words")) / 50)
    score = F.aggregate("gain", F.lit(0.0), lambda a, g: a + g) / norm * F.col("matched") / len(terms)
    if config.span_discount and len(terms) > SPAN_WIDTH:
        score = F.when(F.col("matched") >= SPAN_TERMS, F.greatest(score, config.span_discount * best_span(sequence, F.col("gain"), terms) / norm)).otherwise(score)
    if kind:
        score = F.when(F.col(kind) == "knowledge", score * KNOWLEDGE_BOOST).otherwise(score)
    names = F.filter(F.zip_with(F.array(*[F.lit(t) for t in terms]), "gain", lambda t, g: F.when(g > 0, t)), lambda t: t.isNotNull())
    return w.select(key, F.col("w.line").alias("line"), F.col("w.end_line").alias("end_line"), F.round(score, 4).alias("score"), names.alias("matched_terms"))


def best_per_source(hits: DataFrame, key: str = "source", limit: int | None = None, min_terms: int = 1) -> DataFrame:
    """The best window of each page, those with too few terms left out before any limit."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "line")
    out = hits.where(F.size("matched_terms") >= min_terms).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return out if limit is None else out.orderBy(F.desc("score"), key, "line").limit(limit)


def search(pages: DataFrame, query: str, limit: int = 5, min_terms: int = 1, key: str = "source", text: str = "text", kind: str | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The best hits. Content is not read into the ranking; join it to what is left."""
    return best_per_source(scored_windows(pages, query, key, text, kind, config), key, limit, min_terms)
