"""Index maintenance, proofs of lossless moves, imports, merges and store identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import python_text as P
from ..functions import text as T


def index_delta(known: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """key and change (added, changed, removed, same) from revisions known and seen."""
    j = known.select(key, F.col("revision").alias("k")).join(seen.select(key, F.col("revision").alias("s")), key, "full_outer")
    change = F.when(F.col("k").isNull(), "added").when(F.col("s").isNull(), "removed").when(F.col("k") != F.col("s"), "changed").otherwise("same")
    return j.select(key, change.alias("change"))


def delta_counts(delta: DataFrame) -> DataFrame:
    c = lambda *names: F.count_if(F.col("change").isin(*names))
    return delta.agg(c("added", "changed", "same").alias("indexed"), c("added", "changed").alias("changed"), c("removed").alias("removed"))


def refreshed(index: DataFrame, fresh: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """The index after a delta: rows of removed and changed keys go, fresh rows of added and changed ones come."""
    touched = lambda *names: delta.where(F.col("change").isin(*names)).select(key)
    return index.join(touched("removed", "changed"), key, "left_anti").unionByName(fresh.join(touched("added", "changed"), key, "left_semi"))


def fresh_hits(hits: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Hits whose revision is still the page's."""
    return hits.join(pages.select(key, "revision"), [key, "revision"], "left_semi")


def lost_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines (with repeats) that a move would lose. before, after: text."""
    lines = lambda df: df.select(F.explode(T.lines(F.col("text"))).alias("line")).select(F.rtrim("line").alias("line")).where("trim(line) <> ''")
    return lines(before).exceptAll(lines(after))


def import_active(rows: DataFrame, done: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Active rows that are not yet imported, each with its marker (a digest of the whole row) and target."""
    marker = F.sha2(F.to_json(F.struct(*fields)), 256)
    target = F.when(F.col("scope") == "global", "context/MEMORY.md").otherwise(F.concat(F.lit("projects/"), T.slug(F.col("project")), F.lit("/context/MEMORY.md")))
    return rows.where("status = 'active'").withColumn("marker", marker).withColumn("target", target).join(done, "marker", "left_anti")


def merge_plan(source: DataFrame, target: DataFrame, append: Column) -> DataFrame:
    """path and class of every source file: moved (new), identical, append (transcripts) or collision."""
    t = target.select("path", F.col("sha").alias("t"))
    c = F.when(F.col("t").isNull(), "moved").when(F.col("t") == F.col("sha"), "identical").when(append, "append").otherwise("collision")
    return source.join(t, "path", "left").select("path", c.alias("class"))


def longest_prefix(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """path and the value of the longest prefix (whole components) among prefixes (prefix, value).

    Paths name their own ancestors, so the join is on equality.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    e = paths.select("path", F.explode(above).alias("prefix")).join(prefixes, "prefix")
    best = e.groupBy("path").agg(F.max_by(F.struct("prefix", "value"), F.length("prefix")).alias("x"))
    return paths.select("path").join(best, "path", "left").select("path", "x.prefix", "x.value")


def registry_lookup(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """remote, name, store (exact match) and candidates (stores of the same remote) where there is none."""
    exact = registry.groupBy("remote", "name").agg(F.min("store").alias("store"))
    same = registry.groupBy("remote").agg(F.array_sort(F.collect_set("store")).alias("others"))
    j = asked.join(exact, ["remote", "name"], "left").join(same, "remote", "left")
    return j.select("remote", "name", "store", F.when(F.col("store").isNull(), F.coalesce("others", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("candidates"))


def identity_cascade(asked: DataFrame, bindings: DataFrame, stores: DataFrame, registry: DataFrame) -> DataFrame:
    """dir, store and how it was found: binding (longest prefix), the path's own store, the registry, or new.

    asked: dir, remote, name. bindings: prefix, value. stores: store.
    """
    bound = longest_prefix(asked.select(F.col("dir").alias("path")), bindings).select(F.col("path").alias("dir"), F.col("value").alias("b"))
    own = stores.select(F.col("store").alias("o"))
    a = asked.withColumn("encoded", T.encode_path(F.col("dir"))).join(bound, "dir", "left").join(own, F.col("encoded") == F.col("o"), "left")
    r = registry_lookup(asked.select("remote", "name").distinct(), registry).select("remote", "name", F.col("store").alias("r"))
    a = a.join(r, ["remote", "name"], "left")
    how = F.when(F.col("b").isNotNull(), "binding").when(F.col("o").isNotNull(), "path").when(F.col("r").isNotNull(), "remote").otherwise("new")
    return a.select("dir", F.coalesce("b", "o", "r", "encoded").alias("store"), how.alias("identity"))


def serving(demands: DataFrame, anchors: DataFrame) -> DataFrame:
    """Demands whose directory holds an anchor or lies in it. Each side names its own ancestors: two equality joins."""

    def above(c):
        parts = F.split(c, "/")
        return F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))

    down = anchors.select("anchor", above("anchor").alias("workdir")).join(demands, "workdir").select("name", "anchor")
    up = demands.select("name", above("workdir").alias("anchor")).join(anchors, "anchor").select("name", "anchor")
    return down.unionByName(up).distinct()


def rebased(texts: DataFrame, pages: DataFrame, key: str, text: str) -> DataFrame:
    """texts (key, text, source and target folder) with links to real pages as they read from the target folder.

    The pages that a text names are looked up by a join, so there may be any number of pages.
    """
    named = texts.select(key, F.explode(P.link_targets_column()(text, "source")).alias("page"))
    there = named.join(pages.select("page").distinct(), "page", "left_semi").groupBy(key).agg(F.collect_set("page").alias("there"))
    return texts.join(there, key, "left").withColumn(text, P.rebase_column()(text, "source", "target", "there")).drop("there")
