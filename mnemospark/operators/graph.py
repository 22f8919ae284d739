"""Reachability over page links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_folder

#: Rounds of a search after which what was found is put together.
MERGED = 12


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node of everything that the roots reach over edges (src, dst). Breadth first: each round joins the new
    nodes alone, so a round costs what it finds; cycles end by themselves, and the search ends only when a round
    finds nothing. Rounds are checkpointed, and MERGED of them become one, so a plan does not grow with the depth."""
    checkpoint_folder(edges.sparkSession)
    rounds = [roots.select("node").distinct().checkpoint()]
    while True:
        step = edges.join(rounds[-1].withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
        for seen in rounds:
            step = step.join(seen, "node", "left_anti")
        new = step.checkpoint()
        if new.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
        if len(rounds) == MERGED:
            rounds = [reduce(DataFrame.unionByName, rounds).checkpoint()]
        rounds.append(new)


def archive_chain(pages: DataFrame, edges: DataFrame, start: str) -> DataFrame:
    """Archives that a page's archive links lead to, each once."""
    root = pages.sparkSession.createDataFrame([(start,)], "node string")
    return reachable(edges, root).where(F.col("node") != start)


def chain_ends(links: DataFrame) -> DataFrame:
    """node, last, hops and cyclic of every node of links (node, next): the end of its chain, in one hop from now on,
    and how many hops it took. A node on a cycle, or before one, has neither and is cyclic. Of several links of a node
    the smallest counts; null ends are no links.

    Pointer jumping: each round a node takes over where its next one has got to, so a chain of n links takes log2(n)
    rounds, and what is left after as many is cyclic. Nodes that are at their end are not joined again; rounds are
    checkpointed.
    """
    checkpoint_folder(links.sparkSession)
    one = links.where("node is not null and next is not null").groupBy("node").agg(F.min("next").alias("to"))
    nodes = one.select(F.col("node").alias("there"))
    step = one.join(nodes, F.col("to") == F.col("there"), "left").select("node", "to", F.lit(1).cast("long").alias("hops"), F.col("there").isNull().alias("done")).checkpoint()
    settled, rounds = [step.where("done")], max(1, step.count()).bit_length() + 1
    while rounds and not step.where("not done").isEmpty():
        ahead = reduce(DataFrame.unionByName, [*settled, step.where("not done")]).select(F.col("node").alias("via"), F.col("to").alias("end"), F.col("hops").alias("more"), F.col("done").alias("ended"))
        open_ = step.where("not done")
        step = open_.join(ahead, F.col("to") == F.col("via")).select("node", F.col("end").alias("to"), (F.col("hops") + F.col("more")).alias("hops"), F.col("ended").alias("done")).checkpoint()
        settled.append(step.where("done"))
        rounds -= 1
    found = reduce(DataFrame.unionByName, settled).select("node", F.col("to").alias("last"), "hops", F.lit(False).alias("cyclic"))
    kind = links.schema["next"].dataType
    return found.unionByName(step.where("not done").select("node", F.lit(None).cast(kind).alias("last"), F.lit(None).cast("long").alias("hops"), F.lit(True).alias("cyclic")))


def nearest_ancestor(paths: DataFrame, holders: DataFrame) -> DataFrame:
    """path and the nearest directory at or above it that is among the holders (dir)."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    e = paths.select("path", F.explode(above).alias("dir"))
    return e.join(holders, "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("root"))
