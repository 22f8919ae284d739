"""Salience: which blocks of a store's index stay warm, by use and decay, under a budget of characters."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import events as E

TIERS = "ctx string, fp string, tier string, skipped boolean"
#: Fixed value: the note that an index gets when its first block turns cold.
POINTER_CHARS = len("- [Cold memory](MEMORY-COLD.md) — weaker lines: searched and recalled, not loaded at startup\n")


def shown_hits(events: DataFrame, cross: float = 2.0) -> DataFrame:
    """source, own, blocks, at and weight of every hit that a reader saw: injected by a recall, noted on an edit,
    opened, or listed by the command line in its own project. Another project's sight weighs ``cross``.

    events: see events.SCHEMA; only those of a session count. A reference names a request and a hit; the request's
    own search says what it was, else the last search that met it.
    """
    real = events.where("session is not null and at is not null")
    searches = events.where("event = 'search'").select("request_id", "at", F.explode("hits").alias("h"))
    listed = real.where("event = 'search' and origin = 'cli'").select("at", F.explode("hits").alias("h")).where(F.coalesce("h.own", F.lit(True))).select("h", "at", F.lit(1.0).alias("weight"))
    pair = lambda r: F.struct(F.substring_index(r, ":", 1).alias("r"), F.regexp_extract(r, "(?s)^[^:]*:(.*)$", 1).alias("i"))
    named = (
        F.when(F.col("event") == "recall", F.transform("hit_ids", lambda i: F.struct(F.col("request_id").alias("r"), i.alias("i"))))
        .when(F.col("event") == "rag_edit", F.transform(F.filter("refs", lambda r: F.contains(r, F.lit(":"))), pair))
        .when(F.col("event") == "open", F.array(F.struct(F.col("request_id").alias("r"), F.col("result_id").alias("i"))))
    )
    refs = real.select("at", F.explode(named).alias("x")).select("at", F.col("x.r").alias("request_id"), F.col("x.i").alias("id"))
    keyed = searches.select("request_id", F.col("h.id").alias("id"), "at", "h")
    exact = keyed.groupBy("request_id", "id").agg(F.max_by("h", "at").alias("exact"))
    last = keyed.groupBy("id").agg(F.max_by("h", "at").alias("any"))
    seen = refs.join(exact, ["request_id", "id"], "left").join(last, "id", "left").select(F.coalesce("exact", "any").alias("h"), "at").where("h is not null")
    weight = F.when(F.coalesce("h.own", F.lit(True)), 1.0).otherwise(cross)
    both = seen.select("h", "at", weight.alias("weight")).unionByName(listed)
    return both.select("h.source", F.coalesce("h.own", F.lit(True)).alias("own"), "h.blocks", "at", "weight")


def uses(events: DataFrame, blocks: DataFrame, links: DataFrame, cross: float = 2.0) -> DataFrame:
    """ctx, fp, at, weight: every use of a block.

    A block is used when a prompt of its own store talks about it (once a prompt), when another project is shown it,
    and when a page that it links to is shown. blocks: ctx, fp, index (its page's source). links: ctx, fp, page.
    """
    talked = events.where("event = 'search' and session is not null").select("at", "session", F.coalesce("query_hash", "request_id").alias("query"), F.explode("hits").alias("h"))
    talked = talked.where(F.coalesce("h.own", F.lit(True))).select("at", "session", "query", F.regexp_extract("h.source", "^(.*)/[^/]*$", 1).alias("ctx"), F.explode("h.blocks").alias("fp"))
    matched = talked.groupBy("ctx", "session", "query", "fp").agg(F.min("at").alias("at")).select("ctx", "fp", "at", F.lit(1.0).alias("weight"))
    shown = shown_hits(events, cross)
    foreign = shown.where("not own").select("source", F.explode("blocks").alias("fp"), "at", "weight")
    foreign = foreign.join(blocks.select("ctx", "fp", F.col("index").alias("source")).distinct(), ["source", "fp"]).select("ctx", "fp", "at", "weight")
    linked = links.distinct().join(shown.select(F.col("source").alias("page"), "at", "weight"), "page").select("ctx", "fp", "at", "weight")
    known = blocks.select("ctx", "fp").distinct()
    return matched.join(known, ["ctx", "fp"], "left_semi").unionByName(foreign).unionByName(linked)


def strengths(blocks: DataFrame, used: DataFrame, now: str) -> DataFrame:
    """ctx, fp and strength: base-level activation of a block's birth (first_seen, a date) and its uses."""
    born = blocks.select("ctx", "fp", F.col("first_seen").cast("timestamp").alias("t"), F.lit(1.0).alias("weight"))
    each = born.unionByName(used.select("ctx", "fp", F.to_timestamp("at").alias("t"), "weight")).withColumn("block", F.struct("ctx", "fp"))
    days = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("t")) / 86_400_000_000
    return E.activation(each, "block", days, F.col("weight")).select("block.ctx", "block.fp", F.col("activation").alias("strength"))


def protected(blocks: DataFrame) -> DataFrame:
    """blocks (ctx, pos, section, kind, cold, pinned, text) with ``protected``: warm headings and comments, pinned
    blocks, links to other indexes and to the cold file, and the first other block of each section."""
    pointer = F.col("text").rlike(r"\]\((?:index-[0-9a-f]+|MEMORY-COLD)\.md\)")
    fixed = (F.col("kind") != "block") | F.coalesce("pinned", F.lit(False)) | pointer
    plain = ~F.col("cold") & ~fixed
    first = F.min(F.when(plain, F.col("pos"))).over(Window.partitionBy("ctx", "section")) == F.col("pos")
    return blocks.withColumn("protected", ~F.col("cold") & (fixed | (plain & F.coalesce(first, F.lit(False)))))


def choose(blocks: list[dict], budget: int, margin: float = 0.5, pointer: int = 0) -> set[str] | None:
    """Fingerprints of the blocks that are warm; None if the protected ones alone are over the budget.

    blocks: fp, chars, strength, cold, protected, pos and, for cold ones, open: whether the index still has their
    section. A cold block's strength pays the margin. Room alone never brings one back: it must beat the weakest warm
    block there was, and every one that this choice drives out; if not, the choice is made again without it. The first
    block that turns cold costs the pointer.
    """
    warm = [b for b in blocks if not b["cold"] and not b["protected"]]
    kept = {b["fp"] for b in blocks if b["protected"]}
    room = budget - sum(b["chars"] for b in blocks if b["protected"])
    offers = [(b["strength"], 0, b) for b in warm] + [(b["strength"] - margin, 1, b) for b in blocks if b["cold"] and b.get("open", True)]
    offers.sort(key=lambda o: (-o[0], o[1], -o[2]["pos"]))
    weakest = min((b["strength"] for b in warm), default=-math.inf)

    def fill(room: int) -> tuple[set[str], bool]:
        barred: set[str] = set()
        while True:
            left, taken = room, []
            for score, cold, b in offers:
                if b["fp"] not in barred and b["chars"] + cold <= left:
                    taken.append((score, cold, b["fp"]))
                    left -= b["chars"] + cold
            names = {fp for _, _, fp in taken}
            out = [b["strength"] for b in warm if b["fp"] not in names]
            late = {fp for score, cold, fp in taken if cold and score <= max([weakest, *out])}
            if not late:
                return names, bool(out)
            barred |= late

    paid = pointer if any(b["cold"] for b in blocks) else 0
    for cost in dict.fromkeys((paid, pointer)):
        if room < cost:
            return None
        names, demotes = fill(room - cost)
        if cost == pointer or not demotes:
            break
    return kept | names


def tiers(blocks: DataFrame, budget: int, margin: float = 0.5, pointer: int = 0) -> DataFrame:
    """ctx, fp, tier (warm or cold) of every block, and whether its store was skipped (all stay as they are). A store's
    index has at most a few hundred blocks."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        warm = choose(pdf.to_dict("records"), budget, margin, pointer)
        now = {b.fp for b in pdf.itertuples() if not b.cold} if warm is None else warm
        return pd.DataFrame({"ctx": pdf["ctx"], "fp": pdf["fp"], "tier": ["warm" if f in now else "cold" for f in pdf["fp"]], "skipped": warm is None})

    return blocks.groupBy("ctx").applyInPandas(one, TIERS)
