"""What a session has said since a cursor, as plain dialogue in parts of a bounded size.

A part ends before the line that would pass the cap, and the cursor stops there, so nothing is skipped: the next part, or
the next run, begins with that line. A line that alone is longer is a part by itself, cut at its end, and says by how
much. Sessions are dealt to tasks; lines pass through in order, and of a session only the part's size is held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import greedy

#: Characters of a part, and of a tool call's arguments.
PART_CHARS, TOOL_CHARS = 600_000, 300
#: Characters between two lines of a part.
JOIN = "\n\n"

# Elements of a message that are no part of the dialogue.
ASIDES = "system-reminder local-command-stdout local-command-caveat command-message command-name command-args user-prompt-submit-hook".split()
BLOCKS = "array<struct<type:string,text:string,name:string,input:string>>"


def said(content: Column, listed: Column) -> Column:
    """A message's dialogue: its texts without asides, and its tool calls in a line each; results and thoughts are left
    out. content: a text, or an array of blocks in JSON (listed). Arguments are JSON without blanks between tokens."""
    plain = lambda x: F.btrim(F.regexp_replace(x, rf"(?s)<({'|'.join(ASIDES)})>.*?</\1>", ""), F.lit(" \n\t\r\f\x0b"))
    blocks = F.when(listed, F.from_json(content, BLOCKS)).otherwise(F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("input"))))
    one = lambda b: F.when(b["type"] == "text", F.nullif(plain(F.coalesce(b["text"], F.lit(""))), F.lit(""))).when(b["type"] == "tool_use", F.concat(F.lit("[tool "), F.coalesce(b["name"], F.lit("")), F.lit("] "), F.substring(F.coalesce(b["input"], F.lit("{}")), 1, TOOL_CHARS)))
    return F.array_join(F.filter(F.transform(F.coalesce(blocks, F.array().cast(BLOCKS)), one), lambda x: x.isNotNull()), "\n")


def rendered(lines: DataFrame) -> DataFrame:
    """lines (file, line_no, value) with said: ``## role`` and the dialogue of each, empty where a line has none.
    Malformed lines, sidechains and other types have none."""
    g = lambda path: F.get_json_object("value", path)
    spoken = F.coalesce(g("$.type").isin("user", "assistant") & (F.coalesce(g("$.isSidechain"), F.lit("false")) != "true"), F.lit(False))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.message.content", "variant"))
    text = said(F.coalesce(g("$.message.content"), F.lit("")), F.coalesce(F.startswith(kind, F.lit("ARRAY")), F.lit(False)))
    return lines.withColumn("said", F.when(spoken & (text != ""), F.concat(F.lit("## "), F.coalesce(g("$.message.role"), F.lit("")), F.lit("\n"), text)).otherwise(""))


def cut(lines: DataFrame, session: str, order: str, said: str = "said", cap: int = PART_CHARS, cursors: DataFrame | None = None) -> DataFrame:
    """lines with part, from 1 for each session. cursors (session, line): the first line that counts; a cursor beyond
    the session's end is another log's and counts as 0."""
    if cursors is not None:
        c = cursors.select(F.col(session).alias("__s"), F.col("line").alias("__from"))
        ends = lines.groupBy(F.col(session).alias("__e")).agg(F.max(order).alias("__end"))
        start = ends.join(c, F.col("__e").eqNullSafe(F.col("__s")), "left").select("__e", F.when(F.col("__from") <= F.col("__end") + 1, F.col("__from")).otherwise(0).alias("__start"))
        lines = lines.join(start, lines[session].eqNullSafe(start["__e"])).where(F.col(order) >= F.col("__start")).drop("__e", "__start")

    def parts(sizes, state):
        part, total = state or (1, None)
        out = []
        for n in sizes:
            if total is not None and total + n > cap:
                part, total = part + 1, None
            total = (total or 0) + n
            out.append(part)
        return out, (part, total)

    sized = lines.withColumn("__n", F.length(F.coalesce(said, F.lit(""))).cast("long") + len(JOIN))
    return greedy.fold(sized, session, [order], "__n", parts, "part long").drop("__n")


def parts(lines: DataFrame, session: str, order: str, said: str = "said", cap: int = PART_CHARS, cursors: DataFrame | None = None) -> DataFrame:
    """session, part, first, next (the cursor behind it), text (at most cap characters) and clipped (characters cut off
    the end of a line that is longer)."""
    mine = cut(lines.select(session, order, said), session, order, said, cap, cursors)
    found = F.array_sort(F.collect_list(F.when(F.col(said) != "", F.struct(F.col(order).alias("o"), F.col(said).alias("t")))))
    whole = mine.groupBy(session, "part").agg(F.min(order).alias("first"), (F.max(order) + 1).alias("next"), F.array_join(F.transform(found, lambda x: x["t"]), JOIN).alias("text"))
    return whole.select(session, "part", "first", "next", F.substring("text", 1, cap).alias("text"), F.greatest(F.lit(0), F.length("text") - cap).alias("clipped"))
