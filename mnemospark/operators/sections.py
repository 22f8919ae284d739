"""Sections of Markdown pages, and intervals on lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK_LIMIT, CHUNK_LINES, CHUNK_STRIDE
from ..functions import text as T


def section_chunks(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, end_line (from 1), heading, content: one chunk for each ``## `` section, long ones cut with overlap.

    A page's lines become numbers of section starts inside the row; only chunks leave it.
    """
    p = pages.select(key, T.lines(F.col(text)).alias("ls"))
    index = F.transform("ls", lambda x, i: i)
    close = F.array_min(F.filter(index, lambda i: (i > 0) & (F.get("ls", i) == "---")))
    p = p.withColumn("first", F.when((F.get("ls", F.lit(0)) == "---") & close.isNotNull(), close + 1).otherwise(0))
    p = p.withColumn("title", F.coalesce(F.trim(F.substring(F.get(F.filter("ls", lambda x, i: (i >= F.col("first")) & F.startswith(x, F.lit("# "))), F.lit(0)), 3, 10_000)), F.lit("")))
    heads = F.filter(F.transform("ls", lambda x, i: i), lambda i: (i >= F.col("first")) & F.startswith(F.get("ls", i), F.lit("## ")))
    p = p.withColumn("starts", F.concat(F.array("first"), heads)).withColumn("ends", F.concat(heads, F.array(F.size("ls"))))
    s = p.select(key, "ls", "title", F.explode(F.arrays_zip("starts", "ends")).alias("s")).select(key, "ls", "title", F.col("s.starts").alias("a"), F.col("s.ends").alias("b")).where("b > a")
    s = s.where(F.exists(F.slice("ls", F.col("a") + 1, F.col("b") - F.col("a")), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("# "))))
    head = F.get("ls", F.col("a"))
    s = s.withColumn("heading", F.concat("title", F.when(F.startswith(head, F.lit("## ")), F.concat(F.lit(" > "), F.trim(F.substring(head, 4, 10_000)))).otherwise("")))
    long = F.col("b") - F.col("a") > CHUNK_LIMIT
    cuts = F.when(long, F.sequence("a", F.greatest(F.col("a"), F.col("b") - (CHUNK_LINES - CHUNK_STRIDE) - 1), F.lit(CHUNK_STRIDE))).otherwise(F.array("a"))
    c = s.withColumn("c", F.explode(cuts)).withColumn("e", F.when(long, F.least(F.col("c") + CHUNK_LINES, F.col("b"))).otherwise(F.col("b")))
    return c.select(key, (F.col("c") + 1).cast("long").alias("line"), F.col("e").cast("long").alias("end_line"), "heading", F.array_join(F.slice("ls", F.col("c") + 1, F.col("e") - F.col("c")), "\n").alias("content"))


def overlapping(blocks: DataFrame, windows: DataFrame, key: str, stride: int, width: int) -> DataFrame:
    """Pairs of blocks [start, end) and windows [w_start, w_end) of a page that overlap.

    A block names the windows it can touch by number (w_start / stride), so the join is on equality.
    """
    low = F.greatest(F.lit(0), F.floor((F.col("start") - width) / stride) + 1).cast("long")
    near = blocks.withColumn("k", F.explode(F.sequence(low, F.floor((F.col("end") - 1) / stride).cast("long"))))
    w = windows.withColumn("k", F.floor(F.col("w_start") / stride).cast("long"))
    return near.join(w, [key, "k"]).where("start < w_end and end > w_start").drop("k")
