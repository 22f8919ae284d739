"""Session logs: raw lines to messages, messages to days, turns, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TRANSCRIPT_CAP
from . import greedy

# What a session log holds besides the conversation.
SKIP_TYPES = ("attachment", "last-prompt", "queue-operation", "system")
NOISE_PREFIXES = ("<system-reminder>", "<command-name>", "<command-message>", "<command-args>", "<local-command-stdout>", "<local-command-caveat>", "<user-prompt-submit-hook>")
SYNTHETIC = r"\A\s*(<(local-command-(stdout|stderr|caveat)|bash-(stdout|stderr))>|\[Request interrupted)"


def is_noise(text: Column) -> Column:
    out = F.lit(False)
    for p in NOISE_PREFIXES:
        out = out | F.startswith(text, F.lit(p))
    return out


def content_text(content: Column) -> Column:
    """Text of a message's content, a JSON string that holds either a string or an array of blocks."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (b["text"] != "")), lambda b: b["text"])
    return F.when(F.startswith(F.ltrim(content), F.lit("[")), F.trim(F.array_join(texts, "\n"))).otherwise(content)


def parse_lines(lines: DataFrame) -> DataFrame:
    """file, line_no, type, role, text, ts, cwd, flags of the lines of session logs of the first kind.

    Malformed lines are left out, never fatal; content keeps its own JSON, since it is a string or an array.
    """
    g = lambda path: F.get_json_object("value", path)
    fields = lines.select(
        "file", "line_no", g("$.type").alias("type"), g("$.message.role").alias("role"), g("$.message.content").alias("content"), F.try_to_timestamp(g("$.timestamp")).alias("ts"), g("$.cwd").alias("cwd"),
        *[F.coalesce(g(f"$.{n}") == "true", F.lit(False)).alias(n) for n in ("isSidechain", "isMeta", "isCompactSummary")], g("$.promptSource").alias("prompt_source"), g("$.interruptedMessageId").alias("interrupted"),
    )
    return fields.where(F.col("type").isNotNull()).withColumn("text", content_text(F.col("content")))


def parse_event_lines(lines: DataFrame) -> DataFrame:
    """The same for logs of the second kind: user and agent messages, with the file's last working directory."""
    g = lambda path: F.get_json_object("value", path)
    p = lines.select("file", "line_no", g("$.type").alias("type"), g("$.payload.type").alias("kind"), g("$.payload.message").alias("text"), g("$.payload.cwd").alias("cwd"), F.try_to_timestamp(g("$.timestamp")).alias("ts"))
    cwd = p.where("type = 'session_meta' and cwd is not null").groupBy("file").agg(F.max_by("cwd", "line_no").alias("cwd"))
    said = p.where("type = 'event_msg' and kind in ('user_message', 'agent_message')")
    role = F.when(F.col("kind") == "user_message", "user").otherwise("assistant")
    return said.select("file", "line_no", role.alias("role"), "text", "ts").join(cwd, "file", "left")


def conversation(messages: DataFrame) -> DataFrame:
    """Messages of the two speakers that are neither machinery nor empty."""
    m = messages.where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    if "type" in messages.columns:
        m = m.where(~F.col("type").isin(*SKIP_TYPES))
    if "isSidechain" in messages.columns:
        m = m.where(~F.col("isSidechain") & ~F.col("isMeta"))
    return m.where(~is_noise(F.col("text")))


def is_user_turn(e: DataFrame) -> Column:
    """A prompt that a person typed, by flags first and by text where flags are missing."""
    flags = F.col("isSidechain") | F.col("isMeta") | F.col("isCompactSummary") | (F.coalesce("prompt_source", F.lit("")) == "system") | F.col("interrupted").isNotNull()
    result = F.coalesce(F.contains("content", F.lit('"tool_result"')), F.lit(False)) & F.startswith(F.ltrim("content"), F.lit("["))
    return (F.col("type") == "user") & F.col("content").isNotNull() & ~flags & ~result & ~F.coalesce(F.col("text"), F.lit("")).rlike(SYNTHETIC)


def first_value(lines: DataFrame, group: str, value: str, most: int = 200) -> DataFrame:
    """The first value of each group, by file and line, within a file's first lines."""
    ok = lines.where((F.col("line_no") < most) & F.startswith(value, F.lit("/")))
    return ok.groupBy(group).agg(F.min_by(value, F.struct("file", "line_no")).alias(value))


def consecutive_dedupe(df: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Rows that do not repeat the one before."""
    before = F.lag(text).over(Window.partitionBy(group).orderBy(order))
    first = F.row_number().over(Window.partitionBy(group).orderBy(order)) == 1
    return df.withColumn("__keep", first | ~F.col(text).eqNullSafe(before)).where("__keep").drop("__keep")


def prompt_reply_pairs(df: DataFrame, group: str, order: str) -> DataFrame:
    """Each session's last assistant message with the user's prompt before it."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prompt = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    said = df.withColumn("prompt", prompt).where("role = 'assistant'")
    return said.groupBy(group).agg(F.max_by(F.struct("prompt", "text"), order).alias("x")).select(group, "x.prompt", F.col("x.text").alias("reply"))


# The first line of a complete transcript, and the last one of a cut one.
TRANSCRIPT_MARK = "<!-- auto-extracted from native session jsonl -->"
TRUNCATED = "\n<!-- truncated at %d chars -->"


def transcript_days(messages: DataFrame, cap: int = TRANSCRIPT_CAP, today: str | None = None) -> DataFrame:
    """store, day, text: a day's messages (ts, file, line_no, role, text) in order, up to the first that would pass the
    cap (in characters), which leaves a mark. Today is never written, as it is not over. What is gathered of a day
    keeps to the cap."""
    entry = F.concat(F.lit("\n## "), F.date_format("ts", "HH:mm:ss"), F.lit("\n**"), "role", F.lit(":** "), "text")
    m = messages.where(F.col("day") != today) if today else messages
    w = Window.partitionBy("store", "day").orderBy("ts", "file", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("entry", entry).withColumn("fits", F.sum(F.length("entry")).over(w) <= cap)
    listed = F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("ts", "file", "line_no", "entry"))))
    days = m.groupBy("store", "day").agg(listed.alias("l"), F.every("fits").alias("whole"))
    parts = F.concat(F.array(F.lit(TRANSCRIPT_MARK)), F.transform("l", lambda x: x["entry"]), F.when(F.col("whole"), F.array().cast("array<string>")).otherwise(F.array(F.lit(TRUNCATED % cap))))
    return days.select("store", "day", F.concat(F.array_join(parts, "\n"), F.lit("\n")).alias("text"))


def transcript_merge(old: DataFrame, new: DataFrame, marker: str, force: bool = False) -> DataFrame:
    """store, day and what to do: write where there is none, rewrite a partial one (without the marker) or a shorter one, else skip."""
    o = old.select("store", "day", F.col("text").alias("old"))
    j = new.join(o, ["store", "day"], "full_outer")
    action = (
        F.when(F.col("text").isNull(), "keep").when(F.col("old").isNull(), "write").when(F.lit(force) | ~F.contains("old", F.lit(marker)), "overwrite")
        .when(F.length("text") > F.length("old"), "rewrite").otherwise("skip")
    )
    return j.select("store", "day", action.alias("action"))


def running_budget(df: DataFrame, group: str, order: list[str], size: Column, budget: int) -> DataFrame:
    """Rows in order up to the first that would pass the budget."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def budget_fill(df: DataFrame, group: str, order: str, size: str, key: str, budget: int) -> DataFrame:
    """Rows taken in order of priority; one that doesn't fit is skipped and the next is tried."""

    def fill(sizes, used):
        used, kept = used or 0, []
        for n in sizes:
            kept.append(used + n <= budget)
            used += n if kept[-1] else 0
        return kept, used

    return greedy.fold(df, group, [order, key], size, fill, "kept boolean").where("kept").select(group, key)
