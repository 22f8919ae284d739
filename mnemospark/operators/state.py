"""Keyed state in batch: alert transitions, last states. The streaming twins are in ``streaming``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import greedy


def alert_step(state: Column, since: Column, call: Column, day: Column) -> tuple[Column, Column, Column]:
    """The next state, its day, and whether it is announced: an alert that is closed, or open since another day;
    an OK only of an open one; ``once`` never after an OK."""
    ignored = ((call == "ok") & (state != "!")) | ((call == "once") & (state == "OK"))
    new = F.when(ignored, state).when(call == "ok", "OK").otherwise("!")
    at = F.when(ignored, since).otherwise(day)
    return new, at, ~ignored & ~((new == "!") & (state == "!") & (since == day))


def alert_transitions(calls: DataFrame) -> DataFrame:
    """n, marker, state of the calls that are written. calls: n (their order), day, marker, call.

    The state needs no fold: an alert always opens, and so does ``once`` as long as nothing was closed. So a marker is
    open since its last alert (or, before any, its first ``once``), unless an OK came after that. A call repeats the
    one before if both leave the marker open on the same day.
    """
    order = Window.partitionBy("marker").orderBy("n")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = lambda call: F.when(F.col("call") == call, F.col("n"))
    opened = F.coalesce(F.max(place("alert")).over(so_far), F.min(place("once")).over(so_far))
    closed = F.max(place("ok")).over(so_far)
    c = calls.select("n", "day", "marker", "call", F.when(opened.isNull(), "").when(closed > opened, "OK").otherwise("!").alias("state"))
    before, same_day = F.coalesce(F.lag("state").over(order), F.lit("")), F.lag("day").over(order) == F.col("day")
    told = F.when(F.col("call") == "ok", before == "!").otherwise(((F.col("call") != "once") | (before != "OK")) & ~((before == "!") & same_day))
    return c.withColumn("told", F.coalesce(told, F.lit(True))).where("told").select("n", "marker", "state")


def throttled(df: DataFrame, key: str, at: str, seconds: int, order: str) -> DataFrame:
    """df with admitted: whether a call passes, as none of its key has passed in so many seconds before it. Calls are
    taken in order of their time (a timestamp), then of ``order``."""

    def admit(times, last):
        out = []
        for t in times:
            out.append(last is None or t - last >= seconds * 1_000_000)
            last = t if out[-1] else last
        return out, last

    timed = df.withColumn("__at", F.unix_micros(F.col(at).cast("timestamp")))
    return greedy.fold(timed, key, ["__at", order], "__at", admit, "admitted boolean").drop("__at")


def last_state(df: DataFrame, key: str, state: str, order: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("state"))


def open_alerts(written: DataFrame) -> DataFrame:
    """Markers whose last entry is open, with that entry's number."""
    return written.groupBy("marker").agg(F.max_by(F.struct("state", "n"), "n").alias("x")).where("x.state = '!'").select("marker", "x.n")
