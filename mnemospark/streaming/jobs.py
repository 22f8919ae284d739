"""Streaming twins: session capture, usage windows, alert state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import sessions

ALERT_OUT = "n long, marker string, state string"


def capture_stream(spark: SparkSession, path: str) -> DataFrame:
    """New session lines as they arrive in whole files, as messages of the conversation. The checkpoint is the
    cursor: a line is taken once, and a file that is written again under another name is a new one."""
    lines = spark.readStream.format("text").option("recursiveFileLookup", True).load(path)
    numbered = lines.select(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("line_no"), "value").where("value <> ''")
    return sessions.conversation(sessions.parse_lines(numbered)).where("ts is not null").select("file", "role", "text", "ts")


def once(df: DataFrame, keys: list[str], ts: str, late: str = "35 days") -> DataFrame:
    """Each key once, as long as a repeat comes within the horizon."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def rolling(df: DataFrame, ts: str, kind: str, size: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts of each kind over sliding windows."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, size, slide), kind).agg(F.count(F.lit(1)).alias("n"))


def alert_rows(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One marker's calls in order, with its last state and day kept between batches. A batch's calls of a marker come in
    parts of any order, so all are taken before the first is judged."""
    now, since = state.get if state.exists else ("", "")
    calls = sorted(row for pdf in pdfs for row in zip(*(pdf[c].tolist() for c in ("n", "day", "call")), strict=True))
    out = []
    for n, day, call in calls:
        if call == "ok" and now != "!" or call == "once" and now == "OK":
            continue
        new = "OK" if call == "ok" else "!"
        if not (new == now == "!" and since == day):
            out.append((n, new))
        now, since = new, day
    state.update((now, since))
    if out:
        yield pd.DataFrame({"n": [n for n, _ in out], "marker": key[0], "state": [x for _, x in out]})


def alert_stream(calls: DataFrame) -> DataFrame:
    """The transitions of ``state.alert_transitions``, call by call."""
    return calls.groupBy("marker").applyInPandasWithState(alert_rows, ALERT_OUT, "state string, since string", "append", GroupStateTimeout.NoTimeout)


#: The state store that transformWithState needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Throttle(StatefulProcessor):
    """Calls of a key that pass: none has passed in so many seconds before. The time of the last one is forgotten as
    long after it was written, so keys that are quiet hold no state."""

    def __init__(self, seconds: int, once: bool = False):
        self.seconds, self.once = seconds, once

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long", ttlDurationMs=max(1, self.seconds) * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        last = held[0] if held is not None else None
        calls = sorted((at.value // 1000, n) for pdf in rows for at, n in zip(pdf["at"], pdf["n"], strict=True))
        passed = []
        for at, n in calls:
            if last is None or not self.once and at - last >= self.seconds * 1_000_000:
                passed.append((key[0], n))
                last = at
        if passed:
            self.last.update((last,))
        yield pd.DataFrame(passed, columns=["key", "n"])


def throttle_stream(calls: DataFrame, seconds: int, once: bool = False) -> DataFrame:
    """key and n of the calls (key, n, at) that pass ``state.throttled``; once: of each key the first alone, until it is
    forgotten. The session must use the RocksDB state store (ROCKS), and spark.sql.streaming.noDataMicroBatches.enabled must
    be false where the query is to end by itself (availableNow): state that runs out asks for a batch forever. State lives as long as the throttle by the clock: a
    replay of old calls that takes longer than that lets more of them pass."""
    return calls.groupBy("key").transformWithStateInPandas(Throttle(seconds, once), outputStructType="key string, n long", outputMode="append", timeMode="processingTime")


def exactly_once(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]):
    """Run a sink that is idempotent by batch id over everything that is there now."""
    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
