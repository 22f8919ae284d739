"""Streams take each line once, and the alert stream keeps its state between batches."""

import json

from mnemospark.operators import state
from mnemospark.plans.base import Fixture
from mnemospark.streaming.jobs import alert_stream, capture_stream, exactly_once, once, rolling


ALERTS = Fixture("alerts", "n long, day string, marker string, call string", [
    (1, "2026-01-01", "disk", "alert"), (2, "2026-01-01", "disk", "alert"), (3, "2026-01-02", "disk", "alert"), (4, "2026-01-02", "disk", "ok"), (5, "2026-01-02", "disk", "ok"), (6, "2026-01-02", "disk", "alert"),
    (7, "2026-01-01", "nag", "once"), (8, "2026-01-03", "nag", "ok"), (9, "2026-01-04", "nag", "once"), (10, "2026-01-04", "new", "ok"), (11, "2026-01-05", "job", "once"), (12, "2026-01-05", "job", "once"), (13, "2026-01-06", "job", "alert"),
])


def _line(text, ts, **more):
    return json.dumps({"type": "user", "message": {"role": "user", "content": text}, "timestamp": ts, **more})


def test_capture_takes_each_file_once(spark, tmp_path):
    source, out, cursor = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cursor")
    source.mkdir()
    run = lambda: exactly_once(capture_stream(spark, str(source)), cursor, lambda df, _: df.write.mode("append").parquet(out)).awaitTermination()
    (source / "a.jsonl").write_text(_line("one", "2026-01-01T00:00:00Z") + "\n{broken\n" + _line("meta", "2026-01-01T00:00:01Z", isMeta=True) + "\n")
    run()
    (source / "b.jsonl").write_text(_line("two", "2026-01-02T00:00:00Z") + "\n")
    run()
    run()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["one", "two"]


def test_alert_stream_keeps_state_between_batches(spark, tmp_path):
    calls = ALERTS.rows
    source = tmp_path / "calls"
    source.mkdir()
    names = [c.split(" ")[0] for c in ALERTS.ddl.split(", ")]
    got = []
    for i, part in enumerate((calls[:5], calls[5:9], calls[9:])):
        (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in part))
        stream = alert_stream(spark.readStream.schema(ALERTS.ddl).json(str(source)))
        exactly_once(stream, str(tmp_path / "state"), lambda df, _: got.extend((r.n, r.marker, r.state) for r in df.collect())).awaitTermination()
    want = [(r.n, r.marker, r.state) for r in state.alert_transitions(ALERTS.df(spark)).collect()]
    assert sorted(got) == sorted(want)


def test_alert_parts_of_a_batch_come_in_any_order():
    import pandas as pd

    from mnemospark.streaming.jobs import alert_rows

    class Kept:
        exists = False

        def update(self, value):
            self.value = value

    part = lambda *rows: pd.DataFrame(rows, columns=["n", "day", "call"])
    kept = Kept()
    got = pd.concat(alert_rows(("m",), iter([part((3, "d2", "ok")), part((2, "d1", "alert"), (1, "d1", "once"))]), kept))
    assert [tuple(r) for r in got.itertuples(index=False)] == [(1, "m", "!"), (3, "m", "OK")] and kept.value == ("OK", "d2")


def test_alert_query_holds_nothing_in_the_driver(spark):
    from mnemospark.plans.catalogue import QUERIES

    got = QUERIES["alert_stream"](spark, "/root/testdata/sf0.001")
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("alert_stream_")]
    assert got.inputFiles() and sorted(map(tuple, got.collect())) == sorted(map(tuple, QUERIES["alert_transitions"](spark, "/root/testdata/sf0.001").collect()))


def test_once_and_rolling(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    rows = [{"id": i % 3, "kind": "recall", "ts": f"2026-01-0{1 + i % 2}T00:00:00"} for i in range(12)]
    (source / "0.json").write_text("\n".join(map(json.dumps, rows)))
    stream = lambda: spark.readStream.schema("id long, kind string, ts timestamp").json(str(source))
    seen, windows = [], []
    exactly_once(once(stream(), ["id"], "ts"), str(tmp_path / "c1"), lambda df, _: seen.extend(r.id for r in df.collect())).awaitTermination()
    q = rolling(stream(), "ts", "kind").writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).foreachBatch(lambda df, _: windows.extend(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(seen) == [0, 1, 2] and max(r.n for r in windows) == 12
