"""Session deltas, throttles and chains against plain versions, and the throttle's stream over batches and expiry."""

import json
import random
import re
import time

from pyspark.sql import functions as F

from mnemospark.operators import deltas, graph, state
from mnemospark.streaming.jobs import ROCKS, exactly_once, throttle_stream

ASIDE = re.compile(rf"(?s)<({'|'.join(deltas.ASIDES)})>.*?</\1>")


def say(line):
    try:
        e = json.loads(line)
    except ValueError:
        return ""
    if e.get("isSidechain") or e.get("type") not in ("user", "assistant"):
        return ""
    content, parts = e["message"]["content"], []
    for b in [{"type": "text", "text": content}] if isinstance(content, str) else content:
        if b["type"] == "text" and (t := ASIDE.sub("", b["text"]).strip()):
            parts.append(t)
        elif b["type"] == "tool_use":
            parts.append(f"[tool {b['name']}] " + json.dumps(b["input"], ensure_ascii=False, separators=(",", ":"))[:300])
    return f"## {e['message']['role']}\n" + "\n".join(parts) if parts else ""


def log(n, seed):
    rnd, out = random.Random(seed), []
    for i in range(n):
        role = rnd.choice(["user", "assistant"])
        text = rnd.choice(["", " padded \n", "word " * rnd.randint(1, 60), "é" * 90, "a <system-reminder>hidden\nlines</system-reminder> b", "[not json"])
        blocks = [{"type": "text", "text": text}, {"type": "tool_use", "name": "Read", "input": {"path": "x" * rnd.randint(0, 400), "n": i}}, {"type": "tool_result", "content": "no"}, {"type": "thinking", "thinking": "no"}]
        e = {"type": rnd.choice([role] * 6 + ["system"]), "message": {"role": role, "content": blocks[: rnd.randint(0, 4)] if i % 2 else text}, "isSidechain": rnd.random() < 0.1}
        out.append("{broken" if rnd.random() < 0.05 else json.dumps(e, ensure_ascii=False))
    return out


def plain_parts(lines, cap, start=0):
    out = []
    while start < len(lines):
        end, total = len(lines), 0
        for i in range(start, len(lines)):
            total += len(say(lines[i])) + 2
            if total > cap and i > start:
                end = i
                break
        text = "\n\n".join(filter(None, map(say, lines[start:end])))
        out.append((start, end, text[:cap], max(0, len(text) - cap)))
        start = end
    return out


def test_parts_join_to_the_delta(spark):
    logs = {f"f{k}": log(80 + 30 * k, k) for k in range(4)}
    d = spark.createDataFrame([(f, i, v) for f, x in logs.items() for i, v in enumerate(x)], "file string, line_no long, value string").repartition(3)
    lines = deltas.rendered(d)
    assert {(r.file, r.line_no): r.said for r in lines.collect()} == {(f, i): say(v) for f, x in logs.items() for i, v in enumerate(x)}
    for cap in (150, 1000, 600_000):
        got = sorted((r.file, r.first, r.next, r.text, r.clipped) for r in deltas.parts(lines, "file", "line_no", cap=cap).collect())
        assert got == sorted((f, *p) for f, x in logs.items() for p in plain_parts(x, cap))
    cursors = spark.createDataFrame([("f0", 33), ("f1", 9999), ("f2", len(logs["f2"]))], "file string, line long")
    got = sorted((r.file, r.first, r.next, r.text, r.clipped) for r in deltas.parts(lines, "file", "line_no", cap=1000, cursors=cursors).collect())
    start = {"f0": 33, "f1": 0, "f2": len(logs["f2"]), "f3": 0}  # f1's cursor is of a longer log
    assert got == sorted((f, *p) for f, x in logs.items() for p in plain_parts(x, 1000, start[f]))


def test_chain_ends(spark):
    n = 10_000
    long = [(i, i - 1) for i in range(1, n)]
    odd = [(20_000, 20_001), (20_001, 20_002), (20_002, 20_000), (20_003, 20_001), (20_004, 20_004), (20_005, None), (20_006, 20_005), (20_006, 20_007), (None, 3)]
    star = [(30_000 + i, 5000) for i in range(300)]
    got = {r.node: (r.last, r.hops, r.cyclic) for r in graph.chain_ends(spark.createDataFrame(long + odd + star, "node long, next long").repartition(4)).collect()}
    want = {i: (0, i, False) for i in range(1, n)} | {30_000 + i: (0, 5001, False) for i in range(300)}
    want |= {i: (None, None, True) for i in range(20_000, 20_005)} | {20_006: (20_005, 1, False)}
    assert got == want
    assert graph.chain_ends(spark.createDataFrame([], "node long, next long")).count() == 0


def calls():
    rnd = random.Random(9)
    return [(f"k{rnd.randrange(5)}", n, f"2026-01-01 {n // 60 % 24:02}:{n % 60:02}:{rnd.randrange(60):02}") for n in range(0, 900, 7)]


def plain_throttle(rows, seconds):
    last, out = {}, []
    for key, n, at in sorted(rows, key=lambda r: (r[2], r[1])):
        t = time.mktime(time.strptime(at, "%Y-%m-%d %H:%M:%S"))
        if key not in last or t - last[key] >= seconds:
            out.append((key, n))
            last[key] = t
    return sorted(out)


def test_throttle_in_batch(spark):
    d = spark.createDataFrame(calls(), "key string, n long, at string").withColumn("at", F.to_timestamp("at"))
    got = state.throttled(d.repartition(3), "key", "at", 5400, "n").where("admitted")
    assert sorted((r.key, r.n) for r in got.collect()) == plain_throttle(calls(), 5400)


def test_throttle_stream_over_batches_and_expiry(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        rows, got = calls(), []
        source = tmp_path / "calls"
        source.mkdir()
        read = lambda: spark.readStream.schema("key string, n long, at timestamp").json(str(source))
        run = lambda stream, name: exactly_once(stream, str(tmp_path / name), lambda df, _: got.extend((r.key, r.n) for r in df.collect())).awaitTermination()
        for i in range(0, len(rows), 50):
            (source / f"{i}.json").write_text("\n".join(json.dumps({"key": k, "n": n, "at": at.replace(" ", "T")}) for k, n, at in rows[i : i + 50]))
            run(throttle_stream(read(), 5400), "throttle")
        assert sorted(got) == plain_throttle(rows, 5400)
        got.clear()
        for i, wait in ((900, 0), (901, 0), (902, 4)):  # once for each key, until it is forgotten
            time.sleep(wait)
            (source / f"{i}.json").write_text(json.dumps({"key": "k9", "n": i, "at": "2026-01-02T00:00:00"}))
            run(throttle_stream(read().where("key = 'k9'"), 3, once=True), "once")
        assert [n for _, n in got][:1] == [900] and got[-1] == ("k9", 902) and len(got) in (2, 3)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
