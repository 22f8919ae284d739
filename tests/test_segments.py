"""The segmented index against scans: refreshes, merges, tombstones, pruning, other analysers, concurrent writers."""

import os
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.api import Engine
from mnemospark.config import EngineConfig
from mnemospark.operators import bm25, lexical, segments
from mnemospark.sources import manifest

QUERY = "license version onre thble apache"
WORDS = ["license", "apache", "onre"]


def plain(df):
    return sorted((r[0], r.line, r.end_line, round(r.score, 3), tuple(r.matched_terms)) for r in df.collect())


def ranked(df):
    return [tuple(r) for r in df.collect()]


def scanned(pages, terms):
    return [(r.source, r.grp, r.score) for r in bm25.bm25(pages, terms, "source", "text", ["grp"]).collect()]


def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("source"), "text", F.col("source").alias("grp"))


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)


def agree(index, pages, ranked_too=False):
    """Searches over the segments say what a scan of the pages says."""
    assert plain(index.search(QUERY, 20)) == plain(lexical.search(pages, QUERY, 20))
    want = sorted(scanned(pages, WORDS), key=lambda r: (-r[2], r[0]))
    assert sorted(ranked(index.bm25(WORDS))) == sorted(want)
    totals = pages.agg(F.count(F.lit(1)).alias("docs"), F.count("text").alias("texts"), F.count_if(F.trim("text") != "").alias("some")).first().asDict()
    assert {k: index.state["totals"][k] for k in totals} == totals
    if not ranked_too:
        return
    assert plain(index.scored_windows(QUERY)) == plain(lexical.scored_windows(pages, QUERY))
    assert plain(index.search(QUERY, 10, 2)) == plain(lexical.search(pages, QUERY, 10, 2))
    assert ranked(index.bm25(WORDS, 10)) == want[:10]
    best = {}
    for page, grp, score in want:
        best.setdefault(grp, (page, grp, score))
    assert ranked(index.bm25(WORDS, 3, by_group=True)) == sorted(best.values(), key=lambda r: (-r[2], r[1]))[:3]
    words = pages.select("source", F.explode(segments.T.tokens(F.col("text"))).alias("term")).distinct().groupBy("term").count()
    assert {r.term: r.df for r in index.terms().collect()} == {r.term: r["count"] for r in words.collect()}


def test_refreshes_and_merges_find_what_a_scan_finds(spark, tmp_path):
    pages = documents(spark)
    folder = str(tmp_path / "index")
    known = pages.where("source % 3 <> 0").withColumn("text", F.when(F.col("source") % 5 == 0, F.concat(F.lit("apache "), "text")).otherwise(F.col("text")))
    index = segments.Index(spark, folder)
    first = index.refresh(known, group="grp").first()
    assert (first.indexed, first.changed, first.removed) == (known.count(), known.count(), 0)
    counts = index.refresh(pages, group="grp").first()
    assert counts.indexed == pages.count() and counts.changed > 0 and counts.removed == 0
    agree(index, pages, ranked_too=True)
    fewer = pages.where("source % 4 <> 1")
    assert index.refresh(fewer, group="grp").first().removed == pages.count() - fewer.count()
    again = segments.Index(spark, folder)  # by another reader
    assert again.version == 3 and len(again.state["segments"]) == 3
    assert again.merge(last=2) == 2  # the last two; their tombstones still hold for the first
    agree(again, fewer)
    assert again.merge(like=1000) == 2 and len(again.state["segments"]) == 1 and not again.state["segments"][0]["dead"]
    agree(segments.Index(spark, folder), fewer, ranked_too=True)
    assert again.merge() == 0
    scope = fewer.where("source < 60")
    assert plain(again.search(QUERY, 5, 2, scope=scope.select(F.col("source").alias("page")))) == plain(lexical.search(scope, QUERY, 5, 2))
    assert again.search("the of and").count() == 0 and again.search("nothing-has-this-word").count() == 0 and again.bm25(["nothinghasthis"], 5).count() == 0


def test_a_refresh_writes_its_changes_alone(spark, tmp_path):
    pages = documents(spark)
    index = segments.Index(spark, str(tmp_path / "index"))
    index.refresh(pages)
    whole = size(tmp_path)
    changed = pages.withColumn("text", F.when(F.col("source") == 7, F.lit("zebra quokka")).otherwise(F.col("text")))
    counts = index.refresh(changed).first()
    assert (counts.indexed, counts.changed, counts.removed) == (pages.count(), 1, 0)
    second = index.state["segments"][1]["id"]
    assert size(tmp_path) - whole < 0.05 * whole and index.state["segments"][1]["pages"] == 1
    rows = lambda name: spark.read.parquet(f"{tmp_path}/index/segments/{second}/{name}")
    assert {r.page for r in rows("pages").collect()} == {7}
    assert {p for r in rows("blocks").collect() for p in r.pages} == {7}
    assert [(r.page, r.line) for r in index.search("zebra").collect()] == [(7, 1)]
    assert index.refresh(changed).first().changed == 0


def test_blocks_that_cannot_reach_the_floor_go_unread(spark, tmp_path):
    rnd = random.Random(7)
    rows = []
    for i in range(6000):
        rare = ["apache"] * rnd.choice([1, 1, 1, 2]) if rnd.random() < 0.5 else []
        rows.append((i, " ".join(["license"] * rnd.choice([1, 1, 2, 3]) + rare + [f"w{rnd.randrange(500)}" for _ in range(rnd.randint(20, 60))]), f"g{i % 9}"))
    rows += [(10_000 + i, "apache apache apache license onre short", "g1") for i in range(8)]
    pages = spark.createDataFrame(rows, "source long, text string, grp string").repartition(3)
    index = segments.Index(spark, str(tmp_path / "index"))
    index.refresh(pages, group="grp")
    want = sorted(scanned(pages, WORDS), key=lambda r: (-r[2], r[0]))
    assert ranked(index.bm25(WORDS, 5)) == want[:5]
    assert 0 < index.blocks_read < index.blocks_met / 4
    assert plain(index.search("license apache onre", 5)) == plain(lexical.search(pages, "license apache onre", 5))
    assert 0 < index.blocks_read < index.blocks_met / 4


def test_odd_pages_and_keys(spark, tmp_path):
    rows = [("a", None, "g"), ("b", "", "g"), ("c", "  \n ", None), ("d", "Ünïcode ﬁne strasse Straße\x1cnext line", "g"), ("e", "मराठी words.here -x- a", "h"), (None, "no key", "h"), ("f", "word " * 5000 + "\nlast", "h")]
    pages = spark.createDataFrame(rows, "source string, text string, grp string")
    index = segments.Index(spark, str(tmp_path / "index"))
    index.refresh(pages, group="grp")
    assert [r.page for r in index.search("strasse").collect()] == ["d"] and [r.page for r in index.search("fine").collect()] == ["d"]
    assert [(r.page, r.line) for r in index.search("last").collect()] == [("f", 1)]
    assert index.state["totals"]["docs"] == 6 and index.state["totals"]["texts"] == 5 and index.state["totals"]["some"] == 4
    empty = segments.Index(spark, str(tmp_path / "empty"))
    empty.refresh(pages.limit(0))
    assert empty.search("word").count() == 0 and empty.bm25(["word"], 3).count() == 0 and empty.terms().count() == 0
    empty.refresh(pages, group="grp")
    assert [r.page for r in empty.search("fine").collect()] == ["d"]
    with pytest.raises(FileNotFoundError):
        segments.Index(spark, str(tmp_path / "none")).search("word")


def test_another_analyser_is_refused(spark, tmp_path):
    segments.Index(spark, str(tmp_path)).refresh(documents(spark).limit(5))
    with pytest.raises(segments.OtherAnalyser):
        segments.Index(spark, str(tmp_path), EngineConfig(stop_words=("license",)))


def test_of_two_writers_one_wins(spark, tmp_path):
    pages = documents(spark).limit(6)
    segments.Index(spark, str(tmp_path)).refresh(pages)
    one, two = segments.Index(spark, str(tmp_path)), segments.Index(spark, str(tmp_path))
    one.refresh(pages.limit(3))
    with pytest.raises(manifest.Conflict):
        two.refresh(pages.limit(4))
    assert segments.Index(spark, str(tmp_path)).state["totals"]["docs"] == 3
    assert manifest.versions(spark, f"{tmp_path}/manifest") == [1, 2]


def test_the_engine_searches_its_index(spark, tmp_path):
    pages = documents(spark).withColumn("kind", F.lit("knowledge")).drop("grp")
    index = segments.Index(spark, str(tmp_path))
    index.refresh(pages, kind="kind")
    assert Engine(pages, index=index).search(QUERY, 7) == Engine(pages).search(QUERY, 7)
    long = "license version onre thble apache " + " ".join(f"w{i}" for i in range(10))
    config = EngineConfig(span_discount=0.84)
    assert plain(segments.Index(spark, str(tmp_path), config).search(long, 7)) == plain(lexical.search(pages, long, 7, kind="kind", config=config))

def test_a_bucket_of_terms_is_one_row_of_a_stripe(spark, tmp_path):
    """Rows grow with stripes and buckets, not with terms; no posting is shuffled."""
    pages = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(300)) + " apache") for i in range(200)], "source long, text string").coalesce(1)
    index = segments.Index(spark, str(tmp_path / "index"))
    index.refresh(pages)
    blocks = spark.read.parquet(f"{tmp_path}/index/segments/{index.state['segments'][0]['id']}/blocks")
    stripes = blocks.select("stripe").distinct().count()
    assert blocks.count() <= stripes * 2 * segments.BUCKETS and index.terms().count() == 200 * 300 + 1
    assert {r.page for r in index.search("w7x5 w8x299", 5).collect()} == {7, 8} and index.bm25(["apache"]).count() == 200


def test_scans_of_blocks_hold_small_row_groups(spark, tmp_path, monkeypatch):
    """However large a task's file of blocks is, a row group of it is small, and a Parquet page holds few buckets."""
    import pyarrow.parquet as pq

    rnd = random.Random(5)
    monkeypatch.setattr(segments, "SMALL_BYTES", 0)  # pages are read as they lie
    pages = spark.range(9000).select(F.col("id").alias("source"), F.concat_ws(" ", F.lit("apache"), *[F.concat(F.lit(f"t{i}x"), F.xxhash64("id", F.lit(i)) % rnd.choice([40, 4_000, 4_000_000])) for i in range(120)]).alias("text"))
    index = segments.Index(spark, str(tmp_path / "index"))
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        index.refresh(pages.coalesce(1))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    (file,) = (tmp_path / "index/segments" / index.state["segments"][0]["id"] / "blocks").glob("*.parquet")
    found = pq.ParquetFile(file).metadata
    groups = [found.row_group(i) for i in range(found.num_row_groups)]
    encoded = [sum(g.column(i).total_uncompressed_size for i in range(g.num_columns)) for g in groups]
    assert len(groups) > 1 and sum(encoded) > 16 << 20 and max(encoded) <= 16 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"  # as it was
    assert index.terms().where("term = 'apache'").first().df == 9000


def test_a_task_of_blocks_holds_numbers_and_little_of_a_batch(monkeypatch):
    """Entries of a stripe are kept as numbers, not as texts; stripes end inside batches; all postings come out."""
    import json
    import tracemalloc

    import pyarrow as pa

    names = ["field", "bucket", "stripe", "terms", "starts", "sizes", "tops", "leasts", "pages", "tfs", "lengths"]
    at = {f"w{i}": i if i % 3 else [i, 2, i + 40, 1] for i in range(500)}
    full = {f"w{i}": 1 + i % 4 for i in range(500)}
    n = 900
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([700] * n), pa.array([90] * n, pa.int32()), pa.array([json.dumps(at)] * n), pa.array([json.dumps(full)] * n)], names=["page", "n", "least", "lexical", "full"])
    monkeypatch.setattr(segments, "STRIPE_ENTRIES", 350_000)
    tracemalloc.start()
    got = list(segments._blocks(names)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20 and len({x for b in got for x in b.column(2).to_pylist()}) == 3
    for field, length, tf in ((0, 90, lambda i: 1 if i % 3 else 3 if i + 40 < 32 else 2), (1, 700, lambda i: 1 + i % 4)):
        rows = [r for b in got for r in b.to_pylist() if r["field"] == field]
        seen = {}
        for r in rows:
            assert len(r["pages"]) == len(r["tfs"]) == sum(r["sizes"]) and set(r["lengths"]) == {length}
            for term, start, k, top in zip(r["terms"], r["starts"], r["sizes"], r["tops"], strict=True):
                assert segments.bucket(term) == r["bucket"] and top == max(r["tfs"][start : start + k])
                assert set(r["tfs"][start : start + k]) == {tf(int(term[1:]))}
                seen.setdefault(term, []).extend(r["pages"][start : start + k])
        assert len(seen) == 500 and all(sorted(x) == list(range(n)) for x in seen.values())


def test_words_of_a_text_are_those_of_its_json(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("ab_.-é /म\n\x1c7") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    terms = ["a", "ab", "b", "a.b", "a-b", "7", "a_b", "é", "म", "7a", "bb"]
    read = [segments._read(t, frozenset()) for t in texts]
    for text, (words, at, full) in zip(texts, read, strict=True):
        folded = segments.fold(text)
        assert full == segments.Counter(segments.ALNUM.findall(folded))
        own = [segments.search_words(x, frozenset()) for x in folded.splitlines()]
        assert words == [len(x) for x in own] and set(at) == {w for x in own for w in x}
        for w, lines in at.items():
            pairs = [(lines, 1)] if isinstance(lines, int) else list(zip(lines[::2], lines[1::2], strict=True))
            assert pairs == [(i, x.count(w)) for i, x in enumerate(own) if w in x]
            assert isinstance(lines, int) or len(lines) > 2 or lines[1] > 1
    df = spark.createDataFrame([(i, segments._json(at), segments._json(full)) for i, (_, at, full) in enumerate(read)], "i int, lexical string, full string")
    for r in df.select("i", *[segments._value(c, t).alias(f"{c} {t}") for c in ("lexical", "full") for t in terms]).collect():
        _, at, full = read[r.i]
        for t in terms:
            assert (r[f"lexical {t}"] and segments.json.loads(r[f"lexical {t}"])) == at.get(t) and r[f"full {t}"] == (str(full[t]) if t in full else None)


def test_words_and_peaks_are_those_of_the_plain_rules():
    rnd = random.Random(3)
    for _ in range(3000):
        text = "".join(rnd.choice("ab_.-é /म") for _ in range(rnd.randint(0, 14)))
        assert segments.search_words(text, frozenset()) == [w for x in segments.re.findall(r"[\w.-]+", text) if len(w := x.strip(".-")) > 1]
        lines = [x for i in sorted(rnd.sample(range(90), rnd.randint(1, 9))) for x in (i, rnd.randint(1, 3))]
        pairs = list(zip(lines[::2], lines[1::2], strict=True))
        assert segments._peak(lines) == max(sum(n for i, n in pairs if 24 * k <= i < 24 * k + 32) for k in range(4))
