"""Codec, store, streaming, jobs, query log, sources."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lexspark.operators import codec, querylog
from lexspark.plans.index import Index
from lexspark.plans.jobs import COMPLETED, FAILED, Jobs, QueryLog
from lexspark.sources import corpus as sources
from lexspark.sources import store
from lexspark.sources.html import from_html
from lexspark.streaming import ingest

DOCS = [(i, f"e{i}", f"https://s.example/{i}", f"t{i}", f"lamp {'red ' * (i % 3)} number{i % 4}") for i in range(12)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, sources.CORPUS)


@pytest.mark.parametrize(
    "pairs,want",
    [([(0, 1), (3, 2), (7, 5), (100, 1), (10000, 3)], "0001030204055d01ac4d03"), ([(0, 0), (127, 127), (255, 128), (4294967295, 1)], "00007f7f8001800180feffff0f01"), ([(0, 1), (1, 1), (2, 1)], "000101010101")],
)
def test_codec(spark, pairs, want):
    df = spark.createDataFrame([("t", *p) for p in pairs], "term string, doc_id bigint, tf bigint")
    block = codec.encode_postings(df)
    assert b"".join(bytes(r.data) for r in sorted(block.collect(), key=lambda r: r.block)).hex() == want
    assert sorted((r.doc_id, r.tf) for r in codec.decode_postings(block).collect()) == pairs


def test_codec_limits():
    assert codec._decode(b"", 3) == [] and codec._decode(b"\x01\x01", 0) == [] and codec._decode(b"\x01\x02\x09", 1) == [(1, 2)]
    with pytest.raises(ValueError):
        codec._decode(b"\x01", 1)
    with pytest.raises(ValueError):
        codec._decode(b"\xff" * 12, 1)


def test_store_grows_and_is_pruned(spark, corpus, tmp_path):
    path = str(tmp_path / "i")
    with pytest.raises(ValueError):
        store.read_manifest(spark, path)
    Index.create(corpus.where("doc_id < 6"), path)
    whole = Index.load(spark, path).append(corpus.where("doc_id >= 6"))
    assert whole.doc_count == 12 and store.versions(spark, path) == [1, 2]
    direct = Index.create(corpus, str(tmp_path / "j"))
    assert whole.search("red lamp")["results"] == direct.search("red lamp")["results"]
    assert whole.search("red lamp")["results"][0]["snippet"]
    plan = whole.postings.where("term = 'red'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,red)" in plan
    more = corpus.withColumn("doc_id", corpus.doc_id + 100)
    store.append_segment(spark, path, more, key="again")
    m, segment = store.append_segment(spark, path, more, key="again")
    assert m.version == 3 and segment.docs == 12 and m.doc_count == 24
    assert {r.term: r.df for r in Index.load(spark, path).dictionary.collect()}["lamp"] == 24


def test_ids_on_append(spark, corpus, tmp_path):
    path = str(tmp_path / "i")
    grown = Index.create(corpus.where("doc_id < 6"), path).append(corpus.where("doc_id >= 6").drop("doc_id"))
    assert sorted((r.doc_id, r.external_id) for r in grown.doc_table.collect()) == [(0, "e0"), (1, "e1"), (2, "e2"), (3, "e3"), (4, "e4"), (5, "e5"), (6, "e10"), (7, "e11"), (8, "e6"), (9, "e7"), (10, "e8"), (11, "e9")]
    for bad in (corpus.where("doc_id = 3"), corpus.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("bigint")), corpus.selectExpr("20L as doc_id", "external_id", "url", "title", "content")):
        with pytest.raises(ValueError):
            grown.append(bad)
    assert store.versions(spark, path) == [1, 2] and len([x for x in os.listdir(path) if x.startswith("segment")]) == 2
    assert grown.append(corpus.limit(0)).doc_count == 12 and Index.create(corpus.limit(0).drop("doc_id"), str(tmp_path / "j")).doc_count == 0


def test_two_streams(spark, corpus, tmp_path):
    pages, path = str(tmp_path / "pages"), str(tmp_path / "i")
    corpus.repartition(2).write.parquet(pages)
    for k in (0, 1):
        ingest.ingest_stream(ingest.read_stream(spark, pages, 1).where(f"doc_id % 2 = {k}"), path, str(tmp_path / f"c{k}")).awaitTermination()
    assert sorted(r.doc_id for r in Index.load(spark, path).doc_table.collect()) == list(range(12))


def test_eight_jobs_at_once(spark, corpus, tmp_path):
    path, jobs = str(tmp_path / "i"), Jobs()
    corpus.cache().count()
    started = [jobs.start(corpus.where(f"doc_id % 4 = {k % 4}").drop("doc_id"), path) for k in range(8)]
    done = [jobs.wait(j) for j in started]
    assert [(j.status, j.error, j.result["documents_written"]) for j in done] == [(COMPLETED, None, 3)] * 8
    assert sorted(j.result["version"] for j in done) == list(range(1, 9))
    index = Index.load(spark, path)
    assert sorted(r.doc_id for r in index.doc_table.collect()) == list(range(24)) and index.doc_count == 24
    corpus.unpersist()


def test_stream_equals_batch(spark, corpus, tmp_path):
    pages, path = str(tmp_path / "pages"), str(tmp_path / "i")
    corpus.repartition(3).write.parquet(pages)
    ingest.ingest_stream(ingest.read_stream(spark, pages, 1), path, str(tmp_path / "c")).awaitTermination()
    got = Index.load(spark, path)
    assert len(store.read_manifest(spark, path).segments) == 3
    assert got.search("red number1")["results"] == Index.create(corpus, str(tmp_path / "j")).search("red number1")["results"]


def test_jobs(spark, corpus, tmp_path):
    jobs = Jobs()
    done = jobs.wait(jobs.start(corpus, str(tmp_path / "i"), "pages", str(tmp_path / "out")))
    assert done.status == COMPLETED and done.result["documents_written"] == 12 and len(done.job_id) == 16
    assert spark.read.json(str(tmp_path / "out")).count() == 12
    bad = jobs.wait(jobs.start(corpus.select("doc_id"), str(tmp_path / "k")))
    assert bad.status == FAILED and bad.error and jobs.get("nope") is None and len(jobs.list()) == 2


def test_query_log(spark):
    log = QueryLog()
    for i in range(110):
        log.record(f"q{i}", 2_000_000, i)
    s = log.stats()
    assert s["total_queries"] == 110 and s["avg_latency_ms"] == 2.0 and len(s["recent"]) == 100 and s["recent"][0]["query"] == "q10"
    t = dt.datetime(2024, 1, 1)
    rows = [(f"q{i}", ns, i, t + dt.timedelta(seconds=i)) for i, ns in enumerate([2_000_000, 3_000_000, 1_000_000, None, -5])]
    df = spark.createDataFrame(rows, "query string, latency_ns bigint, results int, logged_at timestamp")
    one = querylog.log_stats(df).first()
    assert (one.total_queries, one.avg_latency_ms, one.uptime_seconds, one.qps) == (5, 1.2, 4.0, 1.25)
    assert [r.query for r in querylog.recent(df, 2).collect()] == ["q3", "q4"]
    assert querylog.log_stats(df.limit(0)).first().qps == 0


def test_sources(spark, corpus, tmp_path):
    path = str(tmp_path / "x")
    sources.write_jsonl(corpus, path)
    assert sorted(sources.read_jsonl(spark, path).collect()) == sorted(corpus.collect())
    ids = sources.with_doc_ids(corpus.repartition(3), 100).orderBy("doc_id").collect()
    assert [r.doc_id for r in ids] == list(range(100, 112)) and [r.external_id for r in ids] == sorted(r.external_id for r in ids)


def test_html(spark):
    rows = ["<html><head><title> A &amp; B </title><style>x</style></head><body><p>One<br>two</p><script>var s = '</p>';</script><!-- <p>no</p> -->\n&lt;three&gt; &amp;amp;\u00a0four</body>", "no tags", "", None, "<title></title><p>x"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(rows)], "doc_id int, html string")
    got = [(r.title, r.content) for r in from_html(df).orderBy("doc_id").collect()]
    assert got == [("A & B", "One two <three> &amp; four"), (None, "no tags"), (None, ""), (None, None), (None, "x")]
