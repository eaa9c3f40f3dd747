"""Ranking against a plain-Python model, on a corpus small enough to read."""

import json
import math
import time

import pytest
from pyspark.sql import functions as F

from lexspark.functions.scoring import BM25Params, bm25_idf, bm25_score, tfidf_score
from lexspark.plans.index import Index, SearchCache

DOCS = [
    (0, "e0", "https://a.example/0", "Red", "red red lamp. The lamp is old, the lamp is red."),
    (1, "e1", "https://a.example/1", "Lamp", "lamp shop"),
    (2, "e2", "https://b.example/2", None, "lamp shop"),
    (3, "e3", None, "", ""),
    (4, "e4", "https://b.example/4", "Null", None),
    (5, "e5", "https://b.example/4", "Blue", "blue shop with a blue door and one lamp"),
]
TOKENS = {0: "red red lamp lamp old lamp red", 1: "lamp shop", 2: "lamp shop", 3: "", 4: "", 5: "blue shop blue door one lamp"}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, external_id string, url string, title string, content string")


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    return Index.create(corpus, str(tmp_path_factory.mktemp("index") / "i"))


def model(query, k=10, mode="or"):
    docs = {d: t.split() for d, t in TOKENS.items()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    scores, hits = {}, {}
    for term in query.split():
        df = sum(term in t for t in docs.values())
        for d, t in docs.items():
            if tf := t.count(term):
                idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
                scores[d] = scores.get(d, 0.0) + idf * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * (len(t) / avg))))
                hits[d] = hits.get(d, 0) + 1
    if mode == "and":
        scores = {d: s for d, s in scores.items() if hits[d] >= len(query.split())}
    ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    return ranked[:k], len(ranked)


@pytest.mark.parametrize("query,k,mode", [("lamp", 10, "or"), ("red lamp", 2, "or"), ("shop lamp", 10, "and"), ("lamp lamp", 10, "and"), ("lamp zzz", 10, "and"), ("blue red door", 10, "or"), ("lamp", 0, "or")])
def test_search_equals_model(index, query, k, mode):
    want, total = model(query, k or 10, mode)
    got = index.search(query, k, mode)
    assert [r["doc_id"] for r in got["results"]] == [d for d, _ in want] and got["total_hits"] == total
    assert [r["score"] for r in got["results"]] == pytest.approx([s for _, s in want], abs=1e-12)


def test_equal_documents_tie_by_id(index):
    got = [(r["doc_id"], r["score"]) for r in index.search("shop")["results"]]
    assert got[0][0] == 1 and got[1][0] == 2 and got[0][1] == got[1][1]


def test_batch_equals_single(index, spark):
    queries = ["red lamp", "shop", "the of", "lamp lamp"]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id bigint, query string")
    rows = index.search_batch(q, 10, "or").collect()
    for i, text in enumerate(queries):
        one = index.search(text)
        mine = sorted((r for r in rows if r.query_id == i), key=lambda r: r["rank"])
        assert [(r.doc_id, r.score, r.snippet) for r in mine] == [(r["doc_id"], r["score"], r["snippet"]) for r in one["results"]]


def test_empty_and_bad_queries(index):
    assert index.search("")["results"] == [] and index.search("the is")["total_hits"] == 0
    with pytest.raises(ValueError):
        index.search("lamp", mode="xor")


def test_cache_and_version(index, corpus):
    first, again = index.search("old door"), index.search("old door")
    assert not first["cache_hit"] and again["cache_hit"] and first["results"] == again["results"]
    more = corpus.sparkSession.createDataFrame([(9, "e9", "u", "t", "old old door")], corpus.schema)
    grown = index.append(more)
    assert grown.version == index.version + 1 and grown.search("old door")["results"][0]["doc_id"] == 9
    assert index.doc_count == 6 and grown.doc_count == 7
    assert Index.load(corpus.sparkSession, index.path, index.version).search("old door")["total_hits"] == first["total_hits"]


def test_lookups(index):
    assert index.doc_meta(0).first().length == 7 and index.doc_meta(99).count() == 0
    assert index.doc_content(4).first().content == ""
    assert {(r.doc_id, r.tf) for r in index.postings_of("Lamps").collect()} == {(0, 3), (1, 1), (2, 1), (5, 1)}
    assert index.postings_of("the").count() == 0
    stats = index.stats().first()
    assert (stats.term_count, stats.doc_count, stats.total_postings) == (7, 6, 3 + 2 + 2 + 5)


def test_lru():
    cache = SearchCache(2)
    for k in "ab":
        cache.put((k,), k)
    assert cache.get(("a",)) == "a"
    cache.put(("c",), "c")
    assert cache.get(("b",)) is None and cache.get(("a",)) == "a"
    cache.invalidate()
    assert cache.stats() == {"size": 0, "capacity": 2, "hits": 2, "misses": 1, "hit_rate": 2 / 3}


def test_scores(spark):
    row = spark.range(1).select(
        bm25_score(F.lit(5), F.lit(10), F.lit(100), F.lit(100), F.lit(1000)), bm25_score(F.lit(0), F.lit(10), F.lit(100), F.lit(100), F.lit(1000)), bm25_score(F.lit(5), F.lit(10), F.lit(100), F.lit(0), F.lit(1000)),
        bm25_idf(F.lit(0), F.lit(5)), tfidf_score(F.lit(5), F.lit(10), F.lit(100), F.lit(1000)), tfidf_score(F.lit(5), F.lit(1000), F.lit(100), F.lit(1000)), tfidf_score(F.lit(5), F.lit(1), F.lit(0), F.lit(1000)),
    ).first()
    assert list(row) == pytest.approx([8.085673345753094, 0, 0, 0, 0.1, 0, 0])
    assert BM25Params() == BM25Params(1.2, 0.75)


def test_evaluate(index, spark):
    rows = [("red lamp", ["https://a.example/0", "https://a.example/0", "nope"]), ("red lamp", []), ("shop", None), (None, ["x"]), ("shop", ["https://b.example/4"])]
    j = spark.createDataFrame(rows, "query string, relevant_urls array<string>")
    got = sorted((r.query or "", r.total_relevant, r.hits, r.precision_at_k, round(r.recall, 6)) for r in index.evaluate(j, 10).collect())
    assert got == [("", 1, 0, 0.0, 0.0), ("red lamp", 0, 0, 0.0, 0.0), ("red lamp", 3, 1, 0.1, 0.333333), ("shop", 0, 0, 0.0, 0.0), ("shop", 1, 1, 0.1, 1.0)]
    assert index.evaluate(j.limit(0), 10).count() == 0


# The four documents of FIXTURES A2 and what part B derives for them.
FOUR = [
    (0, "sha0", "https://go.dev", "The Go Programming Language", "Go is a programming language designed at Google. Go is fast. Go is concurrent. Go Go Go."),
    (1, "sha1", "https://example.com/programming", "Programming Basics", "Programming is the process of creating instructions for computers. Programming requires logic."),
    (2, "sha2", "https://go.dev/concurrency", "Go Concurrency Patterns", "Go provides goroutines and channels for concurrent programming. Concurrency is not parallelism."),
    (3, "sha3", "https://example.com/cooking", "Best Pasta Recipes", "Pasta is a traditional Italian food. Cook pasta in boiling water with salt."),
]
GOLDEN = [
    ("Go", "or", {0: 1.225237362, 2: 0.733708459}),
    ("Go programming", "or", {0: 1.543236709, 2: 1.111255149, 1: 0.509804046}),
    ("Go programming", "and", {0: 1.543236709, 2: 1.111255149}),
    ("Go pasta", "or", {3: 1.668142745, 0: 1.225237362, 2: 0.733708459}),
    ("Go Go", "or", {0: 2.450474723, 2: 1.467416918}),
    ("Go concurrent programming", "or", {0: 2.161223352, 2: 2.101987027, 1: 0.509804046}),
    ("Go fast concurrent", "or", {0: 2.916645541, 2: 1.724440338}),
    ("Go zzz", "and", {}),
    ("the a is", "or", {}),
]


def test_scores_of_four_documents(spark, corpus, tmp_path):
    index = Index.create(spark.createDataFrame(FOUR, corpus.schema), str(tmp_path / "i"))
    assert index.avgdl == 9.25 and tuple(index.stats().first()) == (25, 4, 29)
    for query, mode, want in GOLDEN:
        got = index.search(query, mode=mode)["results"]
        assert [r["doc_id"] for r in got] == list(want) and [r["score"] for r in got] == pytest.approx(list(want.values()), abs=1e-9)
    told = json.loads(index.search_json("Go pasta"))
    assert told["total_hits"] == 3 and [r["doc_id"] for r in told["results"]] == [3, 0, 2] and told["results"][0]["snippet"].startswith("<mark>Pasta</mark>")


def test_jobs_of_a_search(index, spark):
    """A hit in the cache runs no job at all, a search three at most; terms are stemmed without one."""
    tracker = spark.sparkContext.statusTracker()

    def jobs(query):
        spark.sparkContext.setJobGroup(group := f"g-{query}-{time.time()}", "")
        index.search(query)
        return len(tracker.getJobIdsForGroup(group))

    assert index._terms("Red lamps, the shops") == ["red", "lamp", "shop"]
    first, again, none = jobs("shop lamp blue"), jobs("shop lamp blue"), jobs("the of")
    assert again == none == 0 and first <= 6  # adaptive execution runs the stages of one query as jobs
    began = time.perf_counter()
    assert index.search("shop lamp blue")["cache_hit"] and time.perf_counter() - began < 0.01
