"""The search index as one handle over its tables."""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.porter import stem_each
from lexspark.functions.scoring import BM25Params, bm25_score
from lexspark.functions.snippet import snippet
from lexspark.functions.text import tokenize_nostem
from lexspark.operators import build, evaluate, search
from lexspark.sources import store


class SearchCache:
    """The least recently used results go first; what it holds is small, ranked and already on the driver."""

    def __init__(self, capacity: int = 128):
        self.capacity = capacity if capacity > 0 else 128
        self.items: OrderedDict[tuple, Any] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: tuple) -> Any | None:
        if key not in self.items:
            self.misses += 1
            return None
        self.hits += 1
        self.items.move_to_end(key)
        return self.items[key]

    def put(self, key: tuple, value: Any) -> None:
        self.items[key] = value
        self.items.move_to_end(key)
        while len(self.items) > self.capacity:
            self.items.popitem(last=False)

    def invalidate(self) -> None:
        """Forgets the results; the counters go on."""
        self.items.clear()

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"size": len(self.items), "capacity": self.capacity, "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}


class Index:
    """An index of one version. Its tables are DataFrames; nothing is collected but results of a query."""

    def __init__(
        self, spark: SparkSession, post: DataFrame, doc_table: DataFrame, contents: DataFrame, doc_count: int, total_length: int, version: int = 0, path: str | None = None, terms: DataFrame | None = None, cache: int = 128
    ):
        self.spark, self.postings, self.doc_table, self.contents = spark, post, doc_table, contents
        self.segment_terms = terms  # term, df of each segment, where the index is a stored one
        self.doc_count, self.total_length, self.version, self.path = doc_count, total_length, version, path
        self.avgdl = total_length / doc_count if doc_count else 0.0
        self.cache = SearchCache(cache)

    @classmethod
    def from_corpus(cls, corpus: DataFrame) -> Index:
        """An index that is worked out anew in every query; ``save`` it to keep it."""
        docs = build.document_table(corpus)
        n, length, _ = build.corpus_stats(docs).first()
        return cls(corpus.sparkSession, build.postings(corpus), docs, corpus.select("doc_id", "content"), n, length)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> Index:
        m = store.read_manifest(spark, path, version)
        post, docs, contents, terms = (store.read_table(spark, path, m, t) for t in ("postings", "doc_table", "contents", "terms"))
        return cls(spark, post, docs, contents, m.doc_count, m.total_length, m.version, path, terms)

    @classmethod
    def create(cls, corpus: DataFrame, path: str) -> Index:
        """Builds, saves and loads."""
        store.append_segment(corpus.sparkSession, path, corpus)
        return cls.load(corpus.sparkSession, path)

    def append(self, corpus: DataFrame) -> Index:
        """The next version, with ``corpus`` added. Without a column doc_id it gets the ids after the highest; an id that is in already is refused."""
        if self.path is None:
            raise ValueError("only a saved index can be extended")
        store.append_segment(self.spark, self.path, corpus)
        return Index.load(self.spark, self.path)

    @property
    def dictionary(self) -> DataFrame:
        """``term, df``: of a stored index the segments' counts put together, else counted."""
        return self._dictionary()

    def _dictionary(self, wanted: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """The dictionary of the rows that ``wanted`` leaves of it."""
        if self.segment_terms is None:
            return build.dictionary(wanted(self.postings))
        return wanted(self.segment_terms).groupBy("term").agg(F.sum("df").alias("df"))

    def health(self) -> dict[str, str]:
        return {"status": "ok", "service": "lexspark"}

    def stats(self) -> DataFrame:
        return build.index_stats(self.dictionary, self.doc_table)

    def terms(self) -> DataFrame:
        return self.dictionary.select("term")

    def doc_meta(self, doc_id: int) -> DataFrame:
        """The document's row; none if unknown."""
        return self.doc_table.where(F.col("doc_id") == doc_id)

    def doc_content(self, doc_id: int) -> DataFrame:
        return self.contents.where(F.col("doc_id") == doc_id).select("doc_id", F.coalesce("content", F.lit("")).alias("content"))

    def postings_by_term(self, term: str) -> DataFrame:
        """The list of an exact, already stemmed term."""
        return self.postings.where(F.col("term") == term).select("doc_id", "tf")

    def postings_of(self, token: str) -> DataFrame:
        """The list of the first term that the raw ``token`` gives; none for a stopword or an unknown word."""
        terms = self._terms(token)
        return self.postings_by_term(terms[0]) if terms else self.postings.limit(0).select("doc_id", "tf")

    def _terms(self, query: str) -> list[str]:
        """The query's terms in their order, repeats kept. Spark works them out while it plans: no job is run."""
        rows = self.spark.sql("SELECT * FROM VALUES (:q) AS t(q)", args={"q": query})
        return rows.select(stem_each(tokenize_nostem("q")).alias("terms")).collect()[0]["terms"] or []

    def rank_batch(self, queries: DataFrame, k: int = 10, mode: str = "or", params: BM25Params = BM25Params(), scorer: str = "bm25") -> DataFrame:
        """``query_id, rank, doc_id, score, total_hits`` for ``query_id, query``, in one plan.

        Only postings of the queries' terms are read; df comes from the dictionary.
        """
        terms = search.query_terms(queries)
        wanted = terms.select("term").distinct()
        post = self.postings.join(wanted, "term", "left_semi")
        df = self._dictionary(lambda rows: rows.join(wanted, "term", "left_semi"))
        scored = search.score(terms, post, df, self.doc_count, self.avgdl, params, scorer)
        return search.rank(scored, terms, k, mode)

    def search_batch(self, queries: DataFrame, k: int = 10, mode: str = "or", window: int = 200) -> DataFrame:
        """Ranked results with ``external_id, url, title, snippet``; texts are read for ranked documents only."""
        ranked = self.rank_batch(queries, k, mode)
        words = queries.select("query_id", tokenize_nostem("query").alias("words"))
        rows = ranked.join(self.doc_table.select("doc_id", "external_id", "url", "title"), "doc_id").join(self.contents, "doc_id", "left").join(words, "query_id")
        return rows.select("query_id", "rank", "doc_id", "external_id", "url", "title", "score", snippet("content", F.col("words"), window).alias("snippet"), "total_hits")

    def search(self, query: str, k: int = 10, mode: str = "or") -> dict[str, Any]:
        """The response to one query: ``query, results, total_hits, time_taken_ms, cache_hit``.

        What the cache holds costs no job. Else the query's terms are pushed to the scans of the term-sorted
        dictionary and postings as literals, and the ranked ids to those of documents and texts: three jobs.
        """
        began = time.perf_counter()
        if mode not in search.MODES:
            raise ValueError("mode must be 'or' or 'and'")
        k = k if k and k > 0 else 10
        out = {"query": query, "results": [], "total_hits": 0, "cache_hit": False}
        if query:
            key = (query, k, mode, self.version)
            kept = self.cache.get(key)
            out["cache_hit"] = kept is not None
            if kept is None and (terms := self._terms(query)):
                kept = self._search(list(enumerate(terms)), query, k, mode)
                self.cache.put(key, kept)
            if kept is not None:
                out["results"], out["total_hits"] = [dict(r) for r in kept[0]], kept[1]
        out["time_taken_ms"] = (time.perf_counter() - began) * 1000
        return out

    def _search(self, terms: list[tuple[int, str]], query: str, k: int, mode: str) -> tuple[list[dict[str, Any]], int]:
        """The results and the number of hits. Terms and their idf, as many as the query has, are literals."""
        places: dict[str, list[int]] = {}
        for pos, term in terms:
            places.setdefault(term, []).append(pos)
        post = self.postings.where(F.col("term").isin(list(places)))
        df = {r["term"]: r["df"] for r in self._dictionary(lambda rows: rows.where(F.col("term").isin(list(places)))).collect()}
        if not df:
            return [], 0
        per_term = F.create_map(*[x for t in df for x in (F.lit(t), F.struct(F.lit(df[t]).alias("df"), F.array(*map(F.lit, places[t])).alias("pos")))])
        hit = post.withColumn("q", F.element_at(per_term, F.col("term")))
        value = bm25_score("tf", F.col("q.df"), "doc_len", F.lit(self.avgdl), F.lit(self.doc_count))
        parts = hit.select("doc_id", value.alias("s"), F.explode("q.pos").alias("pos")).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "s")).alias("parts"))
        if mode == "and":
            parts = parts.where(F.size("parts") >= len(terms))
        seen = Observation()
        scored = parts.select("doc_id", F.aggregate(F.array_sort("parts"), F.lit(0.0), lambda a, x: a + x["s"]).alias("score"))
        top = scored.observe(seen, F.count(F.lit(1)).alias("n")).orderBy(F.desc("score"), F.asc("doc_id")).limit(k).collect()
        if not top:
            return [], 0
        ids = [r["doc_id"] for r in top]  # at most k: they go to both scans as literals
        texts = self.contents.where(F.col("doc_id").isin(ids)).select("doc_id", snippet("content", tokenize_nostem(F.lit(query))).alias("snippet"))
        rows = self.doc_table.where(F.col("doc_id").isin(ids)).select("doc_id", "external_id", "url", "title").join(F.broadcast(texts), "doc_id", "left")
        meta = {r["doc_id"]: r for r in rows.collect()}
        results = [
            {"doc_id": r["doc_id"], "external_id": m["external_id"], "url": m["url"], "title": m["title"], "score": r["score"], "snippet": m["snippet"] or ""}
            for r in top if (m := meta.get(r["doc_id"]))
        ]
        return results, seen.get["n"]

    def search_json(self, query: str, k: int = 10, mode: str = "or") -> str:
        """The response in JSON; NaN never occurs in it."""
        return json.dumps(self.search(query, k, mode), ensure_ascii=False, allow_nan=False)

    def evaluate(self, judgments: DataFrame, k: int = 10, params: BM25Params = BM25Params()) -> DataFrame:
        """Precision at k and recall of every judgment (``query, relevant_urls``), each row a query of its own.

        Queries are told apart by a hash of the row's place, so equal judgments stay separate rows.
        """
        rows = judgments.withColumn("query_id", F.monotonically_increasing_id()) if "query_id" not in judgments.columns else judgments
        rows = rows.select("query_id", "query", "relevant_urls")
        ranked = self.rank_batch(rows.where("query is not null").select("query_id", "query"), k, "or", params)
        results = ranked.join(self.doc_table.select("doc_id", "url"), "doc_id")
        return evaluate.per_query(rows, results.select("query_id", "url"), k)
