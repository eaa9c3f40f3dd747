"""The engine's queries over the test tables, and the SQL that tells the same rows."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.porter import stem_sql
from lexspark.functions.scoring import bm25_idf, bm25_score, tfidf_score
from lexspark.functions.snippet import highlight, snippet
from lexspark.functions.text import STOPWORDS, normalize, tokenize_nostem, tokenize_raw
from lexspark.operators import build, codec, evaluate, querylog
from lexspark.plans.index import Index
from lexspark.plans.jobs import Jobs, QueryLog
from lexspark.session import checkpoint_dir
from lexspark.sources import corpus as sources
from lexspark.sources import store
from lexspark.sources.html import ENTITIES, from_html
from lexspark.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return sources.read_pages(spark, f"{d}/corpus.parquet")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


#: Indexes built by this process: one for each session and state of the data.
_BUILT: dict[tuple, str] = {}


def _index(spark: SparkSession, d: str) -> Index:
    """The index, built and saved as a user would have it; queries of one session over the same data share it."""
    fs, p = store.file_system(spark, f"{d}/corpus.parquet")
    status = fs.getFileStatus(p)
    key = (spark.sparkContext.applicationId, d, status.getModificationTime(), status.getLen())
    if key not in _BUILT or not store.versions(spark, _BUILT[key]):  # the shared folder may have been cleared since
        path = f"{_folder(spark)}/index"
        Index.create(_corpus(spark, d), path)
        _BUILT[key] = path
    return Index.load(spark, _BUILT[key])


def _folder(spark: SparkSession) -> str:
    """A new folder where all executors can write, removed when Python ends: what a query returns is read from it until then."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/lexspark-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop

    def drop() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone, and the whole folder with it
            p = hadoop.fs.Path(path)
            p.getFileSystem(hadoop.conf.Configuration()).delete(p, True)

    atexit.register(drop)
    return path


def _joined(name: str, tokens: Callable) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _documents(spark, d).select("doc_id", F.array_join(tokens("text"), " ").alias("tokens"))

    run.__name__ = name
    return run


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    rows = docs.select("doc_id", F.posexplode(tokenize_nostem("text")).alias("pos", "token"))
    stemmed = rows.join(build.stem_vocabulary(rows), "token")
    lists = stemmed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("l"))
    return lists.select("doc_id", F.array_join(F.transform("l", lambda x: x["term"]), " ").alias("tokens"))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", normalize("text").alias("norm"))


def stem_vocab(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).select(F.explode(tokenize_raw("text")).alias("token"))
    return build.stem_vocabulary(rows).withColumnRenamed("term", "stem")


def term_freq(spark: SparkSession, d: str) -> DataFrame:
    return build.term_frequencies(_corpus(spark, d))


def doc_length(spark: SparkSession, d: str) -> DataFrame:
    return build.document_table(_corpus(spark, d)).select("doc_id", "length")


def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return build.dictionary(build.term_frequencies(_corpus(spark, d)))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return build.corpus_stats(build.document_table(_corpus(spark, d)))


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).stats()


def terms(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).terms()


def postings_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).postings_of("the Gardens of bridges")


def postings_by_term(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).postings_by_term("measur")


def doc_meta_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).doc_meta(7)


def doc_content_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).doc_content(7)


def bm25_idf_terms(spark: SparkSession, d: str) -> DataFrame:
    i = _index(spark, d)
    return i.dictionary.select("term", F.round(bm25_idf(F.lit(i.doc_count), "df"), 6).alias("idf"))


def _scores(scorer: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        i = _index(spark, d)
        rows = i.postings.join(i.dictionary, "term")
        value = bm25_score("tf", "df", "doc_len", F.lit(i.avgdl), F.lit(i.doc_count)) if scorer == "bm25" else tfidf_score("tf", "df", "doc_len", F.lit(i.doc_count))
        return rows.select("term", "doc_id", F.round(value, 6).alias("score"))

    run.__name__ = f"{scorer}_scores"
    return run


#: name -> (query, k, mode)
SEARCHES = {
    "search_or_1term": ("garden", 10, "or"),
    "search_or_multi": ("The careful harbours: measuring bridges & gardens", 10, "or"),
    "search_and_multi": ("steady bridges measured", 10, "and"),
    "search_dup_terms": ("lens lens mirror", 10, "or"),
    "search_unknown_and": ("lens qqqqzzzz", 10, "and"),
    "search_stopwords_only": ("the a is of", 10, "or"),
    "search_topk_ties": ("cookies privacy", 50, "or"),
    "search_total_hits": ("copyright reserved", 1, "or"),
}


def _search(name: str) -> Query:
    query, k, mode = SEARCHES[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        q = spark.createDataFrame([(1, query)], "query_id bigint, query string")
        return _index(spark, d).rank_batch(q, k, mode).withColumn("score", F.round("score", 6))

    run.__name__ = name
    return run


def _judged_queries(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/judgments.parquet").where("query is not null").select("query").distinct()
    return rows.select(F.xxhash64("query").alias("query_id"), "query")


def search_batch(spark: SparkSession, d: str) -> DataFrame:
    q = _judged_queries(spark, d)
    ranked = _index(spark, d).rank_batch(q, 10, "or")
    return ranked.join(q, "query_id").select("query", "rank", "doc_id", F.round("score", 6).alias("score"), "total_hits")


def search_tfidf(spark: SparkSession, d: str) -> DataFrame:
    q = _judged_queries(spark, d)
    ranked = _index(spark, d).rank_batch(q, 10, "or", scorer="tfidf")
    return ranked.join(q, "query_id").select("query", "rank", "doc_id", F.round("score", 6).alias("score"), "total_hits")


def search_full(spark: SparkSession, d: str) -> DataFrame:
    """Results with metadata and snippets, as a user gets them."""
    q = _judged_queries(spark, d)
    rows = _index(spark, d).search_batch(q, 10, "or")
    return rows.join(q, "query_id").select("query", "rank", "doc_id", "external_id", "url", "title", F.round("score", 6).alias("score"), "snippet", "total_hits")


#: Queries that go one by one through the path of a single search.
SINGLE = ("garden", "The careful harbours: measuring bridges & gardens", "lens lens mirror", "copyright reserved", "the a is of", "qqqqzzzz")


def search_single(spark: SparkSession, d: str) -> DataFrame:
    """The responses to single searches; the second time each comes out of the cache."""
    index = _index(spark, d)
    rows = []
    for q in SINGLE:
        index.search(q)
        got = index.search(q)
        rows += [(q, i + 1, r["doc_id"], r["external_id"], r["url"], r["title"], round(r["score"], 6), r["snippet"], got["total_hits"]) for i, r in enumerate(got["results"])]
    return spark.createDataFrame(rows, "query string, rank int, doc_id bigint, external_id string, url string, title string, score double, snippet string, total_hits bigint")


def snippet_window(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(F.lit("bridge"), F.lit("lens"), F.lit("café"))
    return _corpus(spark, d).select("doc_id", snippet("content", words, 120).alias("snippet"))


def highlight_terms(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).select("doc_id", highlight("title", F.array(F.lit("notes"), F.lit("not"), F.lit("mark"))).alias("title"))


def _evaluation(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/judgments.parquet")
    return _index(spark, d).evaluate(rows, 10)


def eval_per_query(spark: SparkSession, d: str) -> DataFrame:
    return _evaluation(spark, d).select("query", F.round("precision_at_k", 9).alias("precision_at_k"), F.round("recall", 9).alias("recall"), "k", "hits", "total_relevant")


def eval_means(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.means(_evaluation(spark, d))
    return m.select(F.round("mean_precision_at_k", 9).alias("mean_precision_at_k"), F.round("mean_recall", 9).alias("mean_recall"), "queries_run")


def postings_delta(spark: SparkSession, d: str) -> DataFrame:
    return codec.deltas(build.term_frequencies(_corpus(spark, d))).select("term", "doc_id", "tf", "delta")


def postings_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return codec.decode_postings(codec.encode_postings(build.term_frequencies(_corpus(spark, d))))


def postings_encoded(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of each term, in hexadecimal."""
    return codec.encode_postings(build.term_frequencies(_corpus(spark, d))).select("term", "block", "n", F.lower(F.hex("data")).alias("data"))


def varint_size(spark: SparkSession, d: str) -> DataFrame:
    rows = codec.deltas(build.term_frequencies(_corpus(spark, d)))
    return rows.agg(F.count("*").alias("postings"), F.sum(codec.varint_length("delta") + codec.varint_length("tf")).alias("bytes"))


def querylog_stats(spark: SparkSession, d: str) -> DataFrame:
    s = querylog.log_stats(spark.read.parquet(f"{d}/query_log.parquet"))
    return s.select("total_queries", F.round("avg_latency_ms", 6).alias("avg_latency_ms"), F.round("qps", 9).alias("qps"), F.round("uptime_seconds", 6).alias("uptime_seconds"))


def querylog_recent100(spark: SparkSession, d: str) -> DataFrame:
    return querylog.recent(spark.read.parquet(f"{d}/query_log.parquet")).select("query", "latency_ns", "results")


def store_roundtrip_search(spark: SparkSession, d: str) -> DataFrame:
    """Saved in two parts, loaded, searched."""
    path, pages = _folder(spark), _corpus(spark, d)
    index = Index.create(pages.where("doc_id % 2 = 0"), path).append(pages.where("doc_id % 2 = 1"))
    q = _judged_queries(spark, d)
    ranked = index.rank_batch(q, 10, "or")
    return ranked.join(q, "query_id").select("query", "rank", "doc_id", F.round("score", 6).alias("score"), "total_hits")


def stream_index_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """The index built by the stream, searched."""
    base = _folder(spark)
    pages = ingest.read_stream(spark, f"{d}/corpus.parquet")
    ingest.ingest_stream(pages, f"{base}/index", f"{base}/checkpoint").awaitTermination()
    q = _judged_queries(spark, d)
    ranked = Index.load(spark, f"{base}/index").rank_batch(q, 10, "or")
    return ranked.join(q, "query_id").select("query", "rank", "doc_id", F.round("score", 6).alias("score"), "total_hits")


def two_streams(spark: SparkSession, d: str) -> DataFrame:
    """Two streams, each with its own checkpoint, into one index: no page is lost, none comes twice."""
    base = _folder(spark)
    pages = ingest.read_stream(spark, f"{d}/corpus.parquet")
    running = [ingest.ingest_stream(pages.where(f"pmod(doc_id, 2) = {k}"), f"{base}/index", f"{base}/checkpoint-{k}") for k in (0, 1)]
    for query in running:
        query.awaitTermination()
    return Index.load(spark, f"{base}/index").doc_table.select("doc_id", "external_id", "length")


def append_without_ids(spark: SparkSession, d: str) -> DataFrame:
    """Half of the pages with their ids, the rest without: those get the ids after the highest, in the order of external id."""
    path, pages = _folder(spark), _corpus(spark, d)
    index = Index.create(pages.where("pmod(doc_id, 2) = 0"), path).append(pages.where("pmod(doc_id, 2) = 1").drop("doc_id"))
    return index.doc_table.select("doc_id", "external_id", "length")


def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    sources.write_jsonl(_corpus(spark, d), path)
    return sources.read_jsonl(spark, path)


def dense_doc_ids(spark: SparkSession, d: str) -> DataFrame:
    """How many pages each site adds when the ids are given anew: they are dense and in the order of external id."""
    rows = sources.with_doc_ids(_corpus(spark, d))
    return rows.select("doc_id", "external_id")


def html_adapter(spark: SparkSession, d: str) -> DataFrame:
    """The pages wrapped into HTML, with scripts, styles, comments and entities, and taken out of it again."""

    def escaped(text: str) -> F.Column:
        out = F.coalesce(F.col(text), F.lit(""))
        for entity, sign in reversed(ENTITIES):
            out = F.replace(out, F.lit(sign), F.lit(entity))
        return out

    body = F.replace(escaped("content"), F.lit("\n"), F.lit("</p><script>put('</p>');</script><!-- <b>old</b> -->\n<p class=x>"))
    page = F.concat(F.lit("<html><HEAD><Title>"), escaped("title"), F.lit("</title><style>p { x: y }</style></HEAD><body><p>"), body, F.lit("</p></body></html>"))
    return from_html(_corpus(spark, d).select("doc_id", page.alias("html")))


def health(spark: SparkSession, d: str) -> DataFrame:
    got = _index(spark, d).health()
    return spark.createDataFrame([(got["status"], got["service"])], "status string, service string")


def search_defaults(spark: SparkSession, d: str) -> DataFrame:
    """A k below 1 means 10; a mode that is none is refused."""
    index = _index(spark, d)
    rows = [(f"k = {k}", len(index.search("copyright reserved", k)["results"])) for k in (0, -3, 4)]
    for mode in ("xor", "", "or"):
        try:
            rows.append((f"mode = {mode}", len(index.search("garden", 3, mode)["results"])))
        except ValueError:
            rows.append((f"mode = {mode}", -1))
    return spark.createDataFrame(rows, "case string, results int")


#: tf, df, document length, average length, number of documents.
GUARDS = ((5, 10, 100, 100.0, 1000), (0, 10, 100, 100.0, 1000), (5, 0, 100, 100.0, 1000), (5, 10, 0, 100.0, 1000), (5, 10, 100, 0.0, 1000), (5, 10, 100, 100.0, 0), (5, 1000, 100, 100.0, 1000), (5, 2000, 100, 100.0, 1000), (1, 1, 1, 1.0, 1))


def score_guards(spark: SparkSession, d: str) -> DataFrame:
    """Scores where something is zero, or where df reaches N."""
    rows = spark.createDataFrame(GUARDS, "tf bigint, df bigint, len bigint, avg double, n bigint")
    return rows.select("*", F.round(bm25_score("tf", "df", "len", "avg", "n"), 6).alias("bm25"), F.round(tfidf_score("tf", "df", "len", "n"), 6).alias("tfidf"))


def ingest_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Three ingest jobs at once into one index, each writing JSON lines as well: their states and counts, and what the index holds."""
    base, pages, jobs = _folder(spark), _corpus(spark, d), Jobs()
    started = [jobs.start(pages.where(f"pmod(doc_id, 3) = {k}"), f"{base}/index", f"part {k}", f"{base}/json-{k}") for k in range(3)]
    done = [jobs.wait(j) for j in started]
    held = Index.load(spark, f"{base}/index").doc_count
    rows = [(j.source, j.status, j.result["documents_written"] if j.result else -1, sources.read_jsonl(spark, f"{base}/json-{k}").count(), held, len(jobs.list())) for k, j in enumerate(done)]
    return spark.createDataFrame(rows, "source string, status string, documents_written bigint, json_lines bigint, index_documents bigint, jobs int")


def query_log_append(spark: SparkSession, d: str) -> DataFrame:
    """The counters of the running log after all searches of the judged queries."""
    log, index = QueryLog(), _index(spark, d)
    for k, row in enumerate(_judged_queries(spark, d).orderBy("query").collect() * 8):
        log.record(row["query"], 1_000_000 * (k % 3 + 1), k)
    hits = [index.search("garden")["cache_hit"] for _ in range(3)]
    told = log.stats()
    return spark.createDataFrame([(told["total_queries"], len(told["recent"]), round(told["avg_latency_ms"], 6), told["recent"][-1]["query"], sum(hits))], "total_queries bigint, recent int, avg_latency_ms double, last string, cache_hits int")


def response_json(spark: SparkSession, d: str) -> DataFrame:
    """Responses as JSON text, read back."""
    index = _index(spark, d)
    rows = spark.createDataFrame([(index.search_json(q),) for q in SINGLE], "j string")
    told = F.from_json("j", "query string, total_hits bigint, cache_hit boolean, results array<struct<doc_id: bigint, external_id: string, url: string, title: string, snippet: string>>")
    return rows.select(told.alias("r")).select("r.query", "r.total_hits", F.posexplode_outer("r.results").alias("pos", "x")).select("query", "total_hits", (F.col("pos") + 1).alias("rank"), "x.doc_id", "x.external_id", "x.url", "x.title", "x.snippet")


QUERIES: dict[str, Query] = {
    "tokenize_raw": _joined("tokenize_raw", tokenize_raw),
    "tokenize_nostem": _joined("tokenize_nostem", tokenize_nostem),
    **{f.__name__: f for f in (tokenize, normalize_text, stem_vocab, term_freq, doc_length, doc_freq, corpus_stats, index_stats, terms, postings_lookup, postings_by_term, doc_meta_lookup, doc_content_lookup, bm25_idf_terms)},
    "bm25_scores": _scores("bm25"),
    "tfidf_scores": _scores("tfidf"),
    **{name: _search(name) for name in SEARCHES},
    **{f.__name__: f for f in (search_batch, search_tfidf, search_full, search_single, snippet_window, highlight_terms, eval_per_query, eval_means, postings_delta, postings_roundtrip, postings_encoded, varint_size, querylog_stats, querylog_recent100, store_roundtrip_search, stream_index_equals_batch, two_streams, append_without_ids, jsonl_roundtrip, dense_doc_ids, html_adapter, health, search_defaults, score_guards, ingest_jobs, query_log_append, response_json)},
}

# --- the same in SQL -------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))
_SPLIT = "'[^\\p{L}\\p{Nd}]+'"


def _tokens(table: str, key: str, text: str, stop: bool = True) -> str:
    """``key, pos, t`` of every token; pos counts the split pieces, so it keeps the order."""
    cut = f"SELECT {key}, regexp_split_to_array(lower({text}), {_SPLIT}) AS a FROM {table}"
    rows = f"SELECT {key}, unnest(a) AS t, unnest(range(1, len(a) + 1)) AS pos FROM ({cut})"
    return f"SELECT {key}, pos, t FROM ({rows}) WHERE t <> ''" + (f" AND t NOT IN ({_STOP})" if stop else "")


_INDEX = f"""tok AS MATERIALIZED ({_tokens("corpus", "doc_id", "content")}),
stems AS MATERIALIZED ({stem_sql("(SELECT DISTINCT t FROM tok)", "t", "term")}),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tok JOIN stems USING (t) GROUP BY 1, 2),
len AS MATERIALIZED (SELECT doc_id, CAST(count(t) AS INTEGER) AS length FROM corpus LEFT JOIN tok USING (doc_id) GROUP BY 1),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY 1),
st AS MATERIALIZED (SELECT count(*) AS n, CAST(sum(length) AS BIGINT) AS total, CAST(sum(length) AS DOUBLE) / count(*) AS avgdl FROM len)"""
_IDF = "ln((CAST(n AS DOUBLE) - df + 0.5) / (df + 0.5) + 1.0)"
_BM25 = f"({_IDF} * ((tf * (1.2e0 + 1e0)) / (tf + 1.2e0 * (1e0 - 0.75e0 + 0.75e0 * (length / avgdl)))))"
_TFIDF = "CASE WHEN length = 0 THEN 0e0 ELSE (CAST(tf AS DOUBLE) / length) * CASE WHEN df >= n THEN 0e0 ELSE log10(CAST(n AS DOUBLE) / df) END END"


def _ranked(queries: str, k: int, mode: str, out: str, score: str = _BM25) -> str:
    """The search in SQL over ``q(query_id, query)``."""
    need = "HAVING count(*) >= any_value(n_terms)" if mode == "and" else ""
    return f"""WITH {_INDEX}, q AS ({queries}), qt AS MATERIALIZED ({_tokens("q", "query_id", "query")}),
qs AS MATERIALIZED ({stem_sql("(SELECT DISTINCT t FROM qt)", "t", "term")}),
terms AS (SELECT query_id, pos, term, count(*) OVER (PARTITION BY query_id) AS n_terms FROM qt JOIN qs USING (t)),
hits AS (SELECT query_id, doc_id, list_reduce(list_prepend(0e0, list({score} ORDER BY pos)), lambda a, x: a + x) AS score
  FROM terms JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY 1, 2 {need}),
ranked AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, count(*) OVER (PARTITION BY query_id) AS total_hits FROM hits)
{out.format(k=k)}"""


_BATCH_Q = "SELECT query AS query_id, query FROM (SELECT DISTINCT query FROM judgments WHERE query IS NOT NULL)"
_BATCH_OUT = "SELECT query_id AS query, rank, doc_id, round(score, 6) AS score, total_hits FROM ranked WHERE rank <= {k}"
_BATCH = _ranked(_BATCH_Q, 10, "or", _BATCH_OUT)
_EVAL = _ranked(
    "SELECT j AS query_id, query FROM (SELECT row_number() OVER () AS j, query FROM judgments) WHERE query IS NOT NULL", 10, "or",
    """, jd AS (SELECT row_number() OVER () AS j, query, relevant_urls FROM judgments),
res AS (SELECT query_id AS j, url FROM ranked JOIN corpus USING (doc_id) WHERE rank <= {k}),
h AS (SELECT jd.j, count(*) AS h FROM jd JOIN res ON jd.j = res.j WHERE list_contains(relevant_urls, url) GROUP BY 1),
e AS (SELECT query, coalesce(h, 0) / 10e0 AS p, CASE WHEN coalesce(len(relevant_urls), 0) > 0 THEN coalesce(h, 0) / CAST(len(relevant_urls) AS DOUBLE) ELSE 0e0 END AS r,
  CAST(coalesce(h, 0) AS INTEGER) AS hits, CAST(coalesce(len(relevant_urls), 0) AS INTEGER) AS total_relevant FROM jd LEFT JOIN h USING (j))
""",
)
_DELTA = "SELECT term, doc_id, tf, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS delta FROM tf"
def _snippet(source: str, window: int) -> str:
    """``*, snippet`` of a source with ``content, words``, byte by byte: the text is read as pairs of hexadecimal digits."""
    blank, other = "(?:09|0A|0B|0C|0D|20|85|A0)", "(?:0[0-8EF]|1.|2[1-9A-F]|[3-7].|8[0-46-9A-F]|9.|A[1-9A-F]|[B-F].)"
    half = window // 2
    return f"""SELECT * EXCLUDE (h, low, n, pos, s0, e0, l, s1, r, e1, x, s, e, y), CASE WHEN content IS NULL OR content = '' OR len(words) = 0 THEN '' ELSE
  CASE WHEN s > 0 THEN '...' ELSE '' END || list_reduce(list_prepend(decode(unhex(y)), words), lambda a, t: regexp_replace(a, '(' || t || ')', '<mark>\\1</mark>', 'gi')) || CASE WHEN e < n THEN '...' ELSE '' END END AS snippet
FROM (SELECT *, repeat('EFBFBD', CAST(length(regexp_extract(x, '^(?:[89AB].)*')) / 2 AS BIGINT)) || regexp_replace(regexp_replace(x, '^(?:[89AB].)*', ''), '(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){{0,2}})$', 'EFBFBD') AS y
FROM (SELECT *, CASE WHEN r = '' THEN substr(h, 2 * pos + 1, {2 * window}) ELSE r END AS x, CASE WHEN r = '' THEN pos ELSE s1 END AS s, CASE WHEN r = '' THEN least(pos + {window}, n) ELSE e1 END AS e
FROM (SELECT *, s1 + CAST(length(r) / 2 AS BIGINT) AS e1 FROM (SELECT *, CASE WHEN e0 < n THEN regexp_replace(l, '{other}*$', '') ELSE l END AS r
FROM (SELECT *, e0 - CAST(length(l) / 2 AS BIGINT) AS s1 FROM (SELECT *, CASE WHEN s0 > 0 THEN regexp_replace(substr(h, 2 * s0 + 1, 2 * (e0 - s0)), '^{other}*{blank}*', '') ELSE substr(h, 2 * s0 + 1, 2 * (e0 - s0)) END AS l
FROM (SELECT *, greatest(pos - {half}, 0) AS s0, least(pos + {half}, n) AS e0
FROM (SELECT *, coalesce(list_min(list_filter(list_transform(words, lambda t: CASE WHEN regexp_matches(low, '^(?:..)*?' || hex(encode(t))) THEN CAST(length(regexp_extract(low, '^((?:..)*?)' || hex(encode(t)), 1)) / 2 AS BIGINT) END), lambda v: v IS NOT NULL)), 0) AS pos
FROM (SELECT *, hex(encode(content)) AS h, hex(encode(lower(content))) AS low, strlen(content) AS n FROM ({source}))))))))))"""


_FULL_OUT = f""", found AS (SELECT query_id, rank, corpus.doc_id, external_id, url, title, round(score, 6) AS score, total_hits, content,
  list_filter(regexp_split_to_array(lower(query), {_SPLIT}), lambda w: w <> '' AND w NOT IN ({_STOP})) AS words FROM ranked JOIN corpus USING (doc_id) JOIN q USING (query_id) WHERE rank <= 10)
SELECT query_id AS query, rank, doc_id, external_id, url, title, score, snippet, total_hits FROM ({_snippet("SELECT * FROM found", 200)})"""


def _full(queries: str) -> str:
    return _ranked(queries, 10, "or", "") + _FULL_OUT


_HEX = "CASE WHEN {0} < 128 THEN printf('%02x', {0}) WHEN {0} < 16384 THEN printf('%02x%02x', {0} % 128 + 128, {0} // 128) WHEN {0} < 2097152 THEN printf('%02x%02x%02x', {0} % 128 + 128, {0} // 128 % 128 + 128, {0} // 16384) WHEN {0} < 268435456 THEN printf('%02x%02x%02x%02x', {0} % 128 + 128, {0} // 128 % 128 + 128, {0} // 16384 % 128 + 128, {0} // 2097152) END"
_VLEN = "(CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END)"

SQL: dict[str, str] = {
    "tokenize_raw": f"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), {_SPLIT}), lambda x: x <> ''), ' ') AS tokens FROM documents",
    "tokenize_nostem": f"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), {_SPLIT}), lambda x: x <> '' AND x NOT IN ({_STOP})), ' ') AS tokens FROM documents",
    "tokenize": f"""WITH tok AS MATERIALIZED ({_tokens("documents", "doc_id", "text")}), s AS MATERIALIZED ({stem_sql("(SELECT DISTINCT t FROM tok)", "t", "term")})
SELECT doc_id, string_agg(term, ' ' ORDER BY pos) AS tokens FROM tok JOIN s USING (t) GROUP BY doc_id""",
    "normalize_text": "SELECT doc_id, lower(text) AS norm FROM documents",
    "stem_vocab": f"WITH tok AS ({_tokens('documents', 'doc_id', 'text', False)}) SELECT t AS token, term AS stem FROM ({stem_sql('(SELECT DISTINCT t FROM tok)', 't', 'term')})",
    "term_freq": f"WITH {_INDEX} SELECT doc_id, term, tf FROM tf",
    "doc_length": f"WITH {_INDEX} SELECT doc_id, length FROM len",
    "doc_freq": f"WITH {_INDEX} SELECT term, df FROM df",
    "corpus_stats": f"WITH {_INDEX} SELECT n AS doc_count, total AS total_length, avgdl FROM st",
    "index_stats": f"WITH {_INDEX} SELECT (SELECT count(*) FROM df) AS term_count, n AS doc_count, (SELECT count(*) FROM tf) AS total_postings FROM st",
    "terms": f"WITH {_INDEX} SELECT term FROM df",
    "postings_lookup": f"WITH {_INDEX} SELECT doc_id, tf FROM tf WHERE term = 'garden'",
    "postings_by_term": f"WITH {_INDEX} SELECT doc_id, tf FROM tf WHERE term = 'measur'",
    "doc_meta_lookup": f"WITH {_INDEX} SELECT doc_id, external_id, url, title, length FROM corpus JOIN len USING (doc_id) WHERE doc_id = 7",
    "doc_content_lookup": "SELECT doc_id, coalesce(content, '') AS content FROM corpus WHERE doc_id = 7",
    "bm25_idf_terms": f"WITH {_INDEX} SELECT term, round({_IDF}, 6) AS idf FROM df, st",
    "bm25_scores": f"WITH {_INDEX} SELECT term, doc_id, round({_BM25}, 6) AS score FROM tf JOIN df USING (term) JOIN len USING (doc_id), st",
    "tfidf_scores": f"WITH {_INDEX} SELECT term, doc_id, round({_TFIDF}, 6) AS score FROM tf JOIN df USING (term) JOIN len USING (doc_id), st",
    **{
        name: _ranked(f"SELECT CAST(1 AS BIGINT) AS query_id, '{q}' AS query", k, mode, "SELECT query_id, rank, doc_id, round(score, 6) AS score, total_hits FROM ranked WHERE rank <= {k}")
        for name, (q, k, mode) in SEARCHES.items()
    },
    "search_batch": _BATCH,
    "search_full": _full(_BATCH_Q),
    "search_single": _full("SELECT query AS query_id, query FROM (VALUES " + ", ".join(f"('{q}')" for q in SINGLE) + ") t(query)"),
    "snippet_window": f"SELECT doc_id, snippet FROM ({_snippet("SELECT doc_id, content, ['bridge', 'lens', 'café'] AS words FROM corpus", 120)})",
    "two_streams": f"WITH {_INDEX} SELECT doc_id, external_id, length FROM corpus JOIN len USING (doc_id)",
    "append_without_ids": f"""WITH {_INDEX}, even AS (SELECT * FROM corpus JOIN len USING (doc_id) WHERE doc_id % 2 = 0), odd AS (SELECT * FROM corpus JOIN len USING (doc_id) WHERE doc_id % 2 = 1),
numbered AS (SELECT (SELECT max(doc_id) FROM even) + row_number() OVER (ORDER BY external_id) AS doc_id, external_id FROM odd),
lengths AS (SELECT external_id, length, row_number() OVER (PARTITION BY external_id ORDER BY url NULLS FIRST, title NULLS FIRST) AS k FROM odd)
SELECT doc_id, external_id, length FROM even UNION ALL SELECT n.doc_id, n.external_id, l.length FROM (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY doc_id) AS k FROM numbered) n JOIN lengths l USING (external_id, k)""",
    "search_tfidf": _ranked(_BATCH_Q, 10, "or", _BATCH_OUT, _TFIDF),
    "store_roundtrip_search": _BATCH,
    "stream_index_equals_batch": _BATCH,
    "highlight_terms": "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(title, '(notes)', '<mark>\\1</mark>', 'gi'), '(not)', '<mark>\\1</mark>', 'gi'), '(mark)', '<mark>\\1</mark>', 'gi') AS title FROM corpus",
    "eval_per_query": _EVAL + "SELECT query, round(p, 9) AS precision_at_k, round(r, 9) AS recall, CAST(10 AS INTEGER) AS k, hits, total_relevant FROM e",
    "eval_means": _EVAL + "SELECT round(avg(p), 9) AS mean_precision_at_k, round(avg(r), 9) AS mean_recall, count(*) AS queries_run FROM e",
    "postings_delta": f"WITH {_INDEX} {_DELTA}",
    "postings_encoded": f"WITH {_INDEX}, d AS ({_DELTA}) SELECT term, doc_id // 65536 AS block, count(*) AS n, string_agg({_HEX.format('delta')} || {_HEX.format('tf')}, '' ORDER BY doc_id) AS data FROM d GROUP BY 1, 2",
    "postings_roundtrip": f"WITH {_INDEX} SELECT term, doc_id, tf FROM tf",
    "varint_size": f"WITH {_INDEX}, d AS ({_DELTA}) SELECT count(*) AS postings, CAST(sum({_VLEN.format('delta')} + {_VLEN.format('tf')}) AS BIGINT) AS bytes FROM d",
    "querylog_stats": """WITH s AS (SELECT count(*) AS n, coalesce(sum(CASE WHEN latency_ns > 0 THEN latency_ns END), 0) AS ns, (epoch_us(max(logged_at)) - epoch_us(min(logged_at))) / 1e6 AS up FROM query_log)
SELECT n AS total_queries, round(floor(CAST(ns AS DOUBLE) / 1000) / n / 1000, 6) AS avg_latency_ms, round(n / up, 9) AS qps, round(up, 6) AS uptime_seconds FROM s""",
    "querylog_recent100": """SELECT query, latency_ns, results FROM query_log
ORDER BY logged_at DESC, query DESC NULLS LAST, latency_ns DESC NULLS LAST, results DESC NULLS LAST LIMIT 100""",
    "jsonl_roundtrip": "SELECT doc_id, external_id, url, title, content FROM corpus",
    "dense_doc_ids": "SELECT row_number() OVER (ORDER BY external_id, url NULLS FIRST, title NULLS FIRST, content NULLS FIRST) - 1 AS doc_id, external_id FROM corpus",
    "html_adapter": """SELECT doc_id, CASE WHEN coalesce(title, '') <> '' THEN trim(regexp_replace(title, '[ \\t\\n\\f\\r\\x0B\\x{A0}]+', ' ', 'g')) END AS title,
  trim(regexp_replace(coalesce(content, ''), '[ \\t\\n\\f\\r\\x0B\\x{A0}]+', ' ', 'g')) AS content FROM corpus""",
    "health": "SELECT 'ok' AS status, 'lexspark' AS service",
    "search_defaults": f"""WITH {_INDEX}, h AS (SELECT count(DISTINCT CASE WHEN term IN ('copyright', 'reserv') THEN doc_id END) AS c, count(DISTINCT CASE WHEN term = 'garden' THEN doc_id END) AS g FROM tf)
SELECT "case", CASE k WHEN -1 THEN -1 WHEN 3 THEN least(g, 3) ELSE least(c, k) END AS results FROM h, (VALUES ('k = 0', 10), ('k = -3', 10), ('k = 4', 4), ('mode = xor', -1), ('mode = ', -1), ('mode = or', 3)) t("case", k)""",
    "score_guards": f"""SELECT *, CASE WHEN tf = 0 OR df = 0 OR n = 0 OR avg = 0 THEN 0e0 ELSE round({_IDF} * (tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * (len / avg)))), 6) END AS bm25,
  CASE WHEN len = 0 OR df = 0 OR n = 0 OR df >= n THEN 0e0 ELSE round(CAST(tf AS DOUBLE) / len * log10(CAST(n AS DOUBLE) / df), 6) END AS tfidf
FROM (SELECT CAST(tf AS BIGINT) AS tf, CAST(df AS BIGINT) AS df, CAST(len AS BIGINT) AS len, CAST(avg AS DOUBLE) AS avg, CAST(n AS BIGINT) AS n FROM (VALUES {", ".join(map(str, GUARDS))}) t(tf, df, len, avg, n))""",
    "ingest_jobs": """SELECT 'part ' || (doc_id % 3) AS source, 'completed' AS status, count(*) AS documents_written, count(*) AS json_lines, (SELECT count(*) FROM corpus) AS index_documents, CAST(3 AS INTEGER) AS jobs FROM corpus GROUP BY doc_id % 3""",
    "query_log_append": """WITH q AS (SELECT DISTINCT query FROM judgments WHERE query IS NOT NULL), n AS (SELECT count(*) * 8 AS n FROM q),
l AS (SELECT i, 1000 * (i % 3 + 1) AS us FROM range(0, (SELECT n FROM n)) r(i))
SELECT n AS total_queries, CAST(least(n, 100) AS INTEGER) AS recent, (SELECT round(sum(us) / n / 1000, 6) FROM l) AS avg_latency_ms, (SELECT max(query) FROM q) AS last, CAST(2 AS INTEGER) AS cache_hits FROM n""",
    "response_json": f"""WITH r AS ({_full("SELECT query AS query_id, query FROM (VALUES " + ", ".join(f"('{q}')" for q in SINGLE) + ") t(query)")})
SELECT q.query, coalesce(r.total_hits, 0) AS total_hits, r.rank, r.doc_id, r.external_id, r.url, r.title, r.snippet FROM (VALUES {", ".join(f"('{q}')" for q in SINGLE)}) q(query) LEFT JOIN r ON r.query = q.query""",
}
