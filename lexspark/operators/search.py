"""Ranked retrieval: one query or many in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.porter import stem_words
from lexspark.functions.scoring import BM25Params, bm25_idf, bm25_weight, tfidf_score
from lexspark.functions.text import tokenize_nostem

MODES = ("or", "and")


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, pos, token, term`` of ``query_id, query``: a bag of terms in their order, repeats kept."""
    rows = queries.select("query_id", F.posexplode(tokenize_nostem("query")).alias("pos", "token"))
    return stem_words(rows, "token", "term")


def score(terms: DataFrame, post: DataFrame, df: DataFrame, n: int, avgdl: float, params: BM25Params = BM25Params(), scorer: str = "bm25") -> DataFrame:
    """``query_id, doc_id, score, hits``: the sum of the term scores, in the order of the query's terms.

    The order of a floating-point sum is fixed by a fold over (pos, score), at most as long as the query, so
    equal documents get equal scores. idf is computed once per term, before the join with the postings.
    """
    weighed = terms.join(df, "term").withColumn("idf", bm25_idf(F.lit(n), "df"))
    hit = post.join(weighed, "term")
    if scorer == "bm25":
        value = bm25_weight("tf", F.col("idf"), "doc_len", F.lit(avgdl), params)
    elif scorer == "tfidf":
        value = tfidf_score("tf", "df", "doc_len", F.lit(n))
    else:
        raise ValueError(f"unknown scorer {scorer!r}")
    parts = hit.select("query_id", "doc_id", F.struct("pos", value.alias("s")).alias("part")).groupBy("query_id", "doc_id").agg(F.collect_list("part").alias("parts"))
    total = F.aggregate(F.array_sort("parts"), F.lit(0.0), lambda a, x: a + x["s"])
    return parts.select("query_id", "doc_id", total.alias("score"), F.size("parts").alias("hits"))


def rank(scored: DataFrame, terms: DataFrame, k: int = 10, mode: str = "or") -> DataFrame:
    """``query_id, rank, doc_id, score, total_hits``: the ``k`` best of each query, the smaller id first on ties.

    ``and`` keeps documents with as many hits as the query has terms, repeats counted. ``total_hits`` is counted
    before the cut. ``k`` below 1 means 10.
    """
    if mode not in MODES:
        raise ValueError("mode must be 'or' or 'and'")
    k = k if k and k > 0 else 10
    if mode == "and":
        sizes = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
        scored = scored.join(sizes, "query_id").where(F.col("hits") >= F.col("n_terms"))
    totals = scored.groupBy("query_id").agg(F.count("*").alias("total_hits"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id")))
    top = scored.select("query_id", "doc_id", "score", place.alias("rank")).where(F.col("rank") <= k)
    return top.join(totals, "query_id").select("query_id", "rank", "doc_id", "score", "total_hits")
