"""Ranking quality: precision at k and recall, for all judgments in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(judgments: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, query, precision_at_k, recall, k, hits, total_relevant``.

    ``judgments`` is ``query_id, query, relevant_urls``; ``results`` has ``query_id, url`` of the ranked rows.
    A result counts if its url is relevant, two documents of one url both; precision is over ``k``, recall over
    the length of the list, repeats counted; both are 0 where that is 0 or the list is null.
    """
    k = k if k and k > 0 else 10
    wanted = judgments.select("query_id", F.explode("relevant_urls").alias("url")).distinct()
    hits = results.join(wanted, ["query_id", "url"], "left_semi").groupBy("query_id").agg(F.count("*").alias("h"))
    rows = judgments.join(hits, "query_id", "left")
    total = F.when(F.col("relevant_urls").isNull(), F.lit(0)).otherwise(F.size("relevant_urls"))
    h = F.coalesce("h", F.lit(0)).cast("int")
    recall = F.when(total > 0, h / F.when(total > 0, total)).otherwise(0.0)
    return rows.select("query_id", "query", (h / F.lit(float(k))).alias("precision_at_k"), recall.alias("recall"), F.lit(k).alias("k"), h.alias("hits"), total.cast("int").alias("total_relevant"))


def means(results: DataFrame) -> DataFrame:
    """One row ``mean_precision_at_k, mean_recall, queries_run``; 0 without queries."""
    return results.agg(
        F.coalesce(F.avg("precision_at_k"), F.lit(0.0)).alias("mean_precision_at_k"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("mean_recall"), F.count("*").alias("queries_run")
    )
