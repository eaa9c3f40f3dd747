"""Statistics over a query log (``query, latency_ns, results, logged_at``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECENT = 100


def log_stats(log: DataFrame) -> DataFrame:
    """One row ``total_queries, avg_latency_ms, qps, uptime_seconds``.

    The mean is over microseconds cut off, as the running counter has it; unknown and negative latencies add
    nothing. Uptime runs from the first to the last record; a log without span has a qps of 0.
    """
    one = log.agg(
        F.count("*").alias("total_queries"), F.coalesce(F.sum(F.when(F.col("latency_ns") > 0, F.col("latency_ns"))), F.lit(0)).alias("ns"),
        ((F.unix_micros(F.max("logged_at").cast("timestamp")) - F.unix_micros(F.min("logged_at").cast("timestamp"))) / 1e6).alias("up"),
    )
    n, up = F.col("total_queries"), F.coalesce("up", F.lit(0.0))
    avg = F.when(n > 0, F.floor(F.col("ns") / 1000) / F.when(n > 0, n) / 1000).otherwise(0.0)
    return one.select("total_queries", avg.alias("avg_latency_ms"), F.when(up > 0, n / F.when(up > 0, up)).otherwise(0.0).alias("qps"), up.alias("uptime_seconds"))


def recent(log: DataFrame, n: int = RECENT) -> DataFrame:
    """The last ``n`` records, oldest first; equal times are ordered by the other columns."""
    last = log.orderBy(F.desc("logged_at"), F.desc_nulls_last("query"), F.desc_nulls_last("latency_ns"), F.desc_nulls_last("results")).limit(n)
    return last.orderBy("logged_at", "query", "latency_ns", "results")
