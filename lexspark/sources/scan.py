"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores.

    A table of one or two small files is one or two tasks, whatever follows. Such a table is dealt out evenly;
    one with enough splits, as every large table has, is left alone and not shuffled. Only the plan depends on it: the
    rows are the same.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < min(cores, 64) else df
