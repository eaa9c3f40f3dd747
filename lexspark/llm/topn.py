"""Problem 4: the N best items of every group, from one global sort.

The rows are range-partitioned and sorted by (group, score descending, item), so a group of any size lies in
consecutive partitions. Each partition numbers its own rows of a group; the counts of the partitions before
it, summed up, turn these numbers into exact positions. No task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _cut(n: int):
    """Numbers the rows of each group within a sorted partition and keeps the first ``n``.

    A count above ``n`` need not be known: with ``n`` rows before them, later rows are out anyway.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, seen = None, 0  # the open group and its rows so far
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            group = batch.column(0)
            new = np.ones(size, dtype=bool)
            if size > 1:
                new[1:] = pc.not_equal(group.slice(1), group.slice(0, size - 1)).to_numpy(zero_copy_only=False)
            new[0] = last is None or group[0].as_py() != last
            at = np.arange(size, dtype=np.int64)
            begin = np.maximum.accumulate(np.where(new, at, 0))
            position = at - begin + 1
            carried = int(np.argmax(new)) if new.any() else size  # rows that go on with the open group
            position[:carried] = at[:carried] + 1 + seen
            last, seen = group[size - 1].as_py(), int(position[-1])
            keep = position <= n
            if keep.any():
                rows = pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.full(size, part, np.int32)), pa.array(position.astype(np.int32))],
                    names=[*batch.schema.names, "part", "local"],
                )
                yield rows.filter(pa.array(keep))

    return cut


def top_n_per_group(df: DataFrame, group: str, score: str, item: str, n: int = 10) -> DataFrame:
    """``group, score, item, position`` of the ``n`` highest scores of every group; on equal scores the smaller item.

    ``df`` may have further columns (of any name); only the three named ones are read. Rows whose group or
    item is null or whose score is null, NaN or infinite do not count. An item given several times for a
    group counts once, with its highest score. Empty input gives an empty result.
    """
    inf = float("inf")
    rows = df.select(F.col(group).alias("g"), (F.col(score).cast("double") + F.lit(0.0)).alias("s"), F.col(item).alias("i"))
    rows = rows.where(F.col("g").isNotNull() & F.col("i").isNotNull() & ~F.isnan("s") & (F.col("s") < inf) & (F.col("s") > -inf))
    best = rows.groupBy("g", "i").agg(F.max("s").alias("s")).select("g", "s", "i")
    order = [F.col("g").asc(), F.col("s").desc(), F.col("i").asc()]
    ranged = best.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = dict(best.dtypes)
    local = ranged.mapInArrow(_cut(n), f"g {kinds['g']}, s double, i {kinds['i']}, part int, local int")
    before = Window.partitionBy("g").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    place = F.col("local") + F.coalesce(F.count(F.lit(1)).over(before), F.lit(0))
    return (
        local.withColumn("position", place.cast("int"))
        .where(F.col("position") <= n)
        .select(F.col("g").alias(group), F.col("s").alias(score), F.col("i").alias(item), "position")
    )
