"""Problem 6: collection and record frequency of every term or n-gram, by suffix sorting.

Every position of a record gives its suffix, cut to ``n`` terms; equal suffixes of one record are one row with a weight.
Suffixes are routed by their first term, so all n-grams that begin with it meet in one place; there they are sorted in
reverse lexicographic order, and a stack of open prefixes counts the n-grams of all lengths in one pass. Of the rows of a
record that share a prefix one is marked, so record sets are counted by adding marks: the stack holds a few numbers for each
length and no set. A hot first term is spread over salts told by the record; partial counts add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.skew import salt, salts

RARE_DF = 2
COMMON_SHARE = 0.3


def _differs(column: pa.Array) -> np.ndarray:
    """For each row but the first: is it unlike the row before? Null is a value of its own."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    na, nb = pc.is_null(a).to_numpy(zero_copy_only=False), pc.is_null(b).to_numpy(zero_copy_only=False)
    return unlike | (na != nb)


def _stack(n: int):
    """Counts every prefix of the sorted suffixes. Input: t1..tn, weight, m1..mn (1 for the row that stands for its record
    among those with this prefix); output: t1..tn, total, records."""

    names = [f"t{k + 1}" for k in range(n)] + ["total", "records"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple | None] = [None] * n  # of each depth: the prefix, its total, its records

        def out(depth: int, heads: list[pa.Array], total: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
            rest = [pa.nulls(len(total), pa.string())] * (n - depth - 1)
            return pa.RecordBatch.from_arrays([*heads, *rest, pa.array(total, pa.int64()), pa.array(records, pa.int64())], names=names)

        def flush(depth: int) -> Iterator[pa.RecordBatch]:
            if open_[depth] is not None:
                prefix, total, records = open_[depth]
                yield out(depth, [pa.array([x], pa.string()) for x in prefix], np.array([total]), np.array([records]))
            open_[depth] = None

        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            cols = [batch.column(k) for k in range(n)]
            weight = pc.fill_null(batch.column(n), 0).to_numpy(zero_copy_only=False)
            new = np.zeros(size, dtype=bool)
            for depth in range(n):
                if size > 1:
                    new[1:] |= _differs(cols[depth])
                starts = np.flatnonzero(np.concatenate([[True], new[1:]]))
                total = np.add.reduceat(weight, starts)
                records = np.add.reduceat(batch.column(n + 1 + depth).to_numpy(zero_copy_only=False).astype(np.int64), starts)
                heads = [pc.take(cols[k], pa.array(starts)) for k in range(depth + 1)]
                valid = pc.is_valid(heads[depth]).to_numpy(zero_copy_only=False)
                last = len(starts) - 1  # its run stays open
                first = 0
                if open_[depth] is not None:
                    if tuple(h[0].as_py() for h in heads) == open_[depth][0]:
                        prefix, so_far, seen = open_[depth]
                        open_[depth] = (prefix, so_far + int(total[0]), seen + int(records[0]))
                        first = 1
                    if first <= last:
                        yield from flush(depth)
                if first <= last:
                    closed = np.arange(first, last)[valid[first:last]]
                    if len(closed):
                        yield out(depth, [pc.take(h, pa.array(closed)) for h in heads], total[closed], records[closed])
                    open_[depth] = (tuple(h[last].as_py() for h in heads), int(total[last]), int(records[last])) if valid[last] else None
        for depth in range(n):
            yield from flush(depth)

    return run


def suffix_counts(suffixes: DataFrame, n: int) -> DataFrame:
    """``t1..tn, total, records`` of every n-gram of up to ``n`` terms.

    ``suffixes`` has ``t1..tn`` (null beyond the end of the record), ``salt`` (told by the record), ``weight bigint`` and
    the marks ``m1..mn int``; it is partitioned here by first term and salt unless it comes so.
    """
    cols, marks = [f"t{k + 1}" for k in range(n)], [f"m{k + 1}" for k in range(n)]
    ordered = suffixes.sortWithinPartitions(*[F.col(c).desc_nulls_last() for c in cols]).select(*cols, "weight", *marks)
    schema = ", ".join(f"{c} string" for c in cols) + ", total bigint, records bigint"
    partial = ordered.mapInArrow(_stack(n), schema)
    return partial.groupBy(*cols).agg(F.sum("total").alias("total"), F.sum("records").alias("records"))


def clean_postings(postings: DataFrame) -> DataFrame:
    """``term, doc_id, tf, salt``: one row per (term, page), partitioned by (term, salt).

    Terms are trimmed and lowercased; rows with a null term or page do not count. Of rows sent again the
    non-null ``tf`` holds (the highest, should they differ); a pair known only with null keeps a null ``tf``.
    """
    rows = postings.select(F.lower(F.trim("term")).alias("term"), F.col("doc_id"), F.col("tf").cast("bigint").alias("tf"))
    rows = rows.where(F.col("term").isNotNull() & F.col("doc_id").isNotNull()).withColumn("salt", salt(salts(postings), "doc_id"))
    return rows.repartition("term", "salt").groupBy("term", "salt", "doc_id").agg(F.max("tf").alias("tf"))


def page_count(doc_table: DataFrame) -> Column:
    """N, the number of different pages, as a scalar subquery: one row, whatever the size."""
    return doc_table.agg(F.countDistinct("doc_id").alias("n")).scalar()


def term_statistics(postings: DataFrame) -> DataFrame:
    """``term, total_tf, df`` over all segments."""
    # a pair is one row, so every row stands for its page
    suffixes = clean_postings(postings).select(F.col("term").alias("t1"), F.col("tf").alias("weight"), F.lit(1).alias("m1"))
    return suffix_counts(suffixes, 1).select(F.col("t1").alias("term"), F.col("total").alias("total_tf"), F.col("records").alias("df"))


def mark_terms(stats: DataFrame, n: Column, rare: int = RARE_DF, common: float = COMMON_SHARE) -> DataFrame:
    """``term, mark``: ``rare`` up to ``rare`` pages, otherwise ``common`` above the share ``common`` of all pages."""
    mark = F.when(F.col("df") <= rare, "rare").when(F.col("df") > F.lit(common) * n, "common")
    return stats.withColumn("mark", mark).where("mark is not null").select("term", "mark")


def text_ngrams(docs: DataFrame, key: str, tokens: Column, n: int = 3) -> DataFrame:
    """``t1..tn, total, records`` of the n-grams of whole texts; a record without tokens gives none. Rows that share a key are one record."""
    rows = docs.select(F.col(key).alias("doc"), tokens.alias("w")).where(F.size("w") > 0)
    rows = rows.select("doc", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("k"))
    cols = [f"t{k + 1}" for k in range(n)]
    # by record and first term: the sums and the marks of a record's prefixes need no further shuffle
    suffixes = rows.select("doc", *[F.try_element_at("w", F.col("k") + k).alias(f"t{k + 1}") for k in range(n)]).repartition("doc", "t1")
    suffixes = suffixes.groupBy("doc", *cols).agg(F.count("*").alias("weight"))
    marks = [F.when(F.row_number().over(Window.partitionBy("doc", *cols[: k + 1]).orderBy(*cols[k + 1 :])) == 1, 1).otherwise(0) for k in range(n - 1)]
    suffixes = suffixes.select(*cols, "weight", *[m.alias(f"m{k + 1}") for k, m in enumerate(marks)], F.lit(1).alias(f"m{n}"), salt(salts(docs), "doc").alias("salt"))
    return suffix_counts(suffixes.repartition("t1", "salt"), n)
