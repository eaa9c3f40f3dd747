"""Corpus sources and sinks. A corpus is ``doc_id, external_id, url, title, content``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.session import checkpoint_dir
from lexspark.sources.scan import spread

CORPUS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("external_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A page table in Parquet; columns beyond the corpus ones are pruned at the scan."""
    return spread(spark.read.parquet(path).select(*CORPUS.names))


def from_documents(documents: DataFrame) -> DataFrame:
    """The corpus form of a table of texts; the external id is the SHA-256 of the text."""
    return documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("external_id"), "url", "title", F.col("text").alias("content"))


def write_jsonl(corpus: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    corpus.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS).json(path)


def number_rows(corpus: DataFrame) -> tuple[DataFrame, int]:
    """The corpus with dense ids from 0 on, in the order of external id, url and title, and the number of rows.

    Rows are range-partitioned and sorted; each partition numbers its own rows, batch by batch, and is checkpointed, so
    that the numbers hold whatever is lost later. The partition sizes, one small row each, are summed up to the offsets.
    Rows equal in all three are told apart by a hash of their content: no text is compared, and no task sees more than
    its own partition.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            places = pa.array(np.arange(at, at + batch.num_rows, dtype=np.int64))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), places], names=[*batch.schema.names, "part", "local"])

    checkpoint_dir(corpus.sparkSession)
    rows = corpus.select(*[c for c in CORPUS.names if c != "doc_id"])
    order = ["external_id", "url", "title", F.xxhash64("content")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = ranged.mapInArrow(number, T.StructType([*ranged.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])).checkpoint()
    sizes = local.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition of one shuffle
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    count = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return local.join(F.broadcast(offsets), "part").withColumn("doc_id", F.col("local") + F.col("offset")).select(*CORPUS.names), count


def with_doc_ids(corpus: DataFrame, start: int = 0) -> DataFrame:
    """Dense ids from ``start`` on, for a corpus without ids; see ``number_rows``."""
    rows, _ = number_rows(corpus)
    return rows.withColumn("doc_id", F.col("doc_id") + F.lit(start))
