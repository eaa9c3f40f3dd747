"""Continuous ingest: every micro-batch becomes one segment of the stored index."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexspark.sources import store
from lexspark.sources.corpus import CORPUS


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Page files as they arrive in the folder ``path``; of a path that names a file, this file alone."""
    reader = spark.readStream.schema(CORPUS).option("maxFilesPerTrigger", files_per_batch)
    fs, p = store.file_system(spark, path)
    if fs.exists(p) and fs.getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def ingest_stream(pages: DataFrame, index_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends each batch of new pages under the stream's own id and the batch's number.

    A batch that runs again after a failure adds nothing twice, and streams into one index do not meet. The pages bring
    their doc_ids, or (without that column) get the next ones. ``available_now`` ends the query once what is there has
    been read.
    """

    def add(batch: DataFrame, number: int) -> None:
        # Spark names a stream in its checkpoint: the name holds over restarts
        stream = json.loads(store.read_text(batch.sparkSession, f"{checkpoint.rstrip('/')}/metadata"))["id"]
        store.append_segment(batch.sparkSession, index_path, batch, key=f"{stream}-{number}")

    writer = pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
