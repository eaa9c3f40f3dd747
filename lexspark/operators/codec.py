"""Delta-varint postings: for exchange and for reporting sizes; stored indexes are plain Parquet."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TWO_32 = 1 << 32


#: Ids of one block of a term's list: a list of any length is encoded, and read, block by block.
SPAN = 1 << 16


def deltas(post: DataFrame, span: int = SPAN) -> DataFrame:
    """``term, doc_id, tf, delta, block, before``: the distance to the document before it in the term's list, modulo 2^32.

    A list is cut into blocks of ``span`` ids; ``before`` is the last id ahead of the block. The blocks' ends, of which a
    term has few, are all that is put in order per term: no task holds a whole list.
    """
    rows = post.select("term", "doc_id", "tf", F.floor(F.col("doc_id") / span).cast("bigint").alias("block"))
    ends = rows.groupBy("term", "block").agg(F.max("doc_id").alias("last"))
    ends = ends.select("term", "block", F.lag("last", 1, 0).over(Window.partitionBy("term").orderBy("block")).alias("before"))
    inside = rows.withColumn("previous", F.lag("doc_id").over(Window.partitionBy("term", "block").orderBy("doc_id")))
    return inside.join(ends, ["term", "block"]).select("term", "doc_id", "tf", F.pmod(F.col("doc_id") - F.coalesce("previous", "before"), F.lit(TWO_32)).alias("delta"), "block", "before")


def varint_length(value: Column | str) -> Column:
    """Bytes of the value written seven bits at a time."""
    v = F.col(value) if isinstance(value, str) else value
    return sum((F.when(v >= (1 << (7 * i)), 1).otherwise(0) for i in range(1, 9)), F.lit(1))


def varint_hex(value: Column | str) -> Column:
    """The value as an unsigned varint, in hexadecimal."""
    v = (F.col(value) if isinstance(value, str) else value).cast("bigint")
    n = varint_length(v)

    def byte(i: Column) -> Column:
        seven = F.pmod(F.floor(v / F.pow(F.lit(2.0), i * 7)), F.lit(128)).cast("int")
        return seven + F.when(i < n - 1, 128).otherwise(0)

    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), "")


def encode_postings(post: DataFrame, span: int = SPAN) -> DataFrame:
    """``term, block, before, n, data``: (delta, tf) after (delta, tf) in the order of doc_id, in blocks of ``span`` ids.

    A term's blocks put together in their order are its list in one piece.
    """
    rows = deltas(post, span).select("term", "block", "before", "doc_id", F.concat(varint_hex("delta"), varint_hex("tf")).alias("h"))
    blocks = rows.groupBy("term", "block", "before").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("doc_id", "h"))).alias("l"))
    return blocks.select("term", "block", "before", "n", F.unhex(F.array_join(F.transform("l", lambda x: x["h"]), "")).alias("data"))


def _decode(data: bytes, count: int, before: int = 0) -> list[tuple[int, int]]:
    """Raises ValueError on short or overlong data; no count or no data gives nothing, bytes left over are ignored."""
    if not count or not data:
        return []
    out, at, doc = [], 0, before
    for i in range(count):
        pair = []
        for _ in range(2):
            value = shift = 0
            while True:
                if at >= len(data):
                    raise ValueError(f"posting {i}: data ends at byte {at}")
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                if byte < 128:
                    break
                shift += 7
                if shift > 63:
                    raise ValueError(f"posting {i}: overlong varint")
            pair.append(value)
        doc = (doc + pair[0]) % TWO_32
        out.append((doc, pair[1] % TWO_32))
    return out


def decode_postings(blocks: DataFrame) -> DataFrame:
    """``term, doc_id, tf`` of ``term, before, n, data``, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t.as_py(), *pair) for t, b, n, d in zip(*batch.columns) for pair in _decode(d.as_py() or b"", n.as_py(), b.as_py())]
            terms, docs, tfs = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(docs, pa.int64()), pa.array(tfs, pa.int64())], names=["term", "doc_id", "tf"])

    return blocks.select("term", "before", "n", "data").mapInArrow(run, "term string, doc_id bigint, tf bigint")
