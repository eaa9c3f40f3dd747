"""The stored index: immutable segments of Parquet tables, and a manifest that names the live ones.

    <path>/segment-<unique>/postings     range-partitioned and sorted by term, doc_id
    <path>/segment-<unique>/terms        term, df of the segment, sorted by term
    <path>/segment-<unique>/doc_table, contents
    <path>/manifest-<version>.json       written last: a version exists once its manifest does
    <path>/ids-<number>.json             how many ids have been handed out

A writer works in a folder of its own and then takes the next manifest number: taking one that exists fails, and the
writer looks again at what has come in between. So writers never lose each other's segments, and never wait. Frequencies of
terms are per segment sums, put together on reading, so idf always uses the current totals.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators import build
from lexspark.sources.corpus import number_rows

FORMAT = 2
#: A writer gives up after so many others were faster, one after another.
MAX_TRIES = 1000


@dataclass
class Segment:
    name: str
    docs: int
    total_length: int
    postings: int
    min_id: int
    max_id: int
    key: str | None = None


@dataclass
class Manifest:
    version: int = 0
    segments: list[Segment] = field(default_factory=list)
    format: int = FORMAT

    @property
    def doc_count(self) -> int:
        return sum(s.docs for s in self.segments)

    @property
    def total_length(self) -> int:
        return sum(s.total_length for s in self.segments)

    @property
    def max_doc_id(self) -> int:
        return max((s.max_id for s in self.segments), default=-1)

    def segment_of(self, key: str | None) -> Segment | None:
        return next((s for s in self.segments if key is not None and s.key == key), None)


def file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers of the files ``<kind>-<number>.json`` in order."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[len(kind) + 1 : -len(".json")]) for n in names if n.startswith(f"{kind}-") and n.endswith(".json"))


def versions(spark: SparkSession, path: str) -> list[int]:
    return _numbers(spark, path, "manifest")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, read by the driver without a job."""
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read_manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The manifest of ``version``, by default the newest; ValueError if there is none or its format is unknown."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no index version {version if version is not None else ''} at {path}")
    told = json.loads(read_text(spark, f"{path}/manifest-{version or known[-1]}.json"))
    if told["format"] != FORMAT:
        raise ValueError(f"index format {told['format']} is not known")
    return Manifest(told["version"], [Segment(**s) for s in told["segments"]])


def _take(spark: SparkSession, path: str, text: str) -> bool:
    """Writes the file ``path`` whole, unless it exists already; tells whether it did."""
    fs, p = file_system(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.getUri().getScheme() == "file":  # a rename would overwrite here; a link does not
        source, target = (str(x.toUri().getPath()) for x in (draft, p))
        try:
            os.link(source, target)
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(draft, False)
    if not fs.exists(p) and fs.rename(draft, p):
        return True
    fs.delete(draft, False)
    return False


def reserve_ids(spark: SparkSession, path: str, count: int) -> int:
    """The first of ``count`` ids that no one else is given, after all ids of the index."""
    for _ in range(MAX_TRIES):
        known = _numbers(spark, path, "ids")
        handed = int(read_text(spark, f"{path}/ids-{known[-1]}.json")) if known else 0
        start = max(handed, read_manifest(spark, path).max_doc_id + 1 if versions(spark, path) else 0)
        if _take(spark, f"{path}/ids-{known[-1] + 1 if known else 1}.json", str(start + count)):
            return start
    raise RuntimeError(f"no ids to be had at {path}")


def _clash(spark: SparkSession, path: str, new: Segment, others: list[Segment]) -> int | None:
    """A doc_id of ``new`` that one of ``others`` has as well; segments whose ranges do not meet are not read."""
    near = [s.name for s in others if s.min_id <= new.max_id and new.min_id <= s.max_id]
    if not near:
        return None
    held = spark.read.parquet(*[f"{path}/{s}/doc_table" for s in near]).select("doc_id").where(F.col("doc_id").between(new.min_id, new.max_id))
    row = spark.read.parquet(f"{path}/{new.name}/doc_table").select("doc_id").join(held, "doc_id", "left_semi").first()
    return None if row is None else row[0]


def _write_segment(spark: SparkSession, path: str, corpus: DataFrame, key: str | None) -> Segment:
    name = f"segment-{uuid.uuid4().hex}"
    base = f"{path}/{name}"
    build.postings(corpus).repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.parquet(f"{base}/postings")
    post = spark.read.parquet(f"{base}/postings")
    build.dictionary(post).sortWithinPartitions("term").write.parquet(f"{base}/terms")
    # a document's length has travelled with its postings: the texts are not tokenized a second time
    lengths = post.groupBy("doc_id").agg(F.max("doc_len").cast("int").alias("length"))
    docs = corpus.select("doc_id", "external_id", "url", "title").join(lengths, "doc_id", "left").na.fill(0, ["length"])
    docs.write.parquet(f"{base}/doc_table")
    corpus.select("doc_id", "content").sortWithinPartitions("doc_id").write.parquet(f"{base}/contents")
    table = spark.read.parquet(f"{base}/doc_table")
    got = table.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.min("doc_id"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(-1)), F.count_if(F.col("doc_id").isNull())).first()
    twice = table.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").first()
    n = post.count()
    if got[4] or twice is not None:
        _drop(spark, path, name)
        raise ValueError("a doc_id is null" if got[4] else f"doc_id {twice[0]} is given twice")
    return Segment(name, got[0], got[1], n, got[2], got[3], key)


def _drop(spark: SparkSession, path: str, name: str) -> None:
    fs, p = file_system(spark, f"{path}/{name}")
    fs.delete(p, True)


def append_segment(spark: SparkSession, path: str, corpus: DataFrame, key: str | None = None) -> tuple[Manifest, Segment]:
    """Indexes ``corpus`` and adds it as a segment; the manifest, and the segment. Earlier segments are not touched.

    A corpus without a column doc_id gets the ids after the highest; of one with ids, each has to be new (ValueError
    otherwise, and nothing is added). With a ``key`` already present nothing is done, so a batch that is sent again
    leaves no trace. Any number of writers may append at once, from any number of machines.
    """
    m = read_manifest(spark, path) if versions(spark, path) else Manifest()
    if (old := m.segment_of(key)) is not None:
        return m, old
    if "doc_id" not in corpus.columns:
        numbered, count = number_rows(corpus)
        start = reserve_ids(spark, path, count)
        corpus = numbered.withColumn("doc_id", F.col("doc_id") + F.lit(start))
    new = _write_segment(spark, path, corpus, key)
    checked = 0
    for _ in range(MAX_TRIES):
        m = read_manifest(spark, path) if versions(spark, path) else Manifest()
        if (old := m.segment_of(key)) is not None:
            _drop(spark, path, new.name)
            return m, old
        clash = _clash(spark, path, new, m.segments[checked:])
        if clash is not None:
            _drop(spark, path, new.name)
            raise ValueError(f"doc_id {clash} is in the index already")
        checked = len(m.segments)
        grown = Manifest(m.version + 1, [*m.segments, new])
        if _take(spark, f"{path}/manifest-{grown.version}.json", json.dumps(asdict(grown))):
            return grown, new
    _drop(spark, path, new.name)
    raise RuntimeError(f"no version to be had at {path}")


def read_table(spark: SparkSession, path: str, m: Manifest, table: str) -> DataFrame:
    """``postings``, ``terms``, ``doc_table`` or ``contents`` of all live segments."""
    return spark.read.parquet(*[f"{path}/{s.name}/{table}" for s in m.segments])


def remove(spark: SparkSession, path: str) -> None:
    """Deletes an index."""
    fs, p = file_system(spark, path)
    fs.delete(p, True)
