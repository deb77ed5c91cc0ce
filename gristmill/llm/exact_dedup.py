"""Exact dedup over a persistent index of text digests, bucketed and sorted by digest.

The index is a folder with *segments* and *deltas*, all sorted runs of one bucketing, and a numbered manifest that names
them. A batch is aggregated per digest, which is its only shuffle, and merge-anti-joins the segments; digests that none of
them holds are appended as a segment with their keeper, and for the others a delta has how many rows they got. So the
keeper of a digest is written once, by the batch that brought it, and a text that is seen later never replaces it. When
``FANOUT`` appends have gathered, they are merged into one segment. A manifest is written after the files it names, so an
append that broke off has not happened, and a session that opens the folder goes on from the last whole one.

Who calls the index decides what "first" means by the order of batches; :func:`dedup` deals documents in descending
doc_id, so the largest one stays. Only digests, doc_ids and places are shuffled. Copies of a text may be a third of all
rows: they are counted before the shuffle, and the groups with more than one row in ``SPREAD``, of which there are at most
``SPREAD``, meet their members by broadcast. Everything is native.

Two texts are equal if their SHA-256 are. Defined results: a null text is an empty one; of rows that are equal in text and
doc_id exactly one stays; a null doc_id is smaller than any other and a group of none but such rows has no keep_id. Other
columns are passed on untouched, whatever their names.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import Workspace, table
from gristmill.llm.sorted_runs import BUCKETS_MOST, SortedRuns

BATCHES = 4
FANOUT = 8
#: Rows of a bucket of the index, about.
BUCKET_ROWS = 1_000_000
#: A group with more than one row in so many is hot.
SPREAD = 2000

_SCHEMA = "digest binary, n bigint, keep struct<doc_id: bigint, row: bigint>"


def digest_of(text: Column) -> Column:
    """The 32 bytes of the text's SHA-256; null is the empty text."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


class DigestIndex:
    """The index of a folder. ``buckets`` counts when the folder is new; an old one keeps its own."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 2, fanout: int = FANOUT):
        self.spark, self.root, self.fanout = spark, root.rstrip("/"), fanout
        self.version, state = self._newest()
        self.segments: list[str] = state.get("segments", [])
        self.deltas: list[str] = state.get("deltas", [])
        self.runs = SortedRuns(spark, self.root, ["digest"], _SCHEMA, state.get("buckets", buckets))

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *error) -> None:
        self.runs.close()

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _newest(self) -> tuple[int, dict]:
        top, fs = self._fs("")
        names = [str(x.getPath().getName()) for x in fs.listStatus(top)] if fs.exists(top) else []
        version = max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)
        if not version:
            return 0, {}
        path, fs = self._fs(f"manifest-{version:08d}.json")
        stream = fs.open(path)
        try:
            return version, json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self) -> None:
        """The next manifest; it gets its name when it is whole."""
        self.version += 1
        made, fs = self._fs(f"_manifest-{self.version:08d}")
        stream = fs.create(made, True)
        stream.write(bytearray(json.dumps({"segments": self.segments, "deltas": self.deltas, "buckets": self.runs.buckets}).encode()))
        stream.close()
        if not fs.rename(made, self._fs(f"manifest-{self.version:08d}.json")[0]):
            raise RuntimeError(f"{self.root}: another writer has made version {self.version}")

    def novel(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows`` (digest, ...) whose digest no segment holds."""
        return reduce(lambda left, s: left.join(self.runs.read(s).select("digest"), "digest", "left_anti"), self.segments, rows)

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes a batch (digest, doc_id, row) in; returns what it has brought: (digest, n, keep), keep the largest row."""
        with self.runs.settings():
            counted = self.runs.write(batch.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("keep")), "batch")
            if self.segments:
                here = self.runs.read(counted)
                new = self.runs.write(self.novel(here), "segment")
                known = here.join(self.runs.read(new).select("digest"), "digest", "left_anti")
                self.deltas = [*self.deltas, self.runs.write(known.withColumn("keep", F.lit(None).cast(here.schema["keep"].dataType)), "delta")]
            else:
                new = counted
            self.segments = [*self.segments, new]
            self._commit()
            if new != counted:
                self.runs.drop(counted)
            if len(self.segments) > self.fanout:
                self.compact()
            return self.runs.read(new)

    def compact(self) -> None:
        """All segments and deltas as one segment; the old files go when the manifest names the new one."""
        with self.runs.settings():
            old = [*self.segments, *self.deltas]
            self.segments, self.deltas = [self.runs.write(self.groups(), "segment")], []
            self._commit()
            self.runs.drop(*(x for x in old if x not in self.segments))

    def groups(self) -> DataFrame:
        """(digest, n, keep), one row per digest."""
        # their files are read without their buckets, which a union of scans would claim without having them (Spark 4.1.2)
        runs = self.spark.read.schema(_SCHEMA).parquet(*(f"{self.root}/{x}" for x in (*self.segments, *self.deltas)))
        return runs.groupBy("digest").agg(F.sum("n").alias("n"), F.max("keep").alias("keep"))


def _buckets(spark: SparkSession, rows: int) -> int:
    """As many buckets as the rows need; as many as the session deals to where it does not want them joined."""
    if spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") != "true":
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(BUCKETS_MOST, max(2, math.ceil(rows / BUCKET_ROWS)))


def _held(docs: DataFrame, work: Workspace) -> DataFrame:
    """(doc_id, row, digest) of each document row; ``row`` tells equal rows apart."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), digest_of(F.col("text")).alias("digest"))
    return work.put(rows, "digests")


def _groups(held: DataFrame, work: Workspace, rows: int, batches: int) -> DataFrame:
    """(digest, n, keep) of all rows, written, through an index that takes them in descending order of doc_id."""
    spark = held.sparkSession
    cuts = sorted({int(x) for x in held.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)}) if batches > 1 else []
    edges = [None, *cuts, None]
    with DigestIndex(spark, work.path("index"), _buckets(spark, rows)) as index:
        for low, high in reversed(list(zip(edges[:-1], edges[1:], strict=True))):
            inside = F.lit(True) if low is None else F.col("doc_id") >= low
            if high is not None:
                inside = inside & (F.col("doc_id") < high)
            if low is None:
                inside = inside | F.col("doc_id").isNull()  # smaller than any other
            index.add(held.where(inside))
        with index.runs.settings():
            return work.put(index.groups(), "groups")


def _meet(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """``rows`` (digest, ...) with n and keep of their group. Hot groups, at most ``SPREAD``, are met by broadcast."""
    hot = groups.where(F.col("n") * SPREAD > total)
    cold = groups.where(F.col("n") * SPREAD <= total)
    few = rows.join(F.broadcast(hot), "digest")
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold.hint("merge"), "digest")
    return few.unionByName(rest)


def dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256, one row per document row."""
    work = Workspace(docs.sparkSession, "exact-dedup")
    held = _held(docs, work)
    total = held.count()
    groups = _groups(held, work, total, batches)
    return _meet(held, groups, total).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The documents without the copies, all columns kept."""
    work = Workspace(docs.sparkSession, "exact-dedup")
    held = _held(docs, work)
    total = held.count()
    groups = _groups(held, work, total, batches)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")).withColumn("digest", digest_of(F.col("d.text")))
    top = _meet(whole, groups, total).where(F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("keep.doc_id")))
    # only rows that repeat both text and doc_id are still more than one
    again = held.groupBy("digest", "doc_id").agg(F.count("*").alias("times")).where("times > 1").select("digest").distinct()
    if not again.isEmpty():
        again = work.put(again, "again")
        top = top.join(again, "digest", "left_anti").select("d").unionByName(top.join(again, "digest", "left_semi").dropDuplicates(["digest"]).select("d"))
    return top.select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])


def new_documents(docs: DataFrame, index: DigestIndex, work: Workspace | None = None) -> DataFrame:
    """(doc_id, text_sha256) of the documents of a batch that an index has not seen, one per text; the index has them then."""
    held = _held(docs, work or Workspace(docs.sparkSession, "exact-dedup"))
    new = index.add(held)
    return new.select(F.col("keep.doc_id").alias("doc_id"), F.lower(F.hex("digest")).alias("text_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, (count(*) OVER w)::BIGINT AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
