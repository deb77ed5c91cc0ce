"""Line dedup over levelled sorted runs of line hashes.

A *run* is a table bucketed and sorted by line hash with one row per hash: the number of documents that hold the line and,
in the run that brought the line, its keeper. Batches of documents come in descending order of doc_id. A new batch
merge-anti-joins the runs: hashes that no run holds are new and get their largest doc_id as keeper, the others add only
to the count. So a keeper is written once, by the first batch that has the line. Every ``FANOUT`` runs of a level are compacted into one run of the next level, so a batch meets a number
of runs that is logarithmic in the number of batches. All runs have the same buckets, each one sorted file, so anti-joins
and compactions of two neither shuffle nor sort them; a batch is shuffled once, after a partial aggregation.

A line that is common enough loses all copies but those in its keeper. Only hashes, doc_ids and places are shuffled, and
a line that stands in a third of all documents costs one row per task. Texts move once, to meet the places of the lines
that they lose; they are cut at these places without looking at their lines again.

A hash is 128 bits: two 64-bit hashes of the key under different seeds. Everything is native.

Defined results: null and empty texts have one empty line, which is never dropped. A document is a doc_id: rows that repeat
a doc_id count once, whatever their texts, and share their keeper. Rows without doc_id are no documents that could be
counted or kept, and are left as they are. Other columns are passed on untouched, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import SPACE, Workspace, let, table
from gristmill.llm.sorted_runs import BUCKETS_MOST, SortedRuns

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2
#: Rows of a bucket of the runs, about, and the least buckets.
BUCKET_ROWS, BUCKETS_LEAST = 500_000, 2
_RUN = "a bigint, b bigint, n_docs bigint, keep_id bigint"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACE)), _UPPER, _LOWER)


def hash_of(key: Column) -> Column:
    """128 bits, or null for a key that is too short to count."""
    return F.when(
        F.char_length(key) >= MIN_CHARS, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))
    )


def places_of(text: Column) -> Column:
    """(a, b, i, first) of the lines that are long enough: hash, place from 0, whether no earlier line has this hash."""
    hashes = F.transform(lines_of(text), lambda x, i: F.struct(let(key_of(x), hash_of).alias("h"), i.alias("i")))
    long = F.sort_array(F.transform(F.filter(hashes, lambda x: x["h"].isNotNull()), lambda x: F.struct(x["h"]["a"].alias("a"), x["h"]["b"].alias("b"), x["i"].alias("i"))))

    def told(rows: Column) -> Column:
        def row(x: Column, k: Column) -> Column:
            before = F.get(rows, k - 1)
            first = before.isNull() | (before["a"] != x["a"]) | (before["b"] != x["b"])
            return F.struct(x["a"].alias("a"), x["b"].alias("b"), x["i"].alias("i"), first.alias("first"))

        return F.transform(rows, row)

    return let(long, told)


class LineRuns:
    """The levelled runs. ``add`` takes batches in descending order of doc_id."""

    def __init__(self, spark: SparkSession, work: Workspace, buckets: int, fanout: int = FANOUT):
        self.spark, self.work, self.buckets, self.fanout = spark, work, buckets, fanout
        self.files = SortedRuns(spark, work.path("runs"), ["a", "b"], _RUN, buckets)
        self.levels: list[list[str]] = []

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *error) -> None:
        self.files.close()

    def runs(self) -> list[DataFrame]:
        return [self.files.read(run) for level in self.levels for run in level]

    def _settings(self):
        return self.files.settings()

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        """One sorted run of several, by merge joins of whole buckets."""

        def both(x: DataFrame, y: DataFrame) -> DataFrame:
            y = y.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("n_docs").alias("n2"), F.col("keep_id").alias("keep2"))
            return x.join(y, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")), "full").select(
                F.coalesce("a", "a2").alias("a"),
                F.coalesce("b", "b2").alias("b"),
                (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n2", F.lit(0))).cast("bigint").alias("n_docs"),
                F.coalesce("keep_id", "keep2").alias("keep_id"),  # one run at most has it
            )

        return reduce(both, runs)

    def novel(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` (a, b, ...) whose line no run holds."""
        return reduce(lambda rows, run: rows.join(run.select("a", "b"), ["a", "b"], "left_anti"), self.runs(), batch)

    def add(self, batch: DataFrame) -> None:
        """``batch``: one row (a, b, doc_id) per document and distinct line. It is aggregated and shuffled once."""
        with self._settings():
            counted = self.files.write(batch.groupBy("a", "b").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keep_id")), "batch")
            if not self.levels:
                return self._put(counted, 0)
            here = self.files.read(counted)
            new = self.files.write(self.novel(here).select("a", "b", "keep_id"), "new")
            run = self.files.write(here.select("a", "b", "n_docs").join(self.files.read(new), ["a", "b"], "left"))
            self.files.drop(counted, new)
            self._put(run, 0)

    def _put(self, run: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(self.files.write(self._merge([*map(self.files.read, full)])), level + 1)
            self.files.drop(*full)

    def repeated(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(a, b, keep_id) of the lines in at least ``min_docs`` documents, written; the runs go."""
        with self._settings():
            merged = self._merge(self.runs())
            out = self.work.put(merged.where(F.col("n_docs") >= min_docs).select("a", "b", "keep_id"), "repeated")
        self.files.drop(*(run for level in self.levels for run in level))
        self.levels = []
        return out


def _buckets(spark: SparkSession, rows: int) -> int:
    """As many buckets as the rows need; as many as the session deals to where it does not want them joined."""
    if spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") != "true":
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(BUCKETS_MOST, max(BUCKETS_LEAST, math.ceil(rows / BUCKET_ROWS)))


def _row_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _dropped_by_document(docs: DataFrame, batches: int) -> DataFrame:
    """(drop_id, drop_text, at) for each document row that loses lines: doc_id, hash of the text, ordered places."""
    spark = docs.sparkSession
    work = Workspace(spark, "line-dedup")
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    held = work.put(
        source.select("doc_id", _row_key(F.col("text")).alias("t"), F.explode(places_of(F.col("text"))).alias("p")).select("doc_id", "t", "p.a", "p.b", "p.i", "p.first"),
        "held",
    )
    once = held.where("first").select("doc_id", "a", "b")
    again = source.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not again.isEmpty():  # only rows that repeat a doc_id can hold a line of it twice
        again = work.put(again, "again")
        once = once.join(again, "doc_id", "left_anti").unionByName(once.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "a", "b"]))
    cuts = sorted({int(x) for x in held.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)}) if batches > 1 else []
    edges = [None, *cuts, None]
    with LineRuns(spark, work, _buckets(spark, held.count())) as runs:
        for low, high in reversed(list(zip(edges[:-1], edges[1:], strict=True))):
            inside = F.lit(True)
            if low is not None:
                inside = inside & (F.col("doc_id") >= low)
            if high is not None:
                inside = inside & (F.col("doc_id") < high)
            runs.add(once.where(inside))
        hot = runs.repeated()
    return (
        held.join(hot, ["a", "b"])
        .where(F.col("doc_id") != F.col("keep_id"))
        .groupBy(F.col("doc_id").alias("drop_id"), F.col("t").alias("drop_text"))
        .agg(F.sort_array(F.collect_set("i")).alias("at"))
    )


def _with_decision(docs: DataFrame, batches: int) -> DataFrame:
    """(d: the whole row, r: struct n_lines, n_dropped, text)."""
    dropped = _dropped_by_document(docs, batches)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    text, doc_id = F.col("d.text").cast("string"), F.col("d.doc_id").cast("bigint")
    # the hash of the text deals rows without doc_id, and those that share one, over all tasks
    joined = whole.join(dropped, (doc_id == F.col("drop_id")) & (_row_key(text) == F.col("drop_text")), "left")

    def cut(parts: Column) -> Column:
        """What stands between the places, each stretch taken whole."""

        def stretch(k: Column) -> Column:
            start = F.coalesce(F.get(F.col("at"), k - 1) + 1, F.lit(0))
            return F.slice(parts, start + 1, F.coalesce(F.get(F.col("at"), k), F.size(parts)) - start)

        return F.struct(
            F.size(parts).cast("bigint").alias("n_lines"),
            F.size("at").cast("bigint").alias("n_dropped"),
            F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("at")), stretch)), "\n").alias("text"),
        )

    untouched = F.struct(
        F.size(lines_of(text)).cast("bigint").alias("n_lines"),
        F.lit(0).cast("bigint").alias("n_dropped"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    return joined.select("d", F.when(F.col("at").isNull(), untouched).otherwise(let(lines_of(text), cut)).alias("r"))


def dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that stays, one row per document."""
    return _with_decision(docs, batches).select(F.col("d.doc_id").alias("doc_id"), "r.n_lines", "r.n_dropped", "r.text")


def keep(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The documents with their repeated lines removed, all columns kept; ``n_chars`` follows the text if it is there."""
    out = _with_decision(docs, batches)
    cols = []
    for c in docs.columns:
        value = F.col(f"d.`{c}`")
        if c == "text":
            value = F.when(F.col("r.n_dropped") > 0, F.col("r.text")).otherwise(value)
        elif c == "n_chars":
            value = F.when(F.col("r.n_dropped") > 0, F.char_length("r.text").cast(docs.schema[c].dataType)).otherwise(value)
        cols.append(value.alias(c))
    return out.select(*cols)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH l AS (SELECT doc_id, i, line,
                  translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            '{_UPPER}', '{_LOWER}') AS key
           FROM (SELECT doc_id, unnest(parts) AS line, unnest(generate_series(1, len(parts))) AS i
                 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
hot AS (SELECT key, max(doc_id) AS keep_id FROM l WHERE length(key) >= {MIN_CHARS}
        GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
j AS (SELECT l.*, (hot.key IS NOT NULL AND l.doc_id <> hot.keep_id) AS gone FROM l LEFT JOIN hot ON l.key = hot.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
