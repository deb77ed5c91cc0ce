"""Importance resampling towards a target: documents whose hashed words look like those of the target are drawn more often.

1. Words are hashed to ``buckets``. A document becomes two short arrays, its buckets and how often each occurs, at most one
   entry per bucket however long the text; they are written, so texts are read and hashed once.
2. Tasks add their arrays up, Spark adds up the tasks: counts per bucket over all documents and over the whole target.
3. The gain of a bucket is an integer; ``buckets`` of them are all that goes to the tasks. A document's weight is one
   product of arrays, and Gumbel noise, seeded by its doc_id, makes the highest scores a draw without replacement.
4. Scores are integers, so their histogram is exact. It is dealt by range of score, best first; what stands before a range
   is the sum of the ranges before it, and a running sum inside gives each score the number of documents above it. Scores
   with fewer above them than are drawn survive, and only documents with such scores are joined and ranked: by doc_id
   within their score.

No step sorts all documents or meets a group that grows with them: noise spreads equal weights over scores (at most one
in 2,700 of them has the same), and what still ties is ranked by counts per score, doc_id and salt.

Defined results: a null text has no words, weight 0 and no rank, as has any with fewer than ``least_words``; a row without
doc_id is seeded with ``seed:`` alone and comes after others of its score; rows that repeat a doc_id and a text tie, and
take successive ranks; an empty target makes rare buckets gain; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm.common import Workspace, table

#: Bytes of words: 0-9, a-z, A-Z as a-z, and all of other scripts; the rest is space.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Bytes of a text that are split into words at once.
CHUNK = 4 << 20
#: Rows that Python gets at once, and rows of one score and doc_id that are ranked together, about.
ROWS, TIED = 1000, 50_000


@dataclass(frozen=True)
class Draw:
    """What is drawn: runs of ``shortest`` to ``longest`` words are features; ``per_cent`` of the eligible documents stay."""

    buckets: int = 10_000
    shortest: int = 1
    longest: int = 1
    scale: int = 1000
    seed: str = "2024"
    least_words: int = 20
    per_cent: int = 10


def word_lists(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in stretches of about ``CHUNK`` bytes that end between words."""
    text, at = raw.translate(_WORD_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + CHUNK)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def features(raw: bytes | None, how: Draw) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words; buckets in ascending order; how often each occurs."""
    words, kinds, times = 0, np.empty(0, np.int64), np.empty(0, np.int64)
    before: list[bytes] = []
    for here in word_lists(raw or b""):
        words += len(here)
        both, old = before + here, len(before)
        hashes: list[int] = []
        for n in range(how.shortest, how.longest + 1):
            first = max(0, old - n + 1)  # runs that end in this stretch
            hashes.extend(map(zlib.crc32, both[first:] if n == 1 else (b" ".join(both[i : i + n]) for i in range(first, len(both) - n + 1))))
        found, n_found = np.unique(np.array(hashes, np.int64) % how.buckets, return_counts=True)
        if len(kinds):
            dense = np.bincount(kinds, times, how.buckets) + np.bincount(found, n_found, how.buckets)
            found = np.flatnonzero(dense)
            n_found = dense[found].astype(np.int64)
        kinds, times = found, n_found
        before = both[len(both) - how.longest + 1 :] if how.longest > 1 else []
    return words, kinds, times


_COUNTED = "doc_id bigint, place bigint, n_words bigint, n_features bigint, bucket array<int>, times array<bigint>"


def _count(how: Draw):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [features(t.as_py(), how) for t in batch.column(2)]
            ends = pa.array(np.cumsum([0, *(len(k) for _, k, _ in found)]), pa.int32())
            flat = [np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (1, 2)]
            lists = [pa.ListArray.from_arrays(ends, pa.array(v, kind)) for v, kind in zip(flat, (pa.int32(), pa.int64()), strict=True)]
            sums = pa.array([int(t.sum()) for *_, t in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([n for n, *_ in found], pa.int64()), sums, *lists], ["doc_id", "place", "n_words", "n_features", "bucket", "times"]
            )

    return batches


def counted(docs: DataFrame, how: Draw = Draw()) -> DataFrame:
    """Buckets and counts of each document; ``place`` tells equal rows apart."""
    doc_id = F.col("doc_id").cast("bigint") if "doc_id" in docs.columns else F.lit(None).cast("bigint")
    source = docs.select(doc_id.alias("doc_id"), F.monotonically_increasing_id().alias("place"), F.col("text").cast("string").cast("binary").alias("raw"))
    return source.mapInArrow(_count(how), _COUNTED)


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def totals(found: DataFrame, how: Draw = Draw()) -> np.ndarray:
    """How often each bucket occurs in all of ``found``; a task sends one row per bucket at most, the driver gets ``buckets``."""

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(how.buckets, np.int64)
        for batch in rows:
            # a batch has far fewer than 2**53 words, so sums in doubles are exact
            sums += np.bincount(_flat(batch, "bucket"), _flat(batch, "times"), how.buckets).astype(np.int64)
        here = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(here, pa.int32()), pa.array(sums[here], pa.int64())], ["bucket", "n"])

    out = np.zeros(how.buckets, np.int64)
    for r in found.select("bucket", "times").mapInArrow(add, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, how: Draw = Draw()) -> np.ndarray:
    """Integer log-ratio of each bucket, with one more of each counted."""
    all_source, all_target = float(int(source.sum()) + how.buckets), float(int(target.sum()) + how.buckets)
    return np.array([math.floor(how.scale * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, how: Draw = Draw()) -> int:
    """Gumbel noise of a document, an integer."""
    h = int(hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-how.scale * math.log(-math.log((h + 0.5) / 4294967296.0)))


def scored(found: DataFrame, gain: np.ndarray, how: Draw = Draw()) -> DataFrame:
    """doc_id, place, n_words, n_features, weight and score of each row of ``counted``."""

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ends = np.cumsum([0, *batch.column("bucket").value_lengths().to_pylist()])
            sums = np.concatenate(([0], np.cumsum(gain[_flat(batch, "bucket")] * _flat(batch, "times"))))
            weight = sums[ends[1:]] - sums[ends[:-1]]
            luck = np.fromiter((noise(d, how) for d in batch.column("doc_id").to_pylist()), np.int64, len(weight))
            kept = [batch.column(n) for n in ("doc_id", "place", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(weight, pa.int64()), pa.array(weight + luck, pa.int64())], ["doc_id", "place", "n_words", "n_features", "weight", "score"])

    return found.mapInArrow(score, "doc_id bigint, place bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def histogram(rows: DataFrame, work: Workspace) -> DataFrame:
    """(score, n, above) of all scores in ``rows``; above is how many rows have a higher one."""
    counts = rows.groupBy("score").agg(F.count("*").alias("n"))
    ranged = work.put(counts.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()), "histogram")
    # one row per range, as many as the session has shuffle partitions
    ranges = {r["part"]: (r["top"], r["n"]) for r in ranged.groupBy("part").agg(F.max("score").alias("top"), F.sum("n").alias("n")).collect()}
    before, first = 0, []
    for part, (_, n) in sorted(ranges.items(), key=lambda x: -x[1][0]):
        first.append((part, before))
        before += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(first, "part int, first bigint"))
    inside = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.join(offsets, "part").withColumn("above", F.col("first") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return running.select("score", "n", "above")


def _tied(rows: DataFrame) -> DataFrame:
    """Ranks of rows (score, n, above, doc_id, place, ...) that share their score: by doc_id, null last, then by place."""
    told = rows.withColumn("salt", F.pmod(F.xxhash64("place"), 1 + F.floor(F.col("n") / TIED)))
    last = F.col("doc_id").asc_nulls_last()
    sizes = told.groupBy("score", "doc_id", "salt").agg(F.count("*").alias("size"))
    before = Window.partitionBy("score").orderBy(last, "salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("score", F.col("doc_id").alias("of"), "salt", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    row = F.row_number().over(Window.partitionBy("score", "doc_id", "salt").orderBy("place"))
    return (
        told.withColumn("row", row)
        .alias("t")
        .join(base.alias("b"), (F.col("t.score") == F.col("b.score")) & (F.col("t.salt") == F.col("b.salt")) & F.col("t.doc_id").eqNullSafe(F.col("b.of")))
        .select(*[F.col(f"t.{c}").alias(c) for c in rows.columns], (F.col("above") + F.col("base") + F.col("row")).cast("bigint").alias("rank"))
    )


def resample(docs: DataFrame, target: DataFrame, how: Draw = Draw()) -> DataFrame:
    """doc_id, n_features, weight, score and rank, one row per document row; rank is null where it is not drawn."""
    work = Workspace(docs.sparkSession, "resampling")
    found = work.put(counted(docs, how), "counted", ROWS)
    gain = gains(totals(found, how), totals(counted(target, how), how), how)
    rows = work.put(scored(found, gain, how), "scored")
    work.drop(found)
    able = F.col("n_words") >= how.least_words
    drawn = rows.where(able).count() * how.per_cent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return rows.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    surviving = work.put(histogram(rows.where(able), work).where(F.col("above") < drawn), "surviving")
    cutoff = surviving.agg(F.min("score")).first()[0]
    high = able & (F.col("score") >= cutoff)
    met = rows.where(high).join(surviving.hint("merge"), "score").select("score", "n", "above", "doc_id", "place", "n_features", "weight")
    alone = met.where("n = 1").withColumn("rank", F.col("above") + 1)
    ranked = alone.unionByName(_tied(met.where("n > 1"))).select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return ranked.unionByName(rows.where(~high).select(*columns, F.lit(None).cast("bigint").alias("rank")))


def keep(docs: DataFrame, target: DataFrame, how: Draw = Draw()) -> DataFrame:
    """The documents that are drawn, all columns kept. Rows that repeat a doc_id are drawn together."""
    work = Workspace(docs.sparkSession, "resampling")
    drawn = work.put(resample(docs, target, how).where("rank IS NOT NULL").select("doc_id").distinct(), "drawn")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    met = whole.join(drawn, F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("doc_id")), "left_semi")
    return met.select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_D = Draw()
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_ALPHABET}', '{_ALPHABET.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_ALPHABET}', '{_ALPHABET.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM b) GROUP BY ALL),
tbl AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
        FROM (SELECT unnest(range(256)) AS i)),
x AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
y AS (SELECT w, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT) AS bs FROM x),
k AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, bs), lambda c, e: xor(c >> 8, t[(xor(c, e) & 255) + 1]))) % {_D.buckets} AS bucket FROM y, tbl),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM dw JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM bw JOIN k USING (w) GROUP BY bucket),
tot AS (SELECT coalesce((SELECT sum(s) FROM s), 0) + {_D.buckets} AS ss, coalesce((SELECT sum(t) FROM t), 0) + {_D.buckets} AS tt),
g AS (SELECT bucket, floor({_D.scale} * ln((coalesce(t, 0) + 1) * ss / ((s + 1) * tt)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), tot),
wt AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM dw JOIN k USING (w) JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-{_D.scale} * ln(-ln((('0x' || sha256('{_D.seed}:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM d LEFT JOIN wt USING (doc_id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, {_D.per_cent} * count(*) OVER () // 100 AS m FROM r WHERE n_features >= {_D.least_words})
SELECT r.doc_id, n_features, weight, score, (CASE WHEN rank <= m THEN rank END)::BIGINT AS rank FROM r LEFT JOIN o USING (doc_id)
"""
