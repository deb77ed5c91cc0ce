"""Near-duplicate components: fast similarity sketching, banding, exact verification.

1. Each text becomes its set of five-word shingles and a sketch of ``SLOTS`` coordinates. Round i throws every shingle
   into a random slot with a value in [i, i + 1); in the last SLOTS rounds the slot is fixed, so every coordinate of
   every set is filled. A slot keeps its smallest value, and the share of equal slots is concentrated around the
   Jaccard similarity.
2. Texts with the same set are one class, named by its smallest doc_id; only class representatives go on.
3. ``BANDS`` bands of ``ROWS`` slots put a representative into buckets. At a similarity of 0.85 a pair misses all
   buckets with a chance of (1 - 0.85 ** 4) ** 32, about 5e-11, at one of 0.8 of (1 - 0.8 ** 4) ** 32, about 5e-8.
4. Each bucket links its members to its smallest one, verified on full sets. That joins true groups in linear work.
5. Buckets that still hold several components are searched exactly. Two sets that are similar enough share one of their
   rarest shingles (prefix filter, any fixed order is exact), so texts that merely share a passage part here. What still
   meets is compared in blocks of bounded size: a task gets two blocks, counts all intersections through one sorted
   index, and returns at most a spanning set of links. No list of pairs is built and no partner is capped.
6. Links become components by star contraction on the cluster.

Defined results: null, empty and blank texts have no set, stay alone and are kept. A row without doc_id takes part in
its class, and if the whole class has none, its component is null and it is kept. Repeated rows are all returned with
the same component; rows of one doc_id with different texts may be joined through that id. Other columns are passed on
untouched by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm.common import Workspace, table
from gristmill.llm.components import connected
from gristmill.llm.shingles import common, mix, shingle_set

BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: Link while per_cent * union <= 100 * intersection; this is the threshold of op10, other callers give their own.
PER_CENT = 85
#: Shingles that a block of the exact comparison holds, about.
BLOCK = 250_000
#: Texts that are hashed together, and the shingles after which a group is closed early.
_GROUP, _GROUP_SHINGLES = 512, 1 << 18
#: Rows of texts or sets that Python gets at once.
_ROWS = 1000

_U = np.uint64
_EMPTY = np.iinfo(np.uint64).max
_VALUE = _U((1 << 56) - 1)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SLOTS coordinates per non-empty set."""
    count = len(sets)
    slots = np.full(count * SLOTS, _EMPTY, dtype=np.uint64)
    x = np.concatenate(sets)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    for i in range(2 * SLOTS):
        seed = _U((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        m = mix(x ^ seed)
        at = (m >> _U(57)).astype(np.int64) if i < SLOTS else i - SLOTS
        np.minimum.at(slots, owner * SLOTS + at, (m & _VALUE) | _U(min(i, 254) << 56))
        unfilled = (slots.reshape(count, SLOTS) == _EMPTY).any(axis=1)
        if not unfilled.any():
            break
        go_on = unfilled[owner]
        x, owner = x[go_on], owner[go_on]
    return slots.reshape(count, SLOTS)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.zeros((len(sketch), BANDS), dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key ^ parts[:, :, k])
    return mix(key ^ np.arange(BANDS, dtype=np.uint64))


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        start = 0
        while start < len(texts):
            sets, total, stop = [], 0, start
            while stop < len(texts) and stop - start < _GROUP and total < _GROUP_SHINGLES:
                sets.append(shingle_set(texts[stop].as_py()))
                total += len(sets[-1])
                stop += 1
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = band_keys(sketches([sets[i] for i in full])).view(np.int64) if full else None
            row = dict(zip(full, range(len(full)), strict=True))
            digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            pairs = [np.frombuffer(d, dtype=np.int64) if d else (None, None) for d in digest]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(start, stop - start),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([p[0] for p in pairs], pa.int64()),
                    pa.array([p[1] for p in pairs], pa.int64()),
                    pa.array([keys[row[i]] if i in row else None for i in range(len(sets))], pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "ca", "cb", "bands"],
            )
            start = stop


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), _GROUP):
            part = batch.slice(start, _GROUP)
            sets = [shingle_set(t.as_py()).view(np.int64) for t in part.column(1)]
            ends = np.cumsum([0, *map(len, sets)])
            flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["rep", "items"]
            )


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The sets of a list column, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        return [x for chunk in column.chunks for x in _lists(chunk)]
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    ends = column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def similar(a: np.ndarray, b: np.ndarray, per_cent: int = PER_CENT) -> bool:
    both = common(a, b)
    return 100 * both >= per_cent * (len(a) + len(b) - both)


def _verify(per_cent: int):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            pairs = zip(_lists(batch.column(2)), _lists(batch.column(3)), strict=True)
            ok = pa.array([similar(a, b, per_cent) for a, b in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["u", "v"])

    return batches


def _compare_blocks(group: pa.Table, per_cent: int) -> pa.Table:
    """Links between the components of two blocks (or inside one): enough to connect what is similar."""
    reps = group.column("rep").to_numpy()
    sets = _lists(group.column("items"))
    side = group.column("side").to_numpy()
    root = {c: c for c in group.column("comp").to_pylist()}
    comp = group.column("comp").to_pylist()

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    left = np.flatnonzero(side == side.min())
    right = np.flatnonzero(side == side.max())
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate([sets[i] for i in right])
    owners = np.repeat(np.arange(len(right)), sizes[right])
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    found = []
    for i in left:
        lo, hi = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        width = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
        both = np.bincount(owners[at], minlength=len(right))
        for j in np.flatnonzero(100 * both >= per_cent * (sizes[i] + sizes[right] - both)):
            x, y = find(comp[i]), find(comp[right[j]])
            if x != y:
                root[max(x, y)] = min(x, y)
                found.append((reps[i], reps[right[j]]))
    return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})


def _open_buckets(members: DataFrame) -> DataFrame:
    """Buckets that hold several components; buckets with the same members count once."""
    seen = members.groupBy("bucket").agg(
        F.count("*").alias("c"),
        F.min("comp").alias("low"),
        F.max("comp").alias("high"),
        F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s"),
        F.min("rep").alias("r"),
        F.sum("n").alias("items"),
    )
    return (
        seen.where("c > 1 AND low <> high").groupBy("c", "s", "r", "items").agg(F.min("bucket").alias("bucket")).select("bucket", "items")
    )


def _residual_links(open_members: DataFrame, sets: DataFrame, work: Workspace, per_cent: int) -> DataFrame:
    """Exact search among the members of open buckets: links (u, v) between different components, written."""
    reps = work.put(open_members.select("rep", "comp", "n").distinct(), "residual")
    items = sets.join(reps.select("rep"), "rep", "left_semi").select("rep", F.explode("items").alias("item"))
    items = work.put(items, "items")
    shared = items.groupBy("item").agg(F.count("*").alias("f")).where("f > 1")
    held = items.join(shared, "item").join(reps, "rep")
    # the rarest shingles come first; those of one set only need no bucket but take up room in the prefix
    by_rarity = Window.partitionBy("rep").orderBy("f", "item")
    held = held.withColumn("k", F.row_number().over(by_rarity)).withColumn("m", F.count("*").over(Window.partitionBy("rep")))
    room = F.col("n") - F.ceil(F.col("n") * per_cent / 100) + 1 - (F.col("n") - F.col("m"))
    prefix = work.put(held.where(F.col("k") <= room).select("rep", "comp", "n", F.col("item").alias("bucket")), "prefix")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("items") / BLOCK)).cast("int")
    rows = (
        prefix.join(_open_buckets(prefix).select("bucket", blocks.alias("blocks")), "bucket")
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", "rep", "comp", F.col("block").alias("side"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    found = rows.join(sets, "rep").groupBy("bucket", "i", "j").applyInArrow(lambda group: _compare_blocks(group, per_cent), "u bigint, v bigint")
    more = work.put(found, "more-links", _ROWS)
    work.drop(reps, items, prefix)
    return more


def components(docs: DataFrame, work: Workspace, per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = work.put(
        source.mapInArrow(_sketch_batches, "doc_id bigint, n bigint, ca bigint, cb bigint, bands array<bigint>"), "sketches", _ROWS
    )
    classes = work.put(
        sketched.where("ca IS NOT NULL")
        .groupBy("ca", "cb")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        .where("rep IS NOT NULL"),
        "classes",
    )
    banded = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("c"), F.min(F.struct("rep", "n")).alias("first")).where("c > 1")
    buckets = work.put(banded.join(shared.select("bucket", "first"), "bucket"), "buckets")
    involved = buckets.select("rep").distinct()
    sets = work.put(
        source.select(F.col("doc_id").alias("rep"), "text")
        .join(involved.hint("shuffle_hash"), "rep", "left_semi")
        .mapInArrow(_set_batches, "rep bigint, items array<bigint>"),
        "sets",
        _ROWS,
    )
    close = F.least("n", "first.n") * 100 >= F.greatest("n", "first.n") * per_cent
    pairs = buckets.where((F.col("rep") != F.col("first.rep")) & close).select(F.col("rep").alias("u"), F.col("first.rep").alias("v")).distinct()
    links = work.put(
        pairs.join(sets.select(F.col("rep").alias("u"), F.col("items").alias("a")), "u")
        .join(sets.select(F.col("rep").alias("v"), F.col("items").alias("b")), "v")
        .select("u", "v", "a", "b")
        .mapInArrow(_verify(per_cent), "u bigint, v bigint"),
        "links",
        _ROWS,
    )
    first = work.put(connected(links, work), "components")
    members = work.put(
        buckets.select("bucket", "rep", "n").join(first.withColumnRenamed("node", "rep"), "rep", "left")
        .select("bucket", "rep", "n", F.coalesce("component", "rep").alias("comp")),
        "members",
    )
    still_open = members.join(_open_buckets(members).select("bucket"), "bucket", "left_semi")
    more = _residual_links(still_open, sets, work, per_cent)
    final = work.put(connected(first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more), work), "final")
    work.drop(buckets, sets, links, first, members, more)
    named = classes.select("ca", "cb", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("ca", "cb", F.coalesce("component", "rep").alias("component_id"))
    return (
        sketched.select("doc_id", "n", "ca", "cb")
        .join(named, ["ca", "cb"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("ca").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    )


def dedup(docs: DataFrame, work: Workspace | None = None, per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    out = components(docs, work or Workspace(docs.sparkSession, "near-dedup"), per_cent)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep(docs: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """The documents without those that a smaller doc_id stands for; all columns are kept."""
    gone = dedup(docs, per_cent=per_cent).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The same rows by joining all shingles; for small tables only.
ORACLE_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i+4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 4))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * c >= {PER_CENT} * (nu.n + nv.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.other = e.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c ON d.doc_id = c.doc_id
"""
