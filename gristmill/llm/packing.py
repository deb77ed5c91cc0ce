"""Best-fit packing of tokenised documents into sequences, by exact-complement hashing.

A document is its token ids and an end mark; one longer than a sequence is cut into full sequences, and the first piece
takes the rest. What the plan needs is how many pieces there are of each length, at most ``LIMIT`` numbers whatever the
size of the corpus. On them the plan is made: a hash of single, pair and triple sums tells which lengths exactly fill the
gap that a piece leaves; a combination is used as often as all its lengths are available. What has no exact complement
is placed by best fit. Each step places a whole number of equal sequences, so the plan has a few thousand steps and its
cost does not depend on the number of pieces.

Pieces then get their places without meeting each other: a piece knows its rank among the pieces of its length (a count
per length and bucket plus a row number inside the bucket, so a length that a third of all pieces share is ranked in
many tasks, and rows that repeat a doc_id or have none are dealt by their place), and the plan tells which rank goes
into which sequence at which offset.

Defined results: a null text is an empty one, which is the end mark alone; repeated rows are packed again; other columns
are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm.common import Workspace, table

LIMIT = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Of each vocabulary, the JSON file with the tokens that are added to it.
ADDED = {VOCABULARY: "byte_bpe_50k.json"}
#: Pieces of one length that are ranked together, about, while that takes no more than BUCKETS groups for the length.
RANKED, BUCKETS = 400, 20_000

#: The pre-tokenisation of the vocabulary, written without backtracking; it splits alike.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@cache
def added_tokens(vocabulary: str = VOCABULARY) -> dict[str, int]:
    """Ids of the strings that are one token wherever they stand in a text."""
    import json
    from pathlib import Path

    import public_tokenizers

    tokens = json.loads(Path(public_tokenizers.path(ADDED[vocabulary])).read_bytes())["added_tokens"]
    plain = not any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not plain:
        raise ValueError(f"{vocabulary}: an added token that takes more than its own characters")
    return {t["content"]: t["id"] for t in tokens}


def encoder(vocabulary: str = VOCABULARY):
    """The public byte-level BPE; it gives the ids of the JSON file of the same vocabulary, added tokens included."""
    import base64
    from pathlib import Path

    import public_tokenizers
    import tiktoken

    lines = Path(public_tokenizers.path(vocabulary)).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(vocabulary))


@cache
def library(vocabulary: str = VOCABULARY):
    """The JSON file of the vocabulary in the tokenizers library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(ADDED[vocabulary]))


def ids_of(text: str, core, added: set[str], vocabulary: str = VOCABULARY) -> np.ndarray:
    """Ids of a text. The pattern's search runs out of stack in white space of about a million characters; such a text
    is left to the tokenizers library, which gives the same ids in more time."""
    try:
        return np.frombuffer(core.encode_to_tiktoken_buffer(text, added), dtype=np.uint32)
    except ValueError:
        return np.array(library(vocabulary).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def pieces_of(ids: np.ndarray, limit: int = LIMIT) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of each piece: full ones, but for a shorter first one."""
    first = len(ids) % limit or limit
    starts = [0, *range(first, len(ids), limit)]
    return [(a, ids[a:b]) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]


SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _tokenize(vocabulary: str, limit: int, with_ids: bool):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, added = encoder(vocabulary)._core_bpe, {*added_tokens(vocabulary)}
        end = np.array([END_ID], dtype=np.uint32)
        done = 0
        for batch in rows:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py() or "", core, added, vocabulary)
                for k, (start, part) in enumerate(pieces_of(np.concatenate((ids, end)), limit)):
                    raw = part.astype("<u4", copy=False).tobytes()
                    out.append((doc, k, start, len(part), zlib.crc32(raw), done + len(out), *([part.tolist()] if with_ids else ())))
            done += len(out)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "place", *(["ids"] if with_ids else [])]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)

    return batches


def tokenize(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves. ``place`` counts the pieces of a task."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_tokenize(vocabulary, limit, with_ids), SCHEMA + ", place bigint" + ", ids array<bigint>" * with_ids)


@dataclass(frozen=True)
class Step:
    """``times`` equal sequences of pieces with these ``lengths``."""

    lengths: tuple[int, ...]
    times: int


class Sums:
    """A hash of sums: for a gap, the combinations of ``parts`` given lengths that fill it exactly, longest part first."""

    def __init__(self, lengths: np.ndarray, parts: int, most: int):
        rows = np.sort(lengths)[::-1].reshape(-1, 1)
        for _ in range(parts - 1):
            shorter = np.sort(lengths)[::-1]
            longer, with_ = np.repeat(np.arange(len(rows)), len(shorter)), np.tile(shorter, len(rows))
            fits = (with_ <= rows[longer, -1]) & (rows[longer].sum(axis=1) + with_ <= most)
            rows = np.column_stack((rows[longer[fits]], with_[fits]))
        total = rows.sum(axis=1)
        order = np.argsort(total, kind="stable")
        total, rows = total[order], rows[order]
        sums, starts = np.unique(total, return_index=True)
        self._of = {int(g): part for g, part in zip(sums, np.split(rows, starts[1:]), strict=True)} if len(rows) else {}

    def of(self, gap: int) -> np.ndarray:
        return self._of.get(gap, _NO_ROWS)


_NO_ROWS = np.empty((0, 1), dtype=np.int64)


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[Step]:
    """Steps that place every piece of ``counts`` (pieces by length).

    Exact fills come first, then best fit of what is left. Small pieces are what best fit needs to fill odd gaps, so
    some fills may have spent too many: fills are given back, those with the shortest parts first and twice as many each
    time, as long as the sequences are more than their tokens need. What needs the fewest sequences is the plan, so it
    never needs more than best fit alone, and the fills of a plan that wastes nothing all stand.
    """
    fills, left = exact_fills(counts, limit)
    least = -(-sum(size * n for size, n in counts.items()) // limit)
    whole = [s for s in fills if s.lengths == (limit,)]
    fills = sorted((s for s in fills if s.lengths != (limit,)), key=lambda s: (min(s.lengths), s.lengths))
    best, back, all_ = None, 0, sum(s.times for s in fills)
    while True:
        kept, free = give_back(fills, left, back)
        steps = whole + kept + best_fit(free, limit)
        needed = sum(s.times for s in steps)
        if best is None or needed < best[0]:
            best = needed, steps
        if best[0] <= least or back >= all_:
            return best[1]
        back = min(all_, 2 * back or 1)


def exact_fills(counts: dict[int, int], limit: int = LIMIT) -> tuple[list[Step], np.ndarray]:
    """Sequences that lengths fill exactly, and how many pieces of each length are left.

    For each piece that is not yet placed, longest first, the gap it leaves is looked up: single lengths, then pairs
    of lengths of at least a quarter of a sequence, then triples of at least three sixteenths. A combination is used as
    often as all its lengths are available.
    """
    left = np.zeros(limit + 1, dtype=np.int64)
    for size, n in counts.items():
        left[size] = n
    steps = [Step((limit,), int(left[limit]))] * bool(left[limit])
    left[limit] = 0
    for parts, shortest in ((1, 1), (2, limit // 4), (3, 3 * limit // 16)):
        here = np.flatnonzero(left)
        sums = Sums(here[here >= shortest], parts, limit)
        for size in here[::-1].tolist():
            for row in sums.of(limit - size) if left[size] else ():
                lengths = (size, *row.tolist())
                if size >= lengths[1] and (times := min(int(left[x]) // lengths.count(x) for x in set(lengths))):
                    for x in lengths:
                        left[x] -= times
                    steps.append(Step(lengths, times))
    return steps, left


def give_back(fills: list[Step], left: np.ndarray, back: int) -> tuple[list[Step], np.ndarray]:
    """``fills`` without its first ``back`` sequences, and ``left`` with their pieces."""
    kept, free = [], left.copy()
    for s in fills:
        undone = min(back, s.times)
        back -= undone
        for x in s.lengths:
            free[x] += undone
        if s.times > undone:
            kept.append(Step(s.lengths, s.times - undone))
    return kept, free


def best_fit(left: np.ndarray, limit: int = LIMIT) -> list[Step]:
    """Longest pieces first, each into the smallest gap that takes it; equal ones together."""
    open_: dict[int, list[list]] = {}
    for size in range(limit, 0, -1):
        todo = int(left[size])
        while todo:
            gap = min((g for g in open_ if g >= size), default=None)
            if gap is None:
                each = limit // size
                full, rest = divmod(todo, each)
                for copies, times in ((each, full), (rest, 1)):
                    if copies and times:
                        open_.setdefault(limit - copies * size, []).append([(size,) * copies, times])
                break
            lengths, times = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
            now = min(times, todo)
            if times > now:
                open_.setdefault(gap, []).append([lengths, times - now])
            open_.setdefault(gap - size, []).append([(*lengths, size), now])
            todo -= now
    return [Step(lengths, times) for group in open_.values() for lengths, times in group if times]


def slots(steps: list[Step], limit: int = LIMIT) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first ranks of the steps' places, and for each the first sequence_id and the offset."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for step in steps:
        offset = 0
        for size in step.lengths:
            rank = taken.get(size, 0)
            rows.setdefault(size, []).append((rank, sequence, offset))
            taken[size] = rank + step.times
            offset += size
        sequence += step.times
    return {size: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for size, r in rows.items()}


def _place(shared):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in rows:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size):
                mine = np.flatnonzero(size == s)
                firsts, sequences, offsets = places[int(s)]
                k = np.searchsorted(firsts, rank[mine], "right") - 1
                sequence[mine], offset[mine] = sequences[k] + rank[mine] - firsts[k], offsets[k]
            kept = batch.schema.get_field_index("rank")
            columns = [c for i, c in enumerate(batch.columns) if i != kept]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return batches


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    pieces = work.put(tokenize(docs, vocabulary, limit, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.sparkContext.broadcast(slots(plan(counts, limit), limit))
    # a length gets as many buckets as its pieces need; the list is as long as a sequence
    buckets = F.array(*[F.lit(min(1 + counts.get(n, 0) // RANKED, BUCKETS)).cast("bigint") for n in range(1, limit + 1)])
    told = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "place"), F.get(buckets, F.col("length").cast("int") - 1)))
    sizes = told.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    kept = [c for c in pieces.columns if c != "place"]
    ranked = (
        told.withColumn("row", F.row_number().over(inside))
        .join(base, ["length", "bucket"])
        .select(*kept, (F.col("base") + F.col("row") - 1).alias("rank"))
    )
    extra = ", ids array<bigint>" * with_ids
    return ranked.mapInArrow(_place(places), SCHEMA + extra + ", sequence_id bigint, offset bigint")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
