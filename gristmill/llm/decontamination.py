"""Benchmark decontamination by pigeonhole edit matching.

A test item of m normalised characters may occur with up to ``k = RATE * m`` edits. It is cut into k + 1 pieces, so at
least one piece of any such occurrence is unharmed. One automaton finds every exact piece in a document; the passage
around a hit must keep enough of the item's trigrams (an edit harms three at most, so this loses nothing) and is then
measured by Myers' bit-parallel edit distance against the whole item.

Documents are read once per block of items and never shuffled. A block holds at most ``BLOCK_CHARS`` characters, which
bounds what is broadcast and what a Python worker holds (about 70 bytes a character; what verification needs of an item
is made when a piece of it is met, and kept for ``PREPARED`` items); more items make more blocks. A worker that runs
several tasks builds its automaton once.

Texts are compared in lower case, with ASCII punctuation and white space as single spaces. An item that is too short for
an edit must stand there as whole words.

Defined results: null and empty texts contain nothing; null and empty items are contained nowhere; a repeated row or
item is reported again; rows without doc_id are reported without it; other columns are passed on untouched by ``keep``.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import table

RATE = 0.08
BLOCK_CHARS = 2_000_000
#: Items whose trigrams and masks a worker keeps.
PREPARED = 2000

_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def normal(text: str | None) -> str:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()).decode("utf-8", "surrogatepass")


def budget(item: str) -> int:
    return int(RATE * len(item))


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece) of the error budget plus one pieces."""
    n = budget(item) + 1
    cuts = [j * len(item) // n for j in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Pattern:
    """An item, prepared for verification."""

    def __init__(self, item_id: int, text: str):
        self.item_id, self.text, self.budget = item_id, text, budget(text)
        self.grams = frozenset(text[i : i + 3] for i in range(len(text) - 2))
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def may_hold(self, window: str) -> bool:
        need = len(self.grams) - 3 * self.budget
        return need <= 0 or len(self.grams.intersection([window[i : i + 3] for i in range(len(window) - 2)])) >= need

    def distance(self, window: str) -> tuple[int, int]:
        """Least edit distance of the item to a part of ``window``, and where the first such part ends (exclusive)."""
        m = len(self.text)
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, best, end = full, 0, m, m, 0
        get = self.masks.get
        for at, c in enumerate(window, 1):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (~(xh | pv) & full)
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best, end = score, at
            ph = (ph << 1) & full
            mh = (mh << 1) & full
            pv = mh | (~(xv | ph) & full)
            mv = ph & xv
        return best, end


class Finder:
    """All items of a block, ready to search documents."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = items
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            for offset, piece in pieces(text):
                where.setdefault(piece, []).append((k, offset))
        # the automaton holds numbers; the places of a piece lie in one flat array
        self.starts, places = array("q", [0]), array("q")
        for n, (piece, found) in enumerate(where.items()):
            self.automaton.add_word(piece, n)
            for k, offset in found:
                places.extend((k, offset))
            self.starts.append(len(places))
        self.places, self.sizes = places, array("q", map(len, where))
        if where:
            self.automaton.make_automaton()
        self.pattern = lru_cache(PREPARED)(lambda k: Pattern(*items[k]))

    def _met(self, plain: str) -> set[tuple[int, int]]:
        """(item, where it would start) for each piece that stands in the text."""
        out = set()
        for end, n in self.automaton.iter(plain):
            start = end + 1 - self.sizes[n]
            for i in range(self.starts[n], self.starts[n + 1], 2):
                out.add((self.places[i], start - self.places[i + 1]))
        return out

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, budget, end) of each item in ``text``, at its best place."""
        plain = normal(text)
        if not plain or not self.items:
            return []
        best: dict[int, tuple[int, int]] = {}
        for k, start in sorted(self._met(plain)):
            size = len(self.items[k][1])
            if not budget(self.items[k][1]):
                if _whole(plain, start, start + size):
                    best.setdefault(k, (0, start + size))
                continue
            p = self.pattern(k)
            low = max(0, start - p.budget)
            window = plain[low : max(0, start + len(p.text) + p.budget)]
            if k in best and best[k][0] == 0 or not p.may_hold(window):
                continue
            distance, end = p.distance(window)
            if distance <= p.budget and (k not in best or distance < best[k][0]):
                best[k] = (distance, low + end)
        return [(self.items[k][0], d, budget(self.items[k][1]), end) for k, (d, end) in best.items()]


def _whole(plain: str, start: int, end: int) -> bool:
    """Whether the part of a normal text begins and ends with words."""
    return plain[start - 1 : start] in ("", " ") and plain[end : end + 1] in ("", " ")


_finders: dict[str, Finder] = {}


def _finder(block: tuple[str, list[tuple[int, str]]]) -> Finder:
    """The finder of a block, built once per worker; only the last one is kept."""
    name, items = block
    if name not in _finders:
        _finders.clear()
        _finders[name] = Finder(items)
    return _finders[name]


def _search(shared):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared.value)
        for batch in rows:
            found = [(d.as_py(), *hit) for d, t in zip(batch.column(0), batch.column(1), strict=True) for hit in finder.find(t.as_py())]
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "budget", "end"]
            )

    return batches


SCHEMA = "doc_id bigint, item_id bigint, distance bigint, budget bigint, end bigint"


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size; the driver holds one block at a time."""
    block, chars = [], 0
    for row in items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).toLocalIterator():
        text = normal(row[1])
        if not text:
            continue
        if block and chars + len(text) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((row[0], text))
        chars += len(text)
    yield block


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and test item in it: doc_id, item_id, distance, budget, end (in the normalised text)."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [source.mapInArrow(_search(spark.sparkContext.broadcast((uuid.uuid4().hex, block))), SCHEMA) for block in _blocks(items)]
    return reduce(DataFrame.unionAll, found)


def _clean_rows(shared, column: int):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared.value)
        for batch in rows:
            yield batch.filter(pa.array([not finder.find(t.as_py()) for t in batch.column(column)], pa.bool_()))

    return batches


def keep(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no test item, with all their columns. Rows are judged where they are read."""
    spark = docs.sparkSession
    for block in _blocks(items):
        docs = docs.mapInArrow(_clean_rows(spark.sparkContext.broadcast((uuid.uuid4().hex, block)), docs.columns.index("text")), docs.schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
