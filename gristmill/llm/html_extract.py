"""Main text of web pages by wrapper induction.

Pages of one host share a template, or a few. Some pages per host, drawn by a hash from those that hold text, are its
references; every page is aligned with each of them by simple tree matching, and for each reference node it is counted
on how many different pages its text comes back. Nodes that stay constant on most pages of the host are template. So are
two nodes or more that stay constant on most pages of a layout, which are the pages that keep most of what often comes
back of a reference. Varying slots are content. Slots that name themselves as something else (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments; by element, role, class or id) are no content
however much they vary, and where a page marks its article, the content slots are those inside it.

Counts are partial sums per task, so a host with a third of all pages is no hot group. Only reference trees and the
numbers of constant nodes meet the pages: if they are small, which is checked, they are broadcast, and beyond that they
are joined by host, with the pages of a host dealt over several tasks.

Copies of a page count once, and a host needs several different pages before anything is called constant, so that equal
articles are not mistaken for a template.

Defined results: null and empty html give an empty text; a page without url belongs to an unnamed host; repeated rows
are extracted again; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import Workspace, table
from gristmill.llm.dom import BLOCKS, Node, Shape, parse, simple_tree_match

#: Different pages a host needs, and the share of them on which a constant node keeps its text.
LEAST_PAGES = 5
CONSTANT = 0.8
#: References of a host, at most.
REFERENCES = 6
#: Share of a host's pages on which a node comes back often, the share of such nodes that a page of the layout keeps, and
#: the constant nodes that a layout needs.
OFTEN, OF_LAYOUT, LAYOUT_NODES = 0.3, 0.75, 2
#: Bytes of reference trees that may be broadcast.
BROADCAST_BYTES = 16 << 20
#: Tasks over which the pages of a host are dealt when they are joined.
DEALT = 16

#: Elements and roles that are never main text, fixed values.
_OFF_TAGS = frozenset("nav footer aside form button dialog menu head search fieldset".split())
_OFF_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog status menu menubar form toolbar".split())
#: Words that say what an element is, fixed values: a class or id names it as a whole, or by the last word of a compound
#: name that is more than a box.
_OFF_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adbox adslot adsbygoogle sponsor sponsored sponsors promo promos promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall disclaimer "
    "comment comments commentlist respond reply replies disqus discussion sidebar aside widget widgets related recommended recommendations "
    "share sharing social menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer toolbar topbar masthead skip".split()
)
_OFF_UNLESS_ARTICLE = frozenset({"header", "notice", "alert", "banner"})
#: Last words of compound names that say no more than that something is a box, a list or a text, fixed values.
_BOX_WORDS = frozenset(
    "area bar block blocks box boxes button buttons card cards col column container content frame group holder icon icons inner item items "
    "label layer left line link links list message outer panel placeholder region right row section sections slot slots text title top bottom "
    "unit units view wrap wrapper zone thread threads posts stories articles pages topics".split()
)
#: First words that speak of the layout around an element and not of the element.
_LAYOUT_WORDS = frozenset("has with no without".split())
_ARTICLE_WORDS = frozenset("article entry post story content main body text".split())
#: What a container of a single article is called, fixed values.
_POST_NAMES = frozenset("article entry hentry post story".split())
#: Words for what readers say and for adverts, which are no main text even where they are most of a page.
_NEVER = frozenset("ad ads adv advert adverts advertisement advertisements sponsor sponsored comment comments commentlist respond reply replies disqus discussion".split())
#: An element that is named as something else and holds more than this share of a page's text, and as many letters as an
#: article has at least, is taken for its frame.
MOST, ARTICLE_LETTERS = 0.5, 200
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_NONE_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def _names(node: Node) -> list[list[str]]:
    """Class and id names of an element, each as its words in lower case."""
    named = " ".join(filter(None, (node.attribute("class"), node.attribute("id"))))
    return [[w.lower() for w in _WORDS.findall(name)] for name in named.split()]


def _called(words: list[str]) -> str:
    """What a name calls its element: the last word that is more than a box ("site-footer", "comment-list")."""
    words = [w for w in words if not w.isdigit()]
    if words and words[0] in _LAYOUT_WORDS:
        return ""
    while len(words) > 1 and words[-1] in _BOX_WORDS:
        words = words[:-1]
    return words[-1] if words else ""


def _class_words(node: Node) -> set[str]:
    return {w for name in _names(node) for w in name}


def _off(node: Node, inside: bool, most: bool) -> bool:
    """Whether an element says that it is something other than main text.

    ``inside``: it stands in an article or main element; ``most``: it holds most of the page's text.
    """
    tag = node.tag
    if tag in _OFF_TAGS:
        return tag == "head" or not (most and tag in ("form", "fieldset", "aside")) and (tag != "form" or not _holds_article(node))
    if tag == "header" and not inside:
        return not most and not _holds_article(node)
    if not node.attributes or tag in ("html", "body", "main"):
        return False
    lowered = node.attributes.lower()
    if "role" in lowered and (node.attribute("role") or "").lower() in _OFF_ROLES:
        return True
    if "hidden" in lowered and (node.attribute("aria-hidden") == "true" or (node.attribute("hidden") is not None and "aria-hidden" not in lowered)):
        return True
    if "style" in lowered and _NONE_SHOWN.search(node.attribute("style") or ""):
        return True
    called = {_called(name) for name in _names(node)}
    hit = called & _OFF_WORDS
    if "header" in called and not inside:
        hit = hit | {"header"}
    if hit and _class_words(node) & _ARTICLE_WORDS:
        hit = hit - _OFF_UNLESS_ARTICLE
    if most:
        hit = hit & _NEVER
    return bool(hit) and not _holds_article(node)


def _sizes(root: Node) -> dict[int, int]:
    """Letters and digits, about, below each element, by its id."""
    sizes: dict[int, int] = {}
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, done = todo.pop()
        if done:
            sizes[id(node)] = sum(sizes[id(c)] if isinstance(c, Node) else len(c) - c.count(" ") - c.count("\n") for c in node.children)
        else:
            todo.append((node, True))
            todo += [(c, False) for c in node.children if isinstance(c, Node)]
    return sizes


def _is_post(node: Node) -> bool:
    """Whether an element is called a post and has its article as one of several children."""
    return bool(node.attributes) and any(len(n) == 1 and n[0] in _POST_NAMES for n in _names(node)) and sum(c.tag == "article" for c in node.children if isinstance(c, Node)) == 1


def _holds_article(node: Node) -> bool:
    todo = [c for c in node.children if isinstance(c, Node)]
    while todo:
        n = todo.pop()
        if n.tag in ("article", "main") and not (_class_words(n) & {"comment", "comments", "reply", "teaser"}):
            return True
        todo += [c for c in n.children if isinstance(c, Node)]
    return False


class Page:
    """The blocks of a page in order, with the block tree around them."""

    def __init__(self, source: str | None):
        self.texts: list[str] = []
        self.owner: list[int] = []  # of each block, the number of its node
        self.off: list[bool] = []
        self.region: list[tuple[int, ...]] = []  # of each block, the article or main elements around it
        self.regions: list[str] = []
        self._count = 0
        root = parse(source or "")
        self._sizes = _sizes(root)
        self._all = max(1, self._sizes[id(root)])
        self.shape = self._walk(root)

    def _most(self, node: Node) -> bool:
        return self._sizes[id(node)] > max(MOST * self._all, ARTICLE_LETTERS)

    def _walk(self, root: Node) -> Shape:
        run: list[str] = []

        def flush(owner: int, off: bool, region: tuple[int, ...]) -> None:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                self.texts.append(text)
                self.owner.append(owner)
                self.off.append(off)
                self.region.append(region)

        # one frame per open block element, so that depth is not bounded by the interpreter's stack
        def open_(node: Node, off: bool, region: tuple[int, ...]):
            self._count += 1
            return [node, iter(node.children), self._count - 1, off, region, [], len(self.texts)]

        stack = [open_(root, False, ())]
        inline: list[tuple[list, object, bool]] = []  # open inline elements: frame, children, what off was before
        while True:
            frame = stack[-1]
            children = inline[-1][1] if inline and inline[-1][0] is frame else frame[1]
            child = next(children, None)
            if child is None:
                if inline and inline[-1][0] is frame:
                    _, _, was = inline.pop()
                    if was != frame[3]:
                        flush(frame[2], frame[3], frame[4])
                        frame[3] = was
                    continue
                flush(frame[2], frame[3], frame[4])
                stack.pop()
                own = " ".join(t for t, o in zip(self.texts[frame[6] :], self.owner[frame[6] :], strict=True) if o == frame[2])
                shape = Shape(frame[0].tag, frame[2], digest(own), tuple(frame[5]))
                if not stack:
                    return shape
                stack[-1][5].append(shape)
            elif isinstance(child, str):
                run.append(child)
            elif child.tag == "br":
                run.append(" ")
            elif child.tag in BLOCKS or child.tag == "head":
                flush(frame[2], frame[3], frame[4])
                region = frame[4]
                off = frame[3] or _off(child, bool(region), self._most(child))
                if not off and (child.tag in ("article", "main") or child.attribute("itemprop") == "articleBody" or child.attribute("role") == "main" or _is_post(child)):
                    self.regions.append("main" if child.tag == "main" or child.attribute("role") == "main" else "article")
                    region = (*region, len(self.regions) - 1)
                stack.append(open_(child, off, region))
            else:
                off = frame[3] or _off(child, bool(frame[4]), self._most(child))
                if off != frame[3]:
                    flush(frame[2], frame[3], frame[4])
                inline.append((frame, iter(child.children), frame[3]))
                frame[3] = off

    def main(self, layouts: Iterable[tuple[dict[int, int], Shape]] = ()) -> str:
        """The blocks that are content. ``layouts``: reference nodes with the text digest they keep, and the reference."""
        template: set[int] = set()
        for constant, reference in layouts:
            left = {s.text for s in nodes_of(self.shape) if s.number not in template}
            if not left.isdisjoint(constant.values()):
                template |= {y.number for x, y in simple_tree_match(reference, self.shape) if constant.get(x.number) == y.text}
        good = [i for i in range(len(self.texts)) if not self.off[i] and self.owner[i] not in template]
        chosen = self._chosen(good)
        return "\n\n".join(self.texts[i] for i in good if chosen is None or chosen & {*self.region[i]})

    def _chosen(self, good: list[int]) -> set[int] | None:
        """The regions that hold the article; None: the page marks none."""
        for kind in ("article", "main"):
            found = {r for i in good for r in self.region[i] if self.regions[r] == kind}
            if found:
                return found
        return None


def digest(text: str) -> int:
    """64 bits of a node's own text; 0 for none."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1 if text else 0


def nodes_of(shape: Shape) -> Iterator[Shape]:
    todo = [shape]
    while todo:
        s = todo.pop()
        yield s
        todo += s.children


def pack_shape(shape: Shape) -> list:
    """A reference tree as plain lists, in page order: tag, text digest, number of children."""
    out, todo = [], [shape]
    while todo:
        s = todo.pop()
        out.append((s.tag, s.text, len(s.children)))
        todo += reversed(s.children)
    return out


def unpack_shape(rows: list) -> Shape:
    built: list[Shape] = []
    for number in range(len(rows) - 1, -1, -1):
        tag, text, children = rows[number]
        own = tuple(reversed(built[len(built) - children :])) if children else ()
        if children:
            del built[len(built) - children :]
        built.append(Shape(tag, number, text, own))
    return built[0]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


_REFERENCE = "host string, ref bigint, tags array<string>, digests array<bigint>, children array<int>"
_ALIGNED = "host string, ref bigint, page bigint, nodes array<int>"


def _reference_batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """References that hold text."""
    for batch in rows:
        packed = [pack_shape(Page(h.as_py()).shape) for h in batch.column(2)]
        full = [k for k, p in enumerate(packed) if any(r[1] for r in p)]
        columns = [[[r[k] for r in packed[i]] for i in full] for k in range(3)]
        kinds = (pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()))
        taken = pa.array(full, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(taken), batch.column(1).take(taken), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["host", "ref", "tags", "digests", "children"]
        )


class _Shapes(dict):
    """Reference trees by host and number, built when they are first needed."""

    def __init__(self, packed: dict):
        super().__init__()
        self.packed = packed

    def __missing__(self, host: str) -> dict[int, Shape]:
        shapes = self[host] = {ref: unpack_shape(list(zip(*rows, strict=True))) for ref, rows in self.packed.get(host, {}).items()}
        return shapes


def _kept_nodes(page: Page, texts: set[int], reference: Shape) -> list[int]:
    """Reference nodes whose text comes back on the page, which holds ``texts``."""
    if not any(x.text in texts for x in nodes_of(reference) if x.text):
        return []
    return [x.number for x, y in simple_tree_match(reference, page.shape) if x.text and x.text == y.text]


def _align(shared):
    """(host, reference, page digest, nodes that keep the reference's text) of each page."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = _Shapes(shared.value) if shared else None
        for batch in rows:
            out = []
            for k in range(len(batch)):
                host, source = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                references = shapes[host] if shapes is not None else _joined(batch, k)
                if references:
                    page = Page(source)
                    number, texts = digest("\n".join(page.texts)), {s.text for s in nodes_of(page.shape)}
                    out += [(host, ref, number, _kept_nodes(page, texts, shape)) for ref, shape in references.items()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "ref", "page", "nodes"])

    return batches


def _joined(batch: pa.RecordBatch, k: int) -> dict[int, Shape]:
    rows = batch.column(batch.schema.names.index("refs"))[k].as_py() or []
    return {r["ref"]: unpack_shape(list(zip(r["tags"], r["digests"], r["children"], strict=True))) for r in rows}


def _extract(shared):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        constants, shapes = (shared.value[0], _Shapes(shared.value[1])) if shared else (None, None)
        known: dict[str, list[tuple[dict[int, int], Shape]]] = {}
        for batch in rows:
            names = batch.schema.names
            out = []
            for k in range(len(batch)):
                host, source = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if shared:
                    if host not in known:
                        known[host] = _layouts(constants.get(host), shapes[host])
                    layouts = known[host]
                else:
                    numbers = {r["ref"]: r["nodes"] for r in batch.column(names.index("constants"))[k].as_py() or []}
                    layouts = _layouts(numbers, _joined(batch, k) if numbers else {})
                out.append(Page(source).main(layouts))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return batches


def _layouts(numbers: dict[int, list[int]] | None, shapes: dict[int, Shape]) -> list[tuple[dict[int, int], Shape]]:
    return [({n: _text_of(shapes[ref], n) for n in nodes}, shapes[ref]) for ref, nodes in sorted((numbers or {}).items())]


def _text_of(shape: Shape, number: int) -> int:
    while shape.number != number:
        shape = next(c for c in reversed(shape.children) if c.number <= number)
    return shape.text


def _references(source: DataFrame, work: Workspace) -> DataFrame:
    """Up to REFERENCES different trees per host, drawn by a hash."""
    written = source.where(F.col("page_id").isNotNull() & (F.length(F.trim(F.coalesce("html", F.lit("")))) > 0))
    slot = F.pmod(F.xxhash64("page_id"), F.lit(REFERENCES)).alias("slot")
    drawn = written.groupBy("host", slot).agg(F.min(F.struct(F.xxhash64("page_id", F.lit("reference")).alias("h"), "page_id")).alias("first"))
    first = work.put(drawn.select("host", F.col("first.page_id").alias("page_id")), "first")
    # one key, so that a join of many hosts deals pages by page and not by the host they were grouped by
    key = F.concat_ws("\n", F.col("host"), F.col("page_id").cast("string")).alias("key")
    first = first.select(key)
    few = (first.agg(F.sum(F.length("key") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    return work.put(
        written.select("host", "page_id", "html", key)
        .join(F.broadcast(first) if few else first, "key", "left_semi")
        .select("host", "page_id", "html")
        .mapInArrow(_reference_batches, _REFERENCE)
        .dropDuplicates(["host", "tags", "digests", "children"])
        .dropDuplicates(["host", "ref"]),
        "references",
    )


def _constants(aligned: DataFrame, small: bool, work: Workspace) -> DataFrame:
    """host, ref, nodes: the nodes of each reference that are template."""
    near = F.broadcast if small else lambda df: df
    different = aligned.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    kept = aligned.select("host", "ref", "page", F.explode("nodes").alias("node")).distinct().groupBy("host", "ref", "node").agg(F.count("*").alias("kept"))
    kept = work.put(kept.join(different, "host"), "kept")
    often = kept.where((F.col("kept") >= LEAST_PAGES) & (F.col("kept") >= OFTEN * F.col("pages"))).groupBy("host", "ref").agg(F.collect_list("node").alias("often"))
    members = (
        aligned.join(near(work.put(often, "often")), ["host", "ref"])
        .select("host", "ref", "page", F.array_intersect("nodes", "often").alias("nodes"), F.size("often").alias("n"))
        .where(F.size("nodes") >= OF_LAYOUT * F.col("n"))
    )
    members = work.put(members.select("host", "ref", "page", "nodes"), "members")
    sizes = members.select("host", "ref", "page").distinct().groupBy("host", "ref").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    inside = members.select("host", "ref", "page", F.explode("nodes").alias("node")).distinct().groupBy("host", "ref", "node").agg(F.count("*").alias("kept"))
    of_layout = inside.join(sizes, ["host", "ref"]).where(F.col("kept") >= CONSTANT * F.col("pages")).groupBy("host", "ref").agg(F.collect_list("node").alias("nodes"))
    of_layout = of_layout.where(F.size("nodes") >= LAYOUT_NODES).select("host", "ref", F.explode("nodes").alias("node"))
    of_host = kept.where(F.col("kept") >= CONSTANT * F.col("pages")).select("host", "ref", "node")
    return work.put(of_host.unionByName(of_layout).groupBy("host", "ref").agg(F.sort_array(F.collect_set("node")).alias("nodes")), "constants")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text: one row per page."""
    spark = pages.sparkSession
    work = Workspace(spark, "html")
    source = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"), F.col("page_id").cast("bigint").alias("page_id"), F.col("url"))
    references = _references(source, work)
    bytes_ = references.agg(F.sum(F.size("tags") * 24 + 64)).first()[0] or 0
    small = bytes_ <= BROADCAST_BYTES
    per_host = references.groupBy("host").agg(F.collect_list(F.struct("ref", "tags", "digests", "children")).alias("refs"))
    if small:
        packed: dict = {}
        for r in references.toLocalIterator():
            packed.setdefault(r["host"], {})[r["ref"]] = (r["tags"], r["digests"], r["children"])
        aligned = source.select("host", "html").mapInArrow(_align(spark.sparkContext.broadcast(packed)), _ALIGNED)
    else:
        aligned = _meet(source, per_host).mapInArrow(_align(None), _ALIGNED)
    constants = _constants(work.put(aligned, "aligned"), small, work)
    if small:
        numbers: dict = {}
        for r in constants.toLocalIterator():
            numbers.setdefault(r["host"], {})[r["ref"]] = r["nodes"]
        needed = {h: {ref: packed[h][ref] for ref in refs} for h, refs in numbers.items()}
        return source.mapInArrow(_extract(spark.sparkContext.broadcast((numbers, needed))), "page_id bigint, url string, text string")
    found = constants.groupBy("host").agg(F.collect_list(F.struct("ref", "nodes")).alias("constants"))
    return _meet(source, per_host.join(found, "host", "left")).mapInArrow(_extract(None), "page_id bigint, url string, text string")


def _meet(source: DataFrame, per_host: DataFrame) -> DataFrame:
    """Pages with what is known of their host; the pages of a host are dealt over DEALT tasks."""
    dealt = source.withColumn("deal", F.pmod(F.xxhash64("page_id"), F.lit(DEALT)))
    copies = per_host.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(DEALT - 1).cast("bigint"))))
    extra = [c for c in per_host.columns if c != "host"]
    return dealt.join(copies.hint("shuffle_hash"), ["host", "deal"], "left").select("host", "html", "page_id", "url", *extra)


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
