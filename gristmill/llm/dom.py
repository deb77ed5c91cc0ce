"""A tolerant HTML parser to block trees, and simple tree matching of two of them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of a page.
OPAQUE = frozenset("script style noscript template svg math iframe object canvas audio video head select datalist textarea".split())
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre "
    "figure figcaption address details summary hr header footer nav aside form fieldset legend center dialog menu hgroup search".split()
)
#: Opening the first closes an open element of the second kind.
_CLOSES = {
    **dict.fromkeys(BLOCKS - {"html", "body"}, frozenset({"p"})),
    "li": frozenset({"li", "p"}),
    "dt": frozenset({"dt", "dd", "p"}),
    "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}),
    "td": frozenset({"td", "th", "p"}),
    "th": frozenset({"td", "th", "p"}),
    "option": frozenset({"option"}),
}
#: An element of the second kind is not closed across these.
_SCOPES = {"li": frozenset({"ul", "ol", "menu"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "tr": frozenset({"table"}), "td": frozenset({"table"}), "th": frozenset({"table"})}
_P_SCOPE = frozenset({"td", "th", "table", "caption", "button"})

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass(slots=True)
class Node:
    tag: str
    attributes: str = ""
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)
    #: What opening an element in here would close, by kind of element; looked up once for each.
    closes: dict | None = None

    def attribute(self, name: str) -> str | None:
        if name not in self.attributes.lower():
            return None
        for key, *values in _ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return html.unescape("".join(values))
        return None


def parse(text: str) -> Node:
    """The tree of a page; whatever is malformed is read as browsers would, roughly."""
    root = Node("#root")
    at, pos, size = root, 0, len(text)
    while pos < size:
        lt = text.find("<", pos)
        if lt < 0:
            lt = size
        if lt > pos:
            at.children.append(html.unescape(text[pos:lt]))
        if lt == size:
            break
        if text.startswith("<!--", lt):
            end = text.find("-->", lt + 4)
            pos = size if end < 0 else end + 3
            continue
        m = _TAG.match(text, lt)
        if not m:
            if text[lt + 1 : lt + 2] in ("!", "?", "/") or text[lt + 1 : lt + 2].isalpha():
                end = text.find(">", lt)
                pos = size if end < 0 else end + 1
            else:
                at.children.append("<")
                pos = lt + 1
            continue
        pos = m.end()
        tag = m[2].lower()
        if m[1]:
            at = _close(at, tag)
            continue
        if tag in OPAQUE and tag != "head":
            if not m[3].endswith("/"):
                end = _END(tag).search(text, pos)
                pos = end.end() if end else size
            continue
        at = _implied(at, tag)
        node = Node(tag, m[3], at)
        at.children.append(node)
        if tag not in VOID and not (m[3].endswith("/") and tag not in BLOCKS):
            at = node
    return root


_ENDS: dict[str, re.Pattern] = {}


def _END(tag: str) -> re.Pattern:
    if tag not in _ENDS:
        _ENDS[tag] = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE)
    return _ENDS[tag]


def _close(at: Node, tag: str) -> Node:
    node = at
    while node.parent is not None and node.tag != tag:
        if node.tag == "#root" or (tag not in BLOCKS and node.tag in BLOCKS):
            return at  # an inline end tag does not close blocks
        node = node.parent
    return at if node.parent is None else node.parent


def _implied(at: Node, tag: str) -> Node:
    if tag == "body":
        node = at
        while node is not None and node.tag != "head":
            node = node.parent
        return node.parent if node is not None else at
    ends = _CLOSES.get(tag)
    if not ends:
        return at
    found = _closed_by(at, ends, _SCOPES.get(tag, _P_SCOPE))
    return found.parent if found is not None else at


def _closed_by(at: Node, ends: frozenset[str], stop: frozenset[str]) -> Node | None:
    """The outermost open element of ``ends`` inside the scope. A node remembers it, so depth costs nothing twice."""
    kind, path, node = (ends, stop), [], at
    while node.parent is not None and node.tag not in stop and kind not in (node.closes or ()):
        path.append(node)
        node = node.parent
    found = (node.closes or {}).get(kind)
    for node in reversed(path):
        found = found or (node if node.tag in ends else None)
        node.closes = {**(node.closes or {}), kind: found}
    return found


@dataclass(slots=True)
class Shape:
    """A block tree for matching: tag, number of the node in page order, digest of its own text, children."""

    tag: str
    number: int
    text: int
    children: tuple[Shape, ...]
    form: int = 0
    size: int = 0

    def __post_init__(self):
        self.form = hash_form(self.tag, self.children)
        self.size = 1 + sum(c.size for c in self.children)


def hash_form(tag: str, children: tuple[Shape, ...]) -> int:
    value = _stable(tag)
    for c in children:
        value = (value * 1000003 ^ c.form) & 0xFFFFFFFFFFFFFFFF
    return value * 31 + len(children) & 0xFFFFFFFFFFFFFFFF


_TAG_CODES: dict[str, int] = {}


def _stable(tag: str) -> int:
    code = _TAG_CODES.get(tag)
    if code is None:
        code = int.from_bytes(tag.encode()[:8].ljust(8, b"\0"), "little")
        _TAG_CODES[tag] = code
    return code


def simple_tree_match(a: Shape, b: Shape) -> list[tuple[Shape, Shape]]:
    """Pairs of nodes in a largest order- and level-preserving matching with equal tags. Trees may be of any depth."""
    weights: dict[tuple[int, int], int] = {}

    def table(xs, ys) -> list[list[int]]:
        rows = [[0] * (len(ys) + 1)]
        for x in xs:
            last, row = rows[-1], [0]
            for j, y in enumerate(ys):
                w = weights[x.form, y.form] if x.tag == y.tag else 0
                row.append(max(last[j] + w, last[j + 1], row[j]))
            rows.append(row)
        return rows

    def weigh(x: Shape, y: Shape) -> None:
        """Weights of the pair and of all pairs below it that it needs, deepest first."""
        todo = [(x, y)]
        while todo:
            x, y = todo[-1]
            if (x.form, y.form) in weights:
                todo.pop()
            elif x.form == y.form:
                weights[x.form, y.form] = x.size
            else:
                below = {(c.form, d.form): (c, d) for c in x.children for d in y.children if c.tag == d.tag and (c.form, d.form) not in weights}
                if below:
                    todo += below.values()
                else:
                    weights[x.form, y.form] = 1 + table(x.children, y.children)[-1][-1]

    pairs: list[tuple[Shape, Shape]] = []
    todo = [(a, b)] if a.tag == b.tag else []
    if todo:
        weigh(a, b)
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        xs, ys = x.children, y.children
        if x.form == y.form:
            todo += zip(xs, ys, strict=True)
            continue
        rows, i, j = table(xs, ys), len(xs), len(ys)
        while i and j:
            w = weights[xs[i - 1].form, ys[j - 1].form] if xs[i - 1].tag == ys[j - 1].tag else 0
            if w and rows[i][j] == rows[i - 1][j - 1] + w:
                todo.append((xs[i - 1], ys[j - 1]))
                i, j = i - 1, j - 1
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return pairs
