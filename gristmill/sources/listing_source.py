"""A Python data source over the listings of paged boards: a partition is a search term, and its reader pages by itself.

    spark.dataSource.register(BoardListing)
    spark.read.format("board_listing").option("board", "occ").option("terms", json.dumps(["data"])).load()

A reader asks for the next page while pages bring ids of their own and none says that it is the last; a page that cannot
be fetched ends its term and keeps what came before. So no driver job is needed to page, terms are read side by side, and
a cancelled job stops asking. Conditions of the form ``NOT contains(title_low, ...)`` and ``NOT contains(company_low,
...)`` are pushed into the readers (with ``spark.sql.python.filterPushdown.enabled``), so what the title rule rejects never
leaves them, and no offer page is asked for it.
"""

from __future__ import annotations

import json
import random
import re
import time
import urllib.error
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition, Not, StringContains

from gristmill.functions import text as X
from gristmill.sources.http_source import fetch

SCHEMA = "term int, page int, pos int, id string, title string, company string, title_low string, company_low string, item string"
PAGE_SIZE = 100
#: Public addresses of the listings, fixed values; ``{term}`` is the quoted term.
OCC, COMPUTRABAJO = "https://www.occ.com.mx/empleos/de-{term}/tipo-home-office-remoto/", "https://mx.computrabajo.com/trabajo-de-{term}-en-remoto"
HIMALAYAS = "https://himalayas.app/jobs/api?limit={size}&offset={offset}"
#: What follows the last card of a listing that has no more pages, fixed value.
COMPUTRABAJO_END = '<div class="tc mbB pt30 pb30">'

_CARD = re.compile(r'(?s)data-id="([^"]+)".*?(?=data-id="|$)')
_TITLE = re.compile(r'(?s)<a[^>]*class="[^"]*\bjs-o-link\b[^"]*"[^>]*>(.*?)</a>|<h2[^>]*>(.*?)</h2>')
_COMPANY = re.compile(r'(?s)<a[^>]*class="[^"]*\bt_ellipsis\b[^"]*"[^>]*>(.*?)</a>')


@dataclass(frozen=True)
class Entry:
    """What a listing says of a posting; ``item`` is its part of the page."""

    id: str
    title: str = ""
    company: str = ""
    item: str = ""


@dataclass(frozen=True)
class Listing:
    """How a board is paged: the address of a term's page k (from 1), what a page lists, and whether it is the last."""

    address: Callable[[str, int], str]
    entries: Callable[[str], Iterable[Entry]]
    last: Callable[[str], bool] = lambda page: False
    max_pages: int = 5


def _paged(address: str, name: str) -> Callable[[str, int], str]:
    return lambda term, k: address.format(term=quote(term)) + (f"?{name}={k}" if k > 1 else "")


def _occ(page: str) -> Iterator[Entry]:
    yield from map(Entry, re.findall(r"/empleo/oferta/(\d+)", page))


def _first_text(pattern: re.Pattern, card: str) -> str:
    return next((t for m in pattern.finditer(card) if (t := X.strip_tags(next(g for g in m.groups() if g is not None)))), "")


def _computrabajo(page: str) -> Iterator[Entry]:
    for m in _CARD.finditer(page.partition(COMPUTRABAJO_END)[0]):
        yield Entry(m[1], _first_text(_TITLE, m[0]), _first_text(_COMPANY, m[0]), m[0])


def _himalayas(page: str) -> Iterator[Entry]:
    try:
        jobs = json.loads(page, strict=False).get("jobs", [])
    except (ValueError, AttributeError):
        return
    for job in jobs if isinstance(jobs, list) else ():
        if isinstance(job, dict):
            yield Entry(str(job.get("guid") or job.get("applicationLink") or ""), str(job.get("title") or ""), str(job.get("companyName") or ""), json.dumps(job))


LISTINGS: dict[str, Listing] = {
    "occ": Listing(_paged(OCC, "page"), _occ),
    "computrabajo": Listing(_paged(COMPUTRABAJO, "p"), _computrabajo, lambda page: COMPUTRABAJO_END in page, 10),
    "himalayas": Listing(lambda term, k: HIMALAYAS.format(size=PAGE_SIZE, offset=(k - 1) * PAGE_SIZE), _himalayas),
}


@dataclass
class Term(InputPartition):
    number: int
    text: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.board = options["board"]
        self.terms = json.loads(options.get("terms", '[""]'))
        self.max_pages = int(options.get("maxPages", LISTINGS[self.board].max_pages))
        self.timeout, self.pause = float(options.get("timeout", 30)), float(options.get("pause", 0))
        self.via = options.get("via", "")
        self.unwanted: dict[str, list[str]] = {"title_low": [], "company_low": []}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, Not) and isinstance(f.child, StringContains) and len(f.child.attribute) == 1 and f.child.attribute[0] in self.unwanted:
                self.unwanted[f.child.attribute[0]].append(f.child.value)
            else:
                yield f

    def partitions(self):
        return [Term(i, t) for i, t in enumerate(self.terms)]

    def _page(self, url: str) -> str | None:
        if self.pause:
            time.sleep(random.uniform(0.8, 2.2) * self.pause)
        try:
            # a relay is told the address: a cache, or what has captured pages
            return fetch(self.via + quote(url, safe="") if self.via else url, self.timeout)
        except (urllib.error.URLError, OSError):
            return None

    def _wanted(self, title: str, company: str) -> bool:
        return not any(w in title for w in self.unwanted["title_low"]) and not any(w in company for w in self.unwanted["company_low"])

    def read(self, partition: Term):
        board, seen = LISTINGS[self.board], set()
        for k in range(1, self.max_pages + 1):
            page = self._page(board.address(partition.text, k))
            fresh = False
            for pos, e in enumerate(board.entries(page) if page else ()):
                if e.id in seen:
                    continue
                seen.add(e.id)
                fresh = True
                title, company = e.title.lower(), e.company.strip().lower()
                if self._wanted(title, company):
                    yield partition.number, k, pos, e.id, e.title, e.company, title, company, e.item
            if not fresh or board.last(page):
                return


class BoardListing(DataSource):
    @classmethod
    def name(cls):
        return "board_listing"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
