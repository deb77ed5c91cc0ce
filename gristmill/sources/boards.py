"""The boards as chained sources: which pages are asked for, when paging stops, and what is read of them.

A board is a function of a :class:`Visit` that yields frames of postings, part by part, so that what came before a failure
is kept. Pages are written before they are read, so none is fetched twice. Listings that are paged come from the data
source of :mod:`gristmill.sources.listing_source`, whose readers page by themselves and drop what the title rule rejects.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import dates
from gristmill.functions import text as X
from gristmill.sources import payloads as P
from gristmill.sources.listing_source import COMPUTRABAJO, COMPUTRABAJO_END, HIMALAYAS, LISTINGS, OCC, BoardListing  # noqa: F401  (addresses of the boards)
from gristmill.sources.registry import Registry

#: Public addresses of the boards, fixed values.
REMOTIVE = "https://remotive.com/api/remote-jobs?search={term}"
WWR = "https://weworkremotely.com/categories/remote-management-and-finance-jobs.rss"
REMOTEOK = "https://remoteok.com/api"
GREENHOUSE = "https://boards-api.greenhouse.io/v1/boards/{company}/jobs?content=true"
LEVER = "https://api.lever.co/v0/postings/{company}?mode=json"
OCC_HOST = "https://www.occ.com.mx"
OCC_OFFER = "https://oferta.occ.com.mx/offer/{id}/d/j?ipo=41&iapo=1"
COMPUTRABAJO_HOST = "https://mx.computrabajo.com"
COMPUTRABAJO_OFFER = "https://oferta.computrabajo.com/offer/{id}/d/j?ipo=2&iapo=1"
HIRELINE = "https://hireline.io/mx/sitemap_ofertas.xml"
REMOTOJOB = "https://remotojob.com/rj-job-sitemap1.xml"
WEREMOTO_HOST, WEREMOTO_CATEGORIES = "https://www.weremoto.com", ("analista-de-datos", "it", "programacion", "administrativo", "data-entry")

Fetch = Callable[[DataFrame], DataFrame]
_RSS = P._st(channel=P._st(item=T.ArrayType(P._st(title=P._S, link=P._S, description=P._S, pubDate=P._S, region=P._S))))


@dataclass
class Visit:
    """What a board is visited with. ``fetch``: (path, ...) to the same with ``payload``, without what has no page."""

    spark: SparkSession
    fetch: Fetch
    keep: Callable[[DataFrame, str], DataFrame]
    now: Column
    terms: list[str]
    title_terms: list[str]
    rejected: Callable[[Column, Column], Column] = lambda title, company: F.lit(False)
    companies: dict[str, list[str]] = field(default_factory=dict)
    #: Pages per term, at most.
    max_pages: dict[str, int] = field(default_factory=lambda: {name: x.max_pages for name, x in LISTINGS.items()})
    #: Lower-case parts of titles and companies that listings drop where they are read.
    unwanted_titles: tuple[str, ...] = ()
    unwanted_companies: tuple[str, ...] = ()
    #: Options of the listings: via (a relay), timeout, pause.
    listing_options: dict[str, str] = field(default_factory=dict)

    def listing(self, name: str, terms: list[str]) -> DataFrame:
        """What a paged board lists for the terms, written; a term is a task, and the title rule is pushed into it."""
        self.spark.dataSource.register(BoardListing)
        self.spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        options = {"board": name, "terms": json.dumps(terms), "maxPages": str(self.max_pages[name]), **self.listing_options}
        rows = self.spark.read.format("board_listing").options(**options).load()
        for column, words in (("title_low", self.unwanted_titles), ("company_low", self.unwanted_companies)):
            for w in words:
                rows = rows.where(~F.contains(F.col(column), F.lit(w)))
        return self.keep(rows, f"{name}-listing")

    def pages(self, urls: list[tuple] | DataFrame, name: str) -> DataFrame:
        """The pages at ``urls``: (place, path) pairs or a frame with ``path``."""
        asked = urls if isinstance(urls, DataFrame) else self.spark.createDataFrame(urls, "place bigint, path string")
        return self.keep(self.fetch(asked), name)

    def finish(self, found: DataFrame, source: str, **how) -> DataFrame:
        """Postings whose title and company no rule rejects."""
        return P.finish(found.where(~self.rejected(F.col("title"), F.col("company"))), source, self.now, **how)


def _one_page(name: str, url: str, read: Callable[[Visit, DataFrame], DataFrame]):
    def board(v: Visit) -> Iterator[DataFrame]:
        yield v.finish(read(v, v.pages([(0, url)], name)), name)

    return board


def remotive(v: Visit) -> Iterator[DataFrame]:
    yield v.finish(P.remotive(v.pages([(i, REMOTIVE.format(term=quote(t))) for i, t in enumerate(v.title_terms)], "remotive")), "remotive")


def _read_wwr(v: Visit, pages: DataFrame) -> DataFrame:
    items = pages.select("path", F.posexplode(F.from_xml("payload", _RSS)["channel"]["item"]).alias("pos", "j")).where(X.matches_any(F.coalesce("j.title", F.lit("")), v.title_terms))
    j = items.withColumn("h", X.company_and_title(F.col("j.title")))
    return j.select("path", "pos", *P.raw(X.clean(F.col("h.title")), X.clean(F.col("h.company")), X.html_text("j.description"), F.col("j.link"), X.last_segment(F.col("j.link")), X.clean(F.col("j.region")), dates.parse_time(F.col("j.pubDate"))))


def himalayas(v: Visit) -> Iterator[DataFrame]:
    """Pages by offset until an empty one; the listing has the whole postings."""
    listed = v.listing("himalayas", [""]).select((F.col("page") * 1000 + F.col("pos")).alias("path"), F.concat(F.lit('{"jobs":['), "item", F.lit("]}")).alias("payload"))
    yield v.finish(P.himalayas(listed, v.title_terms), "himalayas")


def _by_company(name: str, address: str, read: Callable[[DataFrame, list[str]], DataFrame]):
    def board(v: Visit) -> Iterator[DataFrame]:
        companies = v.companies.get(name, [])
        if companies:
            pages = v.pages([(i, address.format(company=c)) for i, c in enumerate(companies)], name)
            slug = F.element_at(F.split(F.regexp_replace(F.substring_index("path", "?", 1), "/jobs$", ""), "/"), -1)
            found = read(pages.withColumn("path", F.substring_index("path", "?", 1)), v.title_terms)
            yield v.finish(found.withColumn("company", F.when(F.col("company") == "", slug).otherwise(F.col("company"))), name)

    return board


def _offers(v: Visit, ids: DataFrame, address: str, name: str) -> DataFrame:
    head, tail = address.split("{id}")
    return v.pages(ids.withColumn("path", F.concat(F.lit(head), "id", F.lit(tail))), f"{name}-offers")


def _place() -> Column:
    """Where a listing has an entry: by term, page and place on the page."""
    return F.struct((F.col("term") * 1000 + F.col("page")).cast("bigint").alias("place"), "pos")


def occ(v: Visit) -> Iterator[DataFrame]:
    """Ids once over all terms, then the offers, which alone have titles."""
    once = v.keep(v.listing("occ", v.terms).groupBy("id").agg(F.min(_place()).alias("at")), "occ-ids")
    offers = _offers(v, once, OCC_OFFER, "occ").withColumn("j", P._json("payload", P.OCC_DETAIL)["o"]).where("j IS NOT NULL")
    title = X.clean(F.replace(F.coalesce("j.t", F.lit("")), F.lit("**"), F.lit("")))
    found = offers.select(
        F.col("at.place").alias("path"), F.col("at.pos").alias("pos"),
        *P.raw(title, X.clean(F.col("j.cn")), X.html_text("j.ld"), F.concat(F.lit(OCC_HOST), F.coalesce("j.ur", F.lit(""))), F.col("id"), F.lit(""), P._no_time(), dates.relative_age(F.coalesce("j.dlur", F.lit("")), v.now)),
    )
    yield v.finish(found, "occ", require_description=False)


def computrabajo(v: Visit) -> Iterator[DataFrame]:
    """Cards are judged by their title before their offer is fetched."""
    listed = v.listing("computrabajo", v.terms)
    at = F.struct("place", "pos")
    cards = P.computrabajo_cards(listed.select(_place().alias("path"), F.col("item").alias("payload")), v.now).select("path.place", "path.pos", F.col("source_job_id").alias("id"), "title", "company", "url", "given_age")
    wanted = cards.where((F.col("title") != "") & ~v.rejected(F.col("title"), F.col("company")))
    once = v.keep(wanted.groupBy("id").agg(*[F.min_by(c, at).alias(c) for c in ("place", "pos", "title", "company", "url", "given_age")]), "computrabajo-cards")
    offers = _offers(v, once.select("id"), COMPUTRABAJO_OFFER, "computrabajo").select("id", X.html_text(P._json("payload", P.OCC_DETAIL)["o"]["ld"]).alias("text"))
    found = once.join(offers, "id", "left").select(
        F.col("place").alias("path"), "pos", *P.raw(F.col("title"), F.col("company"), F.col("text"), F.concat(F.lit(COMPUTRABAJO_HOST), "url"), F.col("id"), F.lit(""), P._no_time(), F.col("given_age"))
    )
    yield v.finish(found, "computrabajo", require_description=False)


def _by_sitemap(name: str, url: str):
    """A sitemap, whose slugs are searched before any page is fetched, and the postings that pages embed."""

    def board(v: Visit) -> Iterator[DataFrame]:
        listed = v.pages([(0, url)], name).select(F.explode(F.regexp_extract_all("payload", F.lit(r"<loc>\s*([^<\s]+)"), 1)).alias("path")).distinct()
        wanted = listed.where(X.matches_any(X.slug_words(X.last_segment(F.col("path"))), [*v.terms, *v.title_terms]))
        yield v.finish(P.embedded_postings(v.pages(wanted, f"{name}-pages")), name)

    return board


def weremoto(v: Visit) -> Iterator[DataFrame]:
    """Category pages, links once over all of them, then the pages they lead to."""
    listings = v.pages([(i, f"{WEREMOTO_HOST}/categoria-de-trabajo/{c}") for i, c in enumerate(WEREMOTO_CATEGORIES)], "weremoto")
    link = F.when(F.col("loc").startswith("http"), F.col("loc")).otherwise(F.concat(F.lit(WEREMOTO_HOST), "loc"))
    links = P.linked_postings(listings).select(link.alias("path")).distinct()
    yield v.finish(P.embedded_postings(v.pages(links, "weremoto-pages")), "weremoto")


BOARDS: dict[str, Callable[[Visit], Iterator[DataFrame]]] = {
    "occ": occ,
    "computrabajo": computrabajo,
    "remotive": remotive,
    "wwr": _one_page("wwr", WWR, _read_wwr),
    "remoteok": _one_page("remoteok", REMOTEOK, lambda v, pages: P.remoteok(pages, v.title_terms)),
    "himalayas": himalayas,
    "greenhouse": _by_company("greenhouse", GREENHOUSE, P.greenhouse),
    "lever": _by_company("lever", LEVER, P.lever),
    "hireline": _by_sitemap("hireline", HIRELINE),
    "weremoto": weremoto,
    "remotojob": _by_sitemap("remotojob", REMOTOJOB),
}


def build_registry(visit: Callable[[SparkSession], Visit]) -> Registry:
    """All boards, each visited anew when it is run."""
    registry = Registry()
    for name, board in BOARDS.items():
        registry.register(name, lambda spark, board=board: board(visit(spark)))
    return registry
