"""Captured payloads of job boards to postings: a reader per format, a projection per board.

Fetching and parsing are apart: what a board sent is stored first, and everything here reads stored payloads. Each
function takes a frame of payloads and returns raw postings (title, company, description, url, source_job_id,
location_raw, posted_text, age source); ``finish`` makes them postings of one schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gristmill.functions import dates
from gristmill.functions import text as X
from gristmill.operators.gate import first_per_key

_S = T.StringType()


def _st(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


#: What is read of each board's payload.
REMOTIVE = _st(jobs=T.ArrayType(_st(id=_S, title=_S, company_name=_S, description=_S, publication_date=_S, url=_S, candidate_required_location=_S)))
REMOTEOK = T.ArrayType(_st(id=_S, position=_S, company=_S, tags=T.ArrayType(_S), description=_S, date=_S, url=_S, location=_S))
HIMALAYAS = _st(jobs=T.ArrayType(_st(guid=_S, title=_S, companyName=_S, description=_S, pubDate=T.LongType(), applicationLink=_S, locationRestrictions=T.ArrayType(_S))))
GREENHOUSE = _st(jobs=T.ArrayType(_st(id=_S, title=_S, company_name=_S, content=_S, updated_at=_S, absolute_url=_S, location=_st(name=_S))))
LEVER = T.ArrayType(_st(id=_S, text=_S, descriptionPlain=_S, createdAt=T.LongType(), hostedUrl=_S, categories=_st(location=_S)))
OCC_DETAIL = _st(o=_st(t=_S, cn=_S, ld=_S, dlur=_S, ur=_S))
JOB_POSTING = _st(title=_S, description=_S, datePosted=_S, hiringOrganization=_st(name=_S), jobLocation=_st(address=_st(addressLocality=_S, addressRegion=_S)))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, payload) of whole text files, one page of a board each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("payload"))


def _json(column: str, schema: T.DataType) -> Column:
    return F.from_json(column, schema, {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE"})


def _items(pages: DataFrame, schema: T.DataType, within: str | None) -> DataFrame:
    parsed = pages.withColumn("_p", _json("payload", schema))
    items = F.col(f"_p.{within}") if within else F.col("_p")
    return parsed.select(*pages.columns, F.posexplode(items).alias("pos", "j"))


def raw(title, company, description, url, job_id, location, posted, days_old=None) -> list[Column]:
    empty = F.lit("")
    return [
        F.coalesce(title, empty).alias("title"), F.coalesce(company, empty).alias("company"), F.coalesce(description, empty).alias("description"),
        F.coalesce(url, empty).alias("url"), F.coalesce(job_id, empty).alias("source_job_id"), F.coalesce(location, empty).alias("location_raw"),
        posted.alias("posted"), (F.lit(None).cast("int") if days_old is None else days_old).alias("given_age"),
    ]


def _c(name: str) -> Column:
    return F.col(f"j.{name}")


def _no_time() -> Column:
    return F.lit(None).cast("timestamp")


def remotive(pages: DataFrame) -> DataFrame:
    j = _items(pages, REMOTIVE, "jobs")
    return j.select("path", "pos", *raw(X.clean(_c("title")), X.clean(_c("company_name")), X.html_text(_c("description")), _c("url"), _c("id"), X.clean(_c("candidate_required_location")), dates.parse_time(_c("publication_date"))))


def remoteok(pages: DataFrame, terms: list[str]) -> DataFrame:
    """The first array item is a notice without id; titles and tags are searched here, the board does not."""
    j = _items(pages, REMOTEOK, None).where(_c("id").isNotNull())
    j = j.where(X.matches_any(F.concat_ws(" ", _c("position"), F.array_join(_c("tags"), " ")), terms))
    return j.select("path", "pos", *raw(X.clean(_c("position")), X.clean(_c("company")), X.html_text(_c("description")), _c("url"), _c("id"), X.clean(_c("location")), dates.parse_time(_c("date"))))


def himalayas(pages: DataFrame, terms: list[str]) -> DataFrame:
    j = _items(pages, HIMALAYAS, "jobs").where(X.matches_any(F.coalesce(_c("title"), F.lit("")), terms))
    posted = F.timestamp_seconds(_c("pubDate"))
    return j.select("path", "pos", *raw(X.clean(_c("title")), X.clean(_c("companyName")), X.html_text(_c("description")), _c("applicationLink"), X.last_segment(_c("guid")), F.array_join(_c("locationRestrictions"), ", "), posted))


def greenhouse(pages: DataFrame, terms: list[str]) -> DataFrame:
    """Descriptions are HTML that was escaped once more."""
    j = _items(pages, GREENHOUSE, "jobs").withColumn("text", X.html_text(X.html_unescape(_c("content"))))
    j = j.where(X.matches_any(F.concat_ws("\n", _c("title"), "text"), terms))
    return j.select("path", "pos", *raw(X.clean(_c("title")), X.clean(_c("company_name")), F.col("text"), _c("absolute_url"), _c("id"), X.clean(_c("location.name")), dates.parse_time(_c("updated_at"))))


def lever(pages: DataFrame, terms: list[str]) -> DataFrame:
    """One company per page; its name is the slug, which the file is named by."""
    j = _items(pages, LEVER, None)
    slug = F.regexp_replace(X.last_segment(F.col("path")), r"\.[^.]*$", "")
    j = j.where(X.matches_any(F.concat_ws("\n", _c("text"), _c("descriptionPlain")), terms))
    return j.select("path", "pos", *raw(X.clean(_c("text")), X.display_company(slug), X.clean(_c("descriptionPlain")), _c("hostedUrl"), _c("id"), X.clean(_c("categories.location")), F.timestamp_millis(_c("createdAt"))))


def wwr(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """An RSS feed; a heading is ``Company: Title``."""
    schema = _st(title=_S, link=_S, description=_S, pubDate=_S, region=_S)
    feed = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    j = feed.withColumn("h", X.company_and_title(F.col("title"))).where(X.matches_any(F.coalesce("title", F.lit("")), terms))
    out = raw(X.clean(F.col("h.title")), X.clean(F.col("h.company")), X.html_text("description"), F.col("link"), X.last_segment(F.col("link")), X.clean(F.col("region")), dates.parse_time(F.col("pubDate")))
    return j.select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("pos"), *out)


def occ_ids(listings: DataFrame) -> DataFrame:
    """Offer ids of listing pages, each once, in order of appearance."""
    found = listings.select("path", F.posexplode(F.regexp_extract_all("payload", F.lit(r"/empleo/oferta/(\d+)"), 1)).alias("pos", "id"))
    return found.groupBy("id").agg(F.min(F.struct("path", "pos")).alias("at")).select("id", "at.path", "at.pos")


def occ_details(pages: DataFrame, now: Column) -> DataFrame:
    """One JSON detail per page; the date is relative. A posting without description is kept."""
    j = pages.withColumn("j", _json("payload", OCC_DETAIL)["o"]).withColumn("pos", F.lit(0))
    job_id = F.regexp_extract(F.coalesce(_c("ur"), F.lit("")), r"(\d+)(?:\D*)$", 1)
    return j.select("path", "pos", *raw(X.clean(_c("t")), X.clean(_c("cn")), X.html_text(_c("ld")), _c("ur"), job_id, F.lit(""), _no_time(), dates.relative_age(_c("dlur"), now)))


CARD_END = "<!-- end of results -->"


def computrabajo_cards(listings: DataFrame, now: Column, end_marker: str = CARD_END) -> DataFrame:
    """Cards of a listing up to the end marker; a card starts at its data-id."""
    shown = F.substring_index("payload", end_marker, 1)
    cards = listings.select("path", F.posexplode(F.regexp_extract_all(shown, F.lit(r'(?s)(data-id="[^"]+".*?)(?=data-id="|$)'), 1)).alias("pos", "card"))

    def part(pattern: str) -> Column:
        return F.regexp_extract("card", pattern, 1)

    def either(*patterns: str) -> Column:
        """What the first pattern with text finds."""
        return F.coalesce(*[F.nullif(X.html_text(part(p)), F.lit("")) for p in patterns], F.lit(""))

    link = r'(?s)<a[^>]*class="[^"]*\b{}\b[^"]*"[^>]*>(.*?)</a>'
    title = either(link.format("js-o-link"), r"(?s)<h2[^>]*>(.*?)</h2>")
    company = either(link.format("t_ellipsis"), r'(?s)<p class="[^"]*company[^"]*"[^>]*>(.*?)</p>')
    age = dates.relative_age(either(r'(?s)<p[^>]*class="[^"]*\bmt15\b[^"]*"[^>]*>(.*?)</p>', r'(?s)<p class="[^"]*date[^"]*"[^>]*>(.*?)</p>'), now)
    return cards.select("path", "pos", *raw(title, company, F.lit(""), part(r'href="([^"#]*)'), part(r'data-id="([^"]+)"'), F.lit(""), _no_time(), age))


def sitemap_urls(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """URLs of a sitemap whose slug holds a term: decided before any page is fetched."""
    rows = spark.read.format("xml").option("rowTag", "url").schema(_st(loc=_S)).load(path)
    return rows.where(X.matches_any(X.slug_words(X.last_segment(F.col("loc"))), terms)).select("loc").distinct()


def linked_postings(listings: DataFrame, pattern: str = r'href="([^"]*/job-posts/[^"]+)"') -> DataFrame:
    """Links of category pages, each once over all categories."""
    return listings.select(F.explode(F.regexp_extract_all("payload", F.lit(pattern), 1)).alias("loc")).distinct()


def embedded_postings(pages: DataFrame) -> DataFrame:
    """Pages with an embedded JobPosting; ``path`` is the URL or file of the page."""
    j = pages.withColumn("j", _json(X.job_posting("payload"), JOB_POSTING)).where("j IS NOT NULL").withColumn("pos", F.lit(0))
    place = F.concat_ws(", ", _c("jobLocation.address.addressLocality"), _c("jobLocation.address.addressRegion"))
    return j.select("path", "pos", *raw(X.clean(X.html_unescape(_c("title"))), X.clean(_c("hiringOrganization.name")), X.html_text(X.html_unescape(_c("description"))), F.col("path"), X.last_segment(F.col("path")), place, dates.parse_time(_c("datePosted"))))


def finish(found: DataFrame, source: str, now: Column, require_description: bool = True) -> DataFrame:
    """Raw postings of a board as postings: without title they go, ids come once, order is page and place."""
    rows = found.where("title <> ''")
    if require_description:
        rows = rows.where("description <> ''")
    rows = rows.withColumn("_at", F.struct("path", "pos")).withColumn("_key", F.when(F.col("source_job_id") != "", F.col("source_job_id")).otherwise(F.col("url")))
    rows = first_per_key(rows, "_key", "_at")
    age = F.coalesce("given_age", dates.elapsed_days(F.col("posted"), now))
    return rows.select(
        F.lit(source).alias("source"), "source_job_id", "title", F.when(F.col("company") == "", "Unknown").otherwise(F.col("company")).alias("company"),
        "description", "url", F.to_date("posted").alias("posted_at"), age.cast("int").alias("days_old"), "location_raw", now.alias("collected_at"), F.col("_at").alias("arrival"),
    )


def arrival_order(postings: DataFrame) -> DataFrame:
    """``ord``: source name first, then the place inside the source. Ordinals are per source, so no global sort."""
    w = Window.partitionBy("source").orderBy("arrival")
    counted = postings.groupBy("source").agg(F.count("*").alias("_n"))
    before = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("source", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # one row per source
    return postings.withColumn("_k", F.row_number().over(w)).join(F.broadcast(offsets), "source").withColumn("ord", F.col("_base") + F.col("_k")).drop("_k", "_base", "arrival")
