import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from gristmill.sources import boards as B
from gristmill.sources import http_source as H
from gristmill.sources import listing_source as L
from gristmill.sources.registry import Registry, result_rows


def page_of(job):
    return f'<script type="application/ld+json">{json.dumps({"@type": "JobPosting", **job})}</script>'


def card(i, title, company="Acme"):
    return f'<article class="box_offer" data-id="{i}"><a class="js-o-link fc_base" href="/o/{i}">{title}</a><a class="fc_base t_ellipsis">{company}</a><p class="fs13 fc_aux mt15">Hace 2 días</p></article>'


def remotive(i, title):
    return {"id": i, "title": title, "company_name": "R", "description": "<p>d</p>", "publication_date": "2024-06-29T00:00:00", "url": "u"}


OFFER = json.dumps({"o": {"t": "**Data** lead", "cn": "Acme", "ld": "<p>do</p>", "dlur": "Ayer", "ur": "/x-1"}})
WEB = {
    B.REMOTIVE.format(term="data"): json.dumps({"jobs": [remotive(1, "Data lead"), remotive(2, "Sales data")]}),
    B.REMOTIVE.format(term="big%20data"): json.dumps({"jobs": [remotive(1, "Data lead"), remotive(3, "Big data")]}),
    B.WWR: "<rss><channel><item><title>Acme: Data boss</title><link>https://x/jobs/a-1</link><description>&lt;b&gt;Hi&lt;/b&gt;</description><pubDate>Fri, 28 Jun 2024 10:00:00 +0000</pubDate><region>MX</region></item><item><title>Co: Cook</title><link>y</link></item></channel></rss>",
    B.REMOTEOK: json.dumps([{"legal": "x"}, {"id": "9", "position": "Data", "company": "A", "tags": [], "description": "d", "date": "2024-06-30T00:00:00Z"}]),
    **{B.HIMALAYAS.format(size=100, offset=100 * k): json.dumps({"jobs": [{"guid": f"g/{k}", "title": "Data", "companyName": "H", "description": "d", "pubDate": 1719662400}] if k < 2 else []}) for k in range(4)},
    B.GREENHOUSE.format(company="gh"): json.dumps({"jobs": [{"id": 5, "title": "Lead", "company_name": "", "content": "&lt;p&gt;data&lt;/p&gt;", "updated_at": "2024-06-30T00:00:00Z", "absolute_url": "u"}]}),
    B.LEVER.format(company="big-co"): json.dumps([{"id": "z", "text": "Data", "descriptionPlain": "p", "createdAt": 1719000000000, "hostedUrl": "u"}]),
    # a term's second page brings nothing new, so the third is never asked for
    B.OCC.format(term="data"): "/empleo/oferta/11 /empleo/oferta/12 /empleo/oferta/11",
    B.OCC.format(term="data") + "?page=2": "/empleo/oferta/12",
    B.OCC.format(term="data") + "?page=3": "/empleo/oferta/99",
    B.OCC.format(term="big%20data"): "/empleo/oferta/12 /empleo/oferta/13",
    B.OCC_OFFER.format(id=11): OFFER,
    B.OCC_OFFER.format(id=12): OFFER.replace("Data", "Sales"),
    B.OCC_OFFER.format(id=99): OFFER,
    B.COMPUTRABAJO.format(term="data"): card(1, "Data") + card(2, "Sales") + B.COMPUTRABAJO_END + card(3, "Data beyond"),
    B.COMPUTRABAJO.format(term="data") + "?p=2": card(4, "Data on a page that is not asked for"),
    B.COMPUTRABAJO_OFFER.format(id=1): json.dumps({"o": {"ld": "<b>do</b> it"}}),
    B.COMPUTRABAJO_OFFER.format(id=2): json.dumps({"o": {"ld": "never"}}),
    B.HIRELINE: "<urlset><url><loc>https://h/data-lead-1</loc></url><url><loc>https://h/cook-2</loc></url></urlset>",
    "https://h/data-lead-1": page_of({"title": "Data lead", "description": "&lt;p&gt;hi&lt;/p&gt;", "datePosted": "2024-06-28", "hiringOrganization": {"name": "H"}}),
    "https://h/cook-2": page_of({"title": "Cook data", "description": "x"}),
    B.REMOTOJOB: "<urlset><url><loc> https://r/big-data </loc></url></urlset>",
    "https://r/big-data": '<script type="application/ld+json">{"@type":"JobPosting","title":"Big data","description":"a\nb"}</script>',
    **{f"{B.WEREMOTO_HOST}/categoria-de-trabajo/{c}": '<a href="/job-posts/data-1">x</a>' for c in B.WEREMOTO_CATEGORIES[:2]},
    f"{B.WEREMOTO_HOST}/job-posts/data-1": page_of({"title": "Data", "description": "w"}),
}


@pytest.fixture
def relay():
    """A server of captured pages and what it was asked for: /u/<quoted address>."""
    asked, pages = [], dict(WEB)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = unquote(self.path.removeprefix("/u/"))
            asked.append(url)
            body = pages.get(url)
            self.send_response(404 if body is None else 200)
            self.end_headers()
            self.wfile.write((body or "").encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/u/", asked, pages
    server.shutdown()


@pytest.fixture
def web(spark, tmp_path, relay):
    captured = spark.createDataFrame([*WEB.items()], "path string, payload string")
    via, asked, _ = relay

    def fetch(pages):
        asked.extend(r["path"] for r in pages.select("path").collect())
        return pages.join(captured, "path")

    def keep(rows, name):
        place = str(tmp_path / f"{len(list(tmp_path.iterdir()))}-{name}")
        rows.write.parquet(place)
        return spark.read.schema(rows.schema).parquet(place)

    visit = B.Visit(
        spark, fetch, keep, F.lit("2024-06-30 12:00:00").cast("timestamp"), ["data", "big data"], ["data", "big data"],
        rejected=lambda title, company: F.contains(F.lower(title), F.lit("sales")), companies={"greenhouse": ["gh", "gone"], "lever": ["big-co"]},
        unwanted_titles=("sales",), unwanted_companies=("blocked",), listing_options={"via": via},
    )
    return visit, asked, keep


def test_all_boards(spark, web):
    visit, asked, keep = web
    registry = B.build_registry(lambda s: visit)
    assert sorted(registry.names()) == sorted(B.BOARDS) and len(registry.names()) == 11
    got, results = {}, []
    for name in registry.names():
        rows, result = registry.run(spark, name, lambda df, n: keep(df, n.replace("/", "-")))
        results.append(result)
        got[name] = sorted((r["source_job_id"], r["title"], r["company"], r["description"], r["days_old"]) for r in rows.collect())
    assert {r.status for r in results} == {"ok"}, results
    assert got["remotive"] == [("1", "Data lead", "R", "d", 1), ("3", "Big data", "R", "d", 1)]
    assert got["wwr"] == [("a-1", "Data boss", "Acme", "Hi", 2)]
    assert [r[0] for r in got["remoteok"]] == ["9"]
    assert [r[0] for r in got["himalayas"]] == ["0", "1"] and B.HIMALAYAS.format(size=100, offset=300) not in asked
    assert got["greenhouse"][0][2] == "gh" and got["lever"][0][2] == "Big Co"
    assert got["occ"] == [("11", "Data lead", "Acme", "do", 1)]
    assert B.OCC_OFFER.format(id=12) in asked and B.OCC.format(term="data") + "?page=3" not in asked
    assert got["computrabajo"] == [("1", "Data", "Acme", "do it", 2)]
    assert B.COMPUTRABAJO_OFFER.format(id=2) not in asked and B.COMPUTRABAJO.format(term="data") + "?p=2" not in asked
    assert [r[1] for r in got["hireline"]] == ["Data lead"] and "https://h/cook-2" not in asked
    assert got["remotojob"][0][1] == "Big data" and [r[1] for r in got["weremoto"]] == ["Data"]


def listing(spark, via, board, terms, **options):
    spark.dataSource.register(L.BoardListing)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("board_listing").options(board=board, terms=json.dumps(terms), via=via, **options).load()


def test_a_listing_pages_in_its_tasks_and_takes_the_title_rule(spark, relay):
    via, asked, pages = relay
    pages[B.COMPUTRABAJO.format(term="x")] = card(1, "Data <b>A</b>") + card(2, "SALES lead") + card(3, "Data", "Blocked Co")
    pages[B.COMPUTRABAJO.format(term="x") + "?p=2"] = card(3, "Data", "Blocked Co") + card(4, "Data &amp; more")
    pages[B.COMPUTRABAJO.format(term="x") + "?p=3"] = card(4, "Data")
    rows = listing(spark, via, "computrabajo", ["x", "none"])
    assert rows.rdd.getNumPartitions() == 2
    unwanted = ~F.contains("title_low", F.lit("sales")) & ~F.contains("company_low", F.lit("blocked"))
    kept = rows.where(unwanted)
    assert "sales" not in kept._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]  # no filter is left for Spark
    asked.clear()
    got = sorted(kept.collect(), key=lambda r: (r["page"], r["pos"]))
    assert [(r["id"], r["title"], r["page"], r["pos"]) for r in got] == [("1", "Data A", 1, 0), ("4", "Data & more", 2, 1)]
    assert sorted(asked) == sorted([B.COMPUTRABAJO.format(term="x") + p for p in ("", "?p=2", "?p=3")] + [B.COMPUTRABAJO.format(term="none")])
    assert rows.where(F.col("page") == 2).count() == 1 and listing(spark, via, "computrabajo", ["x"], maxPages="1").count() == 3
    # what the reader takes for the title is what the postings have
    cards = B.P.computrabajo_cards(rows.select(F.col("id").alias("path"), F.col("item").alias("payload")), F.lit("2024-06-30 12:00:00").cast("timestamp"))
    assert {(r["path"], r["title"], r["company"]) for r in cards.collect()} == {(r["id"], r["title"], r["company"]) for r in rows.collect()}


def test_a_page_that_fails_ends_its_term_only(spark, relay):
    via, asked, pages = relay
    pages[B.OCC.format(term="y")] = "/empleo/oferta/1 /empleo/oferta/2"
    rows = listing(spark, via, "occ", ["y", "data"])
    assert sorted((r["term"], r["id"]) for r in rows.collect()) == [(0, "1"), (0, "2"), (1, "11"), (1, "12")]
    assert listing(spark, via, "himalayas", [""]).count() == 2
    pages[B.HIMALAYAS.format(size=100, offset=0)] = "{broken"
    assert listing(spark, via, "himalayas", [""]).count() == 0


def test_a_pushed_title_saves_its_offer(spark, web):
    visit, asked, keep = web
    visit.rejected = lambda title, company: F.lit(False)  # nothing but what is pushed rejects
    (rows,) = B.computrabajo(visit)
    assert [r["title"] for r in rows.collect()] == ["Data"] and B.COMPUTRABAJO_OFFER.format(id=2) not in asked
    visit.unwanted_titles = ()
    (rows,) = B.computrabajo(visit)
    assert sorted(r["title"] for r in rows.collect()) == ["Data", "Sales"] and B.COMPUTRABAJO_OFFER.format(id=2) in asked


def test_a_stream_of_pages_fetches_none_twice(spark, relay, tmp_path):
    via, asked, pages = relay
    urls = [f"{via}p{k}" for k in range(5)]
    pages.update({f"p{k}": f"page {k}" for k in range(8)})
    spark.dataSource.register(H.HttpPages)

    def visit(urls, want):
        found = spark.readStream.format("http_pages").option("urls", json.dumps(urls)).option("perBatch", 2).load()
        q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            deadline = time.time() + 90
            while time.time() < deadline and sum(p["numInputRows"] for p in q.recentProgress) < want:
                time.sleep(0.3)
        finally:
            q.stop()
        return sorted(r["payload"] for r in spark.read.schema("path string, payload string").parquet(str(tmp_path / "out")).collect())

    assert visit(urls, 5) == [f"page {k}" for k in range(5)]
    assert visit(urls + [f"{via}p{k}" for k in (5, 6, 7)], 3) == [f"page {k}" for k in range(8)]
    assert sorted(asked) == [f"p{k}" for k in range(8)]


def test_rows_before_an_error_are_kept(spark, tmp_path):
    def put(rows, name):
        rows.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    def midway(s):
        yield s.createDataFrame([("a",), ("b",)], "title string")
        yield s.createDataFrame([("c",)], "title string")
        raise RuntimeError("page three is gone")

    def in_a_task(s):
        yield s.createDataFrame([("a",)], "title string")
        yield s.range(1).select(F.raise_error(F.lit("broken row")).alias("title"))

    registry = Registry()
    registry.register("midway", midway)
    registry.register("in_a_task", in_a_task)
    registry.register("at_once", lambda s: (_ for _ in ()).throw(RuntimeError("down")))
    rows, result = registry.run(spark, "midway", put)
    assert (result.status, result.yielded, result.parts) == ("error", 3, 2) and "three" in result.error and rows.count() == 3
    rows, result = registry.run(spark, "in_a_task", put)
    assert (result.status, result.yielded) == ("error", 1) and rows.count() == 1
    rows, result = registry.run(spark, "at_once", put)
    assert rows is None and result.yielded == 0
    assert result_rows(spark, [result]).first()["status"] == "error"
