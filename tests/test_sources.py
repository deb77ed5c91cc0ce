import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from gristmill.sources import http_source as H
from gristmill.sources import payloads as P
from gristmill.sources.registry import Registry, result_rows

TERMS = ["data"]


def now():
    return F.lit("2024-06-30 12:00:00").cast("timestamp")


def pages(spark, *payloads, name="p"):
    rows = [(f"{name}{i}" if not isinstance(p, tuple) else p[0], p if isinstance(p, str) else p[1] if isinstance(p, tuple) else json.dumps(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "path string, payload string")


def read(found, source, **kw):
    return sorted(P.finish(found, source, now(), **kw).collect(), key=lambda r: r["source_job_id"])


def test_remotive(spark):
    job = {"id": 7, "title": " Data  Lead", "company_name": "Acme", "description": "<p>Hi</p><p>you</p>", "publication_date": "2024-06-28T10:00:00", "url": "u", "candidate_required_location": "MX"}
    got = read(P.remotive(pages(spark, {"jobs": [job, {**job, "id": 8, "title": ""}]}, {"jobs": [job]}, "broken")), "remotive")
    assert [(r["source_job_id"], r["title"], r["description"], r["days_old"], r["source"]) for r in got] == [("7", "Data Lead", "Hi you", 2, "remotive")]


def test_remoteok_skips_the_notice_and_searches_tags(spark):
    items = [{"legal": "notice"}, {"id": "1", "position": "Lead", "tags": ["Data"], "company": "A", "description": "x", "date": "rubbish"}, {"id": "2", "position": "Cook", "tags": [], "description": "x"}]
    got = read(P.remoteok(pages(spark, items), TERMS), "remoteok")
    assert [(r["source_job_id"], r["days_old"], r["company"]) for r in got] == [("1", 999, "A")]


def test_himalayas_greenhouse_lever(spark):
    h = {"jobs": [{"guid": "https://x/jobs/abc", "title": "Data", "companyName": "", "description": "d", "pubDate": 1719662400, "applicationLink": "l", "locationRestrictions": ["MX", "CO"]}]}
    r = read(P.himalayas(pages(spark, h), TERMS), "himalayas")[0]
    assert (r["source_job_id"], r["company"], r["location_raw"], r["days_old"]) == ("abc", "Unknown", "MX, CO", 1)
    g = {"jobs": [{"id": 5, "title": "Lead", "company_name": "G", "content": "&lt;p&gt;data &amp;amp; more&lt;/p&gt;", "updated_at": "2024-06-30T00:00:00-06:00", "absolute_url": "u", "location": {"name": "Remote"}}]}
    r = read(P.greenhouse(pages(spark, g), TERMS), "greenhouse")[0]
    assert (r["description"], r["days_old"], r["location_raw"]) == ("data & more", 0, "Remote")
    lever = [{"id": "z", "text": "Data", "descriptionPlain": "plain", "createdAt": 1719000000000, "hostedUrl": "u", "categories": {"location": "CDMX"}}]
    r = read(P.lever(pages(spark, ("file:/x/big-co.json", json.dumps(lever))), TERMS), "lever")[0]
    assert (r["company"], r["days_old"]) == ("Big Co", 8)


def test_rss_and_sitemap(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        "<rss><channel><item><title>Acme: Data: Lead</title><link>https://x/jobs/acme-1</link><description>&lt;b&gt;Hi&lt;/b&gt;</description><pubDate>Fri, 28 Jun 2024 10:00:00 +0000</pubDate><region>LATAM</region></item>"
        "<item><title>Cook</title><link>y</link><description>z</description></item></channel></rss>"
    )
    r = read(P.wwr(spark, str(tmp_path / "feed.xml"), TERMS), "wwr")
    assert [(x["company"], x["title"], x["description"], x["days_old"], x["source_job_id"]) for x in r] == [("Acme", "Data: Lead", "Hi", 2, "acme-1")]
    (tmp_path / "map.xml").write_text("<urlset><url><loc>https://x/big-data-lead</loc></url><url><loc>https://x/cook</loc></url><url><loc>https://x/big-data-lead</loc></url></urlset>")
    assert [r["loc"] for r in P.sitemap_urls(spark, str(tmp_path / "map.xml"), ["big data"]).collect()] == ["https://x/big-data-lead"]


def test_listings_and_details(spark):
    listing = pages(spark, '<a href="/empleo/oferta/12">a</a><a href="/empleo/oferta/7-x">', '<a href="/empleo/oferta/12">')
    assert sorted(r["id"] for r in P.occ_ids(listing).collect()) == ["12", "7"]
    detail = {"o": {"t": "Data", "cn": None, "ld": "", "dlur": "Hace 3 días", "ur": "https://x/oferta/12"}}
    r = read(P.occ_details(pages(spark, detail), now()), "occ", require_description=False)[0]
    assert (r["source_job_id"], r["company"], r["days_old"], r["description"]) == ("12", "Unknown", 3, "")
    card = '<article data-id="{}"><h2><a href="/oferta/{}#x">Data &amp; BI</a></h2><p class="company">Acme</p><p class="date">Ayer</p></article>'
    html = "<html>" + card.format("A1", 1) + card.format("B2", 2) + P.CARD_END + card.format("C3", 3)
    got = read(P.computrabajo_cards(pages(spark, html), now()), "computrabajo", require_description=False)
    assert [(r["source_job_id"], r["title"], r["company"], r["days_old"], r["url"]) for r in got] == [("A1", "Data & BI", "Acme", 1, "/oferta/1"), ("B2", "Data & BI", "Acme", 1, "/oferta/2")]
    assert sorted(r["loc"] for r in P.linked_postings(pages(spark, '<a href="/job-posts/a"><a href="/x"><a href="/job-posts/a">', '<a href="/job-posts/b">')).collect()) == ["/job-posts/a", "/job-posts/b"]


def test_embedded_postings(spark):
    ld = '<script type="application/ld+json">{"@type":"JobPosting","title":"Data","description":"&lt;p&gt;a\nb&lt;/p&gt;","datePosted":"2024-06-29","hiringOrganization":{"name":"Acme"},"jobLocation":{"address":{"addressLocality":"X","addressRegion":"Y"}}}</script>'
    got = read(P.embedded_postings(pages(spark, ("https://x/jobs/9", ld), ("https://x/none", "<p>"))), "hireline")
    assert [(r["source_job_id"], r["description"], r["company"], r["location_raw"], r["days_old"]) for r in got] == [("9", "a b", "Acme", "X, Y", 1)]


def test_arrival_order_is_by_source_then_place(spark):
    a = P.finish(P.remotive(pages(spark, {"jobs": [{"id": i, "title": f"t{i}", "description": "d"} for i in (3, 1)]}, {"jobs": [{"id": 2, "title": "t2", "description": "d"}]})), "b", now())
    b = P.finish(P.remotive(pages(spark, {"jobs": [{"id": 9, "title": "t9", "description": "d"}]})), "a", now())
    got = P.arrival_order(a.unionByName(b).repartition(5)).orderBy("ord").collect()
    assert [(r["ord"], r["source"], r["source_job_id"]) for r in got] == [(1, "a", "9"), (2, "b", "3"), (3, "b", "1"), (4, "b", "2")]


def test_registry(spark):
    r = Registry()
    frame = spark.createDataFrame([(1,)], "x int")
    r.register("b", lambda s: frame)
    r.register("a", lambda s: frame.where("false"))
    r.register("c", lambda s: (_ for _ in ()).throw(RuntimeError("down")))
    r.register("d", lambda s: frame, enabled=False)
    assert r.names() == ["b", "a", "c", "d"] and r.enabled_names() == ["b", "a", "c"] and not r.is_enabled("d")
    assert r.choose() == ["a", "b", "c"] and r.choose(wanted=["d", "b"]) == ["b"] and r.choose("fast", slow=frozenset({"b"})) == ["a", "c"]
    with pytest.raises(KeyError):
        r.enable("x")
    results = [x for _, x in r.run_enabled(spark, lambda df, n: df)]
    assert [(x.source, x.status, x.yielded) for x in results] == [("a", "empty", 0), ("b", "ok", 1), ("c", "error", 0)] and "down" in results[2].error
    assert result_rows(spark, results).where("status = 'error'").count() == 1
    r.disable("b")
    r.enable("d")
    assert r.choose() == ["a", "c", "d"]


class Answer(io.BytesIO):
    class headers:  # noqa: N801
        @staticmethod
        def get_content_charset():
            return None


def test_fetch_retries(monkeypatch):
    def opener(codes):
        def open_(request, timeout):
            code = codes.pop(0)
            if code == 200:
                return Answer(b"ok")
            raise urllib.error.HTTPError("u", code, "", {}, None) if code else urllib.error.URLError("down")

        return open_

    waits = []
    assert H.fetch("http://x", 1, opener([503, 0, 429, 200]), waits.append) == "ok" and waits == [1, 2, 4]
    assert H.fetch("http://x", 1, opener([404]), waits.append) is None
    for codes in ([500] * 4, [403]):
        with pytest.raises(urllib.error.HTTPError):
            H.fetch("http://x", 1, opener(list(codes)), waits.append)


def test_data_source_reads_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"jobs": []}')
    spark.dataSource.register(H.HttpPages)
    got = spark.read.format("http_pages").option("urls", json.dumps([f"file://{tmp_path}/a.json"])).load().collect()
    assert [r["payload"] for r in got] == ['{"jobs": []}']
