import hashlib
import html
import re
import subprocess
import sys
import textwrap
from pathlib import Path

import duckdb
import pytest

from pyspark.sql import functions as F

from gristmill.functions import text as X
from gristmill.operators import gate
from gristmill.plans import demo
from gristmill.plans import queries as Q

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_entry_works_without_the_optional_parts(tmp_path):
    code = f"""
        import sys
        sys.path.insert(0, {str(ROOT)!r})
        import importlib.util as u
        found = u.find_spec
        u.find_spec = lambda name, package=None: None if name in ("gristmill.llm", "corpus_pipeline") else found(name, package)
        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name == "corpus_pipeline" or name.startswith("gristmill.llm"):
                    raise ModuleNotFoundError(name)
        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 30
        assert not any(n.startswith("op") or n == "pipeline" for n in e.queries())
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, timeout=120)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in found)


@pytest.mark.skipif(not DATA.exists(), reason="needs the shared tables")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_matches_its_oracle(spark, name):
    frame = Q.QUERIES[name](spark, str(DATA))
    found = frame.collect()
    if name not in Q.ORACLES:
        assert frame.columns and name in HELD_TO_BRUTE_FORCE
        return
    with duckdb.connect() as con:
        for f in DATA.glob("*.parquet"):
            con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        want = con.sql(Q.ORACLES[name])
        assert sorted(want.columns) == sorted(frame.columns)
        assert rows(frame.columns, found) == rows(want.columns, want.fetchall())


#: Queries without SQL, which the tests below hold to brute force on the same tables.
HELD_TO_BRUTE_FORCE = {"fuzzy_dedup", "gate_full", "html_to_text"}


def lcs(a, b):
    """Length of the longest common subsequence, one row after the other."""
    v, masks = (1 << len(a)) - 1, {c: sum(1 << i for i, x in enumerate(a) if x == c) for c in set(a)}
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & ((1 << len(a)) - 1)
    return len(a) - v.bit_count()


def greedy(jobs):
    """ord of those that an earlier one of their company stands for; (ord, company, text) in order of ord."""
    kept, gone = {}, set()
    for o, company, text in jobs:
        before = kept.setdefault(company, [])
        if text and any(200 * lcs(text, t) >= 90 * (len(text) + len(t)) for t in before if min(len(t), len(text)) >= 0.7 * max(len(t), len(text))):
            gone.add(o)
        else:
            before.append(text)
    return gone


@pytest.mark.skipif(not DATA.exists(), reason="needs the shared tables")
def test_fuzzy_dedup_and_the_gate_match_brute_force(spark):
    sf = str(DATA)
    j = demo.jobs(spark, sf).select("ord", X.normalize(F.col("company")).alias("c"), X.normalize(F.col("description")).alias("t"))
    told = {r["ord"]: (r["c"], r["t"]) for r in j.collect()}
    want = greedy([(o, *told[o]) for o in sorted(told)])
    assert {r["ord"] for r in Q.fuzzy_dedup(spark, sf).collect()} == want
    # the gate removes copies only among what its rules keep, and then what was seen or dismissed
    first = {r["ord"]: r["reject_reason"] for r in gate.classify(demo.jobs(spark, sf), demo.RULES).select("ord", "reject_reason").collect()}
    gone = greedy([(o, *told[o]) for o in sorted(told) if first[o] is None])
    got = Q.gate_full(spark, sf).collect()
    t = demo.tracking(spark, sf).collect()
    last = {}
    for r in sorted(t, key=lambda r: r["seq"]):
        last[r["signature"]] = r
    for r in got:
        reason = first[r["ord"]] or ("duplicate_within_run" if r["ord"] in gone else None)
        if reason is None and r["signature"] in last:
            reason = "dismissed_by_user" if last[r["signature"]]["action"] == "dismissed" else None
        assert r["reject_reason"] == (reason or "")
    assert len(got) == len(told)


@pytest.mark.skipif(not DATA.exists(), reason="needs the shared tables")
def test_text_of_pages_matches_brute_force(spark):
    got = {r["page_id"]: (r["text_sha1"], r["n_chars"]) for r in Q.html_to_text(spark, str(DATA)).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        bare = re.sub(r"(?is)<(script|style|template)\b.*?</\1\s*>|<!--.*?-->|<![^>]*>", " ", r["html"] or "")
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", bare)).split())
        assert got[r["page_id"]] == (hashlib.sha1(text.encode()).hexdigest(), len(text))


@pytest.mark.skipif(not DATA.exists(), reason="needs the shared tables")
def test_flagship_has_rows(spark):
    assert Q.flagship(spark, str(DATA)).count() > 0
