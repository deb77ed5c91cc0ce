import hashlib
from collections import defaultdict

import pytest

from gristmill.llm import line_dedup as L
from gristmill.llm.common import Workspace

SPACE = " \t\n\x0b\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows):
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(d)
    hot = {k: max(v) for k, v in held.items() if len(v) >= 5}
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if hot.get(key(x), d) == d]
        out[d] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_matches_brute_force(docs, texts, batches):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in L.dedup(docs, batches).collect()}
    want = brute(texts)
    assert got == want
    assert sum(v[1] for v in want.values()) > 5


def test_runs_are_compacted_and_keep_the_largest_id(spark):
    runs = L.LineRuns(spark, Workspace(spark, "runs"), 4, fanout=2)
    for part in ([(9, 1), (8, 1)], [(7, 1), (6, 2)], [(5, 1)], [(4, 2)]):
        runs.add(spark.createDataFrame([(h, h, d) for d, h in part], "a bigint, b bigint, doc_id bigint"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    new = spark.createDataFrame([(1, 1), (3, 3)], "a bigint, b bigint")
    assert [r["a"] for r in runs.novel(new).collect()] == [3]
    (run,) = runs.runs()
    assert {(r["a"], r["n_docs"], r["keep_id"]) for r in run.collect()} == {(1, 4, 9), (2, 2, 6)}
    assert {(r["a"], r["keep_id"]) for r in runs.repeated(3).collect()} == {(1, 9)}
    assert not runs.runs()


@pytest.mark.parametrize("fanout", [2, 9])
def test_the_batch_that_brought_a_line_names_its_keeper(spark, fanout):
    """Without the anti-join 6, 7 and 8 would be new again."""
    frame = lambda *rows: spark.createDataFrame([(h, h, d) for h, d in rows], "a bigint, b bigint, doc_id bigint")
    with L.LineRuns(spark, Workspace(spark, "runs"), 3, fanout) as runs:
        runs.add(frame((1, 5), (1, 4), (2, 5)))
        runs.add(frame((1, 8), (3, 3)))
        runs.add(frame((2, 7), (3, 6), (1, 1)))
        assert {(r["a"], r["keep_id"]) for r in runs.repeated(2).collect()} == {(1, 5), (2, 5), (3, 3)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sorted_run_")]


def test_a_job_that_fails_leaves_no_tables(spark, docs, monkeypatch):
    monkeypatch.setattr(L.LineRuns, "repeated", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        L.dedup(docs)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sorted_run_")]


def test_runs_meet_without_a_shuffle(spark):
    runs = L.LineRuns(spark, Workspace(spark, "runs"), 4, fanout=9)
    for first in (30, 20, 10):
        runs.add(spark.createDataFrame([(i, i, i) for i in range(first, first + 15)], "a bigint, b bigint, doc_id bigint"))
    with runs._settings():
        met = runs.novel(runs.runs()[0])
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort " not in plan and met.count() == 0
        merged = runs._merge(runs.runs()[:2])
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort " not in plan and merged.count() == 25
        assert runs._merge(runs.runs()).count() == 35


def test_keep_has_all_columns_and_follows_the_text(docs, texts):
    kept = L.keep(docs)
    assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes)
    want = brute(texts)
    for r in kept.collect():
        n, dropped, text = want[r["doc_id"]]
        assert (r["text"] or "") == text and r["kept"] == "yes"
        assert r["n_chars"] == len(text)


def test_odd_rows(odd, empty):
    assert L.dedup(odd).count() == 4
    assert L.dedup(empty).count() == 0 and L.keep(empty).count() == 0


def test_rows_that_repeat_a_doc_id_are_one_document(spark):
    line, other = "x" * 45, "y" * 45
    rows = [(1, line)] * 3 + [(2, line)] * 2 + [(None, line)] + [(i, f"{other}\nz{i}") for i in range(3, 8)] + [(7, f"w\n{other}")] * 2 + [(3, f"{other}\n{other}"), (None, other)]
    got = sorted((r["doc_id"] or 0, r["n_dropped"], r["text"]) for r in L.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    stay = [(0, 0, line), (0, 0, other), *[(1, 0, line)] * 3, *[(2, 0, line)] * 2, (7, 0, f"{other}\nz7"), *[(7, 0, f"w\n{other}")] * 2]
    assert got == sorted([*stay, (3, 2, ""), *[(i, 1, f"z{i}") for i in range(3, 7)]])


def test_many_lines_of_one_text(spark):
    lines = [f"{i:05d}" + "q" * 40 for i in range(4000)]
    rows = [(i, "\n".join(["keep", *lines, "end"])) for i in range(5)]
    got = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in L.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[4] == (0, rows[4][1]) and all(got[i] == (4000, "keep\nend") for i in range(4))


def test_digest_of_the_kept_text(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).selectExpr("sha2(encode('', 'UTF-8'), 256) AS h").first()["h"]
