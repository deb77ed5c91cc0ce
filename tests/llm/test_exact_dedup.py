import hashlib
from collections import Counter, defaultdict

import pytest

from gristmill.llm import exact_dedup as E
from gristmill.llm.common import Workspace


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def brute(rows):
    by = defaultdict(list)
    for d, t in rows:
        by[t or ""].append(d)
    return {d: (max(by[t or ""]), len(by[t or ""]), max(by[t or ""]) == d, sha(t)) for d, t in rows}


def told(frame):
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in frame.collect()}


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_matches_brute_force(docs, texts, batches):
    got = E.dedup(docs, batches)
    assert told(got) == brute(texts) and got.count() == len(texts)


def test_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(E, "SPREAD", 5)
    rows = [(i, "hot" if i % 3 else f"t{i % 40}") for i in range(300)]
    assert told(E.dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7))) == brute(rows)


def test_only_equal_texts_are_equal(spark):
    rows = list(enumerate(["a", "A", "a ", " a", "a\n", "é", "é", "", None, "a"]))
    got = told(E.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == brute(rows) and got[0][0] == 9 and got[7][0] == 8 and got[5][2]


def test_repeated_rows_and_rows_without_doc_id(spark):
    rows = [(None, "x"), (None, "x"), (None, "y"), (3, "y"), (3, "y"), (5, None), (None, "")]
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in E.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == Counter(
        {(None, None, 2, True): 1, (None, None, 2, False): 1, (None, 3, 3, False): 1, (3, 3, 3, True): 1, (3, 3, 3, False): 1, (5, 5, 2, True): 1, (None, 5, 2, False): 1}
    )


def test_keep_has_all_columns(spark, docs, texts, odd, empty):
    kept = E.keep(docs)
    assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes)
    want = brute(texts)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d in want if want[d][2])
    assert {r["kept"] for r in kept.collect()} == {"yes"}  # a column of the documents
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in E.keep(odd).collect()) == [(0, ""), (9, "a b c d e f g")]
    assert E.dedup(empty).count() == 0 and E.keep(empty).count() == 0


def batch(spark, rows):
    return spark.createDataFrame([(d, t) for d, t in rows], "doc_id bigint, text string")


def test_an_index_outlives_its_session_and_keeps_who_came_first(spark):
    root = Workspace(spark, "index").path("digests")
    with E.DigestIndex(spark, root, 3) as index:
        assert {r["doc_id"] for r in E.new_documents(batch(spark, [(1, "a"), (2, "b"), (7, "b")]), index).collect()} == {1, 7}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sorted_run_")]
    with E.DigestIndex(spark, root) as index:  # as another session would open it
        assert index.runs.buckets == 3
        assert {r["doc_id"] for r in E.new_documents(batch(spark, [(9, "a"), (8, "c"), (10, None)]), index).collect()} == {8, 10}
        # without the anti-join 9 would be the keeper of "a"
        assert {(bytes(r["digest"]).hex(), r["n"], r["keep"]["doc_id"]) for r in index.groups().collect()} == {(sha("a"), 2, 1), (sha("b"), 2, 7), (sha("c"), 1, 8), (sha(""), 1, 10)}


def test_an_append_that_breaks_off_has_not_happened(spark, monkeypatch):
    root = Workspace(spark, "index").path("digests")
    with E.DigestIndex(spark, root, 2) as index:
        E.new_documents(batch(spark, [(1, "a")]), index)
        with monkeypatch.context() as m:
            m.setattr(E.DigestIndex, "_commit", lambda self: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                E.new_documents(batch(spark, [(2, "b")]), index)
    with E.DigestIndex(spark, root) as index:
        assert {r["doc_id"] for r in E.new_documents(batch(spark, [(3, "b"), (4, "a")]), index).collect()} == {3}


def test_appends_are_merged(spark):
    root = Workspace(spark, "index").path("digests")
    with E.DigestIndex(spark, root, 2, fanout=3) as index:
        for k in range(6):
            E.new_documents(batch(spark, [(10 * k + i, f"t{k + i}") for i in range(4)]), index)
        assert len(index.segments) <= 3
        got = {bytes(r["digest"]).hex(): (r["n"], r["keep"]["doc_id"]) for r in index.groups().collect()}
    want = {}
    for k in range(6):
        for i in range(4):
            n, d = want.get(sha(f"t{k + i}"), (0, 10 * k + i))
            want[sha(f"t{k + i}")] = (n + 1, d)
    assert got == want


def test_segments_meet_without_a_shuffle(spark):
    root = Workspace(spark, "index").path("digests")
    with E.DigestIndex(spark, root, 4) as index:
        for k in range(3):
            E.new_documents(batch(spark, [(i, f"t{i}") for i in range(20 * k, 20 * k + 30)]), index)
        with index.runs.settings():
            plan = index.novel(index.runs.read(index.deltas[0]))._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort " not in plan
            # runs that overlap meet: a digest of every append is one group
            assert index.groups().count() == 70 and index.groups().agg({"n": "sum"}).first()[0] == 90


def test_everything_is_native(spark, docs):
    plan = E.dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
