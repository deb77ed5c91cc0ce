import re
from collections import Counter

from gristmill.llm import quality_rules as Q

SPACE = " \t\n\x0b\f\r"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {p for i, w in enumerate(windows) if count[w] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_measures_match_brute_force(docs, texts):
    got = {r["doc_id"]: (*tuple(r)[1:6], r["base_failed"]) for r in Q.judge(docs).collect()}
    assert got == {d: brute(t) for d, t in texts}


def test_verdict_and_keep(spark, docs, odd, empty):
    judged = {r["doc_id"]: r["kept"] for r in Q.judge(docs).collect()}
    kept = Q.keep(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, k in judged.items() if k}
    assert Q.judge(odd).count() == 4 and Q.keep(odd).count() == 0
    assert Q.judge(empty).count() == 0 and Q.keep(empty).count() == 0


def test_rules_reject_junk_and_keep_prose(spark):
    prose = "the cat and the dog went to the sea because it was warm and they had a lot of time for that sort of thing"
    junk = " ".join(f"w{i}###" for i in range(40))
    rows = spark.createDataFrame([(1, prose), (2, junk), (3, " ".join(f"WORD{i}!!" for i in range(40)))], "doc_id bigint, text string")
    assert [r["doc_id"] for r in Q.keep(rows).collect()] == [1]
    said = "The Cat AND THE dog WENT to a sea which none had ever seen before this one cold grey morning when all was still so very far away"
    line = lambda i: f"the cat{i} and a dog{i} went{i} home"
    lists = "\n".join(f"- {line(i)}" for i in range(10))
    broken = "\n".join(line(i) + (" ..." if i % 2 else "…") for i in range(10))
    few = "\n".join(f"{'-' if i < 8 else ''} {line(i)}{'...' if i < 3 else ''}" for i in range(10))
    rows = spark.createDataFrame([(1, said), (2, lists), (3, broken), (4, few)], "doc_id bigint, text string")
    assert [r["doc_id"] for r in Q.keep(rows).collect()] == [1, 4]


def test_verdicts_match_the_sql_of_the_query(spark, texts, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [*texts, (5000, "a ...\n" * 20), (5001, "  • x y z the of\n" * 20), (5002, "- a\r\n* b\u2028...\u2028")]
    pq.write_table(pa.table({"doc_id": [d for d, _ in rows], "text": pa.array([t for _, t in rows], pa.string())}), tmp_path / "documents.parquet")
    frame = Q.op1_quality_rules(spark, str(tmp_path))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
        want = con.sql(Q.ORACLE_SQL)
        order = [want.columns.index(c) for c in frame.columns]
        assert sorted(map(tuple, frame.collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


def test_plan_is_native(docs):
    plan = Q.judge(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
