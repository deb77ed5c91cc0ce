"""What the plans must look like at any size."""

from pathlib import Path

import pytest

from gristmill.operators import scoring, stores
from gristmill.plans import queries as Q
from gristmill.plans.demo import RULES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the shared tables")

#: Folding any script, comparing texts, reading HTML and answers take Python, in Arrow batches.
PYTHON = {"normalize_text", "content_signature", "flagship", "fuzzy_dedup", "gate_full", "html_to_text", "parse_model_output", "form_answers", "embedded_json"}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - PYTHON))
def test_native_without_cross_joins(spark, name):
    text = plan(Q.QUERIES[name](spark, str(DATA)))
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
    assert "CartesianProduct" not in text


def test_only_needed_columns_are_read(spark):
    text = plan(Q.QUERIES["latest_action"](spark, str(DATA)))
    assert "props" not in text and "value" not in text.split("ReadSchema")[1].split("\n")[0]
    assert "text" not in plan(Q.QUERIES["source_facets"](spark, str(DATA)))


def test_cap_is_a_top_n_and_not_a_global_sort(spark):
    scored = spark.range(1000).selectExpr("id AS ord", "CAST(id % 101 AS INT) AS prefilter_score")
    text = plan(scoring.cap(scored, RULES))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_latest_entry_needs_no_window(spark):
    log = spark.range(10).selectExpr("id AS seq", "CAST(id % 3 AS STRING) AS signature", "'x' AS action")
    text = plan(stores.latest(log))
    assert "Window" not in text and "partial_max_by" in text


@pytest.mark.parametrize("name", ["inbox_order", "cache_order"])
def test_places_need_no_single_task(spark, name):
    frame = Q.QUERIES[name](spark, str(DATA))
    text = plan(frame)
    assert "Window" not in text and "SinglePartition" not in text
    assert sorted(r["place"] for r in frame.collect()) == [*range(1, frame.count() + 1)]


def test_only_rows_of_other_scripts_are_folded_in_python(spark):
    from gristmill.functions import text as X

    rows = [(1, "Ação  ÉL"), (2, "Ｆｕｌｌ ﬁt Việt"), (3, None), (4, "ёлка ½")]
    got = spark.createDataFrame(rows, "i int, t string").select("i", X.normalize("t").alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {1: "acao el", 2: "full fit viet", 3: "", 4: "елка 1 2"}
