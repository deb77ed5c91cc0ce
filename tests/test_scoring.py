from pyspark.sql import functions as F

from gristmill.operators import rules as R
from gristmill.operators import scoring as S

RULES = R.RuleSet(
    role_weights={"analyst": 30, "lead": 15}, skill_weights={"SQL": 25, "Python": 5}, recency_bonus=((3, 10), (7, 8)), reject_floor=20, cap=3,
    title_caution_words={"manager": ("data",)}, positive_phrases=("remote",), reject_phrases=("native english",),
)
SCHEMA = "ord bigint, signature string, title string, company string, description string, remote_status string, days_old int, english_requirement string"


def rows(spark, n=8):
    texts = ["sql remote", "python", "sql", "nothing", "sql python remote", "sql", "sql native english", ""]
    return spark.createDataFrame([(i, f"s{i}", "Analyst" if i != 3 else "Manager", "c", texts[i % 8], "remote" if i % 2 == 0 else "unknown", i, "indeterminate" if i == 2 else "compatible") for i in range(n)], SCHEMA)


def test_scores_and_cap(spark):
    got = {r["ord"]: (r["prefilter_score"], r["disposition"]) for r in S.prefilter(rows(spark), RULES).collect()}
    assert got == {0: (85, "selected"), 1: (45, "deferred"), 2: (85, "selected"), 3: (5, "rejected"), 4: (88, "selected"), 5: (63, "deferred"), 6: (83, "deferred"), 7: (38, "deferred")}
    assert S.prefilter(rows(spark).where("false"), RULES).count() == 0
    assert {r["disposition"] for r in S.prefilter(rows(spark).where("ord = 3"), RULES).collect()} == {"rejected"}


def test_caution_words_are_answered_by_the_description(spark):
    frame = spark.createDataFrame([(1, "Manager", "data sql"), (2, "Manager", "sql")], "i int, t string, d string")
    got = frame.select("i", R.prefilter_score(F.col("t"), F.col("d"), F.lit("unknown"), F.lit(999), RULES).alias("s")).collect()
    assert [r["s"] for r in sorted(got)] == [25, 20]


def test_bands(spark):
    got = spark.createDataFrame([(s,) for s in (100, 95, 90, 85, 80, 79, 70, 69, 55, 54, 50, 49, 30, 29, 0)], "s int").select(R.grade(F.col("s")), R.fit(F.col("s"))).collect()
    assert [r[0] for r in got] == ["A+"] * 3 + ["A"] * 2 + ["B"] * 2 + ["C"] * 2 + ["D"] * 6
    assert [r[1] for r in got] == ["ideal"] * 2 + ["strong"] * 2 + ["good"] * 3 + ["moderate"] * 4 + ["weak"] * 2 + ["poor"] * 2


def test_answers_join_by_id_inside_their_batch(spark):
    calls = []

    def evaluator(batch):
        calls.append(len(batch))
        ids = [r["signature"] for r in batch]
        if "s7" in ids:
            raise RuntimeError("down")
        items = [f'{{"id": "{i}", "score": 90, "contras": ["muy senior", "sueldo"]}}' for i in reversed(ids)]
        return f'[{",".join(items)}, {{"id": "{ids[0]}", "score": 1}}, {{"id": "invented", "score": 100}}, {{"id": "s1", "score": 3}}]'

    selected = S.prefilter(rows(spark), R.RuleSet(**{**RULES.__dict__, "cap": 50})).where("disposition = 'selected'")
    results = S.evaluate(selected, evaluator, size=4)
    got = {r["signature"]: r for r in S.assemble(S.with_batches(selected, 4), results).collect()}
    order = ["s4", "s0", "s2", "s6", "s5", "s1", "s7"]
    assert set(got) == set(order)
    assert got["s4"]["ai_score"] is None and got["s4"]["final_score"] == 88  # named twice
    assert got["s1"]["ai_score"] is None  # named in the first batch, belongs to the second, which failed
    assert [got[s]["ai_score"] for s in ("s0", "s2", "s6")] == [90, 90, 90] and got["s2"]["flags"] == ["confirm_english"]


def test_validation_demotes_and_repeats_itself(spark):
    base = rows(spark).where("ord IN (0, 5, 6)").withColumns({"prefilter_score": F.lit(10), "ai_evaluated": F.lit(True), "ai_score": F.lit(120), "flags": F.array(F.lit("x")), "contras": F.array(F.lit("pide más, pero cuenta con ello"), F.lit("lejos, pero bien"))})
    once = S.validate(base, RULES)
    got = {r["ord"]: (r["ai_score"], r["grade"], r["flags"], r["contras"]) for r in once.collect()}
    assert got == {
        0: (100, "A+", ["x"], ["lejos, pero bien"]), 5: (79, "B", ["x", "remote_uncertain"], ["lejos, pero bien"]), 6: (79, "B", ["x", "remote_uncertain", "english_required"], ["lejos, pero bien"])
    }
    assert {r["ord"]: (r["ai_score"], r["grade"], r["flags"], r["contras"]) for r in S.validate(once, RULES).collect()} == got
    none = S.validate(base.withColumn("ai_evaluated", F.lit(False)).withColumn("ai_score", F.lit(None).cast("int")), RULES).first()
    assert none["final_score"] == 10 and len(none["contras"]) == 2


def test_rank_is_stable(spark):
    split = S.prefilter(rows(spark), RULES)
    ranked = S.rank(S.defer(split.where("disposition = 'selected'")), S.defer(split.where("disposition = 'deferred'")))
    assert [(r["ord"], r["part"]) for r in ranked.collect()] == [(4, 0), (0, 0), (2, 0), (6, 1), (5, 1), (1, 1), (7, 1)]


def test_score_jobs_calls_the_evaluator_once_per_batch(spark, tmp_path):
    def put(df, name):
        df.write.mode("overwrite").parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    log = str(tmp_path / "calls")

    def evaluator(batch):
        with open(log, "a") as f:
            f.write("x")
        return "[]"

    ranked = S.score_jobs(rows(spark), RULES, evaluator, put)
    assert ranked.count() == 7 and ranked.where("ai_evaluated").count() == 0
    assert open(log).read() == "x"
