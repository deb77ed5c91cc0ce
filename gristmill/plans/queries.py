"""One query per operator over the shared tables, with the DuckDB statement for the same rows where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import dates
from gristmill.functions import model_output as M
from gristmill.functions import text as X
from gristmill.operators import fuzzy, gate, scoring, stores
from gristmill.operators import rules as R
from gristmill.plans import pipeline, views
from gristmill.plans import sql as S
from gristmill.plans.demo import JOBS_SQL, NOW, RULES, TODAY, TRACK_SQL, ZONE, jobs, read, tracking
from gristmill.plans.stage import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_STATUS, _EVIDENCE = S.remote("t", RULES)
_CLASSIFIED = f"""{JOBS_SQL}, told AS (SELECT *, {S.LOWERED} AS t FROM jobs),
verdict AS (SELECT *, {S.rejected(RULES)} AS bad_title, {S.english_status('t', RULES)} AS english, {_STATUS} AS remote FROM told),
gated AS (SELECT *, CASE WHEN bad_title THEN 'excluded_title_or_company' WHEN english = 'reject' THEN 'advanced_english_required'
  WHEN remote <> 'remote' THEN 'not_remote:' || remote WHEN days_old > 15 THEN 'stale' END AS reject_reason FROM verdict)"""
_SCORED = f"{_CLASSIFIED}, scored AS (SELECT *, {S.score('remote', RULES)} AS score FROM gated)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _flat(column: str, name: str):
    return F.array_join(F.col(column), "; ").alias(name)


@query(f"SELECT doc_id, sha1({S.normalize('text')}) AS norm_sha1, length({S.normalize('text')})::BIGINT AS norm_chars FROM documents")
def normalize_text(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", X.normalize(F.col("text")).alias("n"))
    return d.select("doc_id", F.sha1("n").alias("norm_sha1"), F.char_length("n").cast("bigint").alias("norm_chars"))


@query(f"WITH {JOBS_SQL} SELECT ord, sha1({S.normalize('company')} || '|' || {S.normalize('title')} || '|' || left({S.normalize('description')}, 400)) AS signature FROM jobs")
def content_signature(spark, sf):
    return jobs(spark, sf).select("ord", X.signature(F.col("company"), F.col("title"), F.col("description")).alias("signature"))


@query(r"SELECT doc_id, (length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 200) AS thin_description, length(trim(regexp_replace(text, '\s+', ' ', 'g')))::BIGINT AS clean_chars FROM documents")
def thin_flag(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", X.is_thin(F.col("text")).alias("thin_description"), F.char_length(X.clean(F.col("text"))).cast("bigint").alias("clean_chars"))


@query(f"WITH {JOBS_SQL} SELECT ord, {S.has_any('lower(trim(company))', RULES.excluded_companies)} AS company_excluded, {S.has_any('lower(title)', RULES.excluded_title_keywords)} AS title_excluded FROM jobs")
def title_reject(spark, sf):
    return jobs(spark, sf).select("ord", R.company_excluded(F.col("company"), RULES).alias("company_excluded"), R.title_excluded(F.col("title"), RULES).alias("title_excluded"))


@query(f"WITH {JOBS_SQL} SELECT ord, {S.caution(RULES)} AS flags, {S.caution(RULES, True)} AS unrescued FROM jobs")
def caution_flags(spark, sf):
    j = jobs(spark, sf).select("ord", R.caution_flags(F.col("title"), RULES).alias("f"), R.caution_flags(F.col("title"), RULES, F.col("description")).alias("u"))
    return j.select("ord", _flat("f", "flags"), _flat("u", "unrescued"))


@query("SELECT doc_id, (contains(lower(text), 'thing') OR contains(lower(text), 'que de') OR contains(lower(text), 'nicht')) AS matched FROM documents")
def matches_any_term(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.matches_any(F.col("text"), ["thing", "que de", "nicht"]).alias("matched"))


@query(f"WITH {JOBS_SQL}, told AS (SELECT *, {S.LOWERED} AS t FROM jobs) SELECT ord, {_STATUS} AS status, {_EVIDENCE} AS evidence FROM told")
def remote_class(spark, sf):
    j = jobs(spark, sf).select("ord", R.remote(R.lowered(F.col("title"), F.col("description")), RULES).alias("r"))
    return j.select("ord", F.col("r.status").alias("status"), _flat("r.evidence", "evidence"))


@query(f"WITH {JOBS_SQL}, told AS (SELECT *, {S.LOWERED} AS t FROM jobs) SELECT ord, {S.english_status('t', RULES)} AS status, {S.english_evidence('t', RULES)} AS evidence FROM told")
def english_class(spark, sf):
    j = jobs(spark, sf).select("ord", R.english(R.lowered(F.col("title"), F.col("description")), RULES).alias("r"))
    return j.select("ord", F.col("r.status").alias("status"), _flat("r.evidence", "evidence"))


@query(f"WITH {_CLASSIFIED} SELECT ord, coalesce(reject_reason, '') AS reject_reason FROM gated")
def gate_reasons(spark, sf):
    return gate.classify(jobs(spark, sf), RULES).select("ord", F.coalesce("reject_reason", F.lit("")).alias("reject_reason"))


@query(f"WITH {_CLASSIFIED} SELECT source, reject_reason, count(*)::BIGINT AS n FROM gated WHERE reject_reason IS NOT NULL GROUP BY ALL")
def funnel(spark, sf):
    return stores.funnel(gate.classify(jobs(spark, sf), RULES))


_COUNTED = f"""{_SCORED}, k AS (SELECT ord, score, row_number() OVER (ORDER BY score DESC, ord) AS k FROM scored WHERE reject_reason IS NULL AND score >= {RULES.reject_floor})"""


@query(
    f"""WITH {_COUNTED} SELECT (SELECT count(*) FROM gated)::BIGINT AS collected, (SELECT count(*) FROM gated WHERE reject_reason IS NULL)::BIGINT AS gated_kept,
  (SELECT count(*) FROM gated WHERE reject_reason IS NOT NULL)::BIGINT AS gated_rejected,
  (SELECT count(*) FROM scored WHERE reject_reason IS NULL AND score < {RULES.reject_floor})::BIGINT AS prefilter_rejected,
  (SELECT count(*) FROM k WHERE k <= {RULES.cap})::BIGINT AS prefilter_selected, (SELECT count(*) FROM k WHERE k > {RULES.cap})::BIGINT AS prefilter_deferred,
  0::BIGINT AS ai_evaluated, (SELECT count(*) FROM k)::BIGINT AS "final\""""
)
def run_counts(spark, sf):
    put = stage(spark)
    g = put(gate.classify(jobs(spark, sf), RULES).drop("url", "source_job_id"), "gated")
    split = put(scoring.prefilter(gate.kept(g), RULES, put).select("ord", "source", "prefilter_score", "english_requirement", "disposition"), "split")
    ranked = scoring.rank(scoring.defer(split.where("disposition = 'selected'")), scoring.defer(split.where("disposition = 'deferred'")))
    return pipeline.counts_of(g, split, ranked)


@query(f"WITH {JOBS_SQL} SELECT min(ord) AS ord, source, count(*)::BIGINT AS copies FROM jobs GROUP BY source, description")
def exact_dedup_first(spark, sf):
    # the text travels as a digest, and only the smallest ord of each meets
    j = jobs(spark, sf).select("ord", "source", F.sha2("description", 256).alias("digest"))
    return j.groupBy("source", "digest").agg(F.min("ord").alias("ord"), F.count("*").alias("copies")).drop("digest")


@query()
def fuzzy_dedup(spark, sf):
    return fuzzy.duplicates(jobs(spark, sf))


@query()
def gate_full(spark, sf):
    t = tracking(spark, sf)
    cache = t.groupBy("signature").agg(F.to_date(F.max("tracked_at")).alias("last_seen"))
    g = gate.gate(jobs(spark, sf), RULES, today=F.lit(TODAY).cast("date"), cache=cache, dismissed=stores.dismissed(t))
    return g.select("ord", "signature", F.coalesce("reject_reason", F.lit("")).alias("reject_reason"))


_CACHE = f"{TRACK_SQL}, cache AS (SELECT signature, max(tracked_at)::DATE AS last_seen FROM track WHERE value > 330 GROUP BY signature)"


@query(f"WITH {_CACHE} SELECT seq, t.signature FROM track t WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.signature = t.signature AND date_diff('day', c.last_seen, DATE '2024-02-05') < 30)")
def seen_recently_anti(spark, sf):
    t = tracking(spark, sf)
    cache = t.where("value > 330").groupBy("signature").agg(F.to_date(F.max("tracked_at")).alias("last_seen"))
    return t.join(gate.recently_seen(cache, F.lit("2024-02-05").cast("date")), "signature", "left_anti").select("seq", "signature")


@query(f"WITH {TRACK_SQL}, last AS (SELECT signature, arg_max(action, seq) AS action FROM track GROUP BY signature) SELECT seq, t.signature FROM track t WHERE signature NOT IN (SELECT signature FROM last WHERE action = 'dismissed')")
def dismissed_anti(spark, sf):
    t = tracking(spark, sf)
    return t.join(stores.dismissed(t), "signature", "left_anti").select("seq", "signature")


@query(f"WITH {TRACK_SQL} SELECT seq, signature, (signature NOT IN (SELECT signature FROM track WHERE event_type = 'signup')) AS is_new FROM track")
def mark_new(spark, sf):
    t = tracking(spark, sf)
    return stores.mark_new(t, t.where("event_type = 'signup'")).select("seq", "signature", "is_new")


@query(f"WITH {TRACK_SQL} SELECT signature, max(seq) AS seq, arg_max(action, seq) AS action, arg_max(tracked_at, seq) AS tracked_at FROM track GROUP BY signature")
def latest_action(spark, sf):
    return stores.latest(tracking(spark, sf).select("seq", "signature", "action", "tracked_at"))


@query(f"WITH {TRACK_SQL} SELECT signature, min(tracked_at) AS first_seen_at FROM track GROUP BY signature")
def first_seen(spark, sf):
    return tracking(spark, sf).groupBy("signature").agg(F.min("tracked_at").alias("first_seen_at"))


_SHOWN = f"""{TRACK_SQL},
old AS (SELECT signature, min(tracked_at)::DATE AS first_seen, max(tracked_at)::DATE AS last_seen, max(floor(value))::INT AS final_score FROM track WHERE action <> 'applied' GROUP BY signature),
shown AS (SELECT signature, arg_max(floor(value)::INT, seq) AS final_score FROM track WHERE action = 'applied' GROUP BY signature)"""


@query(
    f"""WITH {_SHOWN} SELECT coalesce(o.signature, s.signature) AS signature, coalesce(o.first_seen, DATE '{TODAY}') AS first_seen,
CASE WHEN s.signature IS NOT NULL THEN DATE '{TODAY}' ELSE o.last_seen END AS last_seen, coalesce(s.final_score, o.final_score) AS final_score
FROM old o FULL JOIN shown s ON o.signature = s.signature"""
)
def cache_merge(spark, sf):
    t = tracking(spark, sf)
    old = t.where("action <> 'applied'").groupBy("signature").agg(
        F.to_date(F.min("tracked_at")).alias("first_seen"), F.to_date(F.max("tracked_at")).alias("last_seen"), F.max(F.floor("value")).cast("int").alias("final_score")
    )
    old = old.withColumns({c: F.lit("") for c in ("title", "company", "source")})
    shown = t.where("action = 'applied'").select("signature", F.col("seq").alias("ord"), F.floor("value").cast("int").alias("final_score"), *[F.lit("").alias(c) for c in ("title", "company", "source")])
    return stores.merge_cache(old, shown, F.lit(TODAY).cast("date")).select("signature", "first_seen", "last_seen", "final_score")


@query(f"WITH {_SCORED} SELECT ord, score AS prefilter_score FROM scored")
def prefilter_score(spark, sf):
    return _all_scored(spark, sf).select("ord", "prefilter_score")


def _all_scored(spark, sf):
    """Postings with their score, whatever the gate says of them."""
    j = jobs(spark, sf)
    j = j.withColumn("remote_status", R.remote(R.lowered(F.col("title"), F.col("description")), RULES)["status"])
    return j.withColumn("prefilter_score", R.prefilter_score(F.col("title"), F.col("description"), F.col("remote_status"), F.col("days_old"), RULES))


def _split(spark, sf):
    """Scored postings with their disposition; the scores are a stage table without texts."""
    scored = _all_scored(spark, sf).select("ord", "source", "prefilter_score")
    return scoring.cap(stage(spark)(scored, "scored"), RULES)


@query(
    f"""WITH {_SCORED}, r AS (SELECT ord, score, row_number() OVER (ORDER BY score DESC, ord) AS k FROM scored WHERE score >= {RULES.reject_floor})
SELECT s.ord, s.score AS prefilter_score, CASE WHEN s.score < {RULES.reject_floor} THEN 'rejected' WHEN r.k <= {RULES.cap} THEN 'selected' ELSE 'deferred' END AS disposition
FROM scored s LEFT JOIN r ON s.ord = r.ord"""
)
def prefilter_cap(spark, sf):
    return _split(spark, sf).select("ord", "prefilter_score", "disposition")


@query(f"SELECT event_id, ({S.recency('floor(value)', RULES)})::INT AS bonus FROM events")
def recency_bonus(spark, sf):
    return read(spark, sf, "events").select("event_id", R.recency_bonus(F.floor("value"), RULES).cast("int").alias("bonus"))


@query(f"WITH s AS (SELECT o_orderkey, (floor(o_totalprice) % 101)::INT AS score FROM orders) SELECT o_orderkey, score, {S.grade('score')} AS grade, {S.fit('score')} AS fit FROM s")
def grade_fit_bands(spark, sf):
    s = read(spark, sf, "orders").select("o_orderkey", (F.floor("o_totalprice") % 101).cast("int").alias("score"))
    return s.select("o_orderkey", "score", R.grade(F.col("score")).alias("grade"), R.fit(F.col("score")).alias("fit"))


@query(
    """WITH job AS (SELECT DISTINCT (user_id % 10)::INT AS batch_id, 'u' || user_id AS signature FROM events),
res AS (SELECT (event_id % 10)::INT AS batch_id, 'u' || user_id AS signature, floor(value)::INT AS ai_score FROM events WHERE event_type = 'purchase'),
once AS (SELECT batch_id, signature, max(ai_score) AS ai_score FROM res GROUP BY ALL HAVING count(*) = 1)
SELECT job.batch_id, job.signature, once.ai_score FROM job LEFT JOIN once ON job.batch_id = once.batch_id AND job.signature = once.signature"""
)
def batch_id_join(spark, sf):
    e = read(spark, sf, "events")
    job = e.select((F.col("user_id") % 10).cast("int").alias("batch_id"), F.concat(F.lit("u"), "user_id").alias("signature")).distinct()
    res = e.where("event_type = 'purchase'").select((F.col("event_id") % 10).cast("int").alias("batch_id"), F.concat(F.lit("u"), "user_id").alias("signature"), F.floor("value").cast("int").alias("ai_score"))
    return scoring.join_results(job, res).select("batch_id", "signature", "ai_score")


_CONTRA = """CASE ord % 4 WHEN 0 THEN 'perfil senior' WHEN 1 THEN 'pide mucho, pero cuenta con ello' WHEN 2 THEN 'queda lejos, pero bien' ELSE 'sueldo bajo' END"""


@query(f"WITH {JOBS_SQL} SELECT ord, CASE WHEN ord % 4 IN (0, 1) THEN 0 ELSE 1 END::INT AS n_left FROM jobs")
def strip_contras(spark, sf):
    j = jobs(spark, sf).select("ord", F.array(F.expr(_CONTRA)).alias("contras"))
    return j.select("ord", F.size(scoring.strip_contradictions(F.col("contras"))).alias("n_left"))


@query(
    f"""WITH {_CLASSIFIED}, s AS (SELECT *, (ord % 101)::INT AS ai FROM gated),
v AS (SELECT *, ai > 79 AND remote <> 'remote' AS off_site, ai > 79 AND english = 'reject' AS language FROM s),
f AS (SELECT *, CASE WHEN off_site OR language THEN 79 ELSE ai END AS final_score FROM v)
SELECT ord, final_score::INT AS final_score, {S.grade('final_score')} AS grade,
  concat_ws('; ', CASE WHEN off_site THEN 'remote_uncertain' END, CASE WHEN language THEN 'english_required' END) AS flags FROM f"""
)
def validate_demote(spark, sf):
    none = F.array().cast("array<string>")
    j = jobs(spark, sf).withColumns({"ai_evaluated": F.lit(True), "ai_score": (F.col("ord") % 101).cast("int"), "prefilter_score": F.lit(0), "flags": none, "contras": none})
    return scoring.validate(j, RULES).select("ord", "final_score", "grade", _flat("flags", "flags"))


@query(
    f"""WITH {_SCORED}, r AS (SELECT ord, score, row_number() OVER (ORDER BY score DESC, ord) AS k FROM scored WHERE score >= {RULES.reject_floor})
SELECT ord, score AS final_score, {S.grade('score')} AS grade, (k <= {RULES.cap}) AS in_cap FROM r"""
)
def rank_jobs(spark, sf):
    p = _split(spark, sf).withColumn("english_requirement", F.lit("compatible"))
    ranked = scoring.rank(scoring.defer(p.where("disposition = 'selected'")), scoring.defer(p.where("disposition = 'deferred'")))
    return ranked.select("ord", "final_score", "grade", (F.col("part") == 0).alias("in_cap"))


_YIELDS = """y AS (SELECT event_type AS source, tracked_at::DATE AS day, count(*)::INT AS yielded,
  CASE WHEN count(*) % 11 = 0 THEN 'error' ELSE 'ok' END AS status, date_diff('day', DATE '1970-01-01', tracked_at::DATE)::BIGINT AS seq FROM track GROUP BY ALL)"""
_BASE = f"""WITH {TRACK_SQL}, {_YIELDS}, b AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 2
  THEN avg(yielded) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS baseline FROM y)"""


def _yields(spark, sf):
    t = tracking(spark, sf).select(F.col("event_type").alias("source"), F.to_date("tracked_at").alias("day"))
    y = t.groupBy("source", "day").agg(F.count("*").cast("int").alias("yielded"))
    return y.select("source", "day", "yielded", F.when(F.col("yielded") % 11 == 0, "error").otherwise("ok").alias("status"), F.unix_date("day").cast("bigint").alias("seq"))


@query(f"{_BASE} SELECT source, day, yielded, round(baseline, 6) AS baseline FROM b")
def health_baseline(spark, sf):
    return stores.with_baseline(_yields(spark, sf)).select("source", "day", "yielded", F.round("baseline", 6).alias("baseline"))


@query(f"{_BASE} SELECT source, day, CASE WHEN status = 'error' THEN 'error' WHEN yielded = 0 THEN 'zero' WHEN baseline > 0 AND yielded < baseline * 0.3 THEN 'low' ELSE 'ok' END AS health FROM b")
def health_class(spark, sf):
    b = stores.with_baseline(_yields(spark, sf))
    return b.select("source", "day", stores.health_status(F.col("status"), F.col("yielded"), F.col("baseline")).alias("health"))


def _labels(spark, sf):
    l = read(spark, sf, "labels")
    reason = F.when(F.col("toxic") == 1, "off_role").when(F.col("doc_id") % 3 == 0, "not_remote")
    return l.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"), reason.alias("reason"))


@query("SELECT (count(*) FILTER (WHERE quality = 1))::BIGINT AS good, (count(*) FILTER (WHERE quality <> 1))::BIGINT AS bad, count(*)::BIGINT AS total_labeled, (count(*) FILTER (WHERE quality = 1))::DOUBLE / nullif(count(*), 0) AS precision FROM labels")
def precision_report(spark, sf):
    return stores.precision_report(_labels(spark, sf))


@query("SELECT CASE WHEN toxic = 1 THEN 'off_role' WHEN doc_id % 3 = 0 THEN 'not_remote' ELSE 'unspecified' END AS reason, count(*)::BIGINT AS n FROM labels WHERE quality <> 1 GROUP BY ALL")
def fp_reasons(spark, sf):
    return stores.false_positive_reasons(_labels(spark, sf))


_OPEN = f"WITH {TRACK_SQL}, last AS (SELECT signature, arg_max(action, seq) AS action, max(seq) AS seq, arg_max(tracked_at, seq) AS first_seen_at FROM track GROUP BY signature), done AS (SELECT DISTINCT signature FROM track WHERE event_type = 'purchase' AND value > 60)"


def _inbox(spark, sf):
    t = tracking(spark, sf)
    inbox = t.select("seq", "signature", F.col("tracked_at").alias("first_seen_at"))
    return stores.open_entries(inbox, t.where("event_type = 'purchase' AND value > 60").select("seq", "signature", "action"))


@query(f"{_OPEN} SELECT signature, seq, first_seen_at FROM last WHERE signature NOT IN (SELECT signature FROM done)")
def inbox_open(spark, sf):
    return _inbox(spark, sf).select("signature", "seq", "first_seen_at")


_LOCAL = "date_diff('day', (timezone('{z}', timezone('UTC', first_seen_at)))::DATE, (timezone('{z}', timezone('UTC', TIMESTAMP '{n}')))::DATE)".format(z=ZONE, n="2024-01-31 03:00:00")


@query(f"{_OPEN}, d AS (SELECT signature, {_LOCAL} AS days FROM last) SELECT CASE WHEN days <= 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days <= 7 THEN 'this_week' ELSE 'older' END AS bucket, count(*)::BIGINT AS n FROM d GROUP BY ALL")
def inbox_buckets(spark, sf):
    t = tracking(spark, sf).select("seq", "signature", F.col("tracked_at").alias("first_seen_at"))
    b = stores.bucket(F.col("first_seen_at"), F.lit("2024-01-31 03:00:00").cast("timestamp"), ZONE)
    return stores.latest(t).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY source")
def source_facets(spark, sf):
    return stores.source_counts(read(spark, sf, "documents"))


@query(f"WITH {_SCORED} SELECT CASE WHEN score >= 90 THEN 'A+' WHEN score >= 80 THEN 'A' WHEN score >= 70 THEN 'B' ELSE 'C/D' END AS tier, count(*)::BIGINT AS n FROM scored GROUP BY ALL")
def grade_counts(spark, sf):
    p = _all_scored(spark, sf)
    return stores.grade_counts(p.select(R.grade(F.col("prefilter_score")).alias("grade")))


@query(f"WITH {_SCORED} SELECT source, count(*)::BIGINT AS total, (count(*) FILTER (WHERE score >= 40))::BIGINT AS visible, round(avg(score), 6) AS avg_score, {', '.join(f'''(count(*) FILTER (WHERE {S.grade('score')} = '{g}'))::BIGINT AS grade_{n}''' for g, n in (('A+', 'a_plus'), ('A', 'a'), ('B', 'b'), ('C', 'c'), ('D', 'd')))} FROM scored GROUP BY source")
def source_pivot(spark, sf):
    p = _all_scored(spark, sf).select("source", "prefilter_score", R.grade(F.col("prefilter_score")).alias("grade"))
    counts = [F.count_if(F.col("grade") == g).alias(f"grade_{n}") for g, n in (("A+", "a_plus"), ("A", "a"), ("B", "b"), ("C", "c"), ("D", "d"))]
    total, visible = F.count("*").alias("total"), F.count_if(F.col("prefilter_score") >= 40).alias("visible")
    return p.groupBy("source").agg(total, visible, F.round(F.avg("prefilter_score"), 6).alias("avg_score"), *counts).orderBy(F.desc("avg_score"), "source")


@query(f"SELECT event_id, greatest(floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) / 86400), 0)::INT AS age FROM events")
def age_days(spark, sf):
    return read(spark, sf, "events").select("event_id", dates.elapsed_days(F.col("ts"), F.lit(NOW).cast("timestamp")).alias("age"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props_extract(spark, sf):
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query(
    f"""WITH {TRACK_SQL}, days AS (SELECT signature AS provider, tracked_at::DATE AS day, count(*)::BIGINT AS requests FROM track GROUP BY ALL)
SELECT provider, requests FROM days WHERE day = (SELECT max(tracked_at)::DATE FROM track)"""
)
def provider_usage(spark, sf):
    t = tracking(spark, sf)
    days = t.groupBy(F.col("signature").alias("provider"), F.to_date("tracked_at").alias("date")).agg(F.count("*").alias("requests")).withColumn("exhausted", F.lit(False))
    today = t.agg(F.to_date(F.max("tracked_at")).alias("t"))
    return stores.provider_usage(days.join(F.broadcast(today)), F.col("t")).select("provider", "requests")


_HIDDEN = r"(?is)<(script\b.*?</script|style\b.*?</style|template\b.*?</template)\s*>"
_BARE = rf"""regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{_HIDDEN}', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[/!]?[a-zA-Z][^>]*>', ' ', 'g')"""
_READ = f"regexp_replace(replace(replace(replace({_BARE}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g')"


@query(f"SELECT page_id, sha1(t) AS text_sha1, length(t)::BIGINT AS n_chars FROM (SELECT page_id, trim(regexp_replace({_READ}, '\\s+', ' ', 'g')) AS t FROM pages)")
def html_to_text(spark, sf):
    """Text without markup; the statement knows the entities of the shared pages."""
    p = read(spark, sf, "pages").select("page_id", X.html_text("html").alias("text"))
    return p.select("page_id", F.sha1("text").alias("text_sha1"), F.char_length("text").cast("bigint").alias("n_chars"))


@query("SELECT event_id % 500 AS batch, 'u' || user_id AS signature, CASE WHEN event_id % 3 = 0 THEN 7 ELSE greatest(0, least(100, trunc(round(value, 2)))) END::INT AS ai_score, 1::INT AS n_pros FROM events")
def parse_model_output(spark, sf):
    """Answers made from the events, with fences, prose and odd types, read back."""
    e = read(spark, sf, "events")
    item = F.format_string('{"id": "u%d", "score": %s, "pros": ["a", 1, " "], "summary": null}', F.col("user_id"), F.when(F.col("event_id") % 3 == 0, F.lit('"7"')).otherwise(F.format_string("%.2f", "value")))
    answers = e.groupBy((F.col("event_id") % 500).alias("batch")).agg(F.concat(F.lit("Here:\n```json\n["), F.array_join(F.sort_array(F.collect_list(item)), ","), F.lit("]\n``` done")).alias("answer"))
    return M.results(answers).select("batch", "signature", "ai_score", F.size("pros").alias("n_pros"))


@query("SELECT event_id, CASE WHEN floor(value) >= 999 THEN 'unknown' WHEN floor(value) <= 0 THEN 'today' WHEN floor(value) = 1 THEN 'yesterday' ELSE floor(value)::INT || ' days ago' END AS label FROM events")
def age_label(spark, sf):
    return read(spark, sf, "events").select("event_id", views.age_label(F.floor("value").cast("int")).alias("label"))


@query(f"WITH {_OPEN.removeprefix('WITH ')}, prior AS (SELECT signature, min(tracked_at) AS t FROM track WHERE event_type = 'signup' GROUP BY signature) SELECT l.signature, coalesce(prior.t, TIMESTAMP '{NOW}') AS first_seen_at FROM last l LEFT JOIN prior ON prior.signature = l.signature")
def first_seen_carry(spark, sf):
    t = tracking(spark, sf)
    entries = stores.latest(t.select("seq", "signature")).select("signature")
    prior = t.where("event_type = 'signup'").select("signature", F.col("tracked_at").alias("first_seen_at"))
    return stores.with_first_seen(entries, prior, F.lit(NOW).cast("timestamp")).select("signature", "first_seen_at")


@query(f"WITH {TRACK_SQL} SELECT seq, signature FROM track WHERE signature NOT IN (SELECT signature FROM track WHERE value > 330)")
def resume_pending(spark, sf):
    t = tracking(spark, sf)
    return views.pending(t, t.where("value > 330")).select("seq", "signature")


_STATE = "CASE event_type WHEN 'click' THEN 'draft_ready' WHEN 'purchase' THEN 'submitted' ELSE 'failed' END"


@query(f"WITH {TRACK_SQL}, app AS (SELECT signature, arg_max({_STATE}, seq) AS status FROM track GROUP BY signature), box AS (SELECT DISTINCT signature FROM track WHERE value > 150) SELECT app.signature, box.signature IS NULL AS missing FROM app LEFT JOIN box ON app.signature = box.signature WHERE status = 'draft_ready'")
def ready_drafts(spark, sf):
    t = tracking(spark, sf)
    applications = t.select("seq", "signature", F.expr(_STATE).alias("status"))
    return views.drafts(applications, t.where("value > 150").select("seq", "signature", F.lit(1).alias("scored"))).select("signature", "missing")


@query(f"WITH {TRACK_SQL}, a AS (SELECT signature, arg_max(action, seq) AS action FROM track GROUP BY signature), l AS (SELECT signature, arg_max(label, seq) AS label FROM (SELECT seq, signature, CASE WHEN value > 50 THEN 'good' ELSE 'bad' END AS label FROM track WHERE event_type = 'view') GROUP BY signature), p AS (SELECT signature, arg_max({_STATE}, seq) AS application_status FROM track WHERE event_type IN ('click', 'purchase') GROUP BY signature) SELECT e.signature, action, label, application_status FROM (SELECT DISTINCT signature FROM track) e LEFT JOIN a ON e.signature = a.signature LEFT JOIN l ON e.signature = l.signature LEFT JOIN p ON e.signature = p.signature")
def entry_overlay(spark, sf):
    t = tracking(spark, sf)
    marks = t.where("event_type = 'view'").select("seq", "signature", F.when(F.col("value") > 50, "good").otherwise("bad").alias("label"))
    states = t.where("event_type IN ('click', 'purchase')").select("seq", "signature", F.expr(_STATE).alias("status"))
    return stores.overlay(t.select("signature").distinct(), t.select("seq", "signature", "action"), marks, states)


@query("SELECT page_id, string_split(rtrim(url, '/'), '/')[-1] AS segment, translate(string_split(rtrim(url, '/'), '/')[-1], '-_', '  ') AS words FROM pages")
def url_helpers(spark, sf):
    p = read(spark, sf, "pages").select("page_id", X.last_segment(F.col("url")).alias("segment"))
    return p.select("page_id", "segment", X.slug_words(F.col("segment")).alias("words"))


@query(
    """WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderpriority || ': ' || o_orderstatus || ': x' END AS head FROM orders)
SELECT o_orderkey, CASE WHEN contains(head, ': ') THEN trim(string_split(head, ': ')[1]) ELSE 'Unknown' END AS company,
  CASE WHEN contains(head, ': ') THEN trim(substr(head, instr(head, ': ') + 2)) ELSE trim(head) END AS title FROM h"""
)
def heading_split(spark, sf):
    head = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.concat("o_orderpriority", F.lit(": "), "o_orderstatus", F.lit(": x")))
    h = read(spark, sf, "orders").select("o_orderkey", X.company_and_title(head).alias("h"))
    return h.select("o_orderkey", F.col("h.company").alias("company"), F.col("h.title").alias("title"))


@query(f"WITH {_SCORED} SELECT ord, {S.grade('score')} AS grade FROM scored WHERE score >= 55 AND source = 'en' AND contains(lower(concat_ws(' ', title, company)), 'src1')")
def list_view(spark, sf):
    scored = _all_scored(spark, sf).select("ord", "source", "title", "company", R.grade(F.col("prefilter_score")).alias("grade"))
    return stores.view(scored, source="en", search="SRC1").select("ord", "grade")


@query("SELECT l_returnflag AS source, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def union_of_sources(spark, sf):
    li = read(spark, sf, "lineitem")
    parts = [li.where(F.col("l_returnflag") == f).select(F.lit(f).alias("source"), "l_orderkey") for f in ("A", "N", "R")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count("*").alias("n"))


_NEWEST = f"{TRACK_SQL}, app AS (SELECT signature, arg_max({_STATE}, seq) AS status FROM track GROUP BY signature)"


@query(f"WITH {_NEWEST}, box AS (SELECT signature, arg_max(floor(value), seq) AS score, arg_max(seq, seq) AS seq FROM track GROUP BY signature) SELECT box.signature, box.seq FROM box LEFT JOIN app ON app.signature = box.signature WHERE score >= 20 AND (status IS NULL OR status NOT IN ('submitted', 'draft_ready'))")
def apply_candidates(spark, sf):
    """Latest entries with a score that is good enough and no application that is under way."""
    t = tracking(spark, sf)
    entries = stores.latest(t.select("seq", "signature", F.floor("value").alias("score"))).where("score >= 20")
    states = stores.latest(t.select("seq", "signature", F.expr(_STATE).alias("status"))).where("status IN ('submitted', 'draft_ready')")
    return entries.join(states, "signature", "left_anti").select("signature", "seq")


@query(f"WITH {TRACK_SQL}, {_YIELDS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq DESC) AS r FROM y), p AS (SELECT source, count(*) AS n, avg(yielded) FILTER (WHERE r BETWEEN 2 AND 11) AS mean FROM r WHERE r > 1 GROUP BY source), n AS (SELECT * FROM r WHERE r = 1) SELECT n.source, round(CASE WHEN p.n >= 2 THEN mean END, 6) AS baseline, CASE WHEN n.status = 'error' THEN 'error' WHEN n.yielded = 0 THEN 'zero' WHEN p.n >= 2 AND mean > 0 AND n.yielded < mean * 0.3 THEN 'low' ELSE 'ok' END AS health FROM n LEFT JOIN p ON n.source = p.source")
def source_check(spark, sf):
    """The last day of each source against the days before it."""
    y = _yields(spark, sf)
    last = y.groupBy("source").agg(F.max("seq").alias("last"))
    marked = y.join(F.broadcast(last), "source")  # one row per source
    now = marked.where("seq = last").select("source", "yielded", "status")
    return stores.check_sources(now, marked.where("seq < last").select("source", "yielded", "seq")).select("source", F.round("baseline", 6).alias("baseline"), "health")


@query(f"WITH {_SCORED}, k AS (SELECT ord, row_number() OVER (ORDER BY score DESC, ord) AS k FROM scored WHERE score >= {RULES.reject_floor}) SELECT ord, ((k - 1) // 10)::INT AS batch_id FROM k WHERE k <= {RULES.cap}")
def batch_numbers(spark, sf):
    p = _split(spark, sf)
    return scoring.with_batches(p.where("disposition = 'selected'")).select("ord", "batch_id")


@query("SELECT o_orderkey, CASE WHEN h < 0 THEN 999 WHEN h = 0 THEN 0 WHEN h = 1 THEN 1 WHEN h < 8 THEN h WHEN h < 12 THEN (h - 7) * 7 WHEN h < 15 THEN (h - 11) * 30 ELSE 31 END::INT AS age FROM (SELECT o_orderkey, (o_orderkey % 17 - 1)::INT AS h FROM orders)")
def relative_ages(spark, sf):
    """Ages out of phrases that are made from the orders: today, yesterday, days, weeks, months, more than thirty days."""
    h = (F.col("o_orderkey") % 17 - 1).cast("int")
    phrase = (
        F.when(h < 0, "").when(h == 0, "Hoy").when(h == 1, "Ayer").when(h < 8, F.concat(F.lit("hace "), h, F.lit(" días")))
        .when(h < 12, F.concat(F.lit("Hace "), h - 7, F.lit(" semanas"))).when(h < 15, F.concat(F.lit("hace "), h - 11, F.lit(" meses"))).otherwise("Más de 30 días")
    )
    o = read(spark, sf, "orders").select("o_orderkey", phrase.alias("p"))
    return o.select("o_orderkey", dates.relative_age(F.col("p"), F.lit(NOW).cast("timestamp")).cast("int").alias("age"))


@query("SELECT p_partkey, p_name AS title, 'a & b <' || p_brand || '>' AS company FROM part WHERE p_partkey IS NOT NULL")
def embedded_json(spark, sf):
    """Postings that pages embed, behind another block, with a raw line break and escaped text, read back."""
    p = read(spark, sf, "part").where("p_partkey IS NOT NULL")
    block = F.concat(F.lit('<script type="application/ld+json">{"@type":"WebSite"}</script><script type="application/ld+json">[{"@type":"JobPosting","description":"x\ny","title":'), F.to_json(F.struct("p_name")).substr(F.lit(11), F.length(F.to_json(F.struct("p_name"))) - 11), F.lit(',"hiringOrganization":{"name":"a &amp;amp; b &amp;lt;'), "p_brand", F.lit('&amp;gt;"}}]</script>'))
    j = p.select("p_partkey", X.job_posting(X.html_unescape(F.replace(block, F.lit("&amp;"), F.lit("&amp;amp;")))).alias("j"))
    return j.select("p_partkey", F.get_json_object("j", "$.title").alias("title"), X.html_unescape(X.html_unescape(F.get_json_object("j", "$.hiringOrganization.name"))).alias("company"))


@query("SELECT DISTINCT lower(replace(p_type, ' ', '-')) AS slug, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS company FROM part")
def display_names(spark, sf):
    p = read(spark, sf, "part").select(F.lower(F.translate("p_type", " ", "-")).alias("slug")).distinct()
    return p.select("slug", X.display_company(F.col("slug")).alias("company"))


@query(f"WITH {_CLASSIFIED} SELECT ord, CASE WHEN english = 'indeterminate' THEN 'confirm_english' ELSE '' END AS flags FROM gated")
def initial_flags(spark, sf):
    j = jobs(spark, sf).select("ord", R.english(R.lowered(F.col("title"), F.col("description")), RULES)["status"].alias("e"))
    return j.select("ord", F.array_join(scoring.initial_flags(F.col("e")), "; ").alias("flags"))


@query("""WITH asked AS (SELECT event_id % 200 AS form, row_number() OVER (PARTITION BY event_id % 200 ORDER BY event_id) - 1 AS n, 'q ' || event_id AS label, event_type FROM events)
SELECT form, 'q' || n AS id, label, 'yes ' || n AS answer FROM asked WHERE event_type NOT IN ('click', 'purchase')""")
def form_answers(spark, sf):
    """Questions of forms under ids of their own, and what replies answer: clicks are left blank, purchases are answered twice."""
    e = read(spark, sf, "events").select((F.col("event_id") % 200).alias("form"), "event_id", "event_type")
    forms = e.groupBy("form").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    asked = M.questions(forms.select("form", F.transform("e", lambda x: F.concat(F.lit("q "), x["event_id"])).alias("labels")))

    def item(x, at):
        answer = F.when(x["event_type"] == "click", F.lit(" ")).otherwise(F.concat(F.lit(" yes "), at))
        one = F.format_string('{"id": "q%d", "answer": "%s"}', at, answer)
        return F.when(x["event_type"] == "purchase", F.concat(one, F.lit(","), one)).otherwise(one)

    text = F.concat(F.lit('Sure:\n```json\n{"answers": [{"id": "q-9", "answer": "never asked"},'), F.array_join(F.transform("e", item), ","), F.lit("]}\n```"))
    replies = forms.select("form", text.alias("answer"))
    return M.question_answers(replies, asked, ["form"]).select("form", "id", "label", "answer")


@query(f"WITH {_OPEN.removeprefix('WITH ')} SELECT signature, row_number() OVER (ORDER BY first_seen_at DESC, seq DESC)::BIGINT AS place FROM last WHERE signature NOT IN (SELECT signature FROM done)")
def inbox_order(spark, sf):
    """The places of open entries as the inbox lists them, all scored alike and of one day's bucket."""
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    t = tracking(spark, sf)
    entries = t.select("seq", "signature", F.col("tracked_at").alias("first_seen_at"), F.struct(F.lit(0).alias("final_score")).alias("scored"))
    listed = views.inbox(entries, t.where("event_type = 'purchase' AND value > 60").select("seq", "signature", "action"), now, ZONE)
    return views.with_places(listed, "signature")


@query(f"WITH {_SHOWN}, c AS (SELECT coalesce(o.signature, s.signature) AS signature, CASE WHEN s.signature IS NOT NULL THEN DATE '{TODAY}' ELSE o.last_seen END AS last_seen FROM old o FULL JOIN shown s ON o.signature = s.signature) SELECT signature, row_number() OVER (ORDER BY last_seen DESC, signature)::BIGINT AS place FROM c")
def cache_order(spark, sf):
    return views.with_places(stores.cache_records(cache_merge(spark, sf)), "signature")


@query(f"WITH {_SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, ord) AS k FROM scored WHERE score >= {RULES.reject_floor}), e AS (SELECT *, CASE WHEN score >= 50 THEN (ord % 101)::INT END AS ai FROM r WHERE k <= {RULES.cap}) SELECT ord, ai IS NOT NULL AS ai_evaluated, coalesce(ai, score)::INT AS final_score, CASE WHEN english = 'indeterminate' THEN 'confirm_english' ELSE '' END AS flags FROM e")
def assemble_results(spark, sf):
    """Selected postings joined with answers that name the better ones."""
    scored = _all_scored(spark, sf).withColumn("english_requirement", R.english(R.lowered(F.col("title"), F.col("description")), RULES)["status"])
    scored = stage(spark)(scored.select("ord", "prefilter_score", "english_requirement", F.col("ord").cast("string").alias("signature")), "scored")
    selected = scoring.with_batches(scoring.cap(scored, RULES).where("disposition = 'selected'"))
    none = F.array().cast("array<string>")
    found = selected.where("prefilter_score >= 50").select("batch_id", "signature", (F.col("ord") % 101).cast("int").alias("ai_score"), none.alias("pros"), none.alias("contras"), F.lit("").alias("summary"))
    return scoring.assemble(selected, found).select("ord", "ai_evaluated", "final_score", _flat("flags", "flags"))


def flagship(spark, sf):
    """Gate, prefilter, cap and rank of all postings, with the best first."""
    kept = gate.kept(gate.classify(gate.with_identity(jobs(spark, sf)), RULES))
    p = scoring.prefilter(kept.drop("url"), RULES, stage(spark))
    ranked = scoring.rank(scoring.defer(p.where("disposition = 'selected'")), scoring.defer(p.where("disposition = 'deferred'")))
    return ranked.select("ord", "source", "signature", "final_score", "grade", "fit", (F.col("part") == 0).alias("in_cap"))


_SHOWN_SOURCE = "CASE event_type WHEN 'view' THEN 'greenhouse' WHEN 'signup' THEN 'lever' ELSE 'occ' END"
_BOX = f"box AS (SELECT signature, max(seq) AS seq, arg_max({_SHOWN_SOURCE}, seq) AS source, arg_max({S.grade('floor(value)')}, seq) AS grade FROM track GROUP BY signature)"


@query(f"WITH {TRACK_SQL}, {_BOX}, app AS (SELECT signature, arg_max({_STATE}, seq) AS status FROM track WHERE value > 80 GROUP BY signature) SELECT signature, seq, source, grade FROM box WHERE source IN ('greenhouse', 'lever') AND grade <> 'D' AND signature NOT IN (SELECT signature FROM track WHERE event_type = 'purchase' AND value > 200) AND signature NOT IN (SELECT signature FROM app WHERE status <> 'failed')")
def apply_eligible(spark, sf):
    """Open entries whose board has a plain form and whose grade is above D, and that nothing was prepared for."""
    t = tracking(spark, sf)
    scored = F.struct(F.struct(F.expr(_SHOWN_SOURCE).alias("source")).alias("job"), R.grade(F.floor("value")).alias("grade"))
    inbox = t.select("seq", "signature", F.col("tracked_at").alias("first_seen_at"), scored.alias("scored"))
    resolved = t.where("event_type = 'purchase' AND value > 200").select("seq", "signature", "action")
    applications = t.where("value > 80").select("seq", "signature", F.expr(_STATE).alias("status"))
    out = stores.apply_candidates(inbox, resolved, applications)
    return out.select("signature", "seq", F.col("scored.job.source").alias("source"), F.col("scored.grade").alias("grade"))


@query(f"WITH {JOBS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source, company ORDER BY ord) AS r FROM jobs) SELECT ord, source, company, md5(title) AS title_md5 FROM r WHERE r = 1")
def first_per_company(spark, sf):
    """The first posting of each company on each board, in arrival order."""
    rows = jobs(spark, sf).select("ord", "source", "company", "title")
    return gate.first_per_key(rows, ["source", "company"]).select("ord", "source", "company", F.md5("title").alias("title_md5"))


@query("WITH r AS (SELECT count(*) FILTER (WHERE quality = 1) AS good, count(*) AS total FROM labels), f AS (SELECT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'unspecified' END AS reason, count(*) AS n FROM labels WHERE quality <> 1 GROUP BY ALL) SELECT 0 AS section, 0::BIGINT AS rank, 'precision: ' || round(100.0 * good / total)::INT || '% (' || good || '/' || total || ')' AS line FROM r UNION ALL SELECT 1, -n::BIGINT, '  ' || reason || ': ' || n FROM f")
def report_lines(spark, sf):
    """The precision report of the labels as rows of text."""
    word, why = F.when(F.col("quality") == 1, "good").otherwise("bad"), F.when((F.col("quality") != 1) & (F.col("toxic") == 1), "toxic")
    log = read(spark, sf, "labels").select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("signature"), word.alias("label"), why.alias("reason"))
    return views.report_lines(stores.precision_report(log), stores.false_positive_reasons(log))


@query(f"WITH {TRACK_SQL}, r AS (SELECT signature, max(floor(value))::INT AS final_score, min(seq) AS ord FROM track GROUP BY signature), a AS (SELECT signature, arg_max(action, seq) AS action FROM track WHERE action <> 'seen' GROUP BY signature) SELECT r.signature, final_score, a.action, row_number() OVER (ORDER BY final_score DESC, ord)::BIGINT AS place FROM r LEFT JOIN a ON a.signature = r.signature")
def results_view(spark, sf):
    """The last results, best first, with what was decided about each since."""
    t = tracking(spark, sf)
    ranked = t.groupBy("signature").agg(F.max(F.floor("value")).cast("int").alias("final_score"), F.min("seq").alias("ord")).withColumn("part", F.lit(0))
    return views.with_places(views.results(ranked, t.where("action <> 'seen'")), "signature", "final_score", "action")


@query(f"WITH {TRACK_SQL} SELECT signature, max(seq) AS seq, arg_max({_STATE}, seq) AS status FROM track WHERE event_type <> 'view' GROUP BY signature")
def applications_view(spark, sf):
    """The latest state of each application."""
    log = tracking(spark, sf).where("event_type <> 'view'").select("signature", "seq", F.expr(_STATE).alias("status"))
    return views.applications(log)


@query(f"WITH {TRACK_SQL}, l AS (SELECT seq, signature, CASE WHEN value < 50 THEN 'bad' ELSE 'good' END AS label, CASE WHEN value < 10 THEN 'english' ELSE 'off_role' END AS reason FROM track) SELECT signature, max(seq) AS seq, arg_max(label, seq) AS label, arg_max(CASE WHEN label = 'bad' THEN reason ELSE '-' END, seq) AS reason FROM l GROUP BY signature")
def labels_view(spark, sf):
    """The latest label of each signature; only bad ones have a reason."""
    word = F.when(F.col("value") < 50, "bad").otherwise("good")
    log = tracking(spark, sf).select("signature", "seq", word.alias("label"), F.when(F.col("value") < 10, "english").otherwise("off_role").alias("why"))
    told = log.withColumn("reason", views.label_entry(F.col("label"), F.col("why"))).drop("why")
    return views.labels(told).select("signature", "seq", "label", F.coalesce("reason", F.lit("-")).alias("reason"))
