import hashlib
import math
import random
import re
import zlib
from collections import Counter

from gristmill.llm import resampling as R
from gristmill.llm.common import Workspace

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text, how):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    runs = [" ".join(words[i : i + n]) for n in range(how.shortest, how.longest + 1) for i in range(len(words) - n + 1)]
    return len(words), Counter(zlib.crc32(r.encode()) % how.buckets for r in runs)


def brute(rows, target, how=R.Draw()):
    """Straight from the contract, every document at once."""
    own = [(d, *buckets(t, how)) for d, t in rows]
    s, t = Counter(), Counter()
    for *_, c in own:
        s.update(c)
    for text in target:
        t.update(buckets(text, how)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + how.buckets) / ((s[b] + 1) * (big_t + how.buckets)))) for b in s}
    out = []
    for d, n, c in own:
        weight = sum(gain[b] * k for b, k in c.items())
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0]))
    drawn = 10 * len(able) // 100
    rank = {x[0]: k for k, x in enumerate(able, 1) if k <= drawn}
    return {x[0]: (x[2], x[3], x[4], rank.get(x[0])) for x in out}


def told(frame):
    return {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in frame.collect()}


def target_of(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_matches_brute_force(spark, docs, texts):
    target = ["the thing of the thing", None, "", "ÄÖ and ment X-Y_z 42"]
    got = R.resample(docs, target_of(spark, target))
    assert told(got) == brute(texts, target) and got.count() == len(texts)


def test_draws_what_looks_like_the_target(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(d, " ".join(rng.choices(words[:30] if d % 10 == 0 else words, k=25 if d % 7 else 5))) for d in range(2000)]
    target = [" ".join(rng.choices(words[:30], k=400))]
    got = told(R.resample(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), target_of(spark, target)))
    assert got == brute(rows, target)
    drawn = sorted((v[3], d) for d, v in got.items() if v[3])
    assert [k for k, _ in drawn] == list(range(1, len(drawn) + 1)) and len(drawn) == sum(d % 7 > 0 for d in range(2000)) // 10
    assert sum(d % 10 == 0 for _, d in drawn) > 0.9 * len(drawn)


def test_runs_of_several_words(spark, monkeypatch):
    how = R.Draw(shortest=1, longest=3, buckets=50)
    text = "a b c a b " * 40 + "é x1"
    for chunk in (1, 7, 30, R.CHUNK):
        monkeypatch.setattr(R, "CHUNK", chunk)
        n, kinds, times = R.features(text.encode(), how)
        assert (n, dict(zip(kinds.tolist(), times.tolist()))) == (buckets(text, how)[0], dict(buckets(text, how)[1]))
    rows = [(d, text[d:]) for d in range(30)]
    assert told(R.resample(spark.createDataFrame(rows, "doc_id bigint, text string"), target_of(spark, ["b c"]), how)) == brute(rows, ["b c"], how)


def test_ties_go_to_smaller_ids_and_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(R, "TIED", 4)
    rows = [(d, "same word " * 10, s) for d, s in ((5, 9), (None, 9), (2, 9), (9, 9), (None, 9), (7, 3))]
    frame = spark.createDataFrame([(s, 6 if s == 9 else 1, 0 if s == 9 else 6, d, k, 1) for k, (d, _, s) in enumerate(rows)], "score bigint, n bigint, above bigint, doc_id bigint, place bigint, weight bigint")
    got = [(r["doc_id"], r["rank"]) for r in R._tied(frame).orderBy("rank").collect()]
    assert got == [(2, 1), (5, 2), (9, 3), (None, 4), (None, 5), (7, 7)]


def test_histogram_has_what_stands_above(spark):
    rng = random.Random(8)
    scores = [rng.randint(-40, 40) for _ in range(500)]
    rows = spark.createDataFrame([(s,) for s in scores], "score bigint").repartition(5)
    got = {r["score"]: (r["n"], r["above"]) for r in R.histogram(rows, Workspace(spark, "h")).collect()}
    assert got == {s: (scores.count(s), sum(x > s for x in scores)) for s in set(scores)}


def test_repeated_rows_take_successive_ranks(spark):
    text = "alpha beta gamma " * 10
    rows = [(None, text)] * 60 + [(4, text)] * 60
    got = R.resample(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), target_of(spark, ["alpha"])).collect()
    assert len(got) == 120 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 13))


def test_odd_and_empty_tables(spark, odd, empty):
    none = target_of(spark, [])
    assert R.resample(empty, none).count() == 0 and R.keep(empty, none).count() == 0
    got = R.resample(odd, none).collect()
    assert len(got) == 4 and all(r["rank"] is None for r in got)
    rows = [(d, "a b c " * 10) for d in range(40)]
    assert told(R.resample(spark.createDataFrame(rows, "doc_id bigint, text string"), none)) == brute(rows, [])


def test_a_very_long_text(spark):
    rows = [(d, "word " * 5) for d in range(20)] + [(99, "Wörter und 12 words. " * 200_000)]
    assert told(R.resample(spark.createDataFrame(rows, "doc_id bigint, text string"), target_of(spark, ["words"]))) == brute(rows, ["words"])


def test_keep_has_all_columns(spark, docs, texts):
    target = ["lich thing of and"]
    kept = R.keep(docs, target_of(spark, target))
    assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, v in brute(texts, target).items() if v[3]}
