import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from brute import components  # noqa: E402

from gristmill.llm import minhash_dedup as N  # noqa: E402
from gristmill.llm.common import Workspace  # noqa: E402
from gristmill.llm.components import connected  # noqa: E402
from gristmill.llm.shingles import common, shingle_set  # noqa: E402


def test_matches_brute_force(docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.dedup(docs).collect()}
    assert got == components(texts)


def test_shared_passage_and_near_misses(spark):
    """Texts around the threshold that share most of their words: what a bucket's first member cannot decide."""
    rng = random.Random(3)
    core = [f"w{i}" for i in range(90)]
    rows = []
    for d in range(60):
        words = core[:]
        for at in rng.sample(range(90), rng.randint(0, 3)):
            words[at] = f"e{rng.randint(0, 5)}"
        rows.append((d, " ".join(words + [f"t{d % 7}x{k}" for k in range(rng.randint(0, 8))])))
    want = components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want and 1 < len({v[1] for v in want.values()}) < 60


def test_small_blocks_find_the_same(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 300)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.dedup(docs).collect()}
    assert got == components(texts)


def test_keep(docs, odd, empty, texts):
    kept = N.keep(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, v in components(texts).items() if v[2]}
    assert N.keep(empty).count() == 0
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in N.dedup(odd).collect()]
    assert sorted(got, key=str) == sorted([(None, 3, 9, False), (None, 0, None, True), (9, 3, 9, True), (9, 3, 9, True)], key=str)


def test_sketch_fills_and_estimates():
    a, b = shingle_set(" ".join(f"a{i}" for i in range(400))), shingle_set(" ".join(f"a{i}" for i in range(40, 440)))
    one = shingle_set("only three words")
    s = N.sketches([a, b, one])
    assert (s != N._EMPTY).all()
    true = common(a, b) / (len(a) + len(b) - common(a, b))
    assert abs((s[0] == s[1]).mean() - true) < 0.15
    assert np.array_equal(s[2], N.sketches([one])[0])


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in connected(links, Workspace(spark, "t")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_pipeline_stage_removes_near_copies_from_four_fifths_on(spark):
    """1000 shingles each: the other copies share 0.85, 0.82, 0.80 and 0.79 with the first."""
    import corpus_pipeline

    words = [f"w{i}" for i in range(1004)]
    rows = [(1, " ".join(words))]
    for d, changed in ((2, 81), (3, 98), (4, 111), (5, 118)):
        rows.append((d, " ".join(words[: 1004 - changed] + [f"c{d}x{k}" for k in range(changed)])))
    sets = {d: shingle_set(t) for d, t in rows}
    share = [common(sets[1], sets[d]) / (2000 - common(sets[1], sets[d])) for d in (2, 3, 4, 5)]
    assert share[0] > 0.85 > share[1] > 0.81 > share[2] >= 0.8 > share[3] > 0.78
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, frame, "").collect()} == {1, 5}
    assert {r["doc_id"] for r in N.keep(frame).collect()} == {1, 3, 4, 5}
