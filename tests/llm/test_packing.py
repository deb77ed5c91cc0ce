import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gristmill.llm import packing as P


def expected(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = {}
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            out[d, k] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    return out


def check_places(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= P.LIMIT
    return len(by)


def test_pieces_are_those_of_the_tokenizer(docs, texts, monkeypatch):
    rows = P.pack(docs).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected(texts)
    n = check_places(rows)
    total = sum(r["length"] for r in rows)
    assert n <= -(-total // 1024) + 1
    monkeypatch.setattr(P, "RANKED", 2)
    assert check_places(P.pack(docs).collect()) == n


def test_odd_white_space_and_controls(spark):
    texts = [(1, "a  b \n\n  c\t\t"), (2, "don't 've 'LL  12 34½ ＡＢ ❤️ <|endoftext"), (3, "x" * 3000), (4, " " * 500), (5, "é \xa0  z")]
    rows = P.pack(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected(texts)


def test_white_space_of_any_length(spark):
    mark = "<|endoftext|>"
    texts = [(1, " " * 2_000_000 + "x"), (2, "a" + "\t" * 1_000_000 + " b"), (3, f"c {mark}" + "\n" * 1_000_000 + f"{mark} d"), (4, "e" + " \n" * 600_000)]
    rows = P.pack(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected(texts)
    check_places(rows)


def test_added_tokens_in_a_text(spark):
    assert P.added_tokens() == {"<|endoftext|>": 50256}
    mark = "<|endoftext|>"
    texts = [(1, f"a {mark} b"), (2, mark), (3, f"{mark}{mark}\n\n{mark} x"), (4, f"a  {mark}  b \n {mark}"), (5, f"<{mark}> <|endoftext|"), (6, f"w {mark}" * 900)]
    rows = P.pack(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected(texts)


def test_plan_places_everything_once():
    rng = random.Random(1)
    for trial in range(40):
        limit = rng.choice([8, 20, 64])
        counts = Counter(rng.randint(1, limit) for _ in range(rng.choice([0, 5, 40, 400, 4000])))
        steps = P.plan(dict(counts), limit)
        used = Counter()
        for s in steps:
            assert sum(s.lengths) <= limit and s.times > 0
            for x in s.lengths:
                used[x] += s.times
        assert +used == +counts
        left = np.zeros(limit + 1, dtype=np.int64)
        for k, v in counts.items():
            left[k] = v
        assert sum(s.times for s in steps) <= sum(s.times for s in P.best_fit(left, limit))


def test_sums_are_those_of_brute_force():
    lengths = np.array([1, 3, 4, 7, 9])
    for parts in (1, 2, 3):
        sums = P.Sums(lengths, parts, 16)
        for gap in range(20):
            want = {tuple(sorted(c, reverse=True)) for c in itertools.combinations_with_replacement(lengths.tolist(), parts) if sum(c) == gap <= 16}
            got = [tuple(r) for r in sums.of(gap).tolist()]
            assert {*got} == want and len(got) == len(want)


def test_combinations_fill_sequences_of_a_real_table():
    """Fills of one, two and three complements all stand in the plan, and it is no worse than best fit alone."""
    import pyarrow.parquet as pq

    encode = P.encoder().encode
    counts = Counter()
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist():
        full, rest = divmod(len(encode(text or "", allowed_special={*P.added_tokens()})) + 1, P.LIMIT)
        counts[P.LIMIT] += full
        counts[rest or P.LIMIT] += 1 if rest else 0
    steps = P.plan(+counts)
    exact = Counter(len(s.lengths) for s in steps if sum(s.lengths) == P.LIMIT for _ in range(s.times))
    assert sum(s.times for s in steps) <= 964 and exact[2] > 200 and exact[3] > 20 and exact[4] > 5


def test_a_repeated_row_is_ranked_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED", 20)
    rows = spark.createDataFrame([(None, "a b c")] * 300 + [(7, "a b c")] * 300, "doc_id bigint, text string").repartition(3)
    got = P.pack(rows)
    assert check_places(got.collect()) == 3 and len(got.collect()) == 600
    told = P.tokenize(rows).select("doc_id", "piece", "place").distinct()
    assert told.count() >= 200  # what the groups are told apart by


def test_ids_round_trip(spark, odd, empty):
    rows = P.pack(spark.createDataFrame([(1, "one two three " * 700)], "doc_id bigint, text string"), with_ids=True).collect()
    ids = [i for r in sorted(rows, key=lambda r: r["piece"]) for i in r["ids"]]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert ids[-1] == 2 and tokenizer.decode(ids[:-1]) == "one two three " * 700
    assert check_places(P.pack(odd).collect()) == 1
    assert P.pack(empty).count() == 0
