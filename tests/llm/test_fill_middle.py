import hashlib
import random

import pytest
import regex

from gristmill.llm import fill_middle as M

UNIT = regex.compile(M.CODE_POINT)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(d, t):
    """Straight from the contract: code points, hexadecimal groups."""
    t = t or ""
    h = hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(t)
    if t == "" or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return (n, "plain", None, None, sha(t), sha(t)), t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        out = "<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b]
        return (n, "spm", a, b - a, sha(out), sha(t)), out
    out = "<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b]
    return (n, "psm", a, b - a, sha(out), sha(t)), out


def rows_of(frame):
    return [(r["doc_id"], (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"])) for r in frame.collect()]


def test_matches_brute_force(docs, texts):
    assert dict(rows_of(M.cuts(docs))) == {d: brute(d, t)[0] for d, t in texts}


def test_forms_and_shares(spark):
    rng = random.Random(4)
    letters = "ab <>PSM\n\r\t\x0b é😀é\U0001d5ba"
    rows = [(d, "".join(rng.choices(letters, k=rng.randint(0, 40)))) for d in range(3000)]
    got = dict(rows_of(M.cuts(spark.createDataFrame(rows, "doc_id bigint, text string"))))
    assert got == {d: brute(d, t)[0] for d, t in rows}
    forms = [v[1] for v in got.values()]
    assert 0.66 < forms.count("psm") / len(rows) < 0.76 and 0.14 < forms.count("spm") / len(rows) < 0.22


def test_markers_that_stand_half_in_a_text():
    how = M.Cuts()
    for text in ("<", "<P", "P>", "<<", "<S", "S><", ">P<", "<M", "<<M", "<P <S <M", "<\nP>"):
        for d in range(200):
            c = M.cut(text, str(d), how, UNIT)
            assert M.restore(c.output, c.form) == text
    for text in ("<P>", "a<S>b", "x<M>"):
        assert {M.cut(text, str(d), how, UNIT).form for d in range(50)} == {"plain"}


def test_cuts_reach_both_ends():
    seen = {(c.prefix, c.middle) for d in range(400) if (c := M.cut("ab", str(d), M.Cuts(), UNIT)).form != "plain"}
    assert seen == {(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0)}


def test_units_other_than_code_points(spark):
    words = M.Cuts(unit=r"\S+\s*", plain_from=100)
    unit = regex.compile(words.unit)
    text = "one two  three\nfour "
    ends = [0, 4, 9, 15, 20]
    assert M.unit_ends(text, unit).tolist() == ends
    for d in range(60):
        c = M.cut(text, str(d), words, unit)
        assert c.n == 4 and c.prefix in ends and c.prefix + c.middle in ends and M.restore(c.output, c.form) == text


def test_a_very_long_text(spark):
    text = "aé😀\n" * 500_000
    frame = spark.createDataFrame([(5, text)], "doc_id bigint, text string")
    assert rows_of(M.cuts(frame)) == [(5, brute(5, text)[0])]


def test_transform_has_all_columns(docs, texts, empty):
    out = M.transform(docs)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    for r in out.collect():
        text = dict(texts)[r["doc_id"]]
        assert r["text"] == (None if text is None else brute(r["doc_id"], text)[1]) and r["kept"] == "yes"
        assert r["n_chars"] == len(r["text"] or "")
    assert M.transform(empty).count() == 0 and M.cuts(empty).count() == 0


def test_odd_rows(odd):
    want = [(None, "a b c d e f g"), (None, None), (9, "a b c d e f g"), (9, "a b c d e f g")]
    assert sorted(rows_of(M.cuts(odd)), key=lambda x: (x[0] or 0, x[1][0])) == sorted([(d, brute(d, t)[0]) for d, t in want], key=lambda x: (x[0] or 0, x[1][0]))


@pytest.mark.parametrize("big", [2**53 + 1, -7, 2**63 - 1])
def test_ids_are_seeded_exactly(spark, big):
    rows = [(big, "some text"), (None, "x")]
    assert dict(rows_of(M.cuts(spark.createDataFrame(rows, "doc_id bigint, text string")))) == {d: brute(d, t)[0] for d, t in rows}
