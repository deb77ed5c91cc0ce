import random
import re

import pytest

from gristmill.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in L.PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_matches_brute_force(spark, docs, texts, odd, empty):
    rng = random.Random(4)
    bits = ["CC BY", "cc-by", "All Rights\nreserved", "general public", "license", "GNU General  Public License", "é", "xcc by", "cc by", "by", "4.0", "\x00cc\x01by"]
    rows = [(1000 + i, " ".join(rng.choices(bits, k=rng.randint(0, 12)))) for i in range(200)]
    got = {r["doc_id"]: tuple(r)[1:6] for r in L.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {d: brute_base(t) for d, t in rows}
    got = {r["doc_id"]: tuple(r)[1:6] for r in L.scan(docs).collect()}
    assert got == {d: brute_base(t) for d, t in texts}
    assert L.scan(odd).count() == 4 and L.scan(empty).count() == 0


def maximal(text, sequence, least):
    """(start, start in the sequence, length) of the common parts that neither side extends."""
    out = set()
    for i in range(len(text)):
        for j in range(len(sequence)):
            if text[i] == sequence[j] and (not i or not j or text[i - 1] != sequence[j - 1]):
                n = 0
                while i + n < len(text) and j + n < len(sequence) and text[i + n] == sequence[j + n]:
                    n += 1
                if n >= least:
                    out.add((i, j, n))
    return out


def test_matches_are_all_those_of_brute_force():
    rng = random.Random(8)
    for trial in range(60):
        sequences = [[rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(5)]
        automaton = L.SuffixAutomaton(sequences)
        for least in (1, 3):
            text = [rng.randint(0, 4) for _ in range(25)]
            got = list(automaton.matches(text, least))
            want = {(i + n, n, t, j + n) for t, s in enumerate(sequences) for i, j, n in maximal(text, s, least)}
            assert len(got) == len({*got}) and {*got} == want


def brute_spans(words):
    """Chains of brute-force matches, templates one by one."""
    out = []
    for label, template in L.TEMPLATES:
        sequence = L.words_of(template)
        matches = sorted(maximal(words, sequence, L.LEAST))
        best = []
        for i, (at, on, n) in enumerate(matches):
            tops = [(n, at, at + n)]
            for j in range(i - 1, -1, -1):
                a, o, m = matches[j]
                fresh = n - max(0, a + m - at, o + m - on)
                if a < at and o < on and fresh > 0 and at - a - m <= L.GAP and on - o - m <= L.GAP:
                    tops.append((best[j][0] + fresh, best[j][1], at + n))
            best.append(max(tops, key=lambda x: x[0]))
        taken = []
        for covered, start, end in sorted(best, key=lambda x: (-x[0], x[1])):
            if covered / len(sequence) >= L.COVER and all(end <= a or b <= start for a, b in taken):
                taken.append((start, end))
                out.append((-covered, -covered / len(sequence), start, label, end))
    stay = []
    for *_, a, label, b in sorted(out):
        if all(2 * (min(b, d) - max(a, c)) <= min(b - a, d - c) for _, c, d in stay):
            stay.append((label, a, b))
    return sorted(stay, key=lambda x: (x[1], x[2], x[0]))


def test_spans_and_labels_match_brute_force(spark):
    rng = random.Random(3)
    foreign = sorted({w.decode() for _, t in L.TEMPLATES for w in L.words_of(t)})
    rows = []
    for i in range(400):
        words = []
        for _ in range(rng.randint(1, 3)):
            own = rng.choice(L.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 3)):
                own.insert(rng.randint(0, len(own)), rng.choice(foreign))
            words += rng.choices(["lorem", "ipsum", *foreign[:5]], k=rng.randint(0, 6)) + own
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["labels"], r["spans"]) for r in L.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for d, t in rows:
        spans = brute_spans(L.words_of(t))
        base = {x for x in brute_base(t)[4].split(",") if x}
        assert got[d] == (",".join(sorted(base | {x[0] for x in spans})), ",".join(f"{n}:{a}:{b}" for n, a, b in spans)), t


def test_a_template_does_not_hide_another():
    text = "this work is licensed under the apache a creative commons attribution sharealike 4 0 international license"
    assert L.scan_text(L.Scanner(), text)[5] == "cc-by-sa"


def test_templates_are_found_with_small_changes(spark):
    notice = dict((t, label) for label, t in L.TEMPLATES)
    scanner = L.Scanner()
    for text, label in notice.items():
        found = L.scan_text(scanner, f"lorem ipsum {text} dolor")
        assert label in found[5].split(",") and found[6] >= 0.8
    changed = "Permission is hereby granted, free of charge, to any person holding a copy of this software and associated docs files (the Software), to deal in the Software without restriction"
    assert "mit" in L.scan_text(scanner, changed)[5].split(",")
    assert L.scan_text(scanner, "the license of this work and the copy of that software")[5] == ""
    two = L.scan_text(scanner, "Released under the MIT License. " + "word " * 50 + "Released under the MIT License.")
    assert two[7].count("mit:") == 2


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("// SPDX-License-Identifier: MIT\nint x;", "mit"), ("# SPDX-License-Identifier: GPL-2.0-or-later", "gpl"), ("released as GNU GPL v3, see COPYING", "gpl"), ("License: Apache-2.0.", "apache-2.0"),
        ("It is licensed under the terms of the MIT license.", "mit"), ("Distributed under the Boost Software License, Version 1.0. (See file)", "bsl-1.0"),
        ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.', "mit"),
        ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "bsd"),
    ],
)
def test_notices_headers_and_paragraphs(spark, text, label):
    (row,) = L.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert label in row["labels"].split(",")


def test_words_that_licences_share_are_no_licence(spark):
    texts = ["The MIT campus is open to any person.", "Apache 2 helicopters flew", "the above copyright office", "software for any purpose you like", "without any warranty that it will rain", "spdx license identifiers are short"]
    rows = L.scan(spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")).collect()
    assert {r["labels"] for r in rows} == {""}
