"""Personal data: candidate spans, boosted trees, calibrated thresholds.

High-recall generators propose overlapping spans of several kinds. Each candidate gets format features (length, digits,
groups, check sum, hex share, variety) and context features (what stands before and after, cue words near it). Boosted
trees score it, and a threshold per kind, calibrated on candidates that were held back, decides.

What the trees learn from is known by construction and not by a feature: into documents of a bounded sample, made-up
addresses, numbers and secrets are planted, with and without a cue word before them, and beside them decoys that look
alike (versions, order numbers, dates, numbers that fail a check sum, paths, long words). Every kind has as many of both,
so none depends on how often the corpus holds it. What the plain patterns prove is always redacted; the trees add spans
beside it.

Documents are read once for the sample and once for the scan; nothing but the sample is shuffled. It has at most
``SAMPLE_DOCS`` different rows, drawn by a hash of doc_id and text, whatever the size of the corpus and however often a
doc_id or null comes back; the scan covers every text whole.

Defined results: a null text is an empty one without spans; a repeated row is scanned again; other columns are passed
on untouched by ``redact``. Positions are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.boosting import Boosting
from gristmill.llm.common import table

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
#: Documents that training examples are planted in, at most.
SAMPLE_DOCS = 1500
#: Characters before and after a candidate that its context features look at.
BEFORE, AFTER = 32, 8
#: Share of right decisions that a threshold must keep on held-back candidates.
PRECISION = 0.95

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a start inside a run of digits cannot succeed where the start of the run failed, so only starts of runs are tried
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

_AT = re.compile(r"@| ?\[at\] ?| ?\(at\) ?")
_STOPS = frozenset(" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0@,;<>()")
_DOT = re.compile(r" ?(?:\[dot\]|\(dot\)) ?")
_REST = re.compile(r"[^\s@,;<>()]+(?: ?(?:\[dot\]|\(dot\)) ?[^\s@,;<>()]+)*")
_LOOSE_IP = re.compile(r"(?<![0-9A-Za-z.])[0-9]+(?:\.[0-9]+){2,}(?![0-9A-Za-z])")
_LOOSE_NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}(?![0-9A-Za-z])")
_LOOSE_SECRET = re.compile(r"(?<![0-9A-Za-z_+/=.-])[0-9A-Za-z_+/=.-]{16,}(?![0-9A-Za-z])")
#: What no plain word has: a digit, or a capital behind a small letter.
_MIXED = re.compile(r"[0-9]|[a-z][A-Z]")
_ASSIGNED = re.compile(r"(?i)(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|key|auth|bearer)\W{0,3}[=:\s]\W{0,3}$")
#: What a hash of something public stands behind.
_PUBLIC = re.compile(r"(?i)(?:\b(?:commit|sha-?\d*|md5|rev|revision|checksum|digest|etag|uuid|blob|tree)\W{0,3}|://|//)[\w./-]*$")
#: A short value that a name for a secret is given; longer ones are proposed whatever stands before them.
_NAMED_SECRET = re.compile(r"(?i)\b(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key)[\"']?[\x20]?[:=][\x20]?[\"']?([^\s\"',;<>()]{6,15})(?![^\s\"',;<>().])")
_CUES = re.compile(r"(?i)\b(?:token|secret|password|key|mail|e-mail|phone|tel|call|card|visa|ip|address|host)\b")


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _part_ok(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from the @ signs: every start in a local part meets the same @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
            at = text.find("@", done)
        else:
            done, at = at + 1, text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the plain patterns prove, by kind as in ``BASE_KINDS``, then start."""
    found = [("email", a, b) for a, b in emails(text)]
    if _DIGITS.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_part_ok, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def loose_emails(text: str) -> Iterator[tuple[int, int]]:
    """Whatever stands around an at sign, or a word for one, however long."""
    done = 0
    for at in _AT.finditer(text):
        start = at.start()
        while start > done and text[start - 1] not in _STOPS:
            start -= 1
        rest = _REST.match(text, at.end()) if start < at.start() else None
        if rest:
            done = rest.end()
            yield start, done
        else:
            done = max(done, at.end())


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans that might be personal data: high recall, low precision."""
    found = []
    if "@" in text or "[at]" in text or "(at)" in text:
        found += [("email", a, b) for a, b in loose_emails(text)]
    if _DIGITS.search(text):
        found += [("ip", m.start(), m.end()) for m in _LOOSE_IP.finditer(text)]
        for m in _LOOSE_NUMBER.finditer(text):
            found += [("card", m.start(), m.end()), ("phone", m.start(), m.end())]
    found += [("secret", m.start(), m.end()) for m in _LOOSE_SECRET.finditer(text) if _MIXED.search(m[0])]
    if ":" in text or "=" in text:
        found += [("secret", m.start(1), m.end(1)) for m in _NAMED_SECRET.finditer(text) if _DIGITS.search(m[1])]
    return found


def _variety(span: str) -> float:
    """Bits per character of the span's own distribution."""
    counts = [span.count(c) for c in set(span)]
    return -sum(c / len(span) * math.log2(c / len(span)) for c in counts)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    digits = [c for c in span if c.isascii() and c.isdigit()]
    parts = re.split(r"[^0-9]+", span)
    n = len(span)
    ending = _DOT.sub(".", span).rpartition(".")[2]
    turns = sum((a.isdigit() != b.isdigit()) or (a.islower() and b.isupper()) for a, b in zip(span, span[1:], strict=False))
    return [
        float(KINDS.index(kind)),
        float(n),
        float(len(digits)),
        len(digits) / n,
        sum(c in "0123456789abcdefABCDEF" for c in span) / n,
        len(set(span)) / n,
        _variety(span),
        turns / n,
        sum(c.isupper() for c in span) / n,
        float(span.count(".")),
        float(span.count("@")),
        float(len(_DOT.findall(span))),
        float(span.count("/")),
        float(sum(c in " -()" for c in span)),
        float(span.startswith("+")),
        float(13 <= len(digits) <= 19 and luhn("".join(digits))),
        float(max((int(p) if len(p) < 6 else 99999 for p in parts if p), default=0)),
        float(len([p for p in parts if p])),
        float(max(map(len, re.split(r"[-._/+=]", span)))),
        float(ending.isalpha() and 2 <= len(ending) < n),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(bool(_ASSIGNED.search(before))),
        float(bool(_CUES.search(before))),
        float(before[-1:] in "\"'=:"),
        float(bool(_PUBLIC.search(before)) or span.startswith("//")),
        float(max(map(len, re.findall("[a-z]+", span)), default=0)) / n,
    ]


_LOWER, _HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
_ALL = _LOWER + _LOWER.upper() + "0123456789"


def _some(rng: random.Random, alphabet: str, low: int, high: int) -> str:
    return "".join(rng.choices(alphabet, k=rng.randint(low, high)))


def _made_up(rng: random.Random, kind: str) -> str:
    """A span of the kind."""
    if kind == "email":
        local, host = _some(rng, _LOWER + "._", 3, 14).strip("._") or "me", f"{_some(rng, _LOWER, 3, 12)}.{rng.choice(('com', 'org', 'net', 'de', 'fr', 'io', 'mx'))}"
        return rng.choice((f"{local}@{host}", f"{local} [at] {host}", f"{local}(at){host}", f"{local} [at] {host.replace('.', ' [dot] ')}"))
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        digits = rng.choice("3456") + _some(rng, "0123456789", 14, 14)
        check = next(d for d in "0123456789" if luhn(digits + d))
        whole, mark = digits + check, rng.choice(("", " ", "-"))
        return mark.join(whole[i : i + 4] for i in range(0, 16, 4))
    if kind == "phone":
        d = _some(rng, "0123456789", 10, 10)
        return rng.choice((f"+{rng.randint(1, 99)} {d[:3]} {d[3:6]} {d[6:]}", f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"+{rng.randint(1, 99)}{d}", f"+{rng.randint(1, 99)} ({d[:2]}) {d[2:6]}-{d[6:]}"))
    n = rng.choice((20, 24, 32, 40, 48, 64, 88, 200, 600))
    return rng.choice(
        (
            "AKIA" + _some(rng, _LOWER.upper() + "0123456789", 16, 16),
            _some(rng, _HEX, n, n),
            _some(rng, _HEX, n, n).upper(),
            _some(rng, _ALL, n, n),
            rng.choice(("sk-", "ghp_", "AKIA", "xoxb-", "pk_live_")) + _some(rng, _ALL, 16, 40),
            f"eyJ{_some(rng, _ALL, 20, 60)}.eyJ{_some(rng, _ALL, 20, 200)}.{_some(rng, _ALL + '-_', 30, 60)}",
            _some(rng, _ALL + "+/", n, n) + "=" * rng.randint(0, 2),
        )
    )


def _decoy(rng: random.Random, kind: str, words: list[str]) -> str:
    """A span that the generator of the kind proposes, or nearly so, and that is nobody's."""
    word = lambda: rng.choice(words)
    if kind == "email":
        return rng.choice((f"{word()}@{word()}", f"@{word()}", f"{word()} [at] {word()}", f"{word()} (at) {word()}", f"a@{rng.randint(1, 500)}"))
    if kind == "ip":
        return rng.choice((f"{rng.randint(0, 20)}.{rng.randint(0, 30)}.{rng.randint(0, 99)}", ".".join(str(rng.randint(256, 9999)) for _ in range(4)), f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.{rng.randint(1950, 2030)}", ".".join(str(rng.randint(0, 20)) for _ in range(6))))
    if kind == "card":
        while True:
            digits = _some(rng, "0123456789", 13, 19)
            if not luhn(digits):
                return rng.choice((digits, "-".join(digits[i : i + 4] for i in range(0, len(digits), 4))))
    if kind == "phone":
        return rng.choice((f"{rng.randint(1950, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", _some(rng, "0123456789", 7, 16), f"{rng.randint(1, 9)}.{_some(rng, '0123456789', 9, 14)}", f"{rng.randint(100, 999)}.{rng.randint(100, 999)}.{rng.randint(100, 999)}", f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}"))
    n = rng.choice((16, 20, 32, 40, 64))
    return rng.choice(
        (
            f"http://{word()}.{rng.choice(('com', 'org'))}/{_some(rng, _HEX, n, n)}", f"https://{word()}.{word()}.net/{word()}/{_some(rng, _ALL, 16, 24)}",
            "".join(word().capitalize() for _ in range(rng.randint(3, 6))), "".join(word()[:9].capitalize() for _ in range(rng.randint(4, 8))), word().lower() + "".join(word().capitalize() for _ in range(rng.randint(2, 5))) + rng.choice(("", "2", "Test")),
            "-".join([word(), word(), word(), str(rng.randint(1, 99))]), "/".join([word(), word(), word(), f"{word()}{rng.randint(1, 9)}.html"]), f"{word()}{word()}{word()}{rng.randint(1, 2030)}",
            _some(rng, "0123456789", 16, 22), "=" * rng.randint(16, 40) + "1", f"www.{word()}.{word()}/{word()}/{rng.randint(1, 9999)}", f"{word()}_{word()}_v{rng.randint(1, 30)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}.{word()}",
        )
    )


_CUE_WORDS = {
    "email": ("mail: ", "e-mail ", "contact "), "ip": ("host ", "ip: ", "from "), "card": ("card ", "card number: ", "VISA "), "phone": ("call ", "tel. ", "phone: "),
    "secret": ('token = "', "api_key: ", "password=", "secret: ", "Bearer ", 'KEY="'),
}


#: What stands before a public hash, and before a short secret.
_PUBLIC_WORDS = ("commit ", "sha256: ", "sha1 ", "md5: ", "rev ", "checksum ", "digest: ")
_NAMES = ("password: ", "password=", 'secret = "', "pwd=", "token: ", "api_key=")


def _planted(rng: random.Random, kind: str, personal: int, words: list[str]) -> tuple[str, str]:
    """(cue, span) of an example."""
    if kind == "secret" and personal and rng.random() < 0.3:
        short = rng.choice((rng.choice(words)[:8].lower() + _some(rng, "0123456789!#", 1, 4), _some(rng, _ALL + "!#%", 7, 15)))
        return rng.choice(_NAMES), short if _DIGITS.search(short) else short[:-1] + "7"
    if kind == "secret" and not personal and rng.random() < 0.25:
        n = rng.choice((16, 20, 32, 40, 64))
        return rng.choice(_PUBLIC_WORDS), _some(rng, _HEX, n, n)  # only what stands before it tells it from a secret
    span = _made_up(rng, kind) if personal else _decoy(rng, kind, words)
    return rng.choice(_CUE_WORDS[kind]) if rng.random() < (0.5 if personal else 0.15) else "", span


def examples(text: str) -> Iterator[tuple[list[float], int]]:
    """(features, whether it is personal data of its kind) of candidates on what is planted: made-up spans and decoys, two
    of each kind but for addresses of hosts. The words of decoys are those of the whole text."""
    rng = random.Random(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
    words = re.findall(r"[^\W\d_]{3,}", text) or ["word"]
    for kind in (*KINDS, "email", "card", "phone", "secret"):
        for personal in (1, 0):
            cue, span = _planted(rng, kind, personal, words)
            at = rng.randint(0, len(text))
            at = text.find(" ", at) + 1 or len(text)  # between words
            before = text[max(0, at - BEFORE) : at]
            if before and not before[-1].isspace():
                before += " "
            planted = before + cue + span + rng.choice((" ", ".", ",", '"', "\n")) + text[at : at + AFTER]
            start = len(before) + len(cue)
            for k, a, b in candidates(planted):
                if a < start + len(span) and b > start:
                    yield features(planted, k, a, b), int(personal and k == kind)


class Model:
    """Trees and the threshold of each kind."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        self.threshold = dict.fromkeys(KINDS, 0.5)
        self.trees = None
        if not len(rows) or labels.min() == labels.max():
            return
        held = np.arange(len(rows)) % 4 == 0
        self.trees = Boosting().fit(rows[~held], labels[~held].astype(float))
        score = self.trees.probability(rows[held])
        for k, kind in enumerate(KINDS):
            mine = rows[held][:, 0] == k
            if mine.any():
                self.threshold[kind] = self._calibrate(score[mine], labels[held][mine])

    @staticmethod
    def _calibrate(score: np.ndarray, label: np.ndarray) -> float:
        """The lowest threshold, not below one half, above which enough of the held-back candidates are right.

        It lies half way to the next lower score, so that a candidate like the last right one still passes.
        """
        order = np.argsort(-score, kind="stable")
        ranked = score[order]
        right = np.cumsum(label[order]) / np.arange(1, len(order) + 1)
        # equal scores are decided together
        ends = np.append(ranked[1:] != ranked[:-1], True)
        good = np.flatnonzero((right >= PRECISION) & ends & (ranked >= 0.5))
        if not len(good):
            return float((ranked[0] + 1) / 2) if len(ranked) else 0.5
        last = int(good[-1])
        below = ranked[last + 1] if last + 1 < len(ranked) else 0.0
        return float((ranked[last] + max(below, 0.0)) / 2) if below >= 0.5 else max(0.5, float((ranked[last] + below) / 2))

    def choose(self, texts: list[str], spans: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
        flat = [features(t, *s) for t, own in zip(texts, spans, strict=True) for s in own]
        if not flat or self.trees is None:
            return [[] for _ in texts]
        score = iter(self.trees.probability(np.array(flat)).tolist())
        return [[s for s in own if next(score) >= self.threshold[s[0]]] for own in spans]


def _trim(text: str, span: tuple[str, int, int]) -> tuple[str, int, int]:
    kind, a, b = span
    while b > a and text[b - 1] in ".,;:!?\"'=":
        b -= 1
    while a < b and text[a] in "\"'=(" and kind != "phone":
        a += 1
    return kind, a, b


def all_spans(text: str, base: list[tuple[str, int, int]], chosen: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The base spans and what the trees add: no added span overlaps one that stands, longer ones go first."""
    out = list(base)
    taken = bytearray(len(text) if chosen else 0)
    for _, a, b in base if chosen else ():
        taken[a:b] = b"\x01" * (b - a)
    for span in sorted((_trim(text, s) for s in chosen), key=lambda s: (s[1] - s[2], KINDS.index(s[0]), s[1])):
        if span[1] < span[2] and taken.find(1, span[1], span[2]) < 0:
            taken[span[1] : span[2]] = b"\x01" * (span[2] - span[1])
            out.append(span)
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _train_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        found = [e for text in batch.column(0).to_pylist() for e in examples(text or "")]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.list_(pa.float64())), pa.array([y for _, y in found], pa.int32())], ["x", "y"])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Trees from what is planted into at most ``sample_docs`` documents."""
    total = docs.count()
    rows = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("key"))
    if total > 2 * sample_docs:  # twice what is expected to be enough, cut to the bound below
        rows = rows.where(F.pmod("key", F.lit(1 << 50)) < int(2 * sample_docs / total * (1 << 50)))
    sample = rows.groupBy("key").agg(F.min("text").alias("text")).orderBy(F.pmod("key", F.lit(1 << 50)), "key").limit(sample_docs).select("text")
    found = sample.mapInArrow(_train_rows, "x array<double>, y int").collect()
    if not found:
        return Model(np.zeros((0, 1)), np.zeros(0))
    values = np.array([r["x"] for r in found], dtype=float)
    order = np.lexsort(values.T)  # the same model whatever the order of rows
    return Model(values[order], np.array([r["y"] for r in found])[order])


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def _text_of(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(model: Model, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    chosen = model.choose(texts, [candidates(t) for t in texts])
    return [(b, all_spans(t, b, c)) for t, b, c in zip(texts, base, chosen, strict=True)]


def _scan(shared):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in rows:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = find(model, texts)
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in BASE_KINDS]
            digest = [hashlib.sha256(_text_of(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array([_text_of(s) for _, s in found], pa.string())],
                [f.split()[0] for f in SCHEMA.split(", ")],
            )

    return batches


def scan(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per document with the base counts, their digest and all spans."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample_docs))
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_scan(model), SCHEMA)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
