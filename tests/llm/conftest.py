import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, a bigint, n int"


def prose(rng, words):
    stems = ["thing", "ound", "er", "the", "of", "and", "tion", "ment", "ing", "haus", "que", "é", "lich"]
    return " ".join("".join(rng.choices(stems, k=rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) with nulls, empty and blank texts, copies, near copies, ties and one very long text."""
    rng = random.Random(5)
    line = prose(rng, 12)
    base = [prose(rng, 80) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base, 10)]
    for k in range(12):
        words = base[0].split()
        for at in rng.sample(range(len(words)), 1 + k % 3):
            words[at] = "x" * (k + 1)
        rows.append((100 + k, " ".join(words)))
    rows += [(200 + k, base[1]) for k in range(6)]
    rows += [(300 + k, f"{prose(rng, 8)}\n{line.upper() if k % 2 else line}\n  {line}  \n{prose(rng, 30)}") for k in range(6)]
    rows += [(1, None), (2, ""), (3, " \t\n\x0b \n"), (4, "one two"), (5, "one two"), (6, "ÄÖ ünï one two three"), (7, "\n\n\n"), (8, "same same " * 40)]
    rows += [(400, prose(rng, 15000))]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with the columns of documents and some whose names operators might use themselves."""
    rows = [(d, t, "en", "src0", len(t or ""), "yes", d, 1) for d, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def odd(spark):
    """Rows without doc_id and repeated rows."""
    rows = [(None, "a b c d e f g"), (None, None), (9, "a b c d e f g"), (9, "a b c d e f g")]
    return spark.createDataFrame([(d, t, "en", None, None, "no", None, None) for d, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
