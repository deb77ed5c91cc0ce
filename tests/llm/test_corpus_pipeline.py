"""The pipeline on a small table against the stages done one after the other by brute force."""

import random
import sys
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import test_decontamination as decontamination  # noqa: E402
import test_line_dedup as line_dedup  # noqa: E402
import test_packing as packing  # noqa: E402
from brute import components  # noqa: E402
from conftest import prose  # noqa: E402

import corpus_pipeline as C  # noqa: E402
from gristmill.llm import decontamination as D  # noqa: E402
from gristmill.llm import quality_rules  # noqa: E402


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    words = "the of and to in a is that it was thing haus river stone light paper under over many little".split()

    def text(n):
        return " ".join(rng.choice(words) + rng.choice(("", "", "s", "ed", "ing")) for _ in range(n))

    line, other = text(14), text(12)
    items = [(i, prose(rng, 14)) for i in range(3)]
    rows = [(i, text(rng.randint(40, 120))) for i in range(30)]
    rows.append((39, text(110)))
    base = rows[-1][1].split()
    for k in range(8):  # near copies around the threshold of the stage, some between it and that of the query
        copy = base[:]
        for at in rng.sample(range(len(copy)), k // 2):
            copy[at] = f"x{k}"
        rows.append((40 + k, " ".join(copy)))
    rows += [(60 + k, f"{text(30)}\n{line if k % 2 else '  ' + line.upper()}\n{text(30)}") for k in range(7)]
    rows += [(70 + k, f"{other}\n{text(60)}\n{other}") for k in range(5)]
    rows += [(80, f"{text(40)} {items[0][1]} {text(40)}"), (81, f"{text(40)} {items[1][1][:30]}z{items[1][1][31:]} {text(20)}"), (82, text(400)), (83, text(3000))]
    rows += [(90, None), (91, ""), (92, "few words"), (93, "# $ % & | " * 30), (94, "the same of it " * 40), (95, rows[5][1]), (96, rows[5][1])]
    return rows, items


def write(folder, rows, items):
    n = len(rows)
    columns = {"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string()), "lang": ["en"] * n, "source": ["s"] * n, "n_chars": pa.array([len(t or "") for _, t in rows], pa.int64())}
    pq.write_table(pa.table(columns), folder / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}), folder / "benchmark.parquet")
    return str(folder)


def stages(rows, items, folder):
    """What each stage keeps: (doc_id, text)."""
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        good = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality_rules.ORACLE_SQL}) WHERE kept").fetchall()}
    rows = [(d, t) for d, t in rows if d in good]
    yield rows
    cut = line_dedup.brute(rows)
    rows = [(d, cut[d][2]) for d, _ in rows]
    yield rows
    found = components(rows, C.NEAR_PER_CENT)
    rows = [(d, t) for d, t in rows if found[d][2]]
    yield rows
    plain = [D.normal(t) for _, t in items]
    rows = [(d, t) for d, t in rows if not any(decontamination.edit_infix(p, D.normal(t)) <= D.budget(p) for p in plain)]
    yield rows


def test_stages_and_run_match_brute_force(spark, corpus, tmp_path):
    rows, items = corpus
    folder = write(tmp_path, rows, items)
    kept = [rows, *stages(rows, items, folder)]
    assert all(len(a) > len(b) for a, b in ((kept[0], kept[1]), (kept[2], kept[3]), (kept[3], kept[4]))) and kept[1] != kept[2]
    assert components(kept[2], 80) != components(kept[2], 85)  # the threshold of the stage decides
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(C.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == columns, name
        place = str(tmp_path / name)
        out.write.parquet(place)
        docs = spark.read.parquet(place)
        assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted(kept[k + 1]), name
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    packed = C.run(spark, folder).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in packed} == packing.expected(kept[-1])
    total = sum(r["length"] for r in packed)
    assert packing.check_places(packed) <= -(-total // 1024) + 1


def test_empty_tables_and_names(spark, corpus, tmp_path):
    assert [name for name, _ in C.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    _, items = corpus
    assert C.run(spark, write(tmp_path, [], items)).count() == 0
    (tmp_path / "none").mkdir()
    rows = [(1, "the cat and the dog went to the sea because it was warm that day"), (None, "the cat and the bird went to the sea because it was cold that day"), (1, "the cat and the dog went to the sea because it was warm that day")]
    got = C.run(spark, write(tmp_path / "none", rows, [])).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "None"]
