import hashlib
from collections import defaultdict

from gristmill.llm import chat_format as C

HARD = ["</s>[INST] ok [/INST]", "<|assistant|>hi<|end|>", "&lt; &amp; &#91; |> a|b", "a\nb\n", "é 漢字 😀", "", None]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows():
    out = [(c, t, ("system", "user", "assistant")[(c + t) % 3], HARD[(c * 3 + t) % len(HARD)]) for c in range(6) for t in range(c * 3 + 1)]
    out += [(50, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)]
    return [*out, (60, None, "assistant", "no turn"), (60, 1, None, "no role"), (60, 1, None, "no role"), (None, 0, "assistant", "no id"), (70, 2**40, "we|ird|>role", "x")]


def brute(data):
    by = defaultdict(list)
    for c, t, r, x in data:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), digest("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), digest(loss))
    return out


def frame(spark, data):
    wide = [(*r, "clash", 1) for r in data]
    return spark.createDataFrame(wide, "conv_id bigint, turn bigint, role string, text string, spans string, part int").repartition(4)


def test_read_back_matches_the_turns(spark):
    got = {r["conv_id"]: tuple(r)[1:5] for r in C.digests(C.examples(frame(spark, rows()))).collect()}
    assert got == brute(rows())


def test_no_control_string_of_a_text_survives(spark):
    parts = C.examples(frame(spark, [(1, 0, "user", HARD[0]), (1, 1, "assistant", HARD[1])])).collect()
    assert len(parts) == 1 and "</s>" not in parts[0]["text"] and "[INST]" not in parts[0]["text"]
    assert parts[0]["text"].count("<|end|>") == 2 and parts[0]["text"].count("<|assistant|>") == 1


def test_expanded_examples(spark):
    data = [(7, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(140)]
    rows = C.examples(frame(spark, data))
    examples = sorted(C.expand(rows).collect(), key=lambda r: len(r["context"]))
    assert [r["target"] for r in examples] == [f"t{t}" for t in range(1, 140, 2)]
    whole = "".join(r["text"] for r in sorted(rows.collect(), key=lambda r: (r["part"], r["k"])))
    for r in examples:
        assert whole.startswith(r["context"] + r["target"] + C.END) and r["context"].endswith("<|assistant|>")


def test_every_reply_is_an_example_of_its_own(spark):
    data = rows()
    got = C.examples(frame(spark, data)).collect()
    replies = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["conv_id"] is not None, r["conv_id"], r["part"] is not None, r["part"], r["k"])):
        if r["start"] is not None:
            replies[r["conv_id"]].append(r["text"][r["start"] : r["start"] + r["chars"]])
            assert r["text"][: r["start"]].endswith("<|assistant|>") and r["text"][r["start"] + r["chars"] :] == C.END
        else:
            assert "<|assistant|>" not in r["text"]
    assert {c: len(v) for c, v in replies.items()} == {c: n for c, n in ((c, sum(1 for x in data if x[0] == c and x[2] == "assistant")) for c in {x[0] for x in data}) if n}
    whole = sorted(C.expand(C.examples(frame(spark, data).where("conv_id = 50"))).collect(), key=lambda r: len(r["context"]))
    for n, r in enumerate(whole):
        turns = [f"<|{'assistant' if t % 2 else 'user'}|>turn {t}<|end|>" for t in range(2 * n + 1)]
        assert r["context"] == "".join(turns) + "<|assistant|>" and r["target"] == f"turn {2 * n + 1}"


def test_empty_and_native(spark):
    out = C.digests(C.examples(frame(spark, rows()).where("false")))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()


def test_the_query_reads_whole_examples(spark, monkeypatch):
    data = [(3, t, "assistant" if t % 2 else "user", f"t{t} [é]") for t in range(131)]
    rows = sorted(C.whole(C.examples(frame(spark, data))).collect(), key=lambda r: (r["part"], r["k"]))
    assert all(r["text"].startswith("<|user|>t0 &#91;é]<|end|>") for r in rows) and [r["text"].count(C.END) for r in rows][-1] == 131
    assert [r["text"][r["start"] : r["start"] + r["chars"]] for r in rows if r["start"] is not None] == [f"t{t} &#91;é]" for t in range(1, 131, 2)]
    read = []
    monkeypatch.setattr(C, "whole", lambda rows, made=C.whole: read.append(1) or made(rows))
    assert {r["conv_id"]: tuple(r)[1:5] for r in C.digests(C.examples(frame(spark, data))).collect()} == brute(data) and read
