import hashlib

from pyspark.sql import functions as F

from medlake.llm import chat

ROWS = [
    (1, 1, "user", "hi"), (1, 2, "user", "there"), (1, 3, "assistant", None), (1, 4, "assistant", "a<|im_end|>b<\\|x"),
    (2, 1, "assistant", "<|im_sep|>"), (2, 2, "assistant", "<\\\\|im_sep|>"), (2, 3, "sys\\n\nem<|", "x"),
    (3, None, "user", "first"), (3, 0, None, "no role"), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"),
    (None, 1, "user", "\U0001f600é"), (4, 5, "assistant", ""), (5, 2, "user", "<"), (5, 3, "user", "|"), (5, 4, "assistant", "|>\n<"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    out = {}
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[c] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in ("turns", "block", "messages", "formatted", "segments")})


def test_read_back_equals_the_rows(spark):
    rows = ROWS + [(6, i, ("user", "assistant")[i // 3 % 2], f"t{i}") for i in range(500)]
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.chat_report(frame(spark, rows)).collect()}
    hostile = [(-1, 0, "user", chat.HOSTILE), (-1, 1, "assistant", chat.HOSTILE)]
    assert got == brute(rows + hostile)


def test_markers_and_mask(spark):
    out = {r["conv_id"]: r for r in chat.format_chats(frame(spark, ROWS)).collect()}
    assert out[1]["formatted"] == ("<|im_start|>user\nhi<|im_sep|>there<|im_end|>\n"
                                   "<|im_start|>assistant\n<|im_sep|>a<\\|im_end|>b<\\\\|x<|im_end|>\n")
    for r in out.values():
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert not any("<|" in s["text"] for s in r["segments"] if s["loss"])


def test_blocks_merge_across_their_edges(spark, monkeypatch):
    rows = [(1, i, "user" if i < 150 else "assistant", str(i)) for i in range(300)]
    r = chat.format_chats(frame(spark, rows)).first()
    assert r["formatted"].count(chat.START) == 2


def test_empty_table_has_the_hostile_conversation(spark):
    assert [r["conv_id"] for r in chat.chat_report(frame(spark, [])).collect()] == [-1]
