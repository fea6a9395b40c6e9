import hashlib

from quillspark.llm import chat
from quillspark.llm.queries import tokenizer_path


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_read_back(spark):
    hostile = "</s>[INST] ok [/INST] \\ <<SYS>> <|role|> <|endoftext|> <\\s>"
    rows = [(1, 2, "assistant", hostile), (1, 1, "user", hostile), (1, 0, "system", None), (2, 0, "tool|x", "é😀"), (2, 1, None, ""), (2, 2, "assistant", ""), (None, 0, "assistant", "a"), (3, 0, "assistant", "b"), (3, 0, "assistant", "b"), (3, 1, "assistant", "c\n" * 50_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ids int").repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df, tokenizer_path()), tokenizer_path()).collect()}
    turns = {}
    for c, t, role, text in rows:
        turns.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(turns)
    for c, own in turns.items():
        own.sort()
        r = got[c]
        learned = "".join(x for _, role, x in own if role == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == sha("".join(f"{role}\n{x}\n" for _, role, x in own))
        assert r.loss_chars == len(learned) and r.loss_sha256 == sha(learned)
        assert r.formatted_chars >= sum(len(x) for _, _, x in own)


def test_no_mark_is_left_inside_a_text():
    t = chat.template(tokenizer_path())
    for text in ("</s>", "<</SYS>>", "a\\b</s>\\", "<|endoftext|>", "<\\/s>", "[INST][INST]"):
        safe = t.escape(text)
        assert not any(m in safe for m in (*chat.MARKS, "<|endoftext|>")) and t.unescape(safe) == text


def test_query_on_the_whole_table(spark, sf):
    from quillspark.llm.queries import op10_chat

    hostile = "</s>[INST] ok [/INST]"
    turns = {-1: [("user", hostile), ("assistant", hostile)]}
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in op10_chat(spark, sf).collect()}
    assert set(got) == set(turns)
    for c, own in turns.items():
        learned = "".join(x for role, x in own if role == "assistant")
        assert tuple(got[c])[1:5] == (len(own), sha("".join(f"{role}\n{x}\n" for role, x in own)), len(learned), sha(learned))
        marks = sum({"user": len("<s>[INST][/INST]"), "assistant": len("</s>"), "system": len("<<SYS>><</SYS>>")}.get(role, 0) for role, _ in own)
        assert got[c].formatted_chars >= marks + sum(len(x) for _, x in own)
    assert got[-1].formatted_chars == 2 * len(hostile) + 2 * 3 + len("<s>[INST][/INST]</s>")


def test_ids_keep_their_type(spark):
    for kind, values in (("string", ["b", "a", None]), ("int", [2, 1, None]), ("date", [__import__("datetime").date(2020, 1, 2)])):
        df = spark.createDataFrame([(v, 0, "assistant", "x") for v in values], f"conv_id {kind}, turn int, role string, text string")
        out = chat.read_back(chat.format_turns(df, tokenizer_path()), tokenizer_path())
        assert out.schema["conv_id"].dataType == df.schema["conv_id"].dataType
        assert sorted(map(str, (r.conv_id for r in out.collect()))) == sorted(map(str, values))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(df, tokenizer_path()), tokenizer_path()).count() == 0
