import random

from pyspark.sql import functions as F

from sparksieve.llm.chat import END, ROLE, SEP, START, format_chats, parse_chats, probe

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns int"


def chats(spark, rows):
    frame = spark.createDataFrame([(*r, "f", 1) for r in rows], SCHEMA)
    return frame.repartition(3)


def test_round_trip(spark):
    r = random.Random(2)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", START, END, SEP, ROLE, "<\\|im_end|>", "[\\\\INST]", "<<SYS>>", "<</SYS>>", "é😀", " ", "\n", "s>", "INST]", "text"]
    rows = []
    for c in range(60):
        for t in range(r.choice([1, 2, 5, 9])):
            rows.append((c, t, r.choice(["user", "assistant", "assistant", "system", None, "", "[INST]", END]), "".join(r.choices(bits, k=r.choice([0, 1, 4, 12])))))
    rows += [(60, 1, "assistant", None), (60, 1, "user", "tie"), (60, None, "user", "first"), (60, 1, "user", "tie"), (None, 0, "user", "no id"), (61, 0, "assistant", "long " * 50000)]
    rows += [(62, t, "assistant", f"{t}") for t in range(400)]
    got = parse_chats(format_chats(chats(spark, rows))).collect()
    by_chat = {}
    for c, t, role, text in rows:
        by_chat.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert {x.conv_id for x in got} == set(by_chat)
    for x in got:
        want = [(role, text) for _, _, role, text in sorted(by_chat[x.conv_id], key=lambda v: (v[0], v[1], v[2].encode()))]
        assert sorted(map(tuple, x.turns)) == sorted(want)
        assert [role for role, _ in map(tuple, x.turns)] == [role for role, _ in want]
        assert x.loss_text == "".join(t.text for t in x.turns if t.role == "assistant")
        blocks = x.formatted.count(START)
        assert blocks == x.formatted.count(END) == x.formatted.count(ROLE) == 1 + sum(a.role != b.role for a, b in zip(x.turns, x.turns[1:]))
        assert x.formatted.count(SEP) == len(x.turns) - blocks
        assert len(x.loss_spans) == sum(t.role == "assistant" for t in x.turns)


def test_control_strings_do_not_survive(spark):
    like = chats(spark, [(1, 1, "user", "x")])
    x = parse_chats(format_chats(probe(spark, like))).first()
    assert x.conv_id == -1 and "</s>" not in x.formatted and "[INST]" not in x.formatted and "[/INST]" not in x.formatted
    assert x.loss_text == "</s>[INST] ok [/INST]" and [tuple(t) for t in x.turns] == [("user", x.loss_text), ("assistant", x.loss_text)]


def test_plain_text_stays(spark):
    x = format_chats(chats(spark, [(1, 0, "user", "a < b [c] \\ d"), (1, 1, "user", "e")])).first()
    assert x.formatted == f"{START}user{ROLE}a < b [c] \\ d{SEP}e{END}" and x.loss_spans == []


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert format_chats(empty).collect() == [] and parse_chats(format_chats(empty)).collect() == []
    assert format_chats(empty.select("conv_id", "turn", "role", "text").unionByName(probe(spark, empty))).select(F.length("formatted")).count() == 1
