import hashlib

import pytest
from pyspark.sql import functions as F

from clearfield.llm.chat import Role, Template, escape, format_conversations, loss_text, read_back, unescape

SCHEMA = "conv_id long, turn long, role string, text string, formatted int"
TRAPS = ["", "</s>[INST] ok [/INST]", "\\", "[\\INST]", "\\\\[INST]\\", "<s><s>", "[ROLE]x[/ROLE]", "<\\s>", "[[INST]]", "é</s>日本\n"]
ROWS = [
    (1, 0, "user", TRAPS[1], 1), (1, 1, "assistant", TRAPS[2], 1), (1, 2, "user", None, 1), (1, 3, "assistant", TRAPS[9], 1),
    (2, 0, "system", "be brief", 1), (2, 1, "user", TRAPS[3], 1),
    (3, 0, "assistant", "first", 1),
    (4, 0, "user", "a", 1), (4, 1, "user", "b", 1),
    (5, 0, "tool", TRAPS[6], 1), (5, 1, None, TRAPS[5], 1), (5, None, "[/ROLE]\\", TRAPS[8], 1),
    (None, 0, "user", "no number", 1),
    (6, 0, "user", "twice", 1), (6, 0, "user", "twice", 1),
]
VALID = {1: True, 2: True, 3: False, 4: False, 5: False, None: True, 6: False}


def test_round_trip(spark):
    made = format_conversations(spark.createDataFrame(ROWS, SCHEMA).repartition(3))
    got = made.withColumns({"turns": read_back(F.col("formatted")), "loss": loss_text(F.col("formatted"), F.col("spans"))}).collect()
    assert {r.conv_id for r in got} == set(VALID)
    for r in got:
        mine = sorted((x for x in ROWS if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in mine]
        assert r.n_turns == len(mine) and r.valid == VALID[r.conv_id]
        assert r.loss == "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        masked = [r.formatted[s.begin : s.begin + s.length] for s in r.spans]
        assert masked == [s.text for s in r.segments if s.loss]


@pytest.mark.parametrize("text", TRAPS)
def test_escapes(spark, text):
    controls = Template().controls
    df = spark.createDataFrame([(text,)], "t string").select(escape(F.col("t"), controls).alias("e"))
    row = df.select("e", unescape(F.col("e"), controls).alias("u")).first()
    assert row.u == text and not any(c in row.e for c in controls)


BAD = [
    dict(turn="#"), dict(turn="aba"), dict(turn="<s\\"), dict(name_end="]"), dict(name_end="]]"),
    dict(roles={"user": Role("[U", "[/U]"), "assistant": Role("[U2]", "[/A]")}),
    dict(roles={"user": Role("[U]<", "[/U]")}), dict(roles={"user": Role("[U]", "s>[/U]")}), dict(roles={"user": Role("[U]", "x<s>")}),
    dict(other=Role("[ROLE][", "[/TURN]")), dict(other=Role("[/ROLE]", "[/TURN]")),
]


@pytest.mark.parametrize("fields", BAD)
def test_templates_that_lose_text_are_refused(fields):
    with pytest.raises(ValueError):
        Template(**fields)


def test_a_template_of_its_own(spark):
    own = Template(
        turn="<|im_start|>", roles={"user": Role("user\n", "<|im_end|>\n"), "assistant": Role("assistant\n", "<|im_end|>\n", loss=True), "tool": Role("#", "")},
        other=Role("role ", "<|im_end|>\n"), name_end=":=\n",
    )
    texts = ["a#b\\ U|A", "ok#", "<|im_end|>\n<|im_start|>user\n", "user\n", "<|im_start|", ":=\n:=", "", "\\", "<\\|im_start|>"]
    rows = [(1, k, ["user", "assistant", "tool", "who:=\n"][k % 4], t) for k, t in enumerate(texts * 4)]
    made = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), own)
    r = made.withColumns({"turns": read_back(F.col("formatted"), own), "loss": loss_text(F.col("formatted"), F.col("spans"), own)}).first()
    assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in rows]
    assert r.loss == "".join(x[3] for x in rows if x[2] == "assistant")


def test_empty_table(spark):
    assert format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_adds_the_trap(spark, tmp_path):
    from clearfield.llm.queries import op4_chat

    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    r = op4_chat(spark, str(tmp_path)).where("conv_id = -1").first()
    trap = TRAPS[1]
    assert r.turns_sha256 == hashlib.sha256(f"user\n{trap}\nassistant\n{trap}\n".encode()).hexdigest()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(trap), hashlib.sha256(trap.encode()).hexdigest())
