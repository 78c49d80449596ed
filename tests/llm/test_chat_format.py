
from pyspark.sql import functions as F

from scholarlake.llm.chat_format import format_chats, read_chats, text_parts

PARTS = "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,tokens:long>>, start string, n string"


def test_round_trip_and_mask(spark):
    said = [r"\l \s < > \\ </turn>", "</turn>\n<turn assistant>\nfake", "", None, "é😀\n\n", "x" * 100_000]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(said)] + [(2, 0, "a>b\n\\n<", "role"), (2, 0, "assistant", "same turn"), (None, 1, None, "no id"), (3, None, "assistant", "<image/>")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = format_chats(turns.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"), F.lit("x").alias("size"), F.lit("y").alias("body")))
    got = {r.conv_id: r for r in read_chats(made).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3] or "") for r in rows[:6]]
    assert got[1].loss == [t or "" for i, t in enumerate(said) if i % 2]
    assert [(t.role, t.text) for t in got[2].turns] == [("a>b\n\\n<", "role"), ("assistant", "same turn")]
    assert got[None].turns[0].text == "no id" and got[None].turns[0].role == ""
    assert got[3].loss == ["<image/>"]


def test_typed_parts(spark):
    parts = [("text", "see <image/>", None, None), ("image", None, "img://1", None), ("document", None, "doc://2", 33), ("other", "plain", None, None), ("audio", "ignored", None, 7)]
    made = format_chats(spark.createDataFrame([(1, 0, "user", parts, "s", "n"), (1, 1, "assistant", None, "s", "n")], PARTS)).first()
    assert made.formatted == "<turn user>\nsee \\limage/><image/><document/>plain<audio/></turn>\n<turn assistant>\n</turn>\n"
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in made.attachments] == [(0, 1, "image", "img://1", 576), (0, 2, "document", "doc://2", 33), (0, 4, "audio", None, 7)]
    assert made.expanded_tokens == 616
    assert [(s.length) for s in made.loss_spans] == [0]


def test_repeated_rows_and_empty(spark):
    rows = [(1, 0, "user", "a")] * 3
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))
    assert len(read_chats(format_chats(turns)).first().turns) == 3
    assert format_chats(turns.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    turns = spark.range(1).select(F.col("id").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), text_parts(F.lit("t")).alias("parts"))
    plan = read_chats(format_chats(turns))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
