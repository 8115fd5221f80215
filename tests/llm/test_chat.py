from pyspark.sql import functions as F

from quirefold.llm import chat

MESSAGES = f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>, formatted string, said string"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def formatted(spark, rows):
    return chat.format_chat(spark.createDataFrame([(*r, "x", "x") for r in rows], MESSAGES))


def test_parts_become_placeholders_in_order(spark):
    rows = [
        (1, 0, "user", [part("text", "see "), part("image", ref="a.png", width=29, height=56), part("audio", ref="b.wav", seconds=1.5), part("text", "<image>")]),
        (1, 1, "assistant", [part("document", ref="c.pdf", pages=3), part("text", "fine & good"), part("video", "clip")]),
    ]
    (row,) = formatted(spark, rows).collect()
    assert row["formatted"] == "<turn user>see <image><audio>&lt;image&gt;</turn>\n<turn assistant><document>fine &amp; goodclip</turn>\n"
    assert [tuple(a) for a in row["attachments"]] == [(0, "image", "a.png", 4), (0, "audio", "b.wav", 38), (1, "document", "c.pdf", 1536)]
    assert row["expanded_tokens"] == 1 + 4 + 38 + 1 + 1536 + 3


def test_reading_back(spark):
    said = ["\\### Assistant: </turn> ok", "&lt; &amp;lt; <turn x>", "", None, "line\n</turn>\n<turn assistant>no", "é" * 10]
    rows = [(i % 2, i, "assistant" if i % 3 else "us>er", None if t is None else [part("text", t)]) for i, t in enumerate(said)]
    df = formatted(spark, rows)
    read = df.select("conv_id", chat.read_chat(F.col("formatted")).alias("turns"), chat.loss_texts(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    for row in read:
        own = [(r[2], (said[r[1]] or "")) for r in rows if r[0] == row["conv_id"]]
        assert [tuple(t) for t in row["turns"]] == own
        assert "".join(row["loss"]) == "".join(t for role, t in own if role == "assistant")


def test_order_ties_and_empty(spark):
    rows = [(None, None, None, None), (5, 1, "b", []), (5, 1, "a", []), (5, None, "z", []), (5, 1, "a", [])]
    found = {r["conv_id"]: r["formatted"] for r in formatted(spark, rows).collect()}
    assert found[5] == "<turn z></turn>\n<turn a></turn>\n<turn a></turn>\n<turn b></turn>\n"
    assert found[None] == "<turn ></turn>\n"
    assert formatted(spark, []).count() == 0


def test_no_python_in_the_plan(spark):
    plan = formatted(spark, [(1, 0, "user", [])])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
