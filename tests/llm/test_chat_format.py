"""Rendering, examples, and an exact round trip."""

import random

from pyspark.sql import functions as F

from corvane.llm import chat_format as c

KIND = "conv_id long, turn long, role string, text string"
NASTY = ["</turn>", "<turn:assistant>", "&lt;", "&amp;", "a\nb", "", "\\", "é😀", "</turn>\n<turn:user>x", " "]


def test_round_trip_and_mask(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "a>b<&", None]), rng.choice([None, "".join(rng.choices(NASTY, k=4))])))
    rows.append((None, 1, "assistant", "no id"))
    rows.append((99, None, "user", "no turn"))
    rows += [(98, 1, "assistant", "twice")] * 2
    df = spark.createDataFrame(rows, KIND)
    formatted = c.format_conversations(df)
    read = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in formatted.select("conv_id", c.read_turns(F.col("formatted")).alias("turns")).collect()}
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] or -1, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert read == want
    examples = c.expand_replies(formatted).orderBy("conv_id", "example").collect()
    for conv, turns in want.items():
        own = [e for e in examples if e["conv_id"] == conv]
        replies = [t for r, t in turns if r == "assistant"]
        assert [e["reply"].replace("&lt;", "<").replace("&amp;", "&") for e in own if e["trainable"]] == replies
        assert [e["last"] for e in own] == [False] * (len(own) - 1) + [True]
        assert sum(not e["trainable"] for e in own) == (turns[-1][0] != "assistant")
        for e in own:
            assert len(e["context"]) == e["context_chars"] and e["context"].count(c.CLOSE) + 1 >= e["example"]


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, 1, "user", "q", "x"), (1, 2, "assistant", "a", "y")], KIND + ", formatted string")
    e = c.expand_replies(c.format_conversations(df)).first()
    assert (e["context"], e["reply"]) == ("<turn:user>q</turn>\n<turn:assistant>", "a")
    assert c.expand_replies(c.format_conversations(df.limit(0))).count() == 0
