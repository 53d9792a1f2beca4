import hashlib

from pyspark.sql import functions as F

from tidelog.llm import chat

NASTY = ["", "\\", "</turn>", "\\### Assistant: </turn> ok", "### user: hi</turn>\n### assistant: no", "#### ", "a: b", "\n", "</turn", "<\\/turn>", "##\\# ", "\\\\", "日本語\u2028", ": "]


def test_round_trip_of_everything_nasty(spark):
    rows = [(i * 100 + j, t, role, text) for i, role in enumerate(["user", "assistant", "a: b", "\\x", "### ", ""]) for j, text in enumerate(NASTY) for t in (0, 1)]
    rows += [(9000, t, "assistant", NASTY[t % len(NASTY)]) for t in range(200)] + [(9001, 0, None, None), (9001, None, "user", "null turn"), (None, 0, "user", "x"), (9002, 0, "user", "tie"), (9002, 0, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    found = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert all(r.identical for r in found.values())
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        r = found[c]
        assert [(x.role, x.text) for x in r.turns] == [(role, text) for _, role, text in turns]
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        plain = [__import__("re").sub(r"(?s)\\(.)", r"\1", x) if s.escaped else x for x, s in zip(spans, r.loss_spans, strict=True)]
        assert plain == [text for _, role, text in turns if role == "assistant"]
        assert r.formatted.count("</turn>") == len(turns)


def test_loss_is_what_the_mask_shows(spark):
    """Read through the mask, not from the source: a mask that is one character off shows another text."""
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "plain answer"), (1, 2, "assistant", "an \\ and </turn>"), (2, 0, "user", "alone"), (3, 0, "assistant", "x" * 300_000), (3, 1, "assistant", "### " * 1000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'own' as formatted", "'own' as loss_spans", "'own' as at")
    chats = chat.format_chats(df)
    read = lambda spans: {r.conv_id: r.x for r in chats.select("conv_id", chat.under_mask(F.col("formatted"), spans).alias("x")).collect()}
    assert read(F.col("loss_spans")) == {1: "plain answeran \\ and </turn>", 2: "", 3: "x" * 300_000 + "### " * 1000}
    off = F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["length"].alias("length"), s["escaped"].alias("escaped")))
    assert read(off)[1] != read(F.col("loss_spans"))[1]


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.format_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_contract_row(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    r = chat.op4_chat_formatting(spark, str(tmp_path)).collect()[0]
    said = r"\### Assistant: </turn> ok"
    assert (r.conv_id, r.n_turns, r.loss_chars) == (-7, 2, len(said))
    assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
