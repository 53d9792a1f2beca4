r"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation := turn*
    turn         := "### " mark role ": " body "</turn>" "\n"
    mark         := "" | "\"

Neither role nor body may hold "</turn>" or "### ", and a role no ": ". After
the mark "\", role and body are escaped: a backslash and the character after it
stand for that character. The parser splits at "</turn>", checks every rule and
undoes escapes, so it has one reading of a text or none.

Every turn is first rendered as it is and parsed again. Where the parser does
not give back the same role and text, the turn is rendered escaped: backslashes
are doubled and a backslash is put inside each control string. The whole
conversation is then parsed and compared with its source; `identical` says that
they agree, and escaping makes it true for every input.

Defined cases: a null role or text is empty; turns are ordered by turn, then
role, then text, null first; a null conv_id is one conversation; repeated rows
are turns of their own; an empty table gives no rows. Columns other than conv_id, turn, role
and text are never read, whatever their names. A conversation is one text, so its
rows meet in one task; nothing else does. A text of any length is escaped and
parsed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

HEAD, MARK, COLON, END, NEWLINE = "### ", "\\", ": ", "</turn>", "\n"


def escape(text: Column, role: bool = False) -> Column:
    """text without control strings; `unescape` undoes it."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(END), F.lit("<\\/turn>"))
    out = F.replace(out, F.lit(HEAD), F.lit("##\\# "))
    return F.replace(out, F.lit(COLON), F.lit(":\\ ")) if role else out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column, escaped: bool) -> Column:
    if escaped:
        return F.concat(F.lit(HEAD + MARK), escape(role, role=True), F.lit(COLON), escape(text), F.lit(END + NEWLINE))
    return F.concat(F.lit(HEAD), role, F.lit(COLON), text, F.lit(END + NEWLINE))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text); null if it breaks the grammar."""

    def turn(piece: Column, at: Column) -> Column:
        line = F.when(at == 0, piece).when(F.startswith(piece, F.lit(NEWLINE)), F.substr(piece, F.lit(2))).otherwise(F.lit(""))
        marked = F.startswith(line, F.lit(HEAD + MARK))
        rest = F.substr(line, F.when(marked, F.lit(len(HEAD + MARK) + 1)).otherwise(F.lit(len(HEAD) + 1)))
        colon = F.instr(rest, COLON)
        role, text = F.substr(rest, F.lit(1), colon - 1), F.substr(rest, colon + F.lit(len(COLON)))
        good = F.startswith(line, F.lit(HEAD)) & (colon > 0) & ~F.contains(rest, F.lit(HEAD))
        both = F.struct(F.when(marked, unescape(role)).otherwise(role).alias("role"), F.when(marked, unescape(text)).otherwise(text).alias("text"))
        return F.when(good, both)

    pieces = F.split(formatted, END, -1)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)
    whole = (formatted == "") | (F.element_at(pieces, -1) == NEWLINE)
    return F.when(whole & ~F.exists(turns, lambda t: t.isNull()), turns)


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, formatted, turns (parsed back), loss_spans and identical.

    loss_spans: start, length (code points of formatted) and escaped of each
    assistant text, in order.
    """
    source = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    plain = source.withColumn("plain", render(F.col("role"), F.col("text"), escaped=False))
    same = F.coalesce(parse(F.col("plain")) == F.array(F.struct("role", "text")), F.lit(False))
    shown = plain.withColumn("escaped", ~same).withColumn("shown", F.when(F.col("escaped"), render(F.col("role"), F.col("text"), escaped=True)).otherwise(F.col("plain")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body = F.when(F.col("escaped"), F.length(escape(F.col("text")))).otherwise(F.length("text"))
    placed = shown.select("conv_id", F.row_number().over(order).alias("at"), "role", "text", "shown", "escaped", body.alias("length"), (F.sum(F.length("shown").cast("long")).over(so_far) - len(END + NEWLINE)).alias("end"))
    parts = F.array_sort(F.collect_list(F.struct("at", "role", "text", "shown", "escaped", "length", "end")))
    chats = placed.groupBy("conv_id").agg(parts.alias("parts"))
    chats = chats.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["shown"]), "").alias("formatted"),
        F.transform("parts", lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text"))).alias("source"),
        F.transform(F.filter("parts", lambda p: p["role"] == "assistant"), lambda p: F.struct((p["end"] - p["length"]).alias("start"), p["length"].alias("length"), p["escaped"].alias("escaped"))).alias("loss_spans"),
    )
    read = chats.withColumn("turns", parse(F.col("formatted")))
    return read.select("conv_id", "formatted", "turns", "loss_spans", F.coalesce(F.col("turns") == F.col("source"), F.lit(False)).alias("identical"))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask: what formatted has at each span, escapes undone, one after the other."""

    def said(span: Column) -> Column:
        part = F.substr(formatted, (span["start"] + 1).cast("int"), span["length"].cast("int"))
        return F.when(span["escaped"], unescape(part)).otherwise(part)

    return F.array_join(F.transform(spans, said), "")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = format_chats(rows)
    read = chats.select("conv_id", "turns", "formatted", under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"), "identical")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, contains(role || ': ' || text, '</turn>') OR contains(role || ': ' || text, '### ') OR contains(role, ': ') OR starts_with(role, '\') AS escaped,
         replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# ') AS r0,
         replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# ') AS t
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN escaped THEN 15 + length(replace(r0, ': ', ':\ ')) + length(t) ELSE 14 + length(role) + length(text) END)::BIGINT AS formatted_chars, true AS identical
FROM e GROUP BY conv_id
"""
