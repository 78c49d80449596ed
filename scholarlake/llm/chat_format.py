"""Chat formatting with typed content parts, in DataFrame functions only.

Each turn becomes ``<turn ROLE>\\n`` + body + ``</turn>\\n``. Text is escaped so that no template mark can come from it:
a backslash becomes ``\\s``, then ``<`` becomes ``\\l`` (in roles also ``>`` ``\\g`` and line feeds ``\\n``). Every
backslash of an escaped text is followed by a code letter, so undoing the replacements in reverse order is exact.
The visitor over content parts writes text parts as escaped text, and image, audio and document parts as
``<image/>``-like placeholders in their order, noting turn, part, kind, reference and the tokens they expand to.

Defined cases: null text, role or part is empty; turns order by turn, role, text (nulls first); repeated rows are
repeated turns; a null conversation id is a conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlake.llm.common import table

END = "</turn>\n"
#: Kinds with a placeholder, and the tokens one expands to where a part gives no count of its own.
EXPANDS = {"image": 576, "audio": 750, "document": 1024}


def escape(x: Column) -> Column:
    return F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(x: Column) -> Column:
    return F.replace(F.replace(escape(x), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def unescape_role(x: Column) -> Column:
    return unescape(F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\g"), F.lit(">")))


def text_parts(text: Column) -> Column:
    """A plain text as its list of parts."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))


def _visit(part: Column) -> Column:
    """What one part adds to the body. Unknown kinds count as text."""
    return F.when(part["kind"].isin(*EXPANDS), F.concat(F.lit("<"), part["kind"], F.lit("/>"))).otherwise(escape(part["text"]))


def _expands(part: Column) -> Column:
    default = F.lit(0).cast("long")
    for kind, n in EXPANDS.items():
        default = F.when(part["kind"] == kind, F.lit(n).cast("long")).otherwise(default)
    return F.coalesce(part["tokens"], default)


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Conversations from rows (conv_id, turn, role, parts: array<struct<kind, text, ref, tokens>>).

    Returns conv_id, formatted, loss_spans (array of start from 1 and length, in code points of `formatted`; one for
    each body of loss_role), attachments (array of turn, part, kind, ref, tokens in order) and expanded_tokens.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = F.coalesce(F.col("parts"), F.array().cast(turns.schema["parts"].dataType))
    rows = turns.select(
        "conv_id",
        "turn",
        "role",
        "parts",
        F.concat(F.lit("<turn "), escape_role(F.col("role")), F.lit(">\n")).alias("head"),
        F.array_join(F.transform(parts, _visit), "").alias("body"),
        F.filter(
            F.transform(parts, lambda p, i: F.struct(F.col("turn"), i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), _expands(p).alias("tokens"))),
            lambda a: a["kind"].isin(*EXPANDS),
        ).alias("found"),
    ).withColumn("size", F.length("head") + F.length("body") + F.lit(len(END)))
    placed = rows.withColumn("no", F.row_number().over(order)).withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head") + 1)
    grouped = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("no", F.concat("head", "body", F.lit(END)).alias("line"), "start", F.length("body").alias("length"), F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("masked"), "found"))).alias("t")
    )
    attachments = F.flatten(F.transform("t", lambda x: x["found"]))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["line"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["masked"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """Turns back from `formatted` alone: conv_id, turns (array of role and text; placeholders stay), loss (texts under loss_spans)."""
    pieces = F.split("formatted", "</turn>\n", -1)
    return formatted.select(
        "conv_id",
        "formatted",
        F.transform(
            F.slice(pieces, F.lit(1), F.size(pieces) - 1),
            lambda p: F.struct(
                unescape_role(F.substring_index(F.substr(p, F.lit(len("<turn ") + 1)), ">\n", 1)).alias("role"),
                unescape(F.substr(p, F.instr(p, ">\n") + 2)).alias("text"),
            ),
        ).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int")))).alias("loss"),
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.sql(r"""SELECT -7L AS conv_id, CAST(turn AS BIGINT) AS turn, role, r'\### Assistant: </turn> ok' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(turn, role)""")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    back = read_chats(format_chats(turns.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))))
    loss = F.array_join("loss", "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH t AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
 UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
l AS (
 SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS under,
  length(text) + 2 * length(role) - length(role) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '<', ''))) + 16 AS chars
 FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(sum(length(under)) AS BIGINT) AS loss_chars, sha256(string_agg(under, '' ORDER BY turn, role, text)) AS loss_sha256,
 CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id
"""
