r"""Chat formatting with relational operations only.

The turns of a conversation are collected as structs and sorted; adjacent
turns of one role share a block; the pieces are joined into one string:

    <|role|>ROLE<|text|>TEXT<|and|>TEXT<|end|>\n   ... one such block per run of a role

Inside roles and texts ``\`` becomes ``\\`` and ``<|`` becomes ``<\|``, so a
mark never occurs in a text and the escape can be undone.  The loss mask is a
list of spans (code points, end exclusive) that covers the assistant's texts
and nothing between them.

Defined results: a null text or role is empty; a null conversation id is a
conversation of its own; turns are sorted by turn (null first), then role,
then text, so repeated rows are repeated turns; an empty table gives an empty
table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

ROLE, TEXT, AND, END = "<|role|>", "<|text|>", "<|and|>", "<|end|>\n"
TRAINED = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_chat(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = TRAINED) -> DataFrame:
    """Per conversation: conv_id, ``formatted`` and ``loss_spans``."""
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    talks = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        first = ~F.coalesce(F.get("turns", i - 1)["role"] == t["role"], F.lit(False))
        final = ~F.coalesce(F.get("turns", i + 1)["role"] == t["role"], F.lit(False))
        return F.struct(
            F.when(first, F.concat(F.lit(ROLE), escape(t["role"]), F.lit(TEXT))).otherwise(F.lit(AND)).alias("before"),
            escape(t["text"]).alias("text"),
            F.when(final, F.lit(END)).otherwise(F.lit("")).alias("after"),
            (t["role"] == trained).alias("trained"),
        )

    merged = talks.select("conv_id", F.transform("turns", piece).alias("pieces"))
    # Running lengths: the spans of trained texts, as the pieces follow each other.
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["before"]) + F.length(p["text"]) + F.length(p["after"])).alias("at"),
            F.when(
                p["trained"],
                F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["before"])).alias("start"), (a["at"] + F.length(p["before"]) + F.length(p["text"])).alias("end")))),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return merged.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        head = F.split(F.substr(block, F.lit(len(ROLE) + 1)), r"<\|text\|>", -1)
        role = unescape(F.get(head, F.lit(0)))
        return F.transform(F.split(F.get(head, F.lit(1)), r"<\|and\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text")
    )
    out = format_chat(rows.unionByName(extra))
    back = out.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM c),
p AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS first, lead(role) OVER w IS DISTINCT FROM role AS final,
    length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS r, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS t
  FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY n))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{TRAINED}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = '{TRAINED}'), '')) AS loss_sha256,
  sum(t + CASE WHEN first THEN r + {len(ROLE) + len(TEXT)} ELSE {len(AND)} END + CASE WHEN final THEN {len(END)} ELSE 0 END)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
