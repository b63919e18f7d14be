"""Chat formatting with a grammar round trip: what is rendered is parsed again and must give the same turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spans import matches
from .common import table

#: What no text may hold unescaped: the marks of this template and of common others. A backslash after the
#: first character takes a mark's meaning; texts that hold such an escape get one backslash more.
CONTROL = r"[<\[](?:\||/?s>|/?INST\])"
ESCAPABLE = r"([<\[])(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"
END = "<|end|>\n"
#: Roles are percent-encoded where they could close their own mark.
ROLE_MARKS = (("%", "%25"), ("|", "%7C"), ("<", "%3C"), (">", "%3E"), ("[", "%5B"), ("\n", "%0A"))


def _role(role: Column) -> Column:
    for mark, code in ROLE_MARKS:
        role = F.replace(role, F.lit(mark), F.lit(code))
    return role


def _role_back(role: Column) -> Column:
    for mark, code in reversed(ROLE_MARKS):
        role = F.replace(role, F.lit(code), F.lit(mark))
    return role


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPABLE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def render_turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit("<|"), _role(role), F.lit("|>\n"), body, F.lit(END))


def parse_turn(piece: Column) -> Column:
    """struct(role, text) of a rendered turn without its end mark; null if it breaks the grammar."""
    body = F.regexp_extract(piece, r"(?s)^<\|[^|<>\[\n]*\|>\n(.*)\z", 1)
    good = piece.rlike(r"(?s)^<\|[^|<>\[\n]*\|>\n") & ~body.rlike(CONTROL)
    return F.when(good, F.struct(_role_back(F.regexp_extract(piece, r"^<\|([^|<>\[\n]*)\|>\n", 1)).alias("role"), unescape(body).alias("text")))


def render(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """Per turn: its rendered form, plain where the parser gives the source back, else escaped; digest of its source.

    Null roles and texts are empty. Escaping is one step away from identity for any text: each mark in it gets a
    backslash that the parser takes off again, so no third rendering is needed; `escaped` tells which one was taken.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    source = F.struct(role.alias("role"), text.alias("text"))
    plain = parse_turn(F.concat(F.lit("<|"), _role(role), F.lit("|>\n"), text)).eqNullSafe(source)
    return turns.select(conv, order, plain.alias("plain"), source.alias("source")).select(
        conv, order, render_turn(F.col("source.role"), F.when(F.col("plain"), F.col("source.text")).otherwise(escape(F.col("source.text")))).alias("rendered"), (~F.col("plain")).alias("escaped"), _digest(F.col("source")).alias("digest")
    )


def _digest(turn: Column) -> Column:
    return F.md5(F.concat(turn["role"], F.lit("\n"), turn["text"]).cast("binary"))


def loss_mask(formatted: Column, role: str = "assistant") -> Column:
    """array<struct<start, end, said>> of the texts of a role in a formatted conversation, in its code points; said is the text unescaped.

    Only marks of turns are unescaped there, so a turn of the role begins where its mark is and ends at the next end.
    """
    head = f"<|{role}|>\n"
    turns = matches(formatted, rf"(?s)<\|{role}\|>\n.*?<\|end\|>\n")
    size = lambda t: F.length(t["span"]) - len(head) - len(END)
    body = lambda t: (t["start"] + len(head)).alias("start")
    return F.transform(turns, lambda t: F.struct(body(t), (t["end"] - len(END)).alias("end"), unescape(F.substring(t["span"], F.lit(len(head) + 1), size(t))).alias("said")))


def format_conversations(turns: DataFrame, conv: str = "conv_id", order: str = "turn", loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, turns (array of role and text, parsed from formatted), loss_mask (of loss_mask) of each conversation.

    The turns that the parser recovers from the whole conversation are held against the source by digest; a
    difference is an error, never a row. Turns go by `order`, nulls first; ties and repeated rows by their
    rendered form, each kept. Rows with a null conversation form one of their own. A conversation is one row of
    the result, so its turns meet in one task; only rendered text and digests are shuffled for that.
    """
    whole = (
        render(turns, conv, order)
        .groupBy(conv)
        .agg(F.sort_array(F.collect_list(F.struct(order, "rendered", "digest"))).alias("all"))
        .select(conv, F.array_join(F.transform("all", lambda t: t["rendered"]), "").alias("formatted"), F.transform("all", lambda t: t["digest"]).alias("digests"))
    )
    parsed = F.transform(F.split(F.regexp_replace("formatted", r"<\|end\|>\n\z", ""), r"<\|end\|>\n"), parse_turn)
    whole = whole.select(conv, "formatted", "digests", parsed.alias("turns"))
    same = F.coalesce(F.transform("turns", _digest) == F.col("digests"), F.lit(False))
    told = F.when(same, F.col("turns")).otherwise(F.raise_error(F.lit("a conversation doesn't parse back to its turns")))
    return whole.select(conv, "formatted", told.alias("turns"), loss_mask(F.col("formatted"), loss_role).alias("loss_mask"))


def op9_grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """format_conversations over all conversations and a planted one: digests of what is read back and of the text under the loss mask."""
    planted = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    told = format_conversations(turns)
    loss = F.array_join(F.transform("loss_mask", lambda m: m["said"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss.alias("loss"), "formatted").select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (
  SELECT *, '<|' || replace(replace(replace(replace(replace(replace(role, '%', '%25'), '|', '%7C'), '<', '%3C'), '>', '%3E'), '[', '%5B'), chr(10), '%0A')
    || '|>' || chr(10) || regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') || '<|end|>' || chr(10) AS rendered
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, rendered)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, rendered) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(rendered)) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
