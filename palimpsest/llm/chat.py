"""Chat formatting with DataFrame functions only: a finite-state machine, a template, a loss mask.

A template is data: the control strings that open a turn, part role from text
and close it, the roles whose text is trained on, and the machine's moves.
Control strings inside a text or role are escaped by a backslash after their
first character; strings that look escaped already get one more, so that taking
one away again gives back the text, whatever it is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What a formatted conversation looks like and which turn orders are valid."""

    begin: str = "<s>"
    open: str = "[INST]"
    part: str = "<|sep|>"
    close: str = "[/INST]"
    end: str = "</s>"
    #: Roles whose text counts for the loss.
    trained: tuple[str, ...] = ("assistant",)
    #: Moves of the machine: state -> role -> next state.  The start state is "start".
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    #: States in which a conversation may stop.
    final: tuple[str, ...] = ("answered",)

    @property
    def controls(self) -> list[str]:
        return [self.begin, self.open, self.part, self.close, self.end]


def escape(text: Column, template: Template) -> Column:
    """``text`` with a backslash put into every control string, escaped or not."""
    for c in template.controls:
        text = F.regexp_replace(text, F.lit(f"{re.escape(c[0])}(\\\\*){re.escape(c[1:])}"), F.lit(f"{_literal(c[0])}\\\\$1{_literal(c[1:])}"))
    return text


def unescape(text: Column, template: Template) -> Column:
    """The text that ``escape`` was given."""
    for c in reversed(template.controls):
        text = F.regexp_replace(text, F.lit(f"{re.escape(c[0])}\\\\(\\\\*){re.escape(c[1:])}"), F.lit(f"{_literal(c[0])}$1{_literal(c[1:])}"))
    return text


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def _walk(roles: Column, template: Template) -> Column:
    """Where the machine is after all turns (empty once one is out of order), and how many it took: one step a turn."""
    moves = [F.lit(x) for s, row in template.moves.items() for r, t in row.items() for x in (f"{s}>{r}", t)]
    table = F.create_map(*moves)

    def step(at: Column, role: Column) -> Column:
        to = F.coalesce(F.try_element_at(table, F.concat(at["state"], F.lit(">"), role)), F.lit(""))
        return F.struct(to.alias("state"), (at["good"] + F.when(to != "", 1).otherwise(0)).alias("good"))

    return F.aggregate(roles, F.struct(F.lit("start").alias("state"), F.lit(0).alias("good")), step)


def format_chats(turns: DataFrame, template: Template = Template(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``id``, ``n_turns``, ``valid``, ``first_bad`` and ``segments``.

    ``segments`` are (``text``, ``loss``) in order; together they are the
    formatted conversation.  Turns go by their number, null first; equal numbers
    by role and text, and repeated rows stay.  A null text or role is an empty
    one.  Every conversation is formatted; ``valid`` says whether the machine
    takes its turns and may stop where it ends, ``first_bad`` which turn (from 0)
    it refuses.  Rows without an id make up one conversation, whose id is null.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = turns.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    roles = F.transform("turns", lambda t: t["role"])
    mark = lambda text: F.struct(F.lit(text).alias("text"), F.lit(False).alias("loss"))

    def of_turn(t: Column) -> Column:
        head = F.concat(F.lit(template.open), escape(t["role"], template), F.lit(template.part))
        body = F.struct(escape(t["text"], template).alias("text"), t["role"].isin(*template.trained).alias("loss"))
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")), body, mark(template.close))

    segments = F.concat(F.array(mark(template.begin)), F.flatten(F.transform("turns", of_turn)), F.array(mark(template.end)))
    out = grouped.select("id", F.size("turns").cast("long").alias("n_turns"), _walk(roles, template).alias("at"), segments.alias("segments")).select("id", "n_turns", "at.state", "at.good", "segments")
    return out.select("id", "n_turns", F.coalesce(F.col("state").isin(*template.final), F.lit(False)).alias("valid"), F.when(F.col("good") < F.col("n_turns"), F.col("good")).alias("first_bad"), "segments")


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns (``role``, ``text``) of a formatted conversation."""
    inner = F.substring(formatted, F.lit(len(template.begin) + 1), F.length(formatted) - F.lit(len(template.begin) + len(template.end)))
    pieces = F.split(inner, re.escape(template.close) + "(?=" + re.escape(template.open) + "|$)")

    def turn(piece: Column) -> Column:
        sep = F.instr(piece, template.part)
        role = F.substring(piece, F.lit(len(template.open) + 1), sep - F.lit(len(template.open) + 1))
        text = F.substring(piece, sep + F.lit(len(template.part)), F.length(piece))
        return F.struct(unescape(role, template).alias("role"), unescape(text, template).alias("text"))

    return F.transform(F.filter(pieces, lambda p: p != ""), turn)


def op1(spark, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from the formatted text and the loss mask."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text")
    template = Template()
    out = format_chats(turns.unionByName(tricky), template)
    formatted = F.concat_ws("", F.transform("segments", lambda s: s["text"]))
    loss = F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)))
    out = out.select("id", "valid", formatted.alias("formatted"), loss.alias("loss"))
    out = out.withColumn("turns", read_back(F.col("formatted"), template))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select(
        F.col("id").cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


#: The turns as they are read, and the lengths that the template gives them.
OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    len(regexp_extract_all(text, '<\\*s>|\[\\*INST\]|<\\*\|sep\|>|\[\\*/INST\]|<\\*/s>')) + len(regexp_extract_all(role, '<\\*s>|\[\\*INST\]|<\\*\|sep\|>|\[\\*/INST\]|<\\*/s>')) AS marks
  FROM c
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(7 + sum(length(role) + length(text) + marks + 6 + 7 + 7) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN i = 1 THEN role IN ('system', 'user') WHEN role = 'user' THEN before IN ('system', 'assistant')
    WHEN role = 'assistant' THEN before = 'user' ELSE false END) AND arg_max(role, i) = 'assistant' AS valid
FROM t GROUP BY conv_id
"""
