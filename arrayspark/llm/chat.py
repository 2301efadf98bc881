"""Chat formatting by perspective rotation: a dialogue is rendered once for each of its participants.

From one participant's perspective, that speaker's turns are the assistant's and all others are named
users; system turns stay system turns. The loss mask covers what the assistant says, its end mark
included. Only DataFrame functions are used.

Defined results: the participants are the speakers other than ``system``, null being named ``unknown``;
null texts are empty turns; rows that repeat in all their columns are one turn; turns that tie are
ordered by speaker, then text, and null turns come first; null is a conversation of its own; marks
inside a text are broken up, so a text can't forge a turn; turns without a number are a part of their
own, whose number is null; a very long text is one row's; a conversation without participants gives no
rows, nor does an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _header(speaker: Column, perspective: Column) -> Column:
    return (
        F.when(speaker == perspective, F.lit("<|assistant|>\n"))
        .when(speaker == "system", F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), speaker, F.lit("|>\n")))
    )


def rotate(turns: DataFrame, part_turns: int = 64) -> DataFrame:
    """(conv_id, perspective, part, n_turns, text, mask) of ``turns`` (conv_id, turn, role, text).

    A dialogue is rendered in parts of ``part_turns`` turn numbers, which follow one another: a very long
    one is many rows and never one task's. ``mask`` runs along ``text``: value*length, comma-joined,
    lengths in code points, 1 where the assistant speaks.
    """
    speaker = F.coalesce(F.translate(F.col("role"), "|\n", "/ "), F.lit("unknown"))
    said = turns.select("conv_id", F.expr(f"(turn - pmod(turn, {part_turns})) div {part_turns}").alias("part"), F.struct("turn", speaker.alias("speaker"), _safe(F.coalesce("text", F.lit(""))).alias("content")).alias("t"))
    parts = said.groupBy("conv_id", "part").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    names = turns.select(F.col("conv_id").alias("_c"), speaker.alias("perspective")).where("perspective <> 'system'").distinct()
    both = parts.join(names, F.col("conv_id").eqNullSafe(F.col("_c")))
    p = F.col("perspective")
    body = lambda t: F.concat(t.content, F.lit(END))
    text = F.array_join(F.transform("ts", lambda t: F.concat(_header(t.speaker, p), body(t))), "")
    runs = F.transform("ts", lambda t: F.concat(F.lit("0*"), F.length(_header(t.speaker, p)).cast("string"), F.when(t.speaker == p, F.lit(",1*")).otherwise(F.lit(",0*")), F.length(body(t)).cast("string")))
    return both.select("conv_id", "perspective", "part", F.size("ts").cast("long").alias("n_turns"), text.alias("text"), F.array_join(runs, ",").alias("mask"))


SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, (turn - (turn % 64 + 64) % 64) // 64 AS part,
    coalesce(replace(replace(role, '|', '/'), chr(10), ' '), 'unknown') AS speaker,
    replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM conversations
), p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
x AS (
  SELECT t.conv_id, perspective, part, turn, speaker, body,
    CASE WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>' ELSE '<|user name=' || speaker || '|>' END || chr(10) AS header,
    CASE WHEN speaker = perspective THEN ',1*' ELSE ',0*' END AS value
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
)
SELECT conv_id, perspective, part, count(*) AS n_turns,
  string_agg(header || body, '' ORDER BY turn NULLS FIRST, speaker, body) AS text,
  string_agg('0*' || length(header) || value || length(body), ',' ORDER BY turn NULLS FIRST, speaker, body) AS mask
FROM x GROUP BY conv_id, perspective, part
"""
