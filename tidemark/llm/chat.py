"""Preference formatting: one prompt and two masked completions for each pair of conversations.

The turns of the chosen and the rejected conversation of a pair are put in order and compared from the start;
the longest common prefix of turns (equal role and text) is rendered once, as the prompt. What follows on either side is its
completion. A completion's mask is a run-length list of (characters, trained on): the header of every turn is masked
out, the text and end mark of a turn are trained on where its role is ``trained``.

Everything is built from DataFrame functions: one aggregation by pair, then expressions over its two arrays of
turns. A pair is one row of the result, so its turns have to meet; nothing else is gathered.

Defined results: turns are in order of (turn, role, text), nulls first; repeated rows are turns of their own; a
null role is rendered as ``unknown`` and a null text as empty (a null equals only a null); turns of a null pair or
a null side are left out; a pair with one side only has an empty prompt and an empty completion on the other side and is not
``paired``; an empty table gives no rows; only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    before_role: str = "<|"
    after_role: str = "|>\n"
    end: str = "<|end|>\n"
    trained: str = "assistant"


def _header(turn: Column, t: Template) -> Column:
    return F.concat(F.lit(t.before_role), F.coalesce(turn["role"], F.lit("unknown")), F.lit(t.after_role))


def _body(turn: Column, t: Template) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(t.end))


def _rendered(turns: Column, t: Template) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(_header(x, t), _body(x, t))), "")


def _mask(turns: Column, t: Template) -> Column:
    def runs(x: Column) -> Column:
        on = x["role"].eqNullSafe(F.lit(t.trained))
        return F.array(
            F.struct(F.char_length(_header(x, t)).cast("long").alias("chars"), F.lit(False).alias("trained")),
            F.struct(F.char_length(_body(x, t)).cast("long").alias("chars"), on.alias("trained")),
        )

    return F.flatten(F.transform(turns, runs))


def preference_pairs(turns: DataFrame, pair: Column, rejected: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = Template()) -> DataFrame:
    """One row per pair: pair_id, paired, n_prompt_turns, prompt, and text and mask of both completions.

    ``pair`` says which pair a turn belongs to, ``rejected`` on which side it stands."""
    one = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = turns.select(pair.alias("pair_id"), rejected.alias("rejected"), one.alias("one")).where("pair_id IS NOT NULL AND rejected IS NOT NULL")
    sides = rows.groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.when(~F.col("rejected"), F.col("one")))).alias("a"),
        F.sort_array(F.collect_list(F.when(F.col("rejected"), F.col("one")))).alias("b"),
    )
    least = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(F.slice("a", 1, least), F.slice("b", 1, least), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    differs = F.array_position(same, False)
    sides = sides.select("pair_id", "a", "b", F.when(differs > 0, differs - 1).otherwise(least.cast("long")).alias("n"))
    start = (F.col("n") + 1).cast("int")
    rest = [F.slice(side, start, F.greatest(F.size(side), F.lit(1))) for side in ("a", "b")]
    return sides.select(
        "pair_id",
        ((F.size("a") > 0) & (F.size("b") > 0)).alias("paired"),
        F.col("n").alias("n_prompt_turns"),
        _rendered(F.slice("a", 1, F.col("n").cast("int")), template).alias("prompt"),
        _rendered(rest[0], template).alias("chosen"),
        _rendered(rest[1], template).alias("rejected"),
        _mask(rest[0], template).alias("chosen_mask"),
        _mask(rest[1], template).alias("rejected_mask"),
    )


def mask_text(mask: Column) -> Column:
    """A mask as text: ``chars:1`` for runs that are trained on, ``chars:0`` for others."""
    return F.array_join(F.transform(mask, lambda x: F.concat(x["chars"].cast("string"), F.lit(":"), x["trained"].cast("int").cast("string"))), " ")


def neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs of an even conversation (chosen) and the odd one after it (rejected), with masks as text."""
    out = preference_pairs(conversations, F.shiftright("conv_id", 1), F.pmod("conv_id", F.lit(2)) == 1)
    return out.withColumns({c: mask_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


_render = "array_to_string(list_transform({0}, lambda x: '<|' || coalesce(x.role, 'unknown') || '|>' || chr(10) || coalesce(x.text, '') || '<|end|>' || chr(10)), '')"
_runs = (
    "array_to_string(list_transform({0}, lambda x: length('<|' || coalesce(x.role, 'unknown') || '|>' || chr(10)) || ':0 ' || "
    "length(coalesce(x.text, '') || '<|end|>' || chr(10)) || CASE WHEN coalesce(x.role, '') = 'assistant' THEN ':1' ELSE ':0' END), ' ')"
)
ORACLE = f"""
WITH t AS (SELECT conv_id >> 1 AS pair_id, conv_id % 2 AS side, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT pair_id,
        coalesce(list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (side = 0), []) AS a,
        coalesce(list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (side = 1), []) AS b
      FROM t GROUP BY pair_id),
p AS (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[:i] = b[:i])) AS n FROM c),
r AS (SELECT pair_id, n, a, b, a[1:n] AS common, a[n + 1:] AS ca, b[n + 1:] AS cb FROM p)
SELECT pair_id, len(a) > 0 AND len(b) > 0 AS paired, CAST(n AS BIGINT) AS n_prompt_turns, {_render.format("common")} AS prompt,
       {_render.format("ca")} AS chosen, {_render.format("cb")} AS rejected, {_runs.format("ca")} AS chosen_mask, {_runs.format("cb")} AS rejected_mask
FROM r"""
