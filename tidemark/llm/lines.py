"""Line-first cleaning: judge every line, drop the failing ones, then reject documents that lost too much.

A line with at least one word fails when any of these holds:

* boilerplate - it contains one of ``BOILERPLATE`` (ASCII case ignored);
* navigation - it has ``nav_separators`` or more of ``|``, and at least one for every ``nav_words`` words;
  or it has fewer than ``short_words`` words and does not end in sentence punctuation;
* punctuation - it has no letter, or more than ``symbols_pct`` symbols or ``shouts_pct`` exclamation
  marks per hundred words.

Lines without a word are neither judged nor counted. A document is rejected by the method when its failed
lines hold more than ``lost_pct`` per cent of its word characters.

Defined results: a null or empty text has no words, fails the base rules (fewer than ``min_words``) and is
rejected; repeated rows are judged alike; an empty table gives an empty table; only the id and text columns
are read, so other columns may have any name. Work is per row: there is no shuffle, and memory is bounded by
one Arrow batch.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import slices, values

# Phrases that mark a line as boilerplate.
BOILERPLATE = (
    "all rights reserved",
    "licensed under the",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "subscribe to our",
    "click here",
    "enable javascript",
    "lorem ipsum",
    "powered by",
    "copyright (c)",
)
SYMBOLS = "#*$%&|<>"
SPACES = "\x20\t\n\x0b\x0c\r"
# What ends a sentence, in Latin and in East Asian punctuation.
SENTENCE_END = ".!?:;\"')" + "\u2019\u201d\u00bb\u2026\u3002\uff01\uff1f\uff1a\uff1b\u300d\u300f\uff09"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    repeat_pct: int = 50
    nav_separators: int = 3
    nav_words: int = 4
    short_words: int = 5
    symbols_pct: int = 50
    shouts_pct: int = 50
    lost_pct: int = 40


_boilerplate = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE | re.ASCII)
_letter = re.compile(r"[^\W\d_]")


def line_fails(line: str, n_words: int, rules: Rules) -> bool:
    bars = line.count("|")
    if bars >= rules.nav_separators and bars * rules.nav_words >= n_words:
        return True
    if n_words < rules.short_words and line.rstrip(SPACES)[-1] not in SENTENCE_END:
        return True
    if 100 * sum(map(line.count, SYMBOLS)) > rules.symbols_pct * n_words:
        return True
    if 100 * line.count("!") > rules.shouts_pct * n_words:
        return True
    return not _letter.search(line) or bool(_boilerplate.search(line))


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three that occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often, covered, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def analyse(text: str | None, rules: Rules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text)."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    repeat = repeated_words(words)
    seen, dup, lost, good = set(), 0, 0, []
    for line in text.split("\n"):
        n_line = len(line.encode().split())
        if n_line:
            dup += line in seen
            seen.add(line)
            if line_fails(line, n_line, rules):
                lost += len(line) - sum(map(line.count, SPACES))
                continue
        good.append(line)
    base = n < rules.min_words or 100 * repeat > rules.repeat_pct * n
    kept = not base and 100 * lost <= rules.lost_pct * chars
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeat, base, kept, "\n".join(good)


VERDICT = [
    ("n_words", T.LongType()),
    ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()),
    ("base_failed", T.BooleanType()),
    ("kept", T.BooleanType()),
    ("cleaned", T.StringType()),
]


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """One row per document: its id, the counts, both verdicts and (with_text) the text without failed lines."""
    fields = VERDICT if with_text else VERDICT[:-1]
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([read.schema["doc_id"], *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"n_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "cleaned": pa.string()}
        for b in slices(batches):
            rows = [analyse(t, rules) for t in values(b.column(1))]
            cols = [pa.array((r[i] for r in rows), kinds.get(n, pa.int64())) for i, (n, _) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *(n for n, _ in fields)])

    ship(docs.sparkSession)
    return read.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, without their failed lines; same columns, chars_col counted anew if there."""
    schema = docs.schema
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [analyse(t, rules) for t in values(b.column(at))]
            keep = pa.array([r[6] for r in rows], pa.bool_())
            cols = list(b.columns)
            cols[at] = pa.array([r[7] for r in rows], pa.string())
            if chars_col in names:
                k = names.index(chars_col)
                cols[k] = pa.array([len(r[7]) for r in rows]).cast(b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, names).filter(keep)

    ship(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def oracle_sql(rules: Rules = Rules()) -> str:
    """The same rules as DuckDB SQL over ``documents``."""
    word = r"[^\x20\x09-\x0D]+"
    phrases = " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)
    ends = "".join(c.replace("'", "''").replace(")", r"\)").replace(".", r"\.").replace("?", r"\?") for c in SENTENCE_END)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d)),
counted AS (
  SELECT *, len(regexp_extract_all(line, '{word}')) AS n, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars,
         row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth,
         length(regexp_replace(line, '[^|]', '', 'g')) AS bars, length(regexp_replace(line, '[^!]', '', 'g')) AS shouts,
         length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS syms
  FROM lines),
judged AS (
  SELECT doc_id, n, chars, nth,
         (bars >= {rules.nav_separators} AND bars * {rules.nav_words} >= n)
         OR (n < {rules.short_words} AND NOT regexp_matches(line, '[{ends}][\\x20\\x09-\\x0D]*$'))
         OR 100 * syms > {rules.symbols_pct} * n OR 100 * shouts > {rules.shouts_pct} * n
         OR NOT regexp_matches(line, '\\pL') OR {phrases} AS fails
  FROM counted WHERE n > 0),
per_doc AS (SELECT doc_id, count(*) FILTER (nth > 1) AS dup, coalesce(sum(chars) FILTER (fails), 0) AS lost FROM judged GROUP BY doc_id),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
tri AS (
  SELECT doc_id, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS times FROM tri WHERE w3 IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT p) AS rep FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM often WHERE times > 1) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
         coalesce(rep, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN per_doc USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.repeat_pct} * n_words AS base_failed,
       NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.repeat_pct} * n_words)
       AND 100 * lost <= {rules.lost_pct} * word_chars AS kept
FROM base"""
