"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Rules are Boolean SQL expressions over measures of one text. Each rule's cost (seconds) and selectivity
(share rejected) are estimated on a bounded sample; the cascade runs rules by rejection per cost, and a
text that one rule rejects is not measured for the later ones. The order decides what is computed and
which rule is named, never which texts are kept; as seconds vary, so may the name from run to run.

Measures that a caller asks for are made for every row; rules that read only these cost next to nothing and come
first. Of the rest (words with letters, the share of the most frequent word and word pair, capitals, bullet and
ellipsis lines) each is made only for texts that are still in.

Everything is computed inside a row, so a common word, line or source moves nothing. Words repeated in
3-word windows are counted by sorting a text's (window hash, position) pairs, in n log n steps for any
length. Null text has no words. Every input row keeps one output row, also repeated or null doc_ids; an empty table
gives none. Only doc_id and text are read; other columns, whatever their names, do not travel.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

SAMPLE_ROWS = 1000
SYMBOLS = "[#*$%&|<>]"
_SPACES = "[\\x20\\x09-\\x0D]+"
_WORD_CHAR = "[^\\x20\\x09-\\x0D]"


@dataclass(frozen=True)
class Rule:
    """A text is rejected where `rejects` is true; `needs` are the measures that it reads."""

    name: str
    rejects: str
    needs: tuple[str, ...]


BASE = (
    Rule("few_words", "n_words < 50", ("n_words",)),
    Rule("repeats", "100 * n_repeat_words > 50 * n_words", ("n_words", "n_repeat_words")),
)
RULES = (
    *BASE,
    Rule("symbols", "10 * n_symbols > 3 * n_words", ("n_words", "n_symbols")),
    Rule("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines", ("n_lines", "n_dup_lines")),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words", ("n_words", "word_chars")),
    Rule("few_letters", "5 * n_letter_words < 4 * n_words", ("n_words", "n_letter_words")),
    Rule("top_word", "5 * top_word > n_words", ("n_words", "top_word")),
    Rule("top_pair", "10 * top_pair > n_words", ("n_words", "top_pair")),
    Rule("capitals", "2 * n_capitals > n_letters", ("n_capitals", "n_letters")),
    Rule("bullets", "n_lines >= 4 AND 10 * n_bullets > 9 * n_lines", ("n_lines", "n_bullets")),
    Rule("ellipsis", "n_lines >= 4 AND 10 * n_ellipsis > 3 * n_lines", ("n_lines", "n_ellipsis")),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACES), lambda w: w != "")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A letter: of ASCII, or anything beyond it.
_LETTER = "[A-Za-z\\x{80}-\\x{10FFFF}]"
_LINES = ("lines", f"filter(split(t, '\n'), x -> rlike(x, '{_WORD_CHAR}'))".replace("\\", "\\\\"))


def _most(sorted_hashes: str) -> str:
    """How often the most frequent value of a sorted array of longs occurs."""
    run = "if(a.r > 0 AND a.h = x, a.r + 1, 1)"
    return f"aggregate({sorted_hashes}, named_struct('h', 0L, 'r', 0, 'm', 0), (a, x) -> named_struct('h', x, 'r', {run}, 'm', greatest(a.m, {run})), a -> CAST(a.m AS bigint))"


#: Steps by which a measure is made, each a column of its own so that none is computed twice: measure ->
#: ((column, columns it needs, expression), ...).
_STEPS: dict[str, tuple[tuple[str, str], ...]] = {
    "n_words": (("w", ""), ("n_words", "CAST(size(w) AS bigint)")),
    "word_chars": (("w", ""), ("word_chars", "CAST(length(array_join(w, '')) AS bigint)")),
    "n_symbols": (("n_symbols", f"CAST(regexp_count(t, '{SYMBOLS}') AS bigint)"),),
    "n_lines": (_LINES, ("n_lines", "CAST(size(lines) AS bigint)")),
    "n_dup_lines": (_LINES, ("n_dup_lines", "CAST(size(lines) - size(array_distinct(lines)) AS bigint)")),
    "n_bullets": (_LINES, ("n_bullets", "CAST(size(filter(lines, x -> rlike(x, '^[ \\\\t]*[-*•]'))) AS bigint)")),
    "n_ellipsis": (_LINES, ("n_ellipsis", "CAST(size(filter(lines, x -> rlike(x, '([.][.][.]|…)[ \\\\t\\\\r]*$'))) AS bigint)")),
    "n_letter_words": (("w", ""), ("n_letter_words", f"CAST(size(filter(w, x -> rlike(x, '{_LETTER}'))) AS bigint)".replace("\\", "\\\\"))),
    "top_word": (("w", ""), ("top_word", _most("sort_array(transform(w, x -> xxhash64(x)))"))),
    "top_pair": (
        ("w", ""),
        ("w2", "zip_with(w, slice(w, 2, greatest(size(w) - 1, 0)), (a, b) -> xxhash64(a, b))"),
        ("top_pair", _most("sort_array(slice(w2, 1, greatest(size(w2) - 1, 0)))")),
    ),
    "n_capitals": (("n_capitals", f"CAST(length(t) - length(translate(t, '{_UPPER}', '')) AS bigint)"),),
    "n_letters": (("n_letters", f"CAST(length(t) - length(translate(t, '{_UPPER}{_UPPER.lower()}', '')) AS bigint)"),),
    "n_repeat_words": (
        ("w", ""),
        ("w2", "zip_with(w, slice(w, 2, greatest(size(w) - 1, 0)), (a, b) -> xxhash64(a, b))"),
        ("w3", "slice(zip_with(w2, slice(w, 3, greatest(size(w) - 2, 0)), (a, b) -> xxhash64(a, b)), 1, greatest(size(w) - 2, 0))"),
        ("s", "sort_array(transform(w3, (h, i) -> struct(h AS h, i AS p)))"),
        ("q", "zip_with(s, slice(s, 2, greatest(size(s) - 1, 0)), (a, b) -> struct(a.p AS p, coalesce(a.h = b.h, false) AS e))"),
        ("r", "zip_with(q, concat(array(false), slice(q.e, 1, greatest(size(q) - 1, 0))), (a, e) -> CASE WHEN a.e OR e THEN a.p END)"),
        ("at", "sort_array(filter(r, p -> p IS NOT NULL))"),
        ("n_repeat_words", "aggregate(zip_with(at, slice(at, 2, greatest(size(at) - 1, 0)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (n, x) -> n + x)"),
    ),
}


def measured(docs: DataFrame, names: tuple[str, ...], have: tuple[str, ...] = (), alive: Column | None = None) -> tuple[DataFrame, tuple[str, ...]]:
    """docs (with the text as column t) with measures; where alive is false they are null and cost nothing."""
    for name in names:
        for column, sql in _STEPS[name]:
            if column in have:
                continue
            made = _words(F.col("t")) if column == "w" else F.expr(sql)
            docs = docs.withColumn(column, made if alive is None else F.when(alive, made))
            have = (*have, column)
    return docs, have


def estimate(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS) -> list[tuple[float, float]]:
    """(seconds, share rejected) of each rule alone, on the sample_rows documents of least hash."""
    n = docs.count()
    if not n:
        return [(1.0, 0.0)] * len(rules)
    share = min(1.0, (2.0 * sample_rows + 100) / n)
    bound = min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)))
    order = F.xxhash64("doc_id", F.lit(11))
    few = docs.select("t", order.alias("h")).where(F.col("h") <= bound).orderBy("h", F.xxhash64("t")).limit(sample_rows).select("t")
    few = written(few, "quality-sample")

    def timed(found: DataFrame) -> tuple[float, int]:
        began = time.perf_counter()
        rejected = found.agg(F.count(F.when(F.col("no"), 1)), F.count("*"), F.sum(F.length("t"))).first()
        return time.perf_counter() - began, rejected[0] / max(1, rejected[1])

    idle = few.withColumn("no", F.lit(False))
    timed(idle)
    base, out = timed(idle)[0], []
    for rule in rules:
        made, _ = measured(few, rule.needs)
        made = made.withColumn("no", F.expr(rule.rejects))
        seconds, rejected = timed(made)
        out.append((max(1e-4, seconds - base), rejected))
    return out


def ordered(rules: tuple[Rule, ...], estimates: list[tuple[float, float]]) -> tuple[Rule, ...]:
    """By rejection per cost, best first; ties as given."""
    rank = sorted(range(len(rules)), key=lambda i: -estimates[i][1] / estimates[i][0])
    return tuple(rules[i] for i in rank)


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, have: tuple[str, ...] = ()) -> DataFrame:
    """docs with failed_rule, the first rule in the order given that rejects, or null.

    Measures that docs has already (`have`) are used as they are; others are made only for texts that no
    earlier rule has rejected.
    """
    docs = docs.withColumn("failed_rule", F.lit(None).cast("string"))
    for rule in rules:
        alive = F.col("failed_rule").isNull()
        docs, have = measured(docs, rule.needs, have, alive)
        failed = F.when(~alive, F.col("failed_rule")).when(F.expr(rule.rejects), F.lit(rule.name))
        # a generator of one row: filters on the result are not pushed through it, which would copy the whole chain into each of its uses
        docs = docs.select("*", F.inline(F.array(F.struct(failed.alias("_failed"))))).drop("failed_rule").withColumnRenamed("_failed", "failed_rule")
    return docs


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, measures: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, measures asked for, failed_rule, kept) by the cascade in its estimated order."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    order = ordered(rules, estimate(rows, rules))
    rows, have = measured(rows, measures)
    found = cascade(rows, order, have)
    return found.select("doc_id", *measures, "failed_rule", F.col("failed_rule").isNull().alias("kept"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = quality(table(spark, sf_dir, "documents"), RULES, base)
    failed = " OR ".join(f"({r.rejects})" for r in BASE)
    return found.select("doc_id", *base, F.expr(failed).alias("base_failed"), "kept")


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
win AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY k),
words AS (SELECT k, max(c) AS top_word FROM (SELECT k, x, count(*) AS c FROM (SELECT k, unnest(w) AS x FROM d) GROUP BY k, x) GROUP BY k),
two AS (SELECT k, max(c) AS top_pair FROM (SELECT k, x, count(*) AS c FROM (SELECT k, w[i] || ' ' || w[i + 1] AS x FROM (SELECT k, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) >= 2)) GROUP BY k, x) GROUP BY k),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(w, lambda x: regexp_matches(x, '{_LETTER}'))) AS n_letter_words, coalesce(top_word, 0) AS top_word, coalesce(top_pair, 0) AS top_pair,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[ \\t]*[-*•]'))) AS n_bullets, len(list_filter(lines, lambda x: regexp_matches(x, '([.][.][.]|…)[ \\t\\r]*$'))) AS n_ellipsis
  FROM d LEFT JOIN rep USING (k) LEFT JOIN words USING (k) LEFT JOIN two USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  {" OR ".join(f"({r.rejects})" for r in BASE)} AS base_failed, NOT ({" OR ".join(f"({r.rejects})" for r in RULES)}) AS kept
FROM m
"""
