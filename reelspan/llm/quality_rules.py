"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Words are runs of characters other than U+0020 and U+0009 to U+000D. ``measures`` derives every count of a text from
its word and line arrays within the row: no explode, no shuffle, no user function. Words in repeated 3-word windows
are found by sorting (window hash, position) pairs, so a long text costs n log n.

Nulls: a null text has no words and fails the base rule. Rows that share a doc_id, or have none, give a row each.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.llm.common import SPACE_CLASS, text_of

SYMBOLS = "#*$%&|<>"
#: Frequent function words of four languages.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on are this or from "
    "le la les de des du et un une est que qui dans pour pas sur au avec "
    "der die das und ist von zu den mit sich auf ein eine nicht im dem als auch "
    "el los las y en por con para del se su al lo no "
).split()


@dataclass(frozen=True)
class Rule:
    """Keep where ``low <= 100 * numerator / denominator <= high``; a denominator of 0 keeps."""

    name: str
    numerator: str
    denominator: str
    low: float | None
    high: float | None


#: Ratios in per cent, all counts of ``measures``.
RULES = (
    Rule("mean word length", "word_chars", "n_words", 200, 1500),
    Rule("symbols to words", "n_symbols", "n_words", None, 10),
    Rule("stop words to words", "n_stop_words", "n_words", 2, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 50),
    Rule("lines that begin with a bullet", "n_bullet_lines", "n_lines", None, 90),
    Rule("lines that end with an ellipsis", "n_ellipsis_lines", "n_lines", None, 30),
    Rule("words without a lower-case letter", "n_caps_words", "n_words", None, 40),
)


def measures(text: Column) -> dict[str, Column]:
    """Count columns by name; each is a function of ``text`` alone. ``_words``, ``_lines`` are arrays."""
    words = F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {"_words": words, "_lines": lines}


def counts(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    size = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    ordered = F.sort_array(F.when(size >= 3, windows).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    return {
        "n_words": size,
        "word_chars": F.char_length(F.regexp_replace(text, SPACE_CLASS, "")),
        "n_symbols": F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
        "n_caps_words": F.size(F.filter(words, lambda w: (F.lower(w) != w) & (F.upper(w) == w) & (F.char_length(w) > 1))),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
        "_ordered": ordered,
    }


def repeated_words(ordered: Column) -> Column:
    """Words covered by the windows whose hash stands beside an equal one in the sorted array."""
    n = F.size(ordered)
    twice = F.filter(ordered, lambda x, k: (F.get(ordered, k - 1)["h"] == x["h"]) | (F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False))))
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(starts, zero, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")))
    return F.when(n < 2, F.lit(0)).otherwise(covered["n"])


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one condition on the counts."""
    out = F.lit(True)
    for r in rules:
        value, base = F.col(r.numerator) * F.lit(100), F.col(r.denominator)
        if r.low is not None:
            out = out & ((base == 0) | (value >= F.lit(float(r.low)) * base))
        if r.high is not None:
            out = out & ((base == 0) | (value <= F.lit(float(r.high)) * base))
    return out


def _judged(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """_row (all of the input's columns), the counts, base_failed and kept."""
    base = docs.select(F.struct(*docs.columns).alias("_row"), text_of().alias("_text"))
    base = base.select("_row", "_text", *(c.alias(n) for n, c in measures(F.col("_text")).items()))
    found = base.select("_row", *(c.alias(n) for n, c in counts(F.col("_text"), F.col("_words"), F.col("_lines")).items()))
    found = found.withColumn("n_repeat_words", repeated_words(F.col("_ordered"))).drop("_ordered")
    found = found.select("_row", *(F.col(n).cast("long").alias(n) for n in found.columns if n != "_row"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row of ``docs(doc_id, text)``: a map-only plan."""
    found = _judged(docs.select("doc_id", "text"), rules)
    return found.select(F.col("_row.doc_id").cast("long").alias("doc_id"), *[c for c in found.columns if c != "_row"])


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names. The verdict passes
    through a generator of one row: else the optimiser pushes the filter below the projections and writes every count out
    anew at each of its uses."""
    judged = _judged(docs, rules).select("_row", F.explode(F.array("kept")).alias("_kept"))
    return judged.where("_kept").select("_row.*")


def oracle_sql() -> str:
    """The contract's columns in DuckDB SQL."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = []
    for r in RULES:
        for sign, bound in ((">=", r.low), ("<=", r.high)):
            if bound is not None:
                tests.append(f"({r.denominator} = 0 OR {r.numerator} * 100 {sign} {float(bound)} * {r.denominator})")
    ws = r"\x20\x09-\x0D"
    return rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[{ws}]+'), lambda w: w <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{ws}]')) AS l FROM base),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM split WHERE len(w) >= 3),
keyed AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS k FROM win),
twice AS (SELECT doc_id, i FROM keyed QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT s.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[{ws}]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
  len(list_filter(w, lambda x: lower(x) <> x AND upper(x) = x AND length(x) > 1))::BIGINT AS n_caps_words,
  len(list_filter(l, lambda x: regexp_matches(x, '^[{ws}]*[-*•]')))::BIGINT AS n_bullet_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[{ws}]*$')))::BIGINT AS n_ellipsis_lines
  FROM split s LEFT JOIN cover c ON c.doc_id = s.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_caps_words, n_bullet_lines,
  n_ellipsis_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(tests)} AS kept FROM f"""
