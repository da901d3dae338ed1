"""Quality rules: a table of thresholds compiled into one projection of length, symbol, stop-word and line ratios.

Measures come from the words of a text (runs of anything but ASCII white space), its lines (split at line feeds) and its code
points; rules are rows (measure, least, most) of a table, and the verdict is one Boolean expression over them. No user
function, no shuffle: each row is judged by itself.

Null and empty texts: all measures 0, base_failed true, kept false. Texts of any length are measured whole; repeated windows
are found by sorting the hashes of a text's windows. Repeated rows: equal results. Empty table: empty result. Extra columns
are kept by `apply_rules`, but for any that has the name of an added one (MEASURES, base_failed, kept), which gives way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import RESULT, SPACES, WORD, kept_columns, let, read_table

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_chars")
WINDOW = 8
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "it", "on", "with", "le", "la", "les", "de", "des", "et", "un", "une", "du", "der", "die", "das", "und", "ist", "von", "zu", "el", "los", "que", "en", "y")

#: (name, measure over the columns of MEASURES, least, most); None: no bound.
Rule = tuple[str, str, float | None, float | None]
RULES: tuple[Rule, ...] = (
    ("words", "n_words", 20, None),
    ("repeats", "100.0 * n_repeat_words / greatest(n_words, 1)", None, 30),
    ("symbols", "1.0 * n_symbols / greatest(n_words, 1)", None, 0.3),
    ("word_length", "1.0 * word_chars / greatest(n_words, 1)", 2, 15),
    ("dup_lines", "1.0 * n_dup_lines / greatest(n_lines, 1)", None, 0.5),
    ("stop_words", "1.0 * n_stop_words / greatest(n_words, 1)", 0.02, None),
)
#: The rules that make base_failed.
BASE = ("words", "repeats")


def _repeated(words: Column) -> Column:
    """Words in windows of WINDOW that occur more than once: hashes of the windows are sorted with their places; the places
    whose hash has an equal neighbour cover WINDOW words each."""
    at = lambda a, i: F.get(a, i)
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    starts = lambda h: F.sequence(F.lit(0), F.size(h) - WINDOW)
    windows = lambda h: F.transform(starts(h), lambda i: F.xxhash64(*(at(h, i + j) for j in range(WINDOW))))
    placed = lambda v: F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    twins = lambda s: F.filter(s, lambda x, i: (x.h == at(s, i - 1).h) | (x.h == at(s, i + 1).h))
    twins_or_null = lambda s: F.transform(twins(s), lambda x: x.i)
    covered = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))["n"]
    several = lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(let(placed(v), lambda s: covered(F.array_sort(twins_or_null(s)))))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(let(hashed(words), windows), several))


def measures(text: Column) -> dict[str, Column]:
    """MEASURES of a text."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    with_word = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    by_words = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("repeat"), F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).alias("stop")))
    by_lines = let(with_word, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    long = lambda c: c.cast("long")
    return {
        "_words": by_words,
        "_lines": by_lines,
        "word_chars": long(F.length(F.translate(text, SPACES, ""))),
        "n_symbols": long(F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))),
        "n_chars": long(F.length(text)),
    }


def verdict(rules: Sequence[Rule]) -> Column:
    """Whether all rules hold."""
    bounds = [F.expr(m) >= low for _, m, low, _ in rules if low is not None] + [F.expr(m) <= high for _, m, _, high in rules if high is not None]
    out = F.lit(True)
    for b in bounds:
        out = out & b
    return out


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with MEASURES, base_failed and kept."""
    kept = kept_columns(docs, *MEASURES, "base_failed", "kept")
    found = F.struct(*(c.alias(name) for name, c in measures(F.col("text")).items()))
    nested = {"n_words": "_words.n", "n_repeat_words": "_words.repeat", "n_stop_words": "_words.stop", "n_lines": "_lines.n", "n_dup_lines": "_lines.dup"}
    out = docs.select(*kept, found.alias(RESULT)).select(*kept, *(F.col(f"{RESULT}.{nested.get(m, m)}").cast("long").alias(m) for m in MEASURES))
    base = verdict([r for r in rules if r[0] in BASE])
    return out.select("*", (~base).alias("base_failed"), verdict(rules).alias("kept"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).drop("text", "n_lines", "n_stop_words", "n_chars")


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id) AS r FROM documents
), w AS (
  SELECT doc_id, r, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT r, i, array_to_string(ws[i:i+7], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g) WHERE n > 1
), cov AS (
  SELECT r, sum(least(8, coalesce(i - p, 8)))::BIGINT AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM rep) GROUP BY r
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, len(list_filter(ws, lambda x: lower(x) IN {STOP_WORDS})) AS n_stop
  FROM w LEFT JOIN cov USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words AND n_symbols <= 0.3 * n_words AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words
    AND n_dup_lines <= 0.5 * n_lines AND n_stop >= 0.02 * n_words AS kept
FROM m
"""
