"""Quality rules: a threshold table compiled into one projection.

Every feature is a whole-text count and every rule compares two of them with
integers (``100 * count`` against ``percent * base``), so there is no rounding.
The operator is a projection: no shuffle, no Python.

Defined results: a null or empty text has no words, fails ``min_words`` and is
not kept; repeated rows are judged alike; null ids and other columns pass
through untouched; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, let, read, word_array

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Common function words by language (fixed values).
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "this", "are", "at", "from"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour", "est", "dans", "qui", "par", "au", "sur", "pas", "avec"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "eine", "ein", "als"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "las", "del", "un", "por", "con", "no", "una", "su", "para", "al", "es", "lo"],
}


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: ``100 * count`` must be ``op`` (at most or at least) ``percent * base``."""

    name: str
    count: str
    op: str
    percent: int
    base: str  # a feature, or "1"


#: Base rules decide ``base_failed``; the rest are the method's verdict.
BASE_RULES = [
    Rule("min_words", "n_words", ">=", 2000, "1"),
    Rule("repeated_windows", "n_repeat_words", "<=", 30, "n_words"),
]
RULES = [
    Rule("max_words", "n_words", "<=", 100_000_000, "1"),
    Rule("short_mean_word", "word_chars", ">=", 250, "n_words"),
    Rule("long_mean_word", "word_chars", "<=", 1200, "n_words"),
    Rule("symbols", "n_symbols", "<=", 10, "n_words"),
    Rule("stop_words", "n_stop_words", ">=", 6, "n_words"),
    Rule("duplicate_lines", "n_dup_lines", "<=", 50, "n_lines"),
    Rule("bullet_lines", "n_bullet_lines", "<=", 90, "n_lines"),
    Rule("ellipsis_lines", "n_ellipsis_lines", "<=", 30, "n_lines"),
]


def _stop_list() -> list[str]:
    return sorted({w for words in STOP_WORDS.values() for w in words})


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))

    def repeated(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda x, j: F.get(s, j - 1)["h"].eqNullSafe(x["h"]) | F.get(s, j + 1)["h"].eqNullSafe(x["h"])
            return F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))

        covered = F.aggregate(
            let(ordered, positions),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered)

    return F.when(F.size(words) <= WINDOW, 0).otherwise(let(hashes, repeated)).cast("long")


def _passes(rule: Rule) -> Column:
    count = F.lit(100) * F.col(rule.count)
    bound = F.lit(rule.percent).cast("long") * (F.lit(1) if rule.base == "1" else F.col(rule.base))
    return count <= bound if rule.op == "<=" else count >= bound


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the whole-text counts that the threshold table names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("doc_id"),
        text.alias("text"),
        word_array(F.col(text_col)).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    return split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", BLANK, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: w.isin(_stop_list()))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
    )


def judge(counts: DataFrame, rules: list[Rule] = RULES, base_rules: list[Rule] = BASE_RULES) -> DataFrame:
    """``counts`` with ``base_failed``, ``kept`` and the names of the broken rules."""
    failed = F.lit(False)
    for rule in base_rules:
        failed = failed | ~_passes(rule)
    broken = F.array_compact(F.array(*[F.when(~_passes(r), F.lit(r.name)) for r in [*base_rules, *rules]]))
    return counts.select("*", failed.alias("base_failed"), (F.size(broken) == 0).alias("kept"), F.array_join(broken, ",").alias("broken_rules"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts, ``base_failed``, ``kept`` and ``broken_rules``."""
    return judge(features(docs, id_col, text_col))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that every rule passes, with the columns they came with."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    judged = quality_rules(docs.select(whole.alias("row"), F.col(text_col).alias("text")), "row", "text")
    # A filter on the verdict would be pushed below the counts and make each of them again for every rule that names it;
    # a generator's output stays above them.
    row = F.explode_outer(F.when(F.col("kept"), F.array("doc_id"))).alias("row")
    return judged.select(row).filter(F.col("row").isNotNull()).select("row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def _sql_passes(rule: Rule) -> str:
    return f"100 * {rule.count} {rule.op} {rule.percent}" + ("" if rule.base == "1" else f" * {rule.base}")


OP2_SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (
  SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM s WHERE len(words) >= {WINDOW})),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, w) > 1),
cov AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS j FROM rep) GROUP BY rid),
f AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda w: list_contains([{", ".join(f"'{w}'" for w in _stop_list())}], w)))::BIGINT AS n_stop_words,
    len(lines)::BIGINT AS n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]')))::BIGINT AS n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines
  FROM s LEFT JOIN cov USING (rid))
SELECT *, NOT ({" AND ".join(map(_sql_passes, BASE_RULES))}) AS base_failed,
  {" AND ".join(map(_sql_passes, [*BASE_RULES, *RULES]))} AS kept,
  concat_ws(',', {", ".join(f"CASE WHEN NOT ({_sql_passes(r)}) THEN '{r.name}' END" for r in [*BASE_RULES, *RULES])}) AS broken_rules
FROM f
"""
