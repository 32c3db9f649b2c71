"""Quality rules: a threshold table compiled into one Spark projection.

Metrics are built-in column expressions over the whole text (lengths,
symbols, stop words, line ratios, repeated word windows); a rule is
``(name, numerator, denominator, lowest, highest)`` on the ratio of two
metrics.  All rules become one projection; no user functions run.

Defined results: a NULL or empty text has no words and fails the base rule;
repeated rows are judged one by one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

# Word separators, symbols, and frequent function words of four languages.
SPACES = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]+"
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "le", "la", "de", "et", "les", "des", "un", "que",
              "der", "die", "und", "das", "von", "zu", "mit", "ist", "el", "en", "y", "los", "del", "se", "las", "con")

#: name, numerator, denominator (a metric, or 1), lowest and highest ratio that pass (None: no bound).
RULES = (
    ("word_length", "word_chars", "n_words", 2.0, 15.0),
    ("symbols", "n_symbols", "n_words", None, 0.3),
    ("stop_words", "n_stop_words", "n_words", 0.02, None),
    ("letters", "n_letters", "word_chars", 0.6, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 0.3),
    ("bullets", "n_bullets", "n_lines", None, 0.9),
    ("ellipses", "n_ellipses", "n_lines", None, 0.3),
    ("capitals", "n_capitals", "n_letters", None, 0.5),
)
LEAST_WORDS = 50


def _count(pattern: str) -> Column:
    """Characters of the text within matches of ``pattern``."""
    return (F.length("text") - F.length(F.regexp_replace("text", F.lit(pattern), F.lit("")))).cast("long")


def metrics(df: DataFrame) -> DataFrame:
    """``doc_id`` and the metrics of every text.  Steps are separate projections so that each array is built once."""
    d = documents(df).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select(
        "doc_id",
        _count(SYMBOLS).alias("n_symbols"), _count(r"\p{L}+").alias("n_letters"), _count(r"\p{Lu}+").alias("n_capitals"),
        F.array_remove(F.split("text", SPACES), F.lit("")).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.rlike(line, F.lit(r"[^ \t-\r]"))).alias("lines"),
    )
    # A window is its three words' hash; equal windows stand next to each other once sorted by (hash, position).
    w = F.col("words")
    at = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    windows = F.when(F.size(w) >= 4, F.transform(F.sequence(F.lit(0), F.size(w) - 3), at)).otherwise(
        F.array().cast("array<bigint>"))
    common = [*STOP_WORDS, *(x.capitalize() for x in STOP_WORDS), *(x.upper() for x in STOP_WORDS if len(x) > 1)]
    d = d.select(
        "doc_id", "n_symbols", "n_letters", "n_capitals",
        F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
        F.size(w).cast("long").alias("n_words"),
        F.size(F.filter(w, lambda x: x.isin(*common))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: F.rlike(x, F.lit(r"^\s*[-*•]\s")))).cast("long").alias("n_bullets"),
        F.size(F.filter("lines", lambda x: F.rlike(x, F.lit(r"(\.\.\.|…)\s*$")))).cast("long").alias("n_ellipses"),
        windows.alias("windows"),
    )
    # Only texts with a repeated window pay for the sort.
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), pairs))
    s = F.col("sorted")
    same = lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
    d = d.withColumn("repeated", F.transform(F.filter(s, same), lambda x: x["i"]))
    covered = F.array_distinct(F.flatten(F.transform("repeated", lambda i: F.array(i, i + 1, i + 2))))
    d = d.withColumn("n_repeat_words", F.coalesce(F.size(covered), F.lit(0)).cast("long"))
    # size(NULL) is -1 under the legacy setting.
    d = d.withColumn("n_repeat_words", F.greatest("n_repeat_words", F.lit(0).cast("long")))
    return d.drop("windows", "sorted", "repeated")


def compile_rules(rules=RULES) -> list[Column]:
    """One boolean column ``ok_<name>`` per rule; a ratio over nothing passes."""
    out = []
    for name, top, bottom, low, high in rules:
        ratio = F.col(top).cast("double") / (F.nullif(F.col(bottom), F.lit(0)) if isinstance(bottom, str) else F.lit(bottom))
        ok = F.lit(True)
        if low is not None:
            ok = ok & (ratio >= low)
        if high is not None:
            ok = ok & (ratio <= high)
        out.append(F.coalesce(ok, F.lit(True)).alias(f"ok_{name}"))
    return out


def quality_rules(df: DataFrame, rules=RULES, least_words: int = LEAST_WORDS) -> DataFrame:
    """Metrics, one column per rule, ``base_failed`` and ``kept`` for every row of ``df``."""
    m = metrics(df)
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    m = m.select("*", *compile_rules(rules), base.alias("base_failed"))
    verdict = F.lit(True)
    for name, *_ in rules:
        verdict = verdict & F.col(f"ok_{name}")
    return m.withColumn("kept", ~F.col("base_failed") & verdict)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: one row per document."""
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    """The same in DuckDB: window positions are grouped by their words."""
    common = [*STOP_WORDS, *(x.capitalize() for x in STOP_WORDS), *(x.upper() for x in STOP_WORDS if len(x) > 1)]
    stop = ", ".join(f"'{w}'" for w in common)
    def ratio(rule):
        _, top, bottom, low, high = rule
        r = f"({top}::double / nullif({bottom}, 0))"
        parts = [f"{r} >= {low}"] * (low is not None) + [f"{r} <= {high}"] * (high is not None)
        return "coalesce(" + " and ".join(parts) + ", true)"
    verdict = " and ".join(ratio(r) for r in RULES)
    return rf"""
with d as (
  select doc_id, coalesce(text, '') as t,
         list_filter(string_split(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', ' ', 'g'), ' '), lambda x: x <> '') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
windows as (
  select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
repeated as (
  select doc_id, i from (select *, count(*) over (partition by doc_id, a, b, c) as k from windows) where k > 1),
covered as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select doc_id, unnest([i, i + 1, i + 2]) as p from repeated) group by doc_id),
m as (
  select d.doc_id, len(w)::bigint as n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    len(l) as n_lines,
    length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')) as n_letters,
    length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) as n_capitals,
    len(list_filter(w, lambda x: x in ({stop}))) as n_stop_words,
    len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]\s'))) as n_bullets,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) as n_ellipses
  from d left join covered using (doc_id)),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and {verdict} as kept
from v"""
