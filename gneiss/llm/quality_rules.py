"""Quality rules as a short-circuit cascade.

Each rule rejects a text by its own measure.  A sample of at most ``SAMPLE_ROWS`` rows, chosen by hash, is written, and
each rule is run over it alone: what it rejects is its selectivity, and the median time of ``PASSES`` runs, less that of
reading the texts, its cost.  Rules are ordered by rejections per cost, and a row stops at the first that rejects it.
Which rows are kept doesn't depend on the order.  All measures are built-in expressions, so rows stay in the JVM.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.shared import documents, hash_sample, written

SAMPLE_ROWS = 1000
PASSES = 3
#: A cost of less can't be told from none by the clock.
LEAST_SECONDS = 1e-3
MIN_WORDS = 2
MIN_MEAN_WORD, MAX_MEAN_WORD = 2, 20
SYMBOLS_PER_100 = 4
UPPER_PER_100 = 60
REPEATS_PER_100 = 20
LINES_PER_100 = 50
STOPWORD_MIN_WORDS = 30
MAX_INSULTS = 2

_WORD = r"\S+"
_SYMBOL = r"[#$%&*|~^<>{}=_\\]"
_UPPER = r"[A-ZÀ-ÖØ-Þ]"
_LETTER = r"[A-Za-zÀ-ÖØ-öø-ÿ]"
#: A word before its equal; possessive, so no word is tried twice.
_REPEATED = r"(?<!\S)(\S++)\s++(?=\1(?!\S))"
_STOPWORD = r"(?:^|[^a-zà-ÿ])(?:the|and|of|is|le|la|les|et|de|des|der|die|und|das|el|los|que|en)(?:[^a-zà-ÿ]|$)"
_INSULT = r"(?:^|[^a-z])(?:idiot|moron|stupid|trash|scum|loser|pathetic|worthless|disgusting|clown)"


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD))


def _letters(text: Column, kind: str) -> Column:
    """How many characters are of a class: what is missing once its runs, which are fewer than they, are cut out."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{kind}+", ""))


def rules(text: Column, n_words: Column) -> list[Rule]:
    """All rules over a text column that isn't null and its words."""
    ink = F.length(F.regexp_replace(text, r"\s+", ""))
    pairs = F.regexp_count(text, F.lit(_REPEATED))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)
    return [
        Rule("too_few_words", n_words < MIN_WORDS),
        Rule("mean_word_length", ~ink.between(n_words * MIN_MEAN_WORD, n_words * MAX_MEAN_WORD)),
        Rule("symbols", F.regexp_count(text, F.lit(_SYMBOL)) * 100 > SYMBOLS_PER_100 * F.length(text)),
        Rule("upper_case", _letters(text, _UPPER) * 100 > _letters(text, _LETTER) * UPPER_PER_100),
        Rule("repeated_words", pairs * 100 > n_words * REPEATS_PER_100),
        Rule("repeated_lines", (F.size(lines) - F.size(F.array_distinct(lines))) * 100 > LINES_PER_100 * F.size(lines)),
        Rule("no_stopwords", (n_words >= STOPWORD_MIN_WORDS) & ~F.lower(text).rlike(_STOPWORD)),
        Rule("insults", F.regexp_count(F.lower(text), F.lit(_INSULT)) >= MAX_INSULTS),
    ]


def ordered(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, make: Callable[[Column, Column], list[Rule]] = rules) -> list[tuple[str, float, float]]:
    """(rule, selectivity, seconds over the sample) by rejections per second, highest first; ties by cost, then name."""
    sample = hash_sample(docs.where("text is not null").select("doc_id", "text"), sample_rows, docs)
    # one file, so that a run is one task
    sample = written(sample.select("text").coalesce(1), "rule-sample").select("text", word_count(F.col("text")).alias("n_words"))
    found = make(sample["text"], sample["n_words"])

    def seconds(*what: Column) -> tuple[float, int]:
        asked, took, row = sample.agg(F.sum(F.length("text")), F.sum("n_words"), *what), [], None
        for _ in range(PASSES + 1):
            began = time.perf_counter()
            row = asked.first()
            took.append(time.perf_counter() - began)
        return median(took[1:]), row[-1] or 0  # the first run compiles

    rows, (base, _) = sample.count(), seconds()
    measured = []
    for r in found:
        cost, rejected = seconds(F.count_if(r.rejects))
        measured.append((r.name, rejected / max(rows, 1), max(cost - base, LEAST_SECONDS)))
    return sorted(measured, key=lambda m: (-m[1] / m[2], m[2], m[0]))


def judge(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, keep, rejected_by) of every document; ``rejected_by`` is the first rule in cascade order that rejects it.

    A null text is rejected by no_text and an empty one by a rule.  A null doc_id stays null.  Repeated rows give a
    row each and fare alike.  Very long texts are measured whole.  An empty table gives no rows.  Other columns are
    ignored.
    """
    # the words are counted once, in a projection of their own, as all but two rules need them
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", word_count(docs["text"]).alias("n_words"))
    text, n_words = rows["text"], rows["n_words"]
    verdict = F.when(text.isNull(), "no_text")
    by_name = {r.name: r for r in rules(text, n_words)}
    for name, _, _ in ordered(docs, sample_rows):
        verdict = verdict.when(by_name[name].rejects, name)
    out = rows.select("doc_id", verdict.alias("rejected_by"))
    return out.select("doc_id", F.col("rejected_by").isNull().alias("keep"), "rejected_by")


def verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, keep, and a column a rule): whether each rule by itself rejects the document; nulls for a null text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", word_count(docs["text"]).alias("n_words"))
    each = rows.select("doc_id", *(r.rejects.alias(r.name) for r in rules(rows["text"], rows["n_words"])))
    names = each.columns[1:]
    return each.select("doc_id", F.coalesce(~F.greatest(*names), F.lit(False)).alias("keep"), *names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL can't tell ``rejected_by``, as it depends on measured times; it checks `verdicts`, and the tests the cascade."""
    return judge(documents(spark, sf_dir))


def verdicts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir))


def _count(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


VERDICTS_ORACLE = rf"""
WITH t AS (SELECT doc_id, text, {_count(_WORD)} AS n, length(regexp_replace(text, '\s+', '', 'g')) AS ink,
           string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w,
           list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS l FROM documents),
r AS (SELECT doc_id, n < {MIN_WORDS} AS too_few_words,
  ink < {MIN_MEAN_WORD} * n OR ink > {MAX_MEAN_WORD} * n AS mean_word_length,
  {_count(_SYMBOL)} * 100 > {SYMBOLS_PER_100} * length(text) AS symbols,
  {_count(_UPPER)} * 100 > {UPPER_PER_100} * {_count(_LETTER)} AS upper_case,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) * 100 > {REPEATS_PER_100} * n AS repeated_words,
  (len(l) - len(list_distinct(l))) * 100 > {LINES_PER_100} * len(l) AS repeated_lines,
  n >= {STOPWORD_MIN_WORDS} AND NOT regexp_matches(lower(text), '{_STOPWORD}') AS no_stopwords,
  {_count(_INSULT, "lower(text)")} >= {MAX_INSULTS} AS insults FROM t)
SELECT *, coalesce(NOT (too_few_words OR mean_word_length OR symbols OR upper_case OR repeated_words OR repeated_lines OR no_stopwords OR insults), false) AS keep FROM r
"""
