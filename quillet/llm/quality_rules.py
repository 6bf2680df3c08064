"""Quality rules as one projection (operator 10).

The rules are a threshold table: name, measure, lowest and highest value that
passes.  ``compile_rules`` turns the table into a single select of built-in
functions: no user functions, no shuffle, no join.  Texts are read whole.

Words are maximal runs of characters other than ``[\\x20\\x09-\\x0D]``.  A repeated
word is one inside a window of five words that occurs twice or more in the
text, the first occurrence included.  Windows are first compared by hash, which
costs one pass; only texts where two hashes agree have their windows compared
as words.

The thresholds, measured on labelled texts of 10 words or more (0.5th to 99.5th
percentile of good ones): word length 4.5 to 5.9 characters in English and up to 8.2
in other languages, no symbols, repeated lines under 0.27, stop words over 0.12.

Edge cases: a null text has no words and fails ``n_words``; a measure over no
words or lines is 0; ties and repeated rows are judged one by one; extra
columns are ignored by ``judge`` and kept by ``measures`` and ``keep_good``, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, text_or_empty

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"

#: Frequent function words of the languages in the corpus.
STOP_WORDS = (
    "the be to of and that have with in is it for as was on by this from at or are an he his not but "
    "le la les de des du et un une que qui dans pour sur par avec est en au il elle ne pas plus "
    "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch es an "
    "el la los las de que y en un una por con para se del al lo como más su es"
).split()


class Rule(NamedTuple):
    """``measure`` is SQL over the measures below; a row passes from ``low`` to ``high``."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The first two are the base rules; a text must pass all.
RULES: tuple[Rule, ...] = (
    Rule("n_words", "n_words", low=10),
    Rule("repeat_words", "100 * n_repeat_words - 20 * n_words", high=0),
    Rule("mean_word_chars", "word_chars / greatest(n_words, 1)", low=3, high=10),
    Rule("symbols", "n_symbols / greatest(n_words, 1)", high=0.1),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", high=0.3),
    Rule("stop_words", "n_stop_words / greatest(n_words, 1)", low=0.06),
)


def _windows(words: str) -> str:
    """SQL for an array of the hashes of all windows of ``words``."""
    shifted = ", ".join(f"slice({words}, {k}, size({words}) - {WINDOW - 1})" for k in range(1, WINDOW + 1))
    return f"transform(arrays_zip({shifted}), w -> xxhash64(w))"


def _base(docs: DataFrame) -> DataFrame:
    """The arrays that the measures share, each made once."""
    text = text_or_empty()
    return docs.withColumns(
        {
            "_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
            "_lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)),
            "_n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
            "_word_chars": F.length(F.regexp_replace(text, f"[{SPACE}]+", "")),
        }
    )


def _with_windows(base: DataFrame) -> DataFrame:
    hashes = base.withColumn("_hashes", F.expr(f"if(size(_words) >= {WINDOW}, {_windows('_words')}, array())"))
    # Where two hashes agree: (window, start) sorted, so that equal windows stand side by side, starts ascending.
    paired = (
        "if(size(array_distinct(_hashes)) < size(_hashes),"
        f" array_sort(transform(sequence(1, size(_words) - {WINDOW - 1}), i -> struct(array_join(slice(_words, i, {WINDOW}), ' ') AS w, i AS i))),"
        " array())"
    )
    repeats = (
        "array_sort(transform(filter(transform(_pairs, (x, k) -> struct(x.i AS i,"
        " (k > 0 AND _pairs[k - 1].w = x.w) OR (k + 1 < size(_pairs) AND _pairs[k + 1].w = x.w) AS r)), x -> x.r), x -> x.i))"
    )
    covered = (
        f"aggregate(transform(_starts, (s, k) -> if(k + 1 < size(_starts), least(_starts[k + 1] - s, {WINDOW}), {WINDOW})),"
        " 0L, (a, x) -> a + x)"
    )
    staged = hashes.withColumn("_pairs", F.expr(paired)).withColumn("_starts", F.expr(f"if(size(_pairs) > 0, {repeats}, array())"))
    return staged.withColumn("_repeat", F.expr(covered))


def compile_rules(rules: Sequence[Rule]) -> list[Column]:
    """One boolean column per rule, true where the rule is broken."""
    out = []
    for rule in rules:
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | F.expr(f"({rule.measure}) < {rule.low}")
        if rule.high is not None:
            bad = bad | F.expr(f"({rule.measure}) > {rule.high}")
        out.append(F.coalesce(bad, F.lit(True)).alias(f"bad_{rule.name}"))
    return out


def measures(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    staged = _with_windows(_base(docs.select(F.struct("*").alias("row"), "text")))
    made = {
        "n_words": F.size("_words"),
        "word_chars": F.col("_word_chars"),
        "n_symbols": F.col("_n_symbols"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.col("_repeat"),
        "n_lines": F.size("_lines"),
        "n_stop_words": F.size(F.expr(f"filter(_words, x -> lower(x) IN ({stop}))")),
    }
    # Filters must not be pushed below this point: the arrays would be made anew wherever they are named.
    measured = F.struct(*[c.cast("long").alias(name) for name, c in made.items()])
    return staged.select("row", F.explode(F.array(measured)).alias("_m")).select("row", "_m.*")


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed, kept and failed_rules for every row of ``docs``."""
    measured = measures(docs.select("doc_id", "text")).select("row.doc_id", "*").drop("row")
    flags = compile_rules(rules)
    names = [r.name for r in rules]
    judged = measured.select("*", *flags)
    base_failed = F.col("bad_n_words") | F.col("bad_repeat_words")
    failed = F.array_compact(F.array(*[F.when(F.col(f"bad_{n}"), F.lit(n)) for n in names]))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
        base_failed.alias("base_failed"),
        (F.size(failed) == 0).alias("kept"),
        F.array_join(failed, ",").alias("failed_rules"),
    )


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that break no rule, with their columns."""
    bad = compile_rules(rules)
    any_bad = bad[0]
    for b in bad[1:]:
        any_bad = any_bad | b
    return measures(docs).filter(~any_bad).select("row.*")
