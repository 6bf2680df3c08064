"""Text functions as column expressions (TXT-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of scripts with about one token per character.
CJK = "぀-ヿ㐀-䶿一-鿿가-힯豈-﫿"
#: Stop words by language.
STOP_WORDS = {
    "en": "the and of to for is in shall must be with expense policy employee reimbursement",
    "es": "el la de los para que es en y gastos empleado por",
    "fr": "le la les de des pour que est et en frais salarie",
    "de": "der die das und von fur ist in mit nicht kosten mitarbeiter",
    "pt": "de para que os as em nao despesas funcionario",
    "nl": "de het een van voor is en niet kosten",
    "it": "il la di per che non sono spese dipendente",
}
#: Scripts by the language they stand for, in the order in which they are tried.
SCRIPTS = {"ja": "぀-ヿ", "ko": "가-힯", "zh": "一-鿿", "ar": "\u0600-\u06ff", "he": "\u0590-\u05ff", "ru": "\u0400-\u04ff", "hi": "\u0900-\u097f", "th": "\u0e00-\u0e7f"}
SCRIPT_SHARE, LEAST_CHARS = 0.15, 12
PAGE_NUMBER = r"(?i)^[\-–—\s]*(?:page\s+)?\d{1,4}(?:\s*[/\-of]+\s*\d{1,4})?[\-–—\s]*$"


def split_paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines (TXT-3)."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def estimate_tokens(text: Column) -> Column:
    """Tokens by script, rounded up; 0 for no text (TXT-5)."""
    cjk = F.length(F.regexp_replace(text, f"[^{CJK}]", ""))
    other = F.length(text) - cjk
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(cjk / 1.1 + other / 4.0 + 0.999).cast("int")))


def strip_page_numbers(text: Column) -> Column:
    """The text without lines that are only a page number (TXT-9)."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.trim(x).rlike(PAGE_NUMBER)), "\n")


def snippet(text: Column, width: int = 240) -> Column:
    """One line of at most ``width`` characters (TXT-17)."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) > width, F.concat(F.rtrim(F.substring(line, 1, width - 1)), F.lit("…"))).otherwise(line)


def stop_words_in(text: Column) -> Column:
    """The words of the whole text that are a stop word of some language, repeats included."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[^\W\d_]+"), F.lit(0))
    every = sorted({w for stops in STOP_WORDS.values() for w in stops.split()})
    return F.filter(words, lambda w: w.isin(*every))


def stop_word_counts(found: Column) -> list[Column]:
    """Occurrences of each language's stop words among those found."""

    def among(stops: str) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(*stops.split())))

    return [among(stops).alias(f"n_{lang}") for lang, stops in STOP_WORDS.items()]


def detect_latin_language(counts: str = "n_") -> Column:
    """The language whose stop words lead; null on a tie or without any (TXT-7, over stop_word_counts)."""
    names = list(STOP_WORDS)
    top = F.greatest(*[F.col(f"{counts}{x}") for x in names])
    leads = sum(((F.col(f"{counts}{x}") == top).cast("int") for x in names), F.lit(0))
    pick = F.coalesce(*[F.when(F.col(f"{counts}{x}") == top, F.lit(x)) for x in names])
    return F.when((top > 0) & (leads == 1), pick)


def script_language(text: Column) -> Column:
    """The language of the first script that has its share of the letters; Han with kana is Japanese."""
    every = "".join(SCRIPTS.values())
    some = F.regexp_replace(text, f"[^{every}]+", "")  # nothing is left of most texts
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    count = lambda name: F.length(F.regexp_replace(some, rf"[^{SCRIPTS[name]}]|\P{{L}}", ""))
    out = F.lit(None).cast("string")
    for name in reversed(SCRIPTS):
        own = F.when(count("ja") > 0, "ja").otherwise("zh") if name == "zh" else F.lit(name)
        out = F.when(count(name) / letters >= SCRIPT_SHARE, own).otherwise(out)
    return F.when(text.rlike(f"[{every}]") & (letters > 0), out)


def with_language(df: DataFrame, text: str = "text", to: str = "language") -> DataFrame:
    """Adds the language of the whole text: by script, else by stop words; null where neither decides (TXT-7)."""
    counted = df.withColumn("_found", stop_words_in(F.col(text))).select("*", *stop_word_counts(F.col("_found")))
    long = F.length(F.trim(text)) >= LEAST_CHARS
    return counted.withColumn(to, F.when(long, F.coalesce(script_language(F.col(text)), detect_latin_language()))).select(*df.columns, to)


def quality_parts(text: Column) -> dict[str, Column]:
    """Length, letter share and word shape scores between 0 and 1 (TXT-12)."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    n = F.length(t)
    length = F.when(n < 80, n / 80 * 0.3).otherwise(F.least(F.lit(1.0), 0.3 + 0.7 * (n - 80) / 1920))
    alnum = (n - F.length(F.regexp_replace(t, r"(?U)[\p{L}\p{Nd}\s]", ""))) / n
    words = F.regexp_count(t, F.lit(r"(?U)\S+"))
    mean = F.length(F.regexp_replace(t, r"(?U)\s", "")) / words
    off = F.when(mean < 2, 2 - mean).when(mean > 10, mean - 10).otherwise(0.0)
    zero = lambda c: F.when(n > 0, c).otherwise(0.0)
    return {"length_score": zero(length), "alnum_score": zero(alnum), "word_score": zero(F.greatest(F.lit(0.0), 1 - off / 10))}


def quality_score(parts: dict[str, Column], several_sections: Column, has_language: Column) -> Column:
    """The weighted sum of the parts, from 0 to 100 (TXT-12)."""
    total = (
        0.3 * parts["length_score"] + 0.3 * parts["alnum_score"] + 0.2 * parts["word_score"]
        + 0.1 * F.when(several_sections, 1.0).otherwise(0.5) + 0.1 * F.when(has_language, 1.0).otherwise(0.3)
    )
    return F.when(parts["length_score"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * total))).otherwise(0.0)
