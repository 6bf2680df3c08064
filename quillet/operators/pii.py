"""Personal data: finding, masking, rejecting and counting it (TXT-14 to TXT-16)."""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What each kind looks like, how sure a match is, and the words that must stand before some.
EMAIL = r"\b[\w.+-]+@[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+\b"
CARD = r"\b(?:\d[ -]?){12,18}\d\b"
IBAN = r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{2,4}){3,8}\b"
IP4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IP6 = r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"
NATIONAL = r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b"
TAX = r"\b\d{2}-\d{7}\b"
PHONE = r"(?<!\d)(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{3}[ .-]\d{3,4}[ .-]?\d{0,4}(?!\d)"
ADDRESS = r"\b\d{1,5}\s+[A-Z][A-Za-z0-9.\s]{2,40}\b(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl)\b(?:[,\s]+[A-Za-z\s]{2,30})?(?:[,\s]+\d{4,6})?"
PASSPORT, PASSPORT_WORD = r"\b[A-Z][A-Z0-9]{6,8}\b", r"(?i)\bpassport\b"
ACCOUNT, ACCOUNT_WORD = r"\b\d{8,17}\b", r"(?i)\b(?:account|acct|a/c)\b"
TITLED = r"\b(?:Mr|Mrs|Ms|Miss|Dr)\.\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})"
LABELLED = r"\bName:\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})"
NEAR = 40
FINDINGS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("sample", T.StringType()), T.StructField("confidence", T.DoubleType())]))


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def iban(text: str) -> bool:
    bare = text.replace(" ", "")
    number = "".join(str(int(c, 36)) for c in bare[4:] + bare[:4])
    return 15 <= len(bare) <= 34 and int(number) % 97 == 1


def _after(word: str):
    def rule(m: re.Match) -> bool:
        base = max(0, m.start() - NEAR - 10)
        return any(0 <= m.start() - (base + w.end()) <= NEAR for w in re.finditer(word, m.string[base : m.start()]))

    return rule


#: In order of precedence: kind, confidence, pattern, group that holds the value, further test.
SCANNERS = (
    ("CREDIT_CARD", 0.95, CARD, 0, lambda m: luhn(re.sub("[ -]", "", m[0]))),
    ("IBAN", 0.95, IBAN, 0, lambda m: iban(m[0])),
    ("EMAIL", 0.95, EMAIL, 0, None),
    ("IP_ADDRESS", 0.9, IP4, 0, None),
    ("IP_ADDRESS", 0.85, IP6, 0, None),
    ("NATIONAL_ID", 0.75, NATIONAL, 0, None),
    ("TAX_ID", 0.7, TAX, 0, None),
    ("PHONE", 0.65, PHONE, 0, None),
    ("POSTAL_ADDRESS", 0.65, ADDRESS, 0, None),
    ("PASSPORT", 0.6, PASSPORT, 0, _after(PASSPORT_WORD)),
    ("BANK_ACCOUNT", 0.6, ACCOUNT, 0, _after(ACCOUNT_WORD)),
    ("PERSON_NAME", 0.6, TITLED, 1, None),
    ("PERSON_NAME", 0.6, LABELLED, 1, None),
)


def masked(value: str) -> str:
    return value[0] + "*" * (len(value) - 2) + value[-1] if len(value) > 2 else "*" * len(value)


def findings(text: str | None) -> list[dict]:
    """Spans by place; a span that overlaps one of an earlier kind is left to it."""
    taken: list[tuple[int, int]] = []
    out = []
    for kind, sure, pattern, group, test in SCANNERS if text else ():
        for m in re.finditer(pattern, text):
            start, end = m.span(group)
            at = bisect_left(taken, (start, end))
            clash = (at < len(taken) and taken[at][0] < end) or (at and taken[at - 1][1] > start)
            if clash or (test and not test(m)):
                continue
            insort(taken, (start, end))
            out.append({"kind": kind, "start": start, "end": end, "sample": masked(text[start:end]), "confidence": sure})
    return sorted(out, key=lambda f: f["start"])


def redacted(text: str | None, found: list[dict] | None = None) -> str | None:
    """The text with its findings (``found``, if they are known) replaced by their kinds."""
    if not text:
        return text
    parts, at = [], 0
    for f in findings(text) if found is None else found:
        parts += [text[at : f["start"]], f"[REDACTED:{f['kind']}]"]
        at = f["end"]
    return "".join(parts) + text[at:]


@F.pandas_udf(FINDINGS)
def pii_findings(text: pd.Series) -> pd.Series:
    return text.map(findings)


def _kinds_and_text(masked_too: bool):
    """A scan of each text, once: its kinds, in order, and the text, masked or not.

    Said to be nondeterministic, so that a filter on the kinds is not pushed below it and made to scan again.
    """

    @F.pandas_udf("kinds array<string>, text string")
    def run(text: pd.Series) -> pd.DataFrame:
        found = [findings(t) for t in text]
        kinds = [sorted({f["kind"] for f in fs}) for fs in found]
        return pd.DataFrame({"kinds": kinds, "text": [redacted(t, fs) if masked_too else t for t, fs in zip(text, found, strict=True)]})

    return run.asNondeterministic()


def scan_pii(df: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """A row per finding: kind, place, masked sample, confidence (TXT-14)."""
    return df.select(key, F.explode(pii_findings(col)).alias("f")).select(key, "f.*")


def apply_pii_policy(df: DataFrame, mode: str, always: tuple[str, ...] = (), col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): TAG adds the kinds, MASK also replaces values, REJECT refuses any; kinds in ``always`` are refused in every mode (TXT-15)."""
    if mode not in ("TAG", "MASK", "REJECT"):
        raise ValueError(f"unknown mode {mode}")
    scanned = df.withColumn("_s", _kinds_and_text(mode == "MASK")(col)).withColumn("pii_kinds", F.col("_s.kinds"))
    refused = F.arrays_overlap("pii_kinds", F.array(*map(F.lit, always)).cast("array<string>")) | (F.lit(mode == "REJECT") & (F.size("pii_kinds") > 0))
    return scanned.filter(~refused).withColumn(col, F.col("_s.text")).drop("_s"), scanned.filter(refused).drop("_s")


def pii_summary(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents and findings per kind (TXT-16)."""
    per = found.groupBy("kind", key).agg(F.count("*").alias("n"))
    return per.groupBy("kind").agg(F.count("*").alias("documents"), F.sum("n").alias("findings"))
