"""Identifier, keyword and shape features of a text, as Column expressions.

Everything here is JVM side. Counts are numbers of non-overlapping matches.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifier patterns.
PATTERNS: dict[str, str] = {
    "pat_card_like": r"\b(?:\d[ -]?){15}\d\b",
    "pat_email": r"\b[\w.]+@[\w.]+\.\w{2,}\b",
    "pat_phone": r"\+\d{11,12}\b",
    "pat_ipn": r"\b[23]\d{9}\b",
    "pat_money": r"\b\d{2,6} ?(?:usd|uah|eur)\b",
    "pat_person": r"\b[A-Z][a-z]+ [A-Z][a-z]+\b",
    "pat_diag": r"\b[A-Z]\d{2}\.\d\b",
    "pat_ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "pat_iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b",
    "pat_crypto": r"\b(?:0x[0-9a-fA-F]{40}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b",
}

# Keywords, matched inside words, in lower-cased text.
SENSITIVE_WORDS = [
    "confidential", "salary", "diagnosis", "tax id", "credentials",
    "personal", "card", "rate", "monthly",
]
CREDENTIAL_WORDS = [
    "password", "passwd", "pin", "iban", "ssn", "account number",
    "routing", "bitcoin", "wallet", "credential", "cvv",
]

# Feature order.
FEATURE_NAMES = [
    "pat_card_valid", "pat_card_like", "pat_email", "pat_phone", "pat_ipn",
    "pat_money", "pat_person", "pat_diag", "pat_ssn", "pat_iban", "pat_crypto",
    "kw_sensitive", "kw_credential", "meta_len", "meta_digit_ratio",
]

# A pattern can only match a text that has at least this many digits; texts
# below it skip the regular expression.
_MIN_DIGITS = {
    "pat_card_like": 16, "pat_phone": 11, "pat_ipn": 10, "pat_money": 2,
    "pat_diag": 3, "pat_ssn": 9, "pat_iban": 2, "pat_crypto": 1,
}


# Cheap first checks of a position, put before a pattern.
_GUARDS = {"pat_person": "(?=[A-Z])", "pat_diag": "(?=[A-Z])", "pat_iban": "(?=[A-Z])"}

_NON_ASCII = r"[^\x00-\x7F]"


def _odd_digits() -> str:
    """Digits outside ASCII, with the digit-like signs (superscripts, circled digits)."""
    odd = [c for c in range(128, sys.maxunicode + 1) if chr(c).isdigit() and not chr(c).isdecimal()]
    spans: list[list[int]] = []
    for code in odd:
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    signs = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans)
    return f"[{_NON_ASCII}&&[\\p{{Nd}}{signs}]]"


_ODD_DIGITS = _odd_digits()


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def digit_count(text: Column) -> Column:
    plain = F.length(F.regexp_replace(text, "[^0-9]+", ""))
    return plain + F.when(is_ascii(text), 0).otherwise(F.regexp_count(text, F.lit(_ODD_DIGITS)))


def pattern_matches(name: str, text: Column) -> Column:
    """All matches of one identifier pattern, as an array."""
    subject = F.lower(text) if name == "pat_money" else text
    return F.regexp_extract_all(subject, F.lit("(?U)" + _GUARDS.get(name, "") + PATTERNS[name]), F.lit(0))


def pattern_count(name: str, text: Column, digits: Column | None = None) -> Column:
    """Number of matches of one identifier pattern."""
    count = F.size(pattern_matches(name, text))
    if name == "pat_email":
        return F.when(F.contains(text, F.lit("@")), count).otherwise(0)
    if name in _MIN_DIGITS and digits is not None:
        return F.when(digits >= _MIN_DIGITS[name], count).otherwise(0)
    return count


def is_card_number(span: Column) -> Column:
    """16 digits that pass the Luhn check."""
    plain = F.regexp_replace(span, "[^0-9]", "")
    return (F.length(plain) == 16) & F.call_function("luhn_check", plain)


def card_valid_count(text: Column, digits: Column | None = None) -> Column:
    count = F.size(F.filter(pattern_matches("pat_card_like", text), is_card_number))
    return count if digits is None else F.when(digits >= 16, count).otherwise(0)


def keyword_count(words: list[str], lowered: Column) -> Column:
    """Sum of substring counts; lengths in bytes, as the keywords are ASCII.

    The byte-wise ``contains`` is cheap and mostly false; only texts with the keyword
    pay for the replacement that counts it.
    """
    total = F.lit(0)
    for word in words:
        gone = F.octet_length(lowered) - F.octet_length(F.replace(lowered, F.lit(word), F.lit("")))
        count = (gone / len(word)).cast("int")
        total = total + F.when(F.contains(lowered, F.lit(word)), count).otherwise(0)
    return total


def mask_match(match: Column) -> Column:
    """Keep the first two characters of a hit and its length."""
    return F.concat(F.substring(match, 1, 2), F.lit("***"), F.length(match).cast("string"))


def identifier_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the 15 feature columns to a table with a text column; a narrow projection."""
    col = F.col(text)
    staged = df.select(
        "*",
        digit_count(col).alias("__digits"),
        F.lower(col).alias("__lower"),
    )
    digits, lowered = F.col("__digits"), F.col("__lower")
    counts = {"pat_card_valid": card_valid_count(col, digits)}
    for name in PATTERNS:
        counts[name] = pattern_count(name, col, digits)
    counts["kw_sensitive"] = keyword_count(SENSITIVE_WORDS, lowered)
    counts["kw_credential"] = keyword_count(CREDENTIAL_WORDS, lowered)
    counts["meta_len"] = F.length(col) / F.lit(1000.0)
    counts["meta_digit_ratio"] = digits / F.greatest(F.length(col), F.lit(1))
    return staged.select(*df.columns, *[counts[f].cast("double").alias(f) for f in FEATURE_NAMES])
