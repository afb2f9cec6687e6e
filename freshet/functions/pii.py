"""Personal data in texts: find, count, redact, and policies on it. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories, what they look like and what replaces them.
EMAIL = r"(?iU)(?<![\w.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,63}(?![\w.-])"
PHONE = r"(?<!\d)(?:\+?1[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]\d{3}[\s.-]\d{4}(?!\d)"
US_SSN = r"(?<!\d)(?!000|666|9\d\d)\d{3}[- ](?!00)\d{2}[- ](?!0000)\d{4}(?!\d)"
PAYMENT_CARD = r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)"
PATTERNS = {"email": EMAIL, "phone": PHONE, "us_ssn": US_SSN, "payment_card": PAYMENT_CARD}
REDACTED = {"email": "[REDACTED_EMAIL]", "phone": "[REDACTED_PHONE]", "us_ssn": "[REDACTED_SSN]", "payment_card": "[REDACTED_PAYMENT_CARD]"}

#: What every match of a category has, cheap to look for: texts without it are not searched.
_HINTS = {"email": r"@", "phone": r"\d{4}", "us_ssn": r"\d{4}", "payment_card": r"\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d"}


def _hinted(text: Column, category: str) -> Column:
    return F.contains(text, F.lit("@")) if category == "email" else text.rlike(_HINTS[category])


def luhn_valid(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check and has two different digits at least."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    total = F.aggregate(
        F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))
    )
    return (total % 10 == 0) & ~digits.rlike(r"^(\d)\1*$")


def cards(text: Column) -> Column:
    """Payment cards in a text, as they stand."""
    return F.filter(F.regexp_extract_all(text, F.lit(PAYMENT_CARD), 0), lambda m: luhn_valid(F.regexp_replace(m, "[ -]", "")))


def matches(text: Column, category: str) -> Column:
    found = cards(text) if category == "payment_card" else F.regexp_extract_all(text, F.lit(PATTERNS[category]), 0)
    return F.when(_hinted(text, category), found).otherwise(F.array().cast("array<string>"))


def counts(text: Column) -> dict[str, Column]:
    """Numbers of findings by category; null text has none."""
    t = F.coalesce(text, F.lit(""))
    return {k: F.size(matches(t, k)).cast("long") for k in PATTERNS}


def redact(text: Column, categories: tuple[str, ...] = ("email", "us_ssn", "payment_card", "phone")) -> Column:
    """`text` with findings replaced; card-like numbers that fail the check stay."""
    for k in categories:
        if k == "payment_card":
            text = F.aggregate(matches(text, k), text, lambda t, m: F.replace(t, m, F.lit(REDACTED["payment_card"])))
        else:
            text = F.when(_hinted(text, k), F.regexp_replace(text, PATTERNS[k], REDACTED[k].replace("$", r"\$"))).otherwise(text)
    return text


def findings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, category, match) of every finding; overlapping ones of two categories are both found."""
    named = lambda k: lambda m: F.struct(F.lit(k).alias("category"), m.alias("match"))
    each = F.concat(*[F.transform(matches(F.coalesce(F.col(text), F.lit("")), k), named(k)) for k in PATTERNS])
    return df.select(key, F.explode(each).alias("f")).select(key, "f.category", "f.match")


def enforce(df: DataFrame, text: str, policy: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows that go on, rows set aside with `pii_reason`). policy: category -> allow, redact, deny or quarantine.

    deny and quarantine set a row aside, deny first; redact rewrites the text of those that go on.
    """
    n = counts(F.col(text))
    reason = F.lit(None).cast("string")
    for what in ("quarantine", "deny"):
        for k, v in policy.items():
            if v == what:
                reason = F.when(n[k] > 0, F.lit(f"{what}:{k}")).otherwise(reason)
    marked = df.withColumn("pii_reason", reason)
    redacted = tuple(k for k in ("email", "us_ssn", "payment_card", "phone") if policy.get(k) == "redact")
    return marked.where("pii_reason is null").drop("pii_reason").withColumn(text, redact(F.col(text), redacted)), marked.where("pii_reason is not null")
