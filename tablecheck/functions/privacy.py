"""Finding and hiding personal data with JVM-side regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What counts as personal data, in order of precedence.
VALUE_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "ssn": r"\b\d{3}-?\d{2}-?\d{4}\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}

# Column names that suggest personal data.
NAME_PATTERNS = (
    "email",
    "phone",
    "ssn",
    "social.*security",
    "credit.*card",
    "address",
    "name",
    "dob",
    "birth.*date",
)

STRATEGIES = ("mask", "hash", "email", "last4")


def placeholder(kind: str) -> str:
    return f"[REDACTED_{kind.upper()}]"


def is_pii_name(name: Column) -> Column:
    return name.rlike("(?i)" + "|".join(f"(?:{p})" for p in NAME_PATTERNS))


def mask(c: Column) -> Column:
    """Stars for up to 4 characters, 2+2 kept up to 8, 3+3 kept beyond."""
    n = F.length(c)

    def keep(k: int) -> Column:
        return F.concat(F.substring(c, 1, k), F.repeat(F.lit("*"), n - 2 * k), F.substring(c, -k, k))

    return (
        F.when(c.isNull(), F.lit(None))
        .when(n <= 4, F.repeat(F.lit("*"), n))
        .when(n <= 8, keep(2))
        .otherwise(keep(3))
    )


def mask_email(c: Column) -> Column:
    """First letter and domain stay: j***@example.com; other text is masked."""
    at = F.instr(c, "@")
    local = F.when(at > 1, F.substring(c, 1, 1)).otherwise(F.lit(""))
    return F.when(at > 0, F.concat(local, F.lit("***"), c.substr(at, F.length(c)))).otherwise(mask(c))


def mask_last4(c: Column) -> Column:
    n = F.length(c)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.repeat(F.lit("*"), n - 4), F.substring(c, -4, 4))
    )


def hide(c: Column, strategy: str = "mask") -> Column:
    if strategy == "mask":
        return mask(c)
    if strategy == "hash":
        return F.sha2(c, 256)
    if strategy == "email":
        return mask_email(c)
    if strategy == "last4":
        return mask_last4(c)
    raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")


# Cheap conditions every match must meet: an email has an @, every other pattern a
# digit followed by a digit or a dot. Most text meets neither, and then no pattern
# is tried at all; the answer is the same.


def may_have_email(c: Column) -> Column:
    return F.contains(c, F.lit("@"))


def may_have_number(c: Column) -> Column:
    return c.rlike("[0-9][0-9.]")


def may_have(c: Column, kind: str) -> Column:
    return may_have_email(c) if kind == "email" else may_have_number(c)


def _replace(c: Column, kind: str) -> Column:
    return F.regexp_replace(c, VALUE_PATTERNS[kind], placeholder(kind))


_NUMERIC = tuple(k for k in VALUE_PATTERNS if k != "email")


def redact_values(c: Column) -> Column:
    """Replace every match of the first pattern that occurs; other text stays."""
    numbers = c
    for kind in reversed(_NUMERIC):
        numbers = F.when(c.rlike(VALUE_PATTERNS[kind]), _replace(c, kind)).otherwise(numbers)
    return F.when(
        may_have_email(c) & c.rlike(VALUE_PATTERNS["email"]), _replace(c, "email")
    ).otherwise(F.when(may_have_number(c), numbers).otherwise(c))


def redact_text(c: Column) -> Column:
    """All patterns, one after the other. A replacement never puts two digits
    next to each other, so the original text decides what may follow."""
    emails = F.when(may_have_email(c), _replace(c, "email")).otherwise(c)
    numbers = emails
    for kind in _NUMERIC:
        numbers = _replace(numbers, kind)
    return F.when(may_have_number(c), numbers).otherwise(emails)


def count_matches(c: Column, kind: str, possible: Column | None = None) -> Column:
    """Matches of one pattern; `possible` may hold `may_have(c, kind)`."""
    possible = may_have(c, kind) if possible is None else possible
    return F.when(possible, F.regexp_count(c, F.lit(VALUE_PATTERNS[kind]))).otherwise(0)


def has_match(c: Column) -> Column:
    numbers = "|".join(f"(?:{VALUE_PATTERNS[k]})" for k in _NUMERIC)
    found = (may_have_email(c) & c.rlike(VALUE_PATTERNS["email"])) | (
        may_have_number(c) & c.rlike(numbers)
    )
    return F.coalesce(found, F.lit(False))
