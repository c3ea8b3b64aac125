"""Small text functions: token estimates, ages, cuts and secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / 4))


def fit_lines(lines: list[str], budget: int) -> tuple[list[str], int]:
    """The first lines that fit a budget of tokens, and how many were left out."""
    used = 0
    for k, line in enumerate(lines):
        used += max(1, len(line) // 4)
        if used > budget:
            return lines[:k], len(lines) - k
    return lines, 0


def age(then: Column, now: Column) -> Column:
    """Time between two timestamps in its largest unit: ``40s``, ``4m``, ``3h`` or ``2d``."""
    s = F.greatest(F.lit(0).cast("long"), F.unix_seconds(now) - F.unix_seconds(then))
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    return F.when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


#: Public shapes of credentials; a list of our own.
SECRETS = (
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
    r"(?i)\b(?:api[_-]?key|secret|token|password)\b\s*[:=]\s*['\"][^'\"\s]{8,}['\"]",
)


def redacted(text: Column) -> tuple[Column, Column]:
    """A text with its credentials as ``[redacted]``, and their number."""
    out, n = text, F.lit(0)
    for p in SECRETS:
        n = n + F.size(F.regexp_extract_all(out, F.lit(p), F.lit(0)))
        out = F.regexp_replace(out, p, "[redacted]")
    return out, n
