"""Validation, secret redaction and injection flags."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.functions.pytext import is_blank, java_pattern, printable_share, replace_each
from recallspark.settings import DEFAULTS, Settings


@dataclass(frozen=True)
class Secret:
    pattern: str
    hint: str  # literal that every match contains; skips the pattern where absent


# Secret patterns, in the order they are applied.
SECRETS = (
    Secret(r"sk-ant-[a-zA-Z0-9]{20,}", "sk-ant-"),
    Secret(r"sk-[a-zA-Z0-9]{20,}", "sk-"),
    Secret(r"AKIA[A-Z0-9]{16}", "AKIA"),
    Secret(r"ghp_[a-zA-Z0-9]{30,}", "ghp_"),
    Secret(r"xox[bpsa]-[a-zA-Z0-9-]+", "xox"),
)

@dataclass(frozen=True)
class Injection:
    pattern: str
    hint: str  # lower-case word that every match contains, in any spelling of case


# Phrases that look like prompt injection, case-insensitive.
INJECTIONS = (
    Injection(r"ignore\s+(all\s+)?previous\s+instructions", "previous"),
    Injection(r"ignore\s+(all\s+)?above\s+instructions", "above"),
    Injection(r"disregard\s+(all\s+)?previous", "previous"),
    Injection(r"forget\s+(all\s+)?previous", "previous"),
    Injection(r"you\s+are\s+now\s+(a|an)\s+", "now"),
    Injection(r"new\s+instructions?\s*:", "instruction"),
    Injection(r"system\s*:\s*you\s+are", "system"),
    Injection(r"<\s*system\s*>", "system"),
    Injection(r"<\s*/?\s*instructions?\s*>", "instruction"),
    Injection(r"\[SYSTEM\]", "[system]"),
    Injection(r"\[INST\]", "[inst]"),
)

# Letters that equal an ASCII letter when case is ignored but do not lower to it.
_FOLDED = "\u017f\u0131\u0130\u212a"

# Replacement and messages.
REDACTED = "[REDACTED_SECRET]"
SECRET_WARNING = "Redacted potential secret matching pattern: "
INJECTION_WARNING = "Chunk contains text matching injection pattern: "
EMPTY_REASON = "Empty content"
LONG_REASON = "Content exceeds maximum length"
BINARY_REASON = "Content is mostly non-printable"


def reject_reason(text: Column, settings: Settings = DEFAULTS) -> Column:
    """Why a chunk must not be stored; NULL for a valid one."""
    size = F.length(text)
    share = printable_share(text)
    limit = settings.max_content_chars
    return (
        F.when(text.isNull() | is_blank(text), F.lit(EMPTY_REASON))
        .when(size > limit, F.format_string(f"{LONG_REASON} (%d > {limit})", size))
        .when(
            share < settings.min_printable_share,
            F.format_string(f"{BINARY_REASON} (%d%% printable)", F.bround(share * 100).cast("int")),
        )
    )


def validate(chunks: DataFrame, text: str = "content", settings: Settings = DEFAULTS) -> DataFrame:
    reason = reject_reason(F.col(text), settings)
    return chunks.withColumn("reject_reason", reason).withColumn(
        "is_valid", F.col("reject_reason").isNull()
    )


def redact(
    chunks: DataFrame, text: str = "content", secrets: tuple[Secret, ...] = SECRETS
) -> DataFrame:
    """Replace secrets in `text`; add `secret_counts`, matches per pattern."""
    out = chunks
    for i, secret in enumerate(secrets):
        current = F.col(text)
        found = F.when(
            F.contains(current, F.lit(secret.hint)),
            F.regexp_extract_all(current, F.lit(secret.pattern), F.lit(0)),
        ).otherwise(F.array().cast("array<string>"))
        out = out.withColumn("_found", found)
        cleaned = F.when(F.size("_found") == 0, current).otherwise(
            replace_each(current, F.col("_found"), lambda m: m, lambda m: F.lit(REDACTED))
        )
        out = out.withColumn(text, cleaned).withColumn(f"_secret{i}", F.size("_found"))
    counts = [f"_secret{i}" for i in range(len(secrets))]
    return out.withColumn("secret_counts", F.array(*counts)).drop("_found", *counts)


def _injection_hints(text: Column, patterns: tuple[Injection, ...]) -> Column:
    """The hint words in a text; all of them where lower-casing could hide one."""
    words = sorted({p.hint for p in patterns})
    lowered = F.lower(text)
    unsure = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in _FOLDED])
    present = [F.when(F.contains(lowered, F.lit(w)), F.lit(w)) for w in words]
    return F.when(unsure, F.array(*map(F.lit, words))).otherwise(F.array_compact(F.array(*present)))


def flag_injections(
    chunks: DataFrame,
    text: str = "content",
    out: str = "flags",
    patterns: tuple[Injection, ...] = INJECTIONS,
) -> DataFrame:
    """Add `out`: the patterns that occur in the text, in list order.

    One pass looks for the words without which no pattern can match; most texts
    hold none, and a pattern runs only where its word is.
    """
    hinted = chunks.withColumn("_hints", _injection_hints(F.col(text), patterns))
    found = [
        F.when(
            F.array_contains("_hints", p.hint)
            & F.col(text).rlike(java_pattern(p.pattern, ignore_case=True)),
            F.lit(p.pattern),
        )
        for p in patterns
    ]
    flags = F.when(F.size("_hints") == 0, F.array().cast("array<string>")).otherwise(
        F.array_compact(F.array(*found))
    )
    return hinted.withColumn(out, flags).drop("_hints")


def sanitize(
    chunks: DataFrame,
    text: str = "content",
    secrets: tuple[Secret, ...] = SECRETS,
    injections: tuple[Injection, ...] = INJECTIONS,
) -> DataFrame:
    """Redact, then flag the redacted text; add `warnings`.

    One warning per secret found and one per injection pattern that occurs.
    """
    clean = flag_injections(redact(chunks, text, secrets), text, "_flags", injections)
    secret_warnings = F.flatten(
        F.array(
            *[
                F.array_repeat(F.lit(SECRET_WARNING + s.pattern), F.get("secret_counts", F.lit(i)))
                for i, s in enumerate(secrets)
            ]
        )
    )
    flags = F.transform("_flags", lambda p: F.concat(F.lit(INJECTION_WARNING), p))
    return clean.withColumn("warnings", F.concat(secret_warnings, flags)).drop(
        "secret_counts", "_flags"
    )


def hygiene_report(checked: DataFrame, key: str, findings: str = "findings") -> DataFrame:
    """Rows per key and finding; counted before the shuffle."""
    return (
        checked.select(key, F.explode_outer(findings).alias("finding"))
        .filter("finding IS NOT NULL")
        .groupBy(key, "finding")
        .agg(F.count(F.lit(1)).alias("n"))
    )
