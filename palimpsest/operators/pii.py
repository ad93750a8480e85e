"""Personal data in text: eight detectors, custom patterns, and redaction of what they find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import DETECTORS


def card_digits(match: Column) -> Column:
    return F.regexp_replace(match, r"[\s-]", "")


def is_card(match: Column) -> Column:
    digits = card_digits(match)
    return digits.rlike(r"^\d{13,19}$") & F.call_function("luhn_check", digits)


def found(text: Column, category: str) -> Column:
    """Matches of one detector, left to right, unchanged; cards must pass the Luhn check."""
    matches = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DETECTORS[category]), F.lit(0))
    return F.filter(matches, is_card) if category == "credit_card" else matches


def valid_patterns(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Those that compile as Java patterns; an invalid one is left out and the others still run."""
    java = spark.sparkContext._jvm.java.util.regex.Pattern
    kept = []
    for p in patterns:
        try:
            java.compile(p)
            kept.append(p)
        except Exception:
            continue
    return kept


def detections(text: Column, categories=tuple(DETECTORS), custom: list[str] = ()) -> Column:
    """array<struct(category, match)>: all categories in one projection, so a text is read once and exploded once."""
    tagged = lambda name, xs: F.transform(xs, lambda m: F.struct(F.lit(name).alias("category"), m.alias("match")))
    parts = [tagged(c, found(text, c)) for c in categories]
    parts += [tagged("custom", F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)" + p), F.lit(0))) for p in custom]
    return F.concat(*parts)


def detect(df: DataFrame, text: str = "text", categories=tuple(DETECTORS), custom: list[str] = ()) -> DataFrame:
    """df's other columns, and one row (category, match) for each detection."""
    custom = valid_patterns(df.sparkSession, list(custom))
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.explode(detections(F.col(text), categories, custom)).alias("_d")).select(*keep, "_d.category", "_d.match")


def contains(text: Column, category: str) -> Column:
    """Whether a detector's pattern stands anywhere (cards: without the Luhn check); stops at the first."""
    return F.coalesce(text, F.lit("")).rlike(DETECTORS[category])


def has_pii(text: Column) -> Column:
    """Whether any detector finds something."""
    plain = [contains(text, c) for c in DETECTORS if c != "credit_card"]
    any_ = plain[0]
    for one in plain[1:]:
        any_ |= one
    return any_ | (contains(text, "credit_card") & (F.size(found(text, "credit_card")) > 0))


def mask(text: Column, categories=tuple(DETECTORS), block: str = "█") -> Column:
    """Every match of any detector becomes a run of blocks of its length, longer matches first, of equal ones the greater string: where matches overlap, the first takes the place."""
    longest_first = lambda a, b: F.when(F.char_length(a) != F.char_length(b), F.char_length(b) - F.char_length(a)).when(a > b, -1).when(a < b, 1).otherwise(0)
    matches = F.array_sort(F.array_distinct(F.concat(*[found(text, c) for c in categories])), longest_first)
    return F.aggregate(matches, text, lambda t, m: F.replace(t, m, F.repeat(F.lit(block), F.char_length(m))))
