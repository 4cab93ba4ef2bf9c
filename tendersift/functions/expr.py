"""Column expressions shared by the detectors. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from tendersift.schemas import COMPETITIVE_METHODS

MICROS_PER_DAY = 86_400_000_000
MICROS_PER_HOUR = 3_600_000_000


def flag(condition: Column) -> Column:
    """1 where the condition is true, 0 where it is false or unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def competitive_method(method: str = "procurement_method") -> Column:
    return F.col(method).isin(*COMPETITIVE_METHODS)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is null where the denominator is zero or null."""
    return F.try_divide(numerator.cast("double"), F.nullif(denominator.cast("double"), F.lit(0.0)))


def between_open(value: Column, low: float, high: float) -> Column:
    """low <= value < high"""
    return (value >= low) & (value < high)


def divisible(value: Column, step: int) -> Column:
    return (value % F.lit(float(step))) == 0


def ends_with_99(value: Column) -> Column:
    return (F.floor(value).cast("long") % 100) == 99


def first_digit(value: Column) -> Column:
    """First significant digit of a positive number as text shows it; null below 0.1."""
    text = F.regexp_extract(value.cast("string"), r"^0*\.?([0-9])", 1)
    return F.when(value >= 0.1, text.try_cast("int"))


def leading_digit(value: Column) -> Column:
    """First character of the number as an integer: 0 for values below one."""
    return F.when(value >= 1, first_digit(value)).otherwise(F.when(value.isNotNull(), F.lit(0)))


def log1p_clipped(value: Column) -> Column:
    return F.log1p(F.greatest(value.cast("double"), F.lit(0.0)))


def bucket_right(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval (edge, next edge] that holds the value; null outside all of them."""
    out = None
    for low, high, label in zip(edges[:-1], edges[1:], labels, strict=True):
        hit = (value > low) & (value <= high)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def bucket_left(value: Column, upper: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the first upper bound above the value; the last label is open-ended."""
    out = F.when(value < upper[0], labels[0])
    for bound, label in zip(upper[1:], labels[1:], strict=False):
        out = out.when(value < bound, label)
    return out.when(value.isNotNull(), labels[-1])


# Edges and names of the risk levels and value bands.
LEVELS = ("low", "medium", "high", "critical")
RULE_EDGES = (-1, 2, 5, 10, 1000)
STAT_EDGES = (-0.1, 1, 4, 8, 100)
ML_EDGES = (0, 0.5, 0.75, 0.9, 1.01)
VALUE_BOUNDS = (50_000, 200_000, 1_000_000, 10_000_000)
VALUE_BANDS = ("<50K", "50K-200K", "200K-1M", "1M-10M", ">10M")


def rule_level(score: Column) -> Column:
    return bucket_right(score, RULE_EDGES, LEVELS)


def stat_level(score: Column) -> Column:
    return bucket_right(score, STAT_EDGES, LEVELS)


def ml_level(score: Column) -> Column:
    """A score of exactly 0 lies outside the lowest interval and has no level."""
    return bucket_right(score, ML_EDGES, LEVELS)


def consensus_level(share: Column) -> Column:
    return (
        F.when(share >= 0.75, "critical").when(share >= 0.5, "high")
        .when(share >= 0.25, "medium").otherwise("low")
    )


def value_band(value: Column) -> Column:
    return bucket_left(value, VALUE_BOUNDS, VALUE_BANDS)


def micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def whole_days(start: Column, end: Column) -> Column:
    """Whole days from start to end, cut towards zero."""
    return ((micros(end) - micros(start)) / F.lit(float(MICROS_PER_DAY))).cast("long")


def hours_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(MICROS_PER_HOUR))


def lenient_timestamp(text: Column) -> Column:
    """Timestamp of an ISO text, null where it cannot be read."""
    return F.try_to_timestamp(text)


def lookup(code: Column, names: Mapping[int, str], default: str) -> Column:
    """Name of a code out of a small fixed mapping."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit(default))


def distinct_with_null(column: str) -> Column:
    """Distinct values, where a null counts as one more value."""
    return F.count_distinct(F.col(column)) + F.max(F.col(column).isNull().cast("int"))


def hhi(amounts: Column, whole: Column) -> Column:
    """Sum of squared shares of a whole, as one aggregate."""
    return ratio(F.sum(amounts * amounts), F.sum(whole) * F.sum(whole))


def chi2_sf_df8(x: Column) -> Column:
    """Upper tail of the chi-square distribution with 8 degrees of freedom (closed form)."""
    h = x / 2
    return F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)
