"""Number parsing, formatting, bins and intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from evispark.functions.missing import as_col, is_missing, strip


#: The texts that are numbers. Casts alone also take type suffixes such as the d of ``12d``.
NUMBER_TEXT = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"


def number_in(c: Column) -> Column:
    """The number a stripped text is, null for any other text."""
    return F.when(c.rlike(NUMBER_TEXT), c.try_cast("double"))


def to_double(c: Column | str) -> Column:
    """Lenient: null unless the text is a number, which no text for a missing value is."""
    return number_in(strip(as_col(c).cast("string")))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def to_int(c: Column | str) -> Column:
    """Lenient: the number cut to an integer, null for anything else."""
    return F.get(F.transform(F.array(to_double(c)), lambda value: F.when(finite(value), value.try_cast("bigint"))), 0)  # parsed once


def to_int_or(c: Column | str, default: int = 0) -> Column:
    return F.coalesce(to_int(c), F.lit(default).cast("bigint"))


def is_integer_text(c: Column | str) -> Column:
    return F.coalesce(strip(c).rlike(r"^[+-]?\d+$"), F.lit(False))


def strict_number(
    c: Column | str, lo: float | None = None, hi: float | None = None, integer: bool = False, percent: bool = False
) -> Column:
    """A struct of the value and the reason it was refused.

    Missing text gives neither. ``percent`` turns values above one into fractions;
    ``integer`` wants a whole number above zero.
    """
    # The array of one number binds it to a name; a plain column would be parsed again wherever it is read.
    missing = is_missing(c)

    def checked(value: Column) -> Column:
        problem = F.when(value.isNull(), F.when(~missing, "not_numeric")).when(
            F.isnan(value) | (F.abs(value) == float("inf")), "non_finite"
        )
        if integer:
            problem = problem.when(value != F.floor(value), "not_integer").when(value <= 0, "not_positive")
        if lo is not None:
            problem = problem.when(value < lo, "below_minimum")
        if hi is not None:
            problem = problem.when(value > hi, "above_maximum")
        return F.struct(value.alias("value"), problem.alias("problem"))

    def settled(read: Column) -> Column:
        value = read["value"]
        kept = F.when(value > 1, value / 100).otherwise(value) if percent else value
        return F.struct(F.when(read["problem"].isNull(), kept).alias("value"), read["problem"].alias("problem"))

    return F.get(F.transform(F.transform(F.array(number_in(strip(c))), checked), settled), 0)


def year_from(c: Column | str) -> Column:
    year = F.regexp_extract(as_col(c), r"((?:19|20)\d{2})", 1)
    return F.when(is_missing(c), "NA").when(year != "", year).otherwise(as_col(c))


def fmt(c: Column | str, digits: int = 3, trim: bool = False) -> Column:
    """Fixed-point text for sinks, halves to even as the table format wants."""
    shown = F.format_string(f"%.{digits}f", F.bround(as_col(c), digits))
    # Rounding to zero loses the sign, which the table format keeps.
    lost = as_col(c).cast("string").startswith("-") & ~shown.startswith("-")
    shown = F.concat(F.when(lost, "-").otherwise(""), shown)
    if trim:
        shown = F.regexp_replace(shown, r"\.?0+$", "") if digits else shown
    return shown


def gc_from(c: Column | str) -> Column:
    bare = F.rtrim(strip(c), F.lit("%"))
    number = number_in(bare)
    return (
        F.when(is_missing(bare), "NA")
        .when(number.isNull(), bare)
        .otherwise(fmt(F.when(number <= 1, number * 100).otherwise(number), 3, trim=True))
    )


def count_bin(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(c <= 0, "0").when(c == 1, "1").otherwise("2plus")


def score_bin(c: Column | str, cuts: Sequence[tuple[float, str]], below: str, none: str = "no_score") -> Column:
    """The label of the first cut the score reaches; cuts come highest first."""
    c = as_col(c)
    chain = F.when(c.isNull(), none)
    for cut, label in cuts:
        chain = chain.when(c >= cut, label)
    return chain.otherwise(below)


def size_bin(c: Column | str) -> Column:
    c = F.coalesce(as_col(c), F.lit(0))
    return (
        F.when(c <= 0, "unknown_cluster_size")
        .when(c == 1, "singleton_species_like_cluster")
        .otherwise("multi_genome_species_like_cluster")
    )


def wilson(successes: Column | str, total: Column | str, z: float = 1.96) -> Column:
    """A struct of the lower and upper Wilson bounds, null for an empty total."""
    n = as_col(total).cast("double")
    p = as_col(successes).cast("double") / F.nullif(n, F.lit(0.0))
    denominator = 1 + z * z / n
    centre = p + z * z / (2 * n)
    margin = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    inside = n > 0
    return F.struct(
        F.when(inside, (centre - margin) / denominator).alias("low"),
        F.when(inside, (centre + margin) / denominator).alias("high"),
    )


def evidence_state(
    detected: Column | str, assessed: Column | str, total: Column | str, rejected: Column | int = 0
) -> Column:
    """Keep "not assessed" and "rejected" apart from an assessed zero."""
    detected, assessed, total = as_col(detected), as_col(assessed), as_col(total)
    rejected = rejected if isinstance(rejected, Column) else F.lit(rejected)
    return (
        F.when(total <= 0, "not_assessed")
        .when((rejected > 0) & (assessed <= 0) & (detected <= 0), "evidence_rejected")
        .when(assessed <= 0, "not_assessed")
        .when(detected <= 0, "assessed_zero_detected")
        .otherwise("assessed_positive")
    )


def fraction(numerator: Column | str, denominator: Column | str) -> Column:
    d = as_col(denominator).cast("double")
    return F.when(d > 0, as_col(numerator).cast("double") / d).otherwise(F.lit(0.0))
