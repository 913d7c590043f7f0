"""Stripping, missing values and default chains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The texts that stand for "no value".
MISSING = ("", "NA", "N/A", "na", "n/a", "None", "none")
MISSING_DASH = ("", "NA", "N/A", "na", "n/a", "None", "none", "-")
NON_INFORMATIVE = ("", "NA", "N/A", "na", "n/a", "None", "none", "-", "not_assessed", "evidence_rejected")

# Every character that counts as surrounding white space.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.trim(as_col(c), F.lit(WHITESPACE))


def text(c: Column | str) -> Column:
    """Stripped text with null as the empty string."""
    return F.coalesce(strip(c), F.lit(""))


def is_missing(c: Column | str, sentinels: Sequence[str] = MISSING_DASH) -> Column:
    c = as_col(c)
    return c.isNull() | strip(c).isin(*sentinels)


def present(c: Column | str, sentinels: Sequence[str] = MISSING_DASH) -> Column:
    return ~is_missing(c, sentinels)


def null_if_missing(c: Column | str, sentinels: Sequence[str] = MISSING_DASH) -> Column:
    return F.when(present(c, sentinels), strip(c))


def is_informative(c: Column | str) -> Column:
    return present(c, NON_INFORMATIVE)


def safe_value(c: Column | str) -> Column:
    return F.coalesce(null_if_missing(c), F.lit("NA"))


def first_present(*cols: Column | str, sentinels: Sequence[str] = MISSING_DASH) -> Column:
    return F.coalesce(*[null_if_missing(c, sentinels) for c in cols])


def alias_coalesce(
    df: DataFrame, aliases: Sequence[str], fold_dots: bool = False, sentinels: Sequence[str] = MISSING_DASH
) -> Column:
    """The first value present in a row: exact column names first, then folded ones."""

    def fold(name: str) -> str:
        name = name.lower().replace(" ", "_")
        return name.replace(".", "_") if fold_dots else name

    exact = [a for a in aliases if a in df.columns]
    folded = {fold(c): c for c in df.columns}
    loose = [folded[fold(a)] for a in aliases if fold(a) in folded]
    names = list(dict.fromkeys(exact + loose))
    if not names:
        return F.lit(None).cast("string")
    return first_present(*[F.col(f"`{n}`").cast("string") for n in names], sentinels=sentinels)


def fill_defaults(
    df: DataFrame, spec: Mapping[str, object], defaults: Mapping[str, str], label_column: str = "source"
) -> DataFrame:
    """Fill every column of ``defaults``: value, ``<column>_default``, source label, default."""

    def default_for(name: str) -> str:
        if f"{name}_default" in spec:
            return str(spec[f"{name}_default"] or "").strip()
        if name == label_column and spec.get("source_label"):
            return str(spec["source_label"]).strip()
        return defaults[name]

    filled = [
        F.coalesce(null_if_missing(name) if name in df.columns else F.lit(None), F.lit(default_for(name))).alias(name)
        for name in defaults
    ]
    return df.select(*[c for c in df.columns if c not in defaults], *filled)
