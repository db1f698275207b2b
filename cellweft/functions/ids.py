"""Identity rules as Column expressions; every join key goes through one of them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ABSENT_DONORS = ("", "na", "nan", "none")
TRUE_FLAGS = ("true", "t", "1", "yes")
TRUE_WORDS = ("true", "1", "yes", "y")
MISSING = "__missing__"
MISSING_WORDS = ("", "na", "nan", "none", "null", "<na>", "unknown")


def strip(x: Column) -> Column:
    """Trim any white space, not only spaces."""
    return F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"\s+$", "")


def normalize_barcode(x: Column) -> Column:
    """Trim, drop one ``.digits`` at the end, then one ``-digits``; one pass, as this runs on every row."""
    return F.regexp_replace(x, r"^\s+|(?:-\d+)?(?:\.\d+)?\s*$", "")


def strip_10x_suffix(x: Column) -> Column:
    """Drop ``-digits`` at the end and nothing else."""
    return F.regexp_replace(x, r"-\d+$", "")


def barcode_variants(x: Column) -> Column:
    """The spellings under which a whitelisted barcode may appear."""
    norm = normalize_barcode(x)
    return F.array_distinct(F.array(x, norm, F.concat(norm, F.lit("-1")), F.concat(norm, F.lit(".1"))))


def obs_id(modality: Column, cell: Column) -> Column:
    return F.concat_ws("::", modality, cell)


def namespaced(mark: Column, feature: Column) -> Column:
    return F.concat(mark, F.lit("::"), feature)


def bare_feature(x: Column) -> Column:
    return F.element_at(F.split(x, "::"), -1)


def trim_version(x: Column) -> Column:
    """Gene id without its version."""
    return F.regexp_replace(x, r"\.\d+$", "")


def sanitize_token(x: Column) -> Column:
    """Lower case, other runs to ``_``; empty becomes ``value``."""
    token = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(token == "", F.lit("value")).otherwise(F.coalesce(token, F.lit("value")))


def sanitize(x: object) -> str:
    """``sanitize_token`` for the driver."""
    return re.sub(r"[^a-z0-9]+", "_", str(x).lower()).strip("_") or "value"


def to_bool(x: Column) -> Column:
    return F.coalesce(F.lower(strip(x)).isin(*TRUE_FLAGS), F.lit(False))


def as_bool(x: Column) -> Column:
    return F.coalesce(F.lower(strip(x)).isin(*TRUE_WORDS), F.lit(False))


def donor_present(x: Column) -> Column:
    return ~F.lower(strip(F.coalesce(x, F.lit("")))).isin(*ABSENT_DONORS)


def covariate(x: Column) -> Column:
    """Missing spellings of a covariate become one category."""
    return F.when(x.isNull() | F.lower(strip(x)).isin(*MISSING_WORDS), F.lit(MISSING)).otherwise(x)


def int_of_text(x: Column) -> Column:
    """Integer part of a number in text, null if it is none."""
    return x.try_cast("double").try_cast("bigint")
