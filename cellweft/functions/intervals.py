"""Genomic intervals: 0-based, half-open, on a chromosome."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = r"^(?:.*::)?([^:]+):(\d+)-(\d+)$"


def parse(name: Column) -> Column:
    """Struct chrom, start, end of ``chr:start-end`` (also behind ``MARK::``); null if it isn't one."""
    got = F.struct(F.regexp_extract(name, NAME, 1).alias("chrom"), F.regexp_extract(name, NAME, 2).try_cast("bigint").alias("start"), F.regexp_extract(name, NAME, 3).try_cast("bigint").alias("end"))
    return F.when(name.rlike(NAME), got)


def parse_positive(name: Column) -> Column:
    """As ``parse``, but null where the end isn't after the start."""
    got = parse(name)
    return F.when(got["end"] > got["start"], got)


def format_name(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return ~((e1 <= s2) | (s1 >= e2))


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.least(e1, e2) - F.greatest(s1, s2)


def distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """0 if they overlap, else the signed gap; adjacent intervals are 1 apart, negative if the second is left."""
    return F.when(overlaps(s1, e1, s2, e2), F.lit(0)).when(s2 >= e1, s2 - e1 + 1).otherwise(e2 - s1 - 1).cast("bigint")


def midpoint(start: Column, end: Column) -> Column:
    return F.floor((start + end) / 2)


def signed_distance_to_tss(start: Column, end: Column, tss: Column, strand: Column) -> Column:
    off = midpoint(start, end) - tss
    return F.when(strand == "+", off).otherwise(-off)


def tss_of(start: Column, end: Column, strand: Column) -> Column:
    """0-based transcription start of 1-based inclusive coordinates."""
    return F.when(F.coalesce(strand, F.lit("+")) != "-", start - 1).otherwise(end - 1)


def gene_region(start: Column, end: Column, strand: Column, kind: str, promoter: int) -> Column:
    """Struct start, end of a gene's body, promoter or both; null if it is empty."""
    plus = strand != "-"
    if kind == "gene_body":
        s, e = start, end
    elif kind == "promoter":
        s, e = F.when(plus, start - promoter).otherwise(end - 1), F.when(plus, start + 1).otherwise(end + promoter)
    elif kind == "combined":
        s, e = F.when(plus, start - promoter).otherwise(start), F.when(plus, end).otherwise(end + promoter)
    else:
        raise ValueError(f"unknown gene region {kind!r}")
    s = F.greatest(s, F.lit(0))
    return F.when(e > s, F.struct(s.cast("bigint").alias("start"), e.cast("bigint").alias("end")))


def edge_weight(dist: Column, mode: str, alpha: Column | float = 1.0, decay: Column | float = 20000.0) -> Column:
    alpha, decay = (x if isinstance(x, Column) else F.lit(float(x)) for x in (alpha, decay))
    d = F.abs(dist)
    if mode == "exp":
        return alpha * F.exp(-d / F.greatest(F.lit(1.0), decay))
    if mode == "power":
        return alpha * F.pow((d + 1000) / 1000, F.lit(-0.75))
    if mode == "binary":
        return F.lit(1.0)
    raise ValueError(f"unknown weight mode {mode!r}")


def normalize_chrom(chrom: Column, mode: str = "keep") -> Column:
    if mode == "keep":
        return chrom
    if mode == "add_chr":
        return F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))
    if mode == "remove_chr":
        return F.when(chrom.startswith("chr"), F.substring(chrom, 4, 1 << 20)).otherwise(chrom)
    raise ValueError(f"unknown chromosome mode {mode!r}")


def gtf_attribute(attributes: Column, key: str) -> Column:
    """Value of an attribute ``key "value";``, null if absent."""
    got = F.regexp_extract(attributes, rf'(?:^|[; ]){key} "([^"]*)"', 1)
    return F.when(got != "", got)
