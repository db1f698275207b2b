import pytest
from pyspark.sql import functions as F

from cellweft.functions import ids, intervals, scores
from cellweft.operators.guidance import MARK_DEFAULTS, ids_trim, mark_defaults


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("AAA-1", "AAA"), ("AAA.1", "AAA"), ("AAA-1.2", "AAA"), (" AAA \t", "AAA"), ("AAA-1-2", "AAA-1"), ("AAA", "AAA"), ("", ""), ("A-x", "A-x")])
def test_normalize_barcode(spark, raw, want):
    assert one(spark, ids.normalize_barcode(F.col("b")), b=raw) == want


def test_other_ids(spark):
    assert one(spark, ids.strip_10x_suffix(F.col("b")), b=" A.1-12") == " A.1"
    assert sorted(one(spark, ids.barcode_variants(F.col("b")), b="A-7")) == ["A", "A-1", "A-7", "A.1"]
    assert one(spark, ids.sanitize_token(F.col("b")), b=" --Ab C/9__") == "ab_c_9" == ids.sanitize(" --Ab C/9__")
    assert one(spark, ids.sanitize_token(F.col("b")), b="//") == "value"
    assert one(spark, ids.bare_feature(F.col("b")), b="H3::chr1:1-2") == "chr1:1-2"
    assert one(spark, ids.trim_version(F.col("b")), b="ENSG1.12") == "ENSG1" == ids_trim("ENSG1.12")
    assert [one(spark, ids.to_bool(F.col("b")), b=v) for v in ("TRUE", " t ", "0", "y", None)] == [True, True, False, False, False]
    assert [one(spark, ids.as_bool(F.col("b")), b=v) for v in ("Yes", "y", "t")] == [True, True, False]
    assert [one(spark, ids.donor_present(F.col("b")), b=v) for v in ("NA", "nan", " None ", "", None, "d1")] == [False] * 5 + [True]
    assert [one(spark, ids.int_of_text(F.col("b")), b=v) for v in ("12.0", "12.9", "-3.7", "abc", "")] == [12, 12, -3, None, None]
    assert [one(spark, ids.covariate(F.col("b")), b=v) for v in ("NA", None, "x")] == [ids.MISSING, ids.MISSING, "x"]


def test_interval_names(spark):
    assert tuple(one(spark, intervals.parse(F.col("b")), b="K::chr1:5-9")) == ("chr1", 5, 9)
    assert one(spark, intervals.parse(F.col("b")), b="chr1:5_9") is None
    assert one(spark, intervals.parse_positive(F.col("b")), b="chr1:9-9") is None


@pytest.mark.parametrize(("a", "b", "want"), [((0, 10), (10, 20), 1), ((0, 10), (9, 20), 0), ((0, 10), (15, 20), 6), ((15, 20), (0, 10), -6), ((0, 10), (2, 3), 0), ((5, 6), (5, 6), 0)])
def test_distance(spark, a, b, want):
    assert one(spark, intervals.distance(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=a[0], b=a[1], c=b[0], d=b[1]) == want


@pytest.mark.parametrize(("kind", "strand", "want"), [("promoter", "+", (900, 1001)), ("promoter", "-", (1999, 2100)), ("combined", "+", (900, 2000)), ("combined", "-", (1000, 2100)), ("gene_body", "-", (1000, 2000))])
def test_gene_region(spark, kind, strand, want):
    got = one(spark, intervals.gene_region(F.col("s"), F.col("e"), F.col("x"), kind, 100), s=1000, e=2000, x=strand)
    assert tuple(got) == want


def test_gene_region_is_clamped_and_modes_are_checked(spark):
    assert tuple(one(spark, intervals.gene_region(F.col("s"), F.col("e"), F.col("x"), "promoter", 100), s=50, e=80, x="+")) == (0, 51)
    for f in (lambda: intervals.gene_region(F.col("s"), F.col("s"), F.col("s"), "no", 1), lambda: intervals.edge_weight(F.col("d"), "no"), lambda: intervals.normalize_chrom(F.col("c"), "no"), lambda: scores.region_score(F.col("c"), F.col("c"), F.col("c"), mode="no")):
        with pytest.raises(ValueError):
            f()


def test_positions_and_weights(spark):
    assert one(spark, intervals.signed_distance_to_tss(F.col("s"), F.col("e"), F.col("t"), F.col("x")), s=10, e=21, t=20, x="-") == 5
    assert [one(spark, intervals.tss_of(F.col("s"), F.col("e"), F.col("x")), s=11, e=20, x=v) for v in "+-"] == [10, 19]
    assert one(spark, intervals.edge_weight(F.col("d"), "exp", 2.0, 0.5), d=1) == pytest.approx(2 * 2.718281828**-1)
    assert one(spark, intervals.edge_weight(F.col("d"), "power"), d=0) == 1.0
    assert [one(spark, intervals.normalize_chrom(F.col("c"), m), c="chrX") for m in ("keep", "add_chr", "remove_chr")] == ["chrX", "chrX", "X"]
    assert one(spark, intervals.gtf_attribute(F.col("a"), "gene_id"), a='gene_id "G1.2"; havana_gene_id "H"; gene_name "N";') == "G1.2"
    assert one(spark, intervals.gtf_attribute(F.col("a"), "missing"), a='gene_id "G1";') is None


def test_scores(spark):
    assert one(spark, scores.log1p_norm(F.col("x"), F.col("l")), x=1.0, l=0.0) == 0
    assert one(spark, scores.region_score(F.col("x"), F.col("n"), F.col("l")), x=4.0, n=2, l=0.0) == pytest.approx(9.903537553, abs=1e-6)
    assert one(spark, scores.region_score(F.col("x"), F.col("n"), F.col("l")), x=4.0, n=0, l=1.0) is None
    roles = {"expr__A_log1p": "expr", "promoter_1__H3K4me3": "promoter", "FIRE__H3K27ac": "distal", "ure2__H3K4me1": "distal", "chr1:1-2__H3K27ac": "other", "enhancer": "other"}
    assert {n: one(spark, scores.node_role(F.col("n")), n=n) for n in roles} == roles
    assert one(spark, scores.gene_base_name(F.col("n")), n="expr__CD14_raw_counts") == "CD14"
    assert one(spark, scores.peak_mark(F.col("n")), n="chr1:1-2__H3K27ac") == "H3K27ac"
    kinds = {("TAIL", "ARROW"): "directed", ("ARROW", "TAIL"): "directed", ("TAIL", "TAIL"): "undirected", ("CIRCLE", "ARROW"): "partial", ("ARROW", "ARROW"): "partial"}
    assert {k: one(spark, scores.edge_kind(F.col("a"), F.col("b")), a=k[0], b=k[1]) for k in kinds} == kinds
    assert one(spark, scores.edge_text(F.col("a"), F.lit("TAIL"), F.col("b"), F.lit("ARROW")), a="x", b="y") == "x --> y"


def test_mark_defaults():
    assert mark_defaults("H3K4me3") == (1, 150_000, 75_000.0, 1.0)
    assert mark_defaults("H3K4me3", "shared_gene") == (1, 25_000, 10_000.0, 1.0)
    assert all(v[0] in (-1, 1) for v in MARK_DEFAULTS.values())
