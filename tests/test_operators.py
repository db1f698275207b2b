import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweft.operators import assignment, counting, dataset, demux, embedding, families, guidance, matrix, metacells, neighbours, peaks, qc, range_joins, support, transforms
from cellweft.operators.causal import dagma, pc, priors, runner
from cellweft.operators.causal import tests as ci
from cellweft.schema import SchemaError, require_columns, require_unique
from cellweft.sources import toy

BED = "chrom string, start bigint, end bigint, name string"


def intervals_of(seed, n, spark):
    rng = np.random.default_rng(seed)
    rows = [(f"c{rng.integers(2)}", int(s := rng.integers(0, 400)), int(s + rng.integers(1, 60)), f"{seed}_{k}") for k in range(n)]
    return rows, spark.createDataFrame(rows, BED)


@pytest.mark.parametrize("tile", [7, 50, 1000])
def test_overlap_and_window_joins_match_brute_force(spark, tile):
    a, da = intervals_of(1, 60, spark)
    b, db = intervals_of(2, 60, spark)
    got = {(r.a_name, r.b_name) for r in range_joins.overlap_join(da, db, tile=tile).collect()}
    assert got == {(x[3], y[3]) for x, y in itertools.product(a, b) if x[0] == y[0] and x[1] < y[2] and x[2] > y[1]}
    rows = range_joins.overlap_join(da, db, 20, tile).collect()
    assert len(rows) == len({(x[3], y[3]) for x, y in itertools.product(a, b) if x[0] == y[0] and min(x[2], y[2]) - max(x[1], y[1]) >= 20})
    for w in (0, 1, 30):
        near = {(r.a_name, r.b_name): r.distance for r in range_joins.window_join(da, db, w, tile).collect()}
        want = {}
        for x, y in itertools.product(a, b):
            d = 0 if x[1] < y[2] and x[2] > y[1] else y[1] - x[2] + 1 if y[1] >= x[2] else y[2] - x[1] - 1
            if x[0] == y[0] and abs(d) <= w:
                want[x[3], y[3]] = d
        assert near == want


def test_center_join_is_inclusive(spark):
    bins = spark.createDataFrame([("c", 0, 11, "b")], BED)
    genes = spark.createDataFrame([("c", 15, "in"), ("c", 16, "out"), ("c", -5 + 5, "zero")], "chrom string, tss bigint, gene_name string")
    assert {r.b_gene_name for r in range_joins.center_tss_join(bins, genes, 10).collect()} == {"in", "zero"}


def test_toy_counts_keep_their_invariants(spark):
    meta = toy.cells(spark)
    f = toy.fragments(spark)
    cells = qc.clean_cells(meta, qc.fragment_counts(f), 100)
    assert cells.count() == 40
    kept = qc.keep_listed(f, cells)
    p = counting.peak_counts(kept, toy.peaks(spark))
    assert p.agg(F.sum("value")).first()[0] == 40 * 160 and p.select("feature").distinct().count() == 5
    bins = counting.bin_universe(toy.sizes(spark), 1000)
    assert bins.count() == 16
    spans = kept.where(F.floor(F.col("start") / 1000) != F.floor((F.col("end") - 1) / 1000)).count()
    assert counting.bin_counts(kept, 1000, toy.sizes(spark)).agg(F.sum("value")).first()[0] == 40 * 170 + spans


def test_clean_cells_rules(spark):
    meta = spark.createDataFrame([("A-1", " Singlet ", "d1", "TRUE"), ("A.1", "Singlet", "d2", "no"), ("B", "singlet", "d", "TRUE"), ("C", "Singlet", "NA", "TRUE"), ("D", "Singlet", "d", None), (" ", "Singlet", "d", "TRUE")], "barcode string, hto_classification string, donor_id string, singlet_flag string")
    counts = spark.createDataFrame([("A-1", 60), ("A-2", 150), ("C", 500), ("D", 99), ("B", 500)], "barcode string, n bigint")
    got = qc.clean_cells(meta, counts, 100).orderBy(*qc.cell_order()).collect()
    assert [(r.barcode, r.donor_id, r.n_cuttag_fragments, r.singlet_flag) for r in got] == [("A", "d1", 150, True), ("A", "d2", 150, False)]
    assert qc.clean_cells(meta, counts, 100, True).count() == 3


def test_schema_assertions(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    with pytest.raises(SchemaError):
        require_columns(df, ["c"])
    with pytest.raises(SchemaError):
        require_unique(df, ["a"])
    assert require_unique(df, ["b"]) is df


def test_thresholds_and_filters(spark):
    long = spark.createDataFrame([("A", 3.0), ("A", 4.0), ("B", 1.0)], "barcode string, count double")
    assert [tuple(r) for r in qc.count_thresholds(long, long, 7, 7).collect()] == [("A", 7.0, 7.0)]
    with pytest.raises(SchemaError):
        qc.count_thresholds(long, long, 8, 0, required=True)
    vec = spark.createDataFrame([(1, [1.0, 2.0]), (2, [float("nan"), 0.0]), (3, [float("inf"), 0.0]), (4, [None, 1.0])], "id int, emb array<double>")
    assert [r.id for r in qc.finite_vectors(vec).collect()] == [1]
    entries = spark.createDataFrame([("a", "f", 0.0), ("b", "f", 2.0)], "cell string, feature string, value double")
    assert [r.cell for r in qc.non_empty_cells(entries).collect()] == ["b"]


def test_region_scores_edge_cases(spark):
    entries = spark.createDataFrame([("c1", "b1", 2.0), ("c1", "b9", 2.0), ("c2", "b9", 4.0)], "cell string, feature string, value double")
    pairs = spark.createDataFrame([("r1", "b1"), ("r1", "b2")], "region string, feature string")
    regions = spark.createDataFrame([("r1",), ("none",)], "region string")
    cells = spark.createDataFrame([("c1",), ("c2",), ("absent",)], "cell string")
    got = {(r.cell, r.region): r.score for r in counting.region_scores(entries, pairs, regions, cells).collect()}
    assert got == {("c1", "r1"): pytest.approx(math.log1p(2 / 2 * 1e4 / 4)), ("c2", "r1"): 0.0, ("c1", "none"): None, ("c2", "none"): None}
    raw = {(r.cell, r.region): r.score for r in counting.region_scores(entries, pairs, regions, cells, mode="raw_counts").collect()}
    assert raw["c1", "r1"] == 2.0


def test_region_scores_pairs_of_cells_and_regions_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(counting, "REGION_PAGE", 10)
    entries = spark.range(40).selectExpr("id as cell", "concat('b', id % 7) as feature", "cast(id + 1 as double) as value")
    pairs = spark.range(7).selectExpr("concat('r', id * 3) as region", "concat('b', id) as feature")
    got = counting.region_scores(entries, pairs, spark.range(30).selectExpr("concat('r', id) as region"), entries.select("cell"), mode="raw_counts")
    assert {(r.cell, r.region): r.score for r in got.collect()} == {(c, f"r{r}"): (c + 1.0 if r == c % 7 * 3 else 0.0) if r % 3 == 0 and r < 21 else None for c in range(40) for r in range(30)}
    # nothing is exchanged once pages have been opened
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("Generate")]


def test_column_stats_edge_cases(spark):
    nan = float("nan")
    long = spark.createDataFrame([("one", 3.0), ("void", None), ("void", nan), ("mix", 0.0), ("mix", 2.0), ("mix", None)], "variable string, value double")
    got = {r.variable: r for r in matrix.column_stats(long).collect()}
    assert (got["one"]["std"], got["one"].zero_fraction) == (0.0, 0.0)
    assert (got["void"].n_unique, got["void"].zero_fraction, got["void"].missing_fraction) == (0, 1.0, 1.0)
    assert got["mix"].zero_fraction == 0.5 and got["mix"].missing_fraction == pytest.approx(1 / 3)


def test_alignment_and_scores(spark):
    entries = spark.createDataFrame([("c", "a", 2.0), ("c", "x", 1.0)], "cell string, feature string, value double")
    target = spark.createDataFrame([("a", 0), ("b", 1)], "feature string, idx int")
    aligned, flags = matrix.align_features(entries, target)
    assert [tuple(r) for r in aligned.collect()] == [("c", 0, "a", 2.0)]
    assert {r.feature: r.feature_available for r in flags.collect()} == {"a": True, "b": False}
    links = spark.createDataFrame([("a", "g", 0.5), ("x", "g", -1.0), ("a", "h", 1.0)], "feature string, gene string, weight double")
    assert [tuple(r) for r in matrix.gene_scores(entries, links).collect()] == [("c", "h", 2.0)]


def points(spark, n=120, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    x[1] = x[0]
    return x, spark.createDataFrame([(k, [float(v) for v in x[k]], str(k % 3)) for k in range(n)], "id bigint, emb array<double>, label string").repartition(5)


@pytest.mark.parametrize("block", [7, 4096])
def test_knn_matches_brute_force(spark, block):
    x, df = points(spark)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = {}
    for r in neighbours.knn(df.select("id", "emb"), df.select("id", "emb"), 5, True, block=block).collect():
        got.setdefault(r.query, []).append((r["rank"], r.neighbour))
    for q in range(len(x)):
        want = sorted((k for k in range(len(x)) if k != q), key=lambda k: (d[q, k], k))[:5]
        assert [n for _, n in sorted(got[q])] == want


def test_knn_with_few_references_and_none(spark):
    _, df = points(spark, 10)
    refs = df.where("id < 2").select("id", "emb")
    assert neighbours.knn(df.select("id", "emb"), refs, 5).count() == 20
    assert neighbours.knn(df.select("id", "emb").limit(0), refs, 5).count() == 0
    assert neighbours.knn(df.select("id", "emb"), refs.limit(0), 5).count() == 0


def test_majority_ties_go_to_the_first_seen(spark):
    votes = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, None, 3), (1, "", 4), (2, None, 1)], "query int, label string, rank int")
    assert [(r["query"], r.label, r.share) for r in neighbours.majority(votes, "query", "label").collect()] == [(1, "b", 0.5)]


def test_label_transfer_uses_the_winning_pool(spark):
    near = spark.createDataFrame([(9, k, k) for k in range(1, 6)], "query bigint, neighbour bigint, rank int")
    labels = spark.createDataFrame([(1, "T", "x", "o1"), (2, "T", "y", "o2"), (3, "T", "y", "o2"), (4, "B", "z", "o3"), (5, "B", "z", "o3")], "id bigint, coarse string, fine string, ontology string")
    r = neighbours.transfer_labels(near, labels).first()
    assert (r.coarse, r.fine, r.ontology) == ("T", "y", "o2") and r.coarse_confidence == 0.6 and r.fine_confidence == pytest.approx(2 / 3)
    r = neighbours.transfer_labels(near, labels, 0.65).first()
    assert (r.coarse, r.fine) == ("unknown", "y")


def test_silhouette_limits(spark):
    _, df = points(spark, 12)
    assert neighbours.silhouette(df.withColumn("label", F.lit("a")), "label").first()[0] is None
    assert neighbours.same_label_fraction(df.where("id < 2"), "label", 3).first()[0] is None


def test_assignment_is_optimal(spark):
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 5), (6, 6)):
        cost = rng.random((n, m))
        got = assignment.solve(cost)
        assert len(set(got)) == n
        assert cost[np.arange(n), got].sum() == pytest.approx(min(cost[np.arange(n), list(p)].sum() for p in itertools.permutations(range(m), n)))
    with pytest.raises(ValueError):
        assignment.solve(np.zeros((2, 1)))
    _, df = points(spark, 30)
    anchors = df.where("id < 4").select(F.format_string("S%d", "id").alias("sample_id"), "id", "emb")
    pairs = assignment.match(anchors, df.withColumnRenamed("label", "mark"))
    assert pairs.count() == 12 and pairs.groupBy("mark", "matched_cell").count().where("count > 1").count() == 0
    wide = assignment.wide_matches(pairs, ["0", "1", "2"])
    assert wide.count() == 4 and "distance_2" in wide.columns
    with pytest.raises(SchemaError):
        assignment.match(anchors, df.where("id < 5").withColumnRenamed("label", "mark"))


def test_metacells(spark):
    _, df = points(spark, 60)
    assigned, centres = metacells.cluster(df.select("id", "emb"), 4, rounds=1)
    assert assigned.count() == 60 and centres.count() == 4
    sizes = [r.n for r in metacells.summary(assigned).orderBy("metacell").collect()]
    assert sizes == sorted(sizes, reverse=True)
    pure = metacells.purity(assigned, df.select("id", "label").where("id < 1"))
    assert pure.where("majority_label = 'unknown' and purity is null").count() == 3
    assert metacells.choose_n(100, 10, 2, 8, 50) == 8 and metacells.export_n(50, 100) == 5
    with pytest.raises(ValueError):
        metacells.choose_n(5, 100, 1)


def test_guidance_graph(spark):
    genes = spark.createDataFrame([("c", 100, 200, "+", "g1"), ("c", 400, 500, "-", "g2")], "chrom string, start bigint, end bigint, strand string, gene_name string")
    bins = spark.createDataFrame([("c", 150, 160, "in"), ("c", 210, 220, "near"), ("c", 2000, 2010, "far")], BED)
    found = guidance.links(bins, guidance.regions(genes, "gene_body"), "H3K27me3", 250)
    assert {(r.feature, r.gene, r.distance) for r in found.collect()} == {("in", "g1", 0), ("in", "g2", 241), ("near", "g1", 11), ("near", "g2", 181)}
    nearest = guidance.links(bins, guidance.regions(genes, "gene_body"), "H3K27me3", 250, k=1)
    assert {(r.feature, r.gene) for r in nearest.collect()} == {("in", "g1"), ("near", "g1")}
    edges = guidance.edges(nearest, {"H3K27me3": -1}, bins.select(F.col("name").alias("feature"), F.lit("H3K27me3").alias("mark")), genes.select(F.col("gene_name").alias("gene")))
    assert {r.type: r["count"] for r in edges.groupBy("type").count().collect()} == {"fwd": 2, "rev": 2, "loop": 5}
    assert edges.where("type <> 'loop' and sign <> -1").count() == 0
    assert [r.feature for r in guidance.linked_features(edges, "g1", "H3K27me3").collect()] == ["in", "near"]
    nodes = guidance.nodes(edges, genes.select(F.col("gene_name").alias("gene")), bins.select(F.col("name").alias("feature"), F.lit("H3K27me3").alias("mark")))
    assert nodes.count() == 5 and guidance.subgraph(edges, nodes.where("node <> 'far'")).count() == 8


def test_universe_modes_and_unique_ids(spark):
    genes = spark.createDataFrame([("G1.1", "A", "c", 1, 2, "+"), ("G2", "A", "c", 3, 4, "+"), ("G3", "B", "c", 5, 6, "+")], "gene_id string, gene_name string, chrom string, start bigint, end bigint, strand string")
    rna = spark.createDataFrame([("A", "G1.1")], "feature string, gene_id string")
    found = spark.createDataFrame([("A",)], "gene string")
    assert [r.feature_id for r in guidance.universe(rna, genes, found, "rna").collect()] == ["A"]
    assert [r.feature_id for r in guidance.universe(rna, genes, found, "union_linked").collect()] == ["A", "G2"]
    assert [r.feature_id for r in guidance.universe(rna, genes, found, "gtf_all").collect()] == ["A", "G2", "B"]
    with pytest.raises(ValueError):
        guidance.universe(rna, genes, found, "no")


def test_transforms(spark):
    long = spark.createDataFrame([(k, "v", float(v)) for k, v in enumerate([3, 1, 1, 2])] + [(k, "flat", 1.0) for k in range(4)], "row int, variable string, value double")
    got = {r.row: r.value for r in transforms.rank_gaussian(long.where("variable = 'v'")).collect()}
    assert got[1] == got[2] and got[0] == pytest.approx(1.1503494) and got[3] == pytest.approx(0.3186394)
    z = transforms.standardise(long)
    assert z.where("variable = 'flat' and value is not null").count() == 0
    assert transforms.centre_and_scale(long).where("variable = 'flat' and value <> 0").count() == 0
    holes = long.union(spark.createDataFrame([(9, "v", 1.0)], long.schema))
    assert transforms.complete_rows(holes, 2).select("row").distinct().count() == 4
    reasons = {r.variable: r.drop_reason for r in matrix.drop_constant(long.withColumn("value", F.col("value").cast("string"))).collect()}
    assert reasons == {"v": None, "flat": "too_few_unique"}


def test_lgamma_and_families(spark):
    x = np.array([1e-4, 0.3, 1, 2, 7.5, 40, 1e6])
    assert families.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)
    rng = np.random.default_rng(0)
    rows = [("nb", float(v), 1.0) for v in rng.negative_binomial(1.5, 0.2, 800)] + [("po", float(v), 1.0) for v in rng.poisson(6, 800)]
    sized = families.size_factors(spark.createDataFrame(rows, "gene string, y double, library double"))
    best = families.best_family(families.compare(sized))
    assert {r.gene: r.best_family for r in best.collect()}["nb"] in ("nb2", "nb1") and {r.gene: r.best_family for r in best.collect()}["po"] == "poisson"
    assert families.recommend(best) == "mixed"
    disp = {r.gene: r.dispersion for r in families.dispersions(sized).collect()}
    assert disp["nb"] == pytest.approx(1.5, rel=0.35)


def test_demux_finds_planted_classes(spark):
    long = toy.counts(spark, ["HTO_A", "HTO_B"], "hto").select("feature", "barcode", "count")
    truth = {r.barcode: r.hto_classification for r in toy.cells(spark).collect()}
    got = {r.barcode: r for r in demux.demux(long).collect()}
    assert np.mean([got[b].hto_classification == truth[b] for b in truth]) > 0.95
    assert all(r.singlet_flag == (r.hto_classification == "Singlet") for r in got.values())
    assert demux.nb_quantile(5, 5, 0.99) == 11


def test_peaks_find_planted_enrichment(spark):
    called = peaks.call(toy.fragments(spark), 16000, min_length=100).orderBy("chrom", "start").collect()
    assert len(called) >= 2
    for chrom, s, e in toy.PEAKS:
        assert any(r.chrom == chrom and r.start < e and r.end > s for r in called)
    assert peaks.log10_poisson_tail(10, 3.0) == pytest.approx(2.957, abs=0.01) and peaks.log10_poisson_tail(0, 3.0) == 0


def test_pileup_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    spans = [("c", int(s := rng.integers(0, 3_000_000)), int(s + rng.integers(1, 900_000))) for _ in range(40)]
    got = peaks.pileup(spark.createDataFrame(spans, "chrom string, s bigint, e bigint")).collect()
    for r in got:
        assert r.depth == sum(s <= r.start and e >= r.end for _, s, e in spans)
    assert sum((r.end - r.start) * r.depth for r in got) == sum(e - s for _, s, e in spans)


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    x = rng.poisson(2, (30, 8)).astype(float)
    entries = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(30) for j in range(8) if x[i, j]], "cell int, feature int, value double")
    f = spark.createDataFrame([(j, j) for j in range(8)], "feature int, idx int")
    emb = np.array([r.emb for r in embedding.pca(entries, f, 3).orderBy("cell").collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    u, sv, _ = np.linalg.svd(z, full_matrices=False)
    assert np.abs(emb) == pytest.approx(np.abs(u[:, :3] * sv[:3]), abs=1e-6)
    tf = x / x.sum(1, keepdims=True) * np.log1p(30 / (x > 0).sum(0))
    u, sv, _ = np.linalg.svd(tf, full_matrices=False)
    lsi = np.array([r.emb for r in embedding.lsi(entries, 30, f, 3).orderBy("cell").collect()])
    assert np.abs(lsi) == pytest.approx(np.abs(u[:, :3] * sv[:3]), abs=1e-6)
    assert embedding.variable_by_dispersion(embedding.feature_moments(entries, 30), 3, 2).count() == 3
    hot = embedding.one_hot(spark.createDataFrame([("a", "x"), (None, "x")], "b string, s string"), ["b", "s"]).collect()
    assert [r.covariates for r in hot] == [[0.0, 1.0], [1.0, 0.0]]


def chain(n=3000, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(2, n))
    c = a + b + 0.3 * rng.normal(size=n)
    d = c + 0.3 * rng.normal(size=n)
    return np.stack([a, b, c, d], 1)


def test_pc_finds_the_collider():
    x = chain()
    edges = pc.pc(4, ci.FisherZ(np.corrcoef(x.T), len(x)), 0.01)
    directed = {(a, b) if (ea, eb) == ("TAIL", "ARROW") else (b, a) for a, ea, b, eb in edges if {ea, eb} == {"TAIL", "ARROW"}}
    assert {(a, b) for a, _, b, _ in edges} == {(0, 2), (1, 2), (2, 3)} and directed == {(0, 2), (1, 2), (2, 3)}
    for stable in (True, False):
        blocked = {(0, 2), (2, 0)}
        assert (0, 2) not in {(a, b) for a, _, b, _ in pc.pc(4, ci.FisherZ(np.corrcoef(x.T), len(x)), 0.01, 1, blocked, stable)}


def test_fci_marks():
    x = chain()
    edges = {(a, b): (ea, eb) for a, ea, b, eb in pc.fci(4, ci.FisherZ(np.corrcoef(x.T), len(x)), 0.01)}
    assert edges == {(0, 2): ("CIRCLE", "ARROW"), (1, 2): ("CIRCLE", "ARROW"), (2, 3): ("TAIL", "ARROW")}


def test_kernel_test_sees_what_correlation_does_not():
    rng = np.random.default_rng(0)
    a = rng.normal(size=150)
    x = np.stack([a, a**2 + 0.1 * rng.normal(size=150), rng.normal(size=150)], 1)
    t = ci.KernelTest(x)
    assert t(0, 1) < 0.01 < t(0, 2)
    y = np.stack([a + 0.2 * rng.normal(size=150), a, a + 0.2 * rng.normal(size=150)], 1)
    t = ci.KernelTest(y)
    assert t(0, 2) < 0.01 and t(0, 2, (1,)) > 0.01
    assert ci.gamma_upper(2.0, 3.0) == pytest.approx(0.1991483, abs=1e-6) and ci.gamma_upper(5.0, 1.0) == pytest.approx(0.9963402, abs=1e-6)


def test_correlation_sums_match_numpy(spark):
    x = chain(200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    corr, n = ci.correlation(df, list("abcd"))
    assert n == 200 and corr == pytest.approx(np.corrcoef(x.T), abs=1e-9)


def test_dagma_recovers_a_chain():
    rng = np.random.default_rng(0)
    a = rng.normal(size=400)
    b = 1.5 * a + rng.normal(size=400)
    w = dagma.Dagma(["gaussian"] * 2, stages=3, warm=2000, last=3000, threshold=0.2).fit(np.stack([a, b], 1), {(1, 0)})
    assert w[0, 1] > 0.8 and w[1, 0] == 0
    h, g = dagma.acyclicity(np.array([[0.0, 0.5], [0.0, 0.0]]), 1.0)
    assert h == pytest.approx(0) and g[1, 0] == 0
    mixed = dagma.Dagma(["nb2", "bernoulli"], stages=1, last=50)
    got = mixed.fit(np.stack([rng.poisson(4, 200), rng.integers(0, 2, 200)], 1))
    assert got.shape == (2, 2) and np.isfinite(got).all()
    assert dagma.edge_records(np.array([[0, 0.5], [0, 0]]), ["x", "y"])[0]["edge_text"] == "x --> y"


def test_score_gradient_is_right():
    rng = np.random.default_rng(1)
    x = np.stack([rng.normal(size=60), rng.integers(0, 2, 60), rng.poisson(3, 60)], 1).astype(float)
    m = dagma.Dagma(["gaussian", "bernoulli", "nb2"], stages=1, last=1)
    m.fit(x)
    f, w, b = m.smooth(x, np.zeros_like(x)), rng.normal(0, 0.2, (3, 3)), rng.normal(0, 0.2, 3)
    _, gw, gb = f(w, b)
    for i, j in itertools.product(range(3), range(3)):
        e = np.zeros((3, 3))
        e[i, j] = 1e-5
        assert gw[i, j] == pytest.approx((f(w + e, b)[0] - f(w - e, b)[0]) / 2e-5, abs=1e-5)
        assert gb[j] == pytest.approx((f(w, b + e[i])[0] - f(w, b - e[i])[0]) / 2e-5, abs=1e-5) or not e[i].any()


@pytest.mark.parametrize("seed", range(3))
def test_planted_graphs_are_found_with_the_weights_of_their_regressions(seed):
    rng = np.random.default_rng(seed)
    d, n = 6, 4000
    true = np.triu(rng.random((d, d)) < 0.4, 1) * rng.uniform(0.7, 1.5, (d, d)) * rng.choice([-1, 1], (d, d))
    x = np.zeros((n, d))
    for j in range(d):
        x[:, j] = x @ true[:, j] + rng.normal(size=n)
    order = {(j, i) for i in range(d) for j in range(i + 1, d)}
    for exclude in (set(), order):
        m = dagma.Dagma(["gaussian"] * d, lambda1=0.02)
        w = m.fit(x, exclude)
        assert ((w != 0) == (true != 0)).all() and all(m.converged)
        for j in range(d):
            of = np.flatnonzero(true[:, j])
            best = np.linalg.lstsq(x[:, of] - x[:, of].mean(0), x[:, j] - x[:, j].mean(), rcond=None)[0]
            assert np.abs(w[of, j] - best).max(initial=0) < 0.15  # the threshold on |W| pulls them in


def test_a_stage_without_other_edges_is_the_lasso():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 3))
    x[:, 2] += 0.8 * x[:, 0] - 0.05 * x[:, 1]
    m = dagma.Dagma(["gaussian"] * 3, lambda1=0.1, threshold=0.0, stages=1, tolerance=1e-8)
    only = {(i, j) for i in range(3) for j in range(3) if j != 2}
    w = m.fit(x, only)[:, 2]
    m.offsets = np.zeros_like(x)
    assert np.allclose(m.fit(x, only)[:, 2], w, atol=1e-5)  # by rows and by moments
    centred = x - x.mean(0)
    slope = centred.T @ (centred[:, 2] - centred @ w) / len(x)
    assert slope[0] == pytest.approx(0.1 * np.sign(w[0]), abs=1e-5) and w[1] == 0 and abs(slope[1]) <= 0.1


def test_mixed_families_find_the_count_child():
    rng = np.random.default_rng(5)
    a, c = rng.normal(size=1500), rng.integers(0, 2, 1500)
    y = rng.negative_binomial(5, 5 / (5 + np.exp(1 + 0.8 * a - 0.9 * c)))
    m = dagma.Dagma(["nb2", "gaussian", "bernoulli"], lambda1=0.002, threshold=0.2)
    w = m.fit(np.stack([y, a, c], 1).astype(float), {(0, 1), (0, 2), (1, 2), (2, 1)})
    assert w[1, 0] == pytest.approx(0.8, abs=0.12) and w[2, 0] == pytest.approx(-0.9, abs=0.2) and (w != 0).sum() == 2
    assert m.intercepts[0] == pytest.approx(1, abs=0.15)


def long_matrix(spark, x, names):
    return spark.createDataFrame([(k, n, float(v)) for k, r in enumerate(x) for n, v in zip(names, r, strict=True)], "row int, variable string, value double")


def test_runner_with_priors_and_sweeps(spark):
    names = ["enhancer__H3K27ac", "promoter__H3K4me3", "expr__G_log1p", "other__H3K4me1"]
    long = long_matrix(spark, chain(300), names).union(spark.createDataFrame([(k, "flat__H3K9me3", 1.0) for k in range(300)] + [(k, "libsize__rna", 5.0) for k in range(300)], "row int, variable string, value double"))
    edges, summary = runner.run(long, runner.Spec(background="tiered_distal_promoter_expr"))
    assert summary["dropped"] == {"flat__H3K9me3": "too_few_unique"} and summary["rows"] == 300
    assert all(r.source is None or not r.source.startswith("expr__") for r in edges.collect())
    rules = priors.rules(spark.createDataFrame([(n,) for n in names], "node string"))
    assert rules.where("reason = 'promoter_not_parent_of_distal'").count() == 1 and rules.count() == 4
    wide = long.where(F.col("variable").isin(*names)).groupBy("row").pivot("variable", names).agg(F.first("value")).drop("row")
    grid = runner.depth_grid(["pc", "fci"], [0, 1])
    found = runner.sweep(wide, names, grid)
    assert found.select("run").distinct().count() == 4
    with pytest.raises(ValueError):
        runner.depth_grid(["dagma"], [1])
    assert len(runner.dagma_grid(["gaussian", "nb2_nb2"], [0.1], [0.3], [1, 2])) == 4
    assert runner.quant_mode_of("nb2_gaussian") == "raw_counts" and runner.run_name(grid[0]) == "pc_fisherz_a0_05_depth0_none"
    d, s = runner.run(long, runner.Spec(method="dagma", stages=1, last=200, threshold=0.01))
    assert s["method"] == "dagma" and "weight" in d.columns
    with pytest.raises(ValueError):
        runner.run(long, runner.Spec(method="no"))


def test_support(spark):
    names = spark.createDataFrame([("expr__CD14_log1p",), ("chr1:10-20__H3K27ac",), ("reg__H3K27ac",), ("loner__H3K27ac",)], "node string")
    loci = spark.createDataFrame([("reg", "chr1", 100, 200)], "region_name string, chrom string, start bigint, end bigint")
    nodes = support.nodes(names, loci)
    ev = spark.createDataFrame([("chr1", 15, 30, "cd14", "b", "x1", "", "n", "atlas"), ("chr1", 19, 150, "", "a", "", "s", "", "screen"), ("chr2", 1, 9, "", "z", "", "", "", "atlas")], "chrom string, start bigint, end bigint, gene string, support_label string, external_id string, biosample string, notes string, source string")
    got = {r.node: r for r in support.summary(nodes, support.matches(nodes, ev), "atlas", "screen").collect()}
    assert {n: (r.n_matches, r.highlight) for n, r in got.items()} == {"expr__CD14_log1p": (1, "atlas"), "chr1:10-20__H3K27ac": (2, "both"), "reg__H3K27ac": (1, "screen"), "loner__H3K27ac": (0, "none")}
    assert got["chr1:10-20__H3K27ac"].labels == "a|b"
    samples = spark.createDataFrame([(f"s{k}", k, k % 2) for k in range(20)], "sample_id string, cell int, type int")
    null = support.permuted_pairs(samples, "cell", "type", 1).collect()
    assert sorted(r.cell for r in null) == list(range(20)) and all(r.cell % 2 == r.type for r in null)
    sizes = spark.createDataFrame([("chr1", 1000)], "chrom string, size bigint")
    moved = support.shifted_regions(loci, sizes, 850).first()
    assert (moved.start, moved.end) == (50, 150)


def test_datasets(spark):
    samples = spark.createDataFrame([("S1", "r1", "h1"), ("S2", "r2", "h2"), ("S3", "r1", "gone")], "sample_id string, cell_rna string, cell_H3K27ac string")
    rna = spark.createDataFrame([("r1", "G", 3.0), ("r1", "X", 1.0), ("r2", "X", 2.0)], "cell string, feature string, value double")
    entries = spark.createDataFrame([("h1", "p1", 2.0), ("h2", "p9", 1.0)], "cell string, feature string, value double")
    bins = spark.createDataFrame([("chr1", 100, 200, "p1"), ("chr1", 5000, 5100, "p9")], BED)
    genes = spark.createDataFrame([("G", "chr1", 150, "+")], "gene string, chrom string, tss bigint, strand string")
    near = dataset.nearby_peaks(bins.withColumn("mark", F.lit("H3K27ac")), genes, 1000)
    assert [r.variable_name for r in near.collect()] == ["chr1:100-200__H3K27ac"]
    long = dataset.locus_matrix(samples, rna, "G", near, {"H3K27ac": (entries, bins)})
    got = {(r.sample_id, r.variable): r.value for r in long.collect()}
    assert got["S1", "expr__G_raw_counts"] == 3.0 and got["S2", "expr__G_log1p"] == 0.0
    assert got["S1", "chr1:100-200__H3K27ac"] == pytest.approx(math.log1p(1e4)) and got["S2", "chr1:100-200__H3K27ac"] == 0.0
    assert ("S3", "chr1:100-200__H3K27ac") not in got and got["S1", "libsize__H3K27ac"] == 2.0
    roles = {r.variable: r.role for r in dataset.variables(long).collect()}
    assert roles["libsize__rna"] == "libsize" and roles["chr1:100-200__H3K27ac"] == "signal"
    none = dataset.expression(rna, samples.select(F.col("cell_rna").alias("cell")).distinct(), "absent").where("variable like 'expr%' and value is not null")
    assert none.count() == 0
    loci = spark.createDataFrame([("chr1", 150, 160, "second", "G", 2), ("chr1", 90, 101, "first", "G", 1)], "chrom string, start bigint, end bigint, region_name string, gene string, pos int")
    assert dataset.curated_overlaps(near, loci).first().curated_regions == "first;second"
    assigned = spark.createDataFrame([("rna", "r1", "M1"), ("chrom_H3K27ac", "h1", "M1"), ("chrom_H3K27ac", "h2", "M1")], "modality_key string, id string, metacell string")
    edges = spark.createDataFrame([("G", "p1", 1.0, 1, 0, "H3K27ac", "fwd")], "source string, target string, weight double, sign int, distance_bp bigint, mark string, type string")
    row = dataset.causal_export("G", rna, edges, {"H3K27ac": entries}, assigned, 1, 2).first()
    assert row.qc_pass and row["linked__H3K27ac"] == pytest.approx(math.log1p(1e4) / 2)


def test_merging_over_tiles_matches_a_walk(spark, monkeypatch):
    monkeypatch.setattr(peaks, "TILE", 50)
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for chrom in ("c", "d"):
        at, last, g = 0, None, 0
        for _ in range(150):
            start = at + int(rng.integers(0, 40))
            at = start + int(rng.integers(1, 180 if rng.random() < 0.1 else 20))
            g += last is None or start - last > 15
            last = at
            rows.append((chrom, start, at))
            want[chrom, start] = g
    got = peaks._merged(spark.createDataFrame(rows, "chrom string, start bigint, end bigint").repartition(5), 15)
    assert set(got.columns) == {"chrom", "start", "end", "_g"}
    assert {(r.chrom, r.start): r._g for r in got.collect()} == want


def test_peak_counts_count_a_fragment_once_a_peak(spark):
    rng = np.random.default_rng(7)
    found = [("c" if rng.random() < 0.8 else "d", int(s := rng.integers(0, 900)), int(s + rng.integers(1, 200)), f"b{rng.integers(4)}") for _ in range(300)] * 2
    wide = [("c", s, s + 120, f"p{s}") for s in range(0, 1000, 70)] + [("d", 5, 6, "one")]
    want = Counter()
    for chrom, s, e, b in found:
        for c, ps, pe, name in wide:
            want[b, name] += chrom == c and (ps <= s < pe or ps <= e - 1 < pe)
    got = counting.peak_counts(spark.createDataFrame(found, "chrom string, start bigint, end bigint, barcode string"), spark.createDataFrame(wide, "chrom string, start bigint, end bigint, name string"), 100)
    assert {(r.cell, r.feature): r.value for r in got.collect()} == {k: n for k, n in want.items() if n}
