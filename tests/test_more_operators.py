import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweft import recovery
from cellweft.operators import clusters, components, embedding, families, joins, latent, layout, matrix
from cellweft.schema import SchemaError
from cellweft.sources import discovery, hdf5


def test_joins(spark):
    obs = spark.createDataFrame([("A-1", 1), ("B-2", 2)], "barcode string, x int")
    cells = spark.createDataFrame([("A-9", "d")], "barcode string, donor string")
    got = joins.attach_metadata(obs, cells)
    assert {(r.barcode, r.donor, r.matched) for r in got.collect()} == {("A-1", "d", True), ("B-2", None, False)}
    assert tuple(joins.matched_fraction(got).first()) == (2, 1, 0.5)
    both = joins.join_labels(spark.createDataFrame([("o", 1)], "obs_id string, mark int"), spark.createDataFrame([("o", 2, 3)], "obs_id string, mark int, z int"))
    assert both.columns == ["obs_id", "mark", "mark_label", "z"]
    flags = joins.flag_lookup(obs, spark.createDataFrame([("A-1", True)], "barcode string, ok boolean"), "barcode", "ok")
    assert {r.barcode: r.ok for r in flags.collect()} == {"A-1": True, "B-2": False}
    with pytest.raises(SchemaError):
        joins.positions(obs, cells.withColumn("idx", F.lit(0)).drop("donor"), "barcode")
    assert [r.row_id for r in joins.row_ids(obs, ["barcode"]).orderBy("barcode").collect()] == ["row_00001", "row_00002"]
    assert joins.row_ids(obs.withColumn("sample_id", F.lit("s")), ["x"]).first().row_id == "s"
    assert [tuple(r) for r in joins.unmapped_counts(spark.createDataFrame([("unknown",), (None,), ("x",)], "a string"), ["a"]).collect()] == [("a", 1, 1, 3)]
    assert joins.label_agreement(obs, obs.withColumn("x", F.lit(1)), "barcode", "x").first().agreement == 0.5


def test_clusters_find_separate_clouds(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.3, (25, 2)), rng.normal(9, 0.3, (25, 2))])
    points = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(50)], "id bigint, emb array<double>")
    graph = clusters.neighbour_graph(points, 6)
    assert graph.where("a >= b").count() == 0
    got = {r.id: r.cluster for r in clusters.label_propagation(graph).collect()}
    assert len(got) == 50 and not {got[k] for k in range(25)} & {got[k] for k in range(25, 50)}


def test_layouts(spark):
    nodes = spark.createDataFrame([("expr__G_log1p",), ("chr1:5-9__H3K27ac",), ("chr1:1-3__H3K4me3",)], "node string")
    assert layout.is_local(nodes) and not layout.is_local(nodes.union(spark.createDataFrame([("odd",)], "node string")))
    at = {r.node: (r.x, r.y) for r in layout.local(nodes).collect()}
    assert at == {"chr1:1-3__H3K4me3": (0.0, -2.0), "chr1:5-9__H3K27ac": (1.0, -1.0), "expr__G_log1p": (0.5, 1.0)}
    edges = spark.createDataFrame([("expr__G_log1p", "chr1:5-9__H3K27ac")], "source string, target string")
    pos = {r.node: np.array([r.x, r.y]) for r in layout.spring(nodes, edges).collect()}
    near = np.linalg.norm(pos["expr__G_log1p"] - pos["chr1:5-9__H3K27ac"])
    assert near < np.linalg.norm(pos["expr__G_log1p"] - pos["chr1:1-3__H3K4me3"])


def test_latent_space_mixes_modalities_and_keeps_structure(spark):
    rng = np.random.default_rng(0)
    types = rng.integers(0, 2, 300)
    kind = np.arange(300) % 2
    base = np.where(types[:, None] == 1, 1.5, -1.5) * np.array([1, -1, 1, -1, 1, -1, 0, 0])
    x = base + 0.3 * rng.normal(size=(300, 8))
    x[:, 6] += 2.0 * kind
    mask = np.ones((300, 8))
    mask[kind == 1, 7] = 0
    df = spark.createDataFrame([(f"c{k}", "ab"[kind[k]], x[k].tolist(), mask[k].tolist()) for k in range(300)], "cell string, modality_key string, x array<double>, available array<double>").repartition(3)
    model, kinds = latent.fit(df, 8, latent=3, hidden=16, epochs=60, warmup=10, batch=64)
    assert kinds == ["a", "b"]
    z = {r.cell: np.array(r.emb) for r in latent.encode(df, model).collect()}
    emb = np.array([z[f"c{k}"] for k in range(300)])
    near = np.argsort(((emb[:, None] - emb[None]) ** 2).sum(2), 1)[:, 1:8]
    assert (types[near] == types[:, None]).mean() > 0.95
    assert np.abs(model.decode(emb) - base)[:, :6].mean() < 0.8


def test_latent_losses():
    assert latent.kl_standard(np.zeros((1, 2)), np.zeros((1, 2)))[0] == 0
    m = np.ones((1, 2))
    assert latent.kl_general(m, m, m, m)[0] == 0 and latent.kl_general(m, 0 * m, 0 * m, 0 * m)[0] == pytest.approx(latent.kl_standard(m, 0 * m)[0])
    x = np.random.default_rng(0).normal(size=(9, 3))
    assert latent.isometry(x, 7 * x) == pytest.approx(0, abs=1e-12)
    from math import exp, lgamma, log

    got = latent.zinb_nll(np.array([[3.0]]), np.array([[2.0]]), np.array([[1.5]]), np.array([[-40.0]]))
    want = -(lgamma(4.5) - lgamma(1.5) - lgamma(4) + 1.5 * log(1.5 / 3.5) + 3 * log(2 / 3.5))
    assert got == pytest.approx(want, abs=1e-6)
    zero = latent.zinb_nll(np.array([[0.0]]), np.array([[2.0]]), np.array([[1.5]]), np.array([[0.0]]))
    assert zero == pytest.approx(-log(0.5 + 0.5 * exp(1.5 * log(1.5 / 3.5))), abs=1e-6)
    assert latent.masked_mse(np.ones((1, 2)), np.zeros((1, 2)), np.array([[True, False]])) == 1
    assert latent.reconstruction_family(["shared"], True) == "gaussian" and latent.reconstruction_family(["shared", "x"], True) == "zinb"


def test_shared_features(spark):
    entries = spark.createDataFrame([("rna", "c1", "a", 1.0), ("rna", "c2", "a", 3.0), ("rna", "c2", "b", 1.0), ("H", "c1", "b", 2.0)], "modality_key string, cell string, feature string, value double")
    target = spark.createDataFrame([("a", 0), ("b", 1), ("z", 2)], "feature string, idx int")
    got = {(r.modality_key, r.cell): r for r in latent.shared_features(entries, target, 3).collect()}
    assert got["rna", "c1"].available == [1.0, 1.0, 0.0] and got["H", "c1"].available == [0.0, 1.0, 0.0]
    assert got["rna", "c1"].x[1] == pytest.approx(-1) and got["rna", "c2"].x[1] == pytest.approx(1) and got["H", "c1"].x == [0.0, 0.0, 0.0]


def test_saved_graph_and_hdf5_gate(spark, tmp_path):
    (tmp_path / "pc_edges.tsv").write_text("node1\tendpoint1\tnode2\tendpoint2\na\tTAIL\tb\tARROW\n")
    assert discovery.saved_graph(spark, tmp_path)[::2] == ("pc", ["a", "b"])
    (tmp_path / "summary.json").write_text('{"variables": ["a", "b", "c"], "quant_mode": "raw_counts"}')
    assert discovery.saved_graph(spark, tmp_path)[2] == ["a", "b", "c"] and discovery.quant_mode(tmp_path / "summary.json") == "raw_counts"
    if hdf5.h5py is None:
        with pytest.raises(ImportError, match="h5py"):
            hdf5.read_10x(spark, "x.h5")


def test_lengths_of_embeddings_are_those_of_a_plain_decomposition(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(2, (12, 7)).astype(float)
    e = spark.createDataFrame([(i, j, v) for i, r in enumerate(x.tolist()) for j, v in enumerate(r) if v], "cell int, feature int, value double")
    f = spark.createDataFrame([(j, j) for j in range(7)], "feature int, idx int")
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    _, _, right = np.linalg.svd(z, full_matrices=False)
    got = {r.cell: np.linalg.norm(r.emb) for r in embedding.pca(e, f, 3).collect()}
    assert np.allclose([got[i] for i in range(12)], np.linalg.norm(z @ right[:3].T, axis=1))
    weighed = {(r.cell, r.feature): r.value for r in matrix.tf_idf(e, 12).collect()}
    t = np.array([[weighed.get((i, j), 0.0) for j in range(7)] for i in range(12)])
    _, _, right = np.linalg.svd(t, full_matrices=False)
    got = {r.cell: np.linalg.norm(r.emb) for r in embedding.lsi(e, 12, f, 3).collect()}
    assert np.allclose([got[i] for i in range(12)], np.linalg.norm(t @ right[:3].T, axis=1))


def test_median_library_is_exact_and_no_task_holds_all_of_it(spark):
    for n in (1, 2, 7, 5000, 5001):
        cells = spark.range(n).selectExpr("cast(if(id % 5 = 4, -id, (id * 7919 % 1013) / 3 + 1) as double) as library")
        x = [r.library for r in cells.collect() if r.library > 0]
        assert families.middle(cells, "library") == np.median(x)
    assert families.middle(cells.where("library < 0"), "library") is None
    plan = families.size_factors(cells)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "median" not in plan and "percentile" not in plan


def test_log_gamma_takes_few_logarithms(monkeypatch):
    from math import lgamma

    x = 10 ** np.random.default_rng(2).uniform(-12, 7, 3000)
    taken = []
    log = np.log
    monkeypatch.setattr(families.np, "log", lambda v: taken.append(np.size(v)) or log(v))
    got = families.lgamma(x)
    assert np.allclose(got, [lgamma(v) for v in x], rtol=1e-13, atol=1e-13) and families.lgamma(3.0) == pytest.approx(np.log(2.0))
    assert sum(taken) <= 3 * len(x) + 4


@pytest.mark.parametrize("shape", [(60, 90), (90, 60)])
def test_components_of_either_side_are_found_without_a_gram_matrix(spark, monkeypatch, shape):
    monkeypatch.setattr(components, "DENSE", 4)
    x = np.random.default_rng(5).poisson(0.7, shape).astype(float)
    x[:, 0] = 3.0
    e = spark.createDataFrame([(i, j, v) for i, r in enumerate(x.tolist()) for j, v in enumerate(r) if v], "cell int, feature int, value double")
    f = spark.createDataFrame([(j, j) for j in range(shape[1])], "feature int, idx int")
    z = (x - x.mean(0)) / np.where(x.std(0, ddof=1) > 0, x.std(0, ddof=1), 1)
    for emb, m in ((embedding.pca(e, f, 4), z), (components.project(e, f, 4), x)):
        u, sv, _ = np.linalg.svd(m, full_matrices=False)
        assert np.allclose(np.abs([r.emb for r in emb.orderBy("cell").collect()]), np.abs(u[:, :4] * sv[:4]), atol=1e-5)


def test_components_with_equal_values_and_more_columns_than_a_covariance_holds(spark, monkeypatch):
    monkeypatch.setattr(components, "DENSE", 4)
    blocks, wide = 30, 70_000
    e = spark.range(blocks * 3).selectExpr("cast(id div 3 as int) as cell", "cast(id * 700 as int) as feature", "cast(id % 3 + 1 as double) as value")
    f = spark.range(wide).selectExpr("cast(id as int) as feature", "cast(id as int) as idx")
    got = np.array([r.emb for r in components.project(e, f, 5).collect()])
    # every cell has columns of its own, so all singular values are the length of (1, 2, 3)
    assert got.shape == (blocks, 5) and np.allclose(got.T @ got, 14 * np.eye(5), atol=1e-6)


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        recovery.shared_dir(Session())


def test_old_columns_of_a_basis_are_not_multiplied_again(monkeypatch):
    """Products of old columns are kept over passes and cuts, and the answer stays that of the whole decomposition."""
    monkeypatch.setattr(components, "DENSE", 4)
    monkeypatch.setattr(components, "BASIS", 1)
    x = np.random.default_rng(5).normal(size=(90, 60)) * np.linspace(1, 3, 60)
    asked, placed = [], []
    real = components.np.empty
    monkeypatch.setattr(components.np, "empty", lambda *a, **b: placed.append(a) or real(*a, **b))
    values, vectors = components._largest(lambda v: asked.append(v.shape[1]) or x.T @ (x @ v), 60, 5)
    monkeypatch.undo()
    every = np.linalg.eigvalsh(x.T @ x)[::-1]
    assert np.allclose(values, every[:5]) and np.allclose(x.T @ (x @ vectors), vectors * values, atol=1e-6 * every[0])
    # more columns than the basis has places, so it was cut back, in the places it has
    assert sum(asked) > 4 * 13 and [a for a in placed if a[0] == (60, 65)] == [((60, 65),)] * 2


def test_a_pass_takes_a_column_at_a_time(monkeypatch):
    seen = []
    real = np.bincount
    monkeypatch.setattr(components.np, "bincount", lambda *a, **b: seen.append(a[0].shape) or real(*a, **b))
    x = np.random.default_rng(6).normal(size=(7, 3))
    row, at, value = np.array([0, 0, 2, 3]), np.array([1, 6, 0, 1]), np.array([2.0, 1.0, -1.0, 4.0])
    m = np.zeros((4, 7))
    m[row, at] = value
    assert np.allclose(components._times(row, at, value, 4, x), m @ x) and seen == [(4,)] * 3
