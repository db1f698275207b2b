import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cellweft.plans import cli, matching, qc_chain
from cellweft.schema import SchemaError
from cellweft.sinks import tables
from cellweft.sources import delimited, mtx, toy
from cellweft.streaming import fragments as stream


def write_toy(spark, tmp_path):
    for name, tags in (("ADT", ["CD3", "CD4"]), ("HTO", ["HTO_A", "HTO_B"])):
        long = toy.counts(spark, tags, name).withColumns({"value": F.col("count").cast("bigint").cast("string"), "row_pos": F.dense_rank().over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("feature"))})
        tables.write_wide_matrix(long, tmp_path / f"{name}.tsv")
    tables.write_tsv(toy.fragments(spark), tmp_path / "f.tsv.gz", header=False)
    tables.write_tsv(toy.sizes(spark), tmp_path / "sizes", header=False)
    tables.write_tsv(toy.peaks(spark), tmp_path / "peaks.bed", header=False)


def test_qc_chain_over_files(spark, tmp_path):
    write_toy(spark, tmp_path)
    (tmp_path / "out").mkdir()
    assert cli.main(["qc", "--out", f"{tmp_path}/out", "--adt", f"{tmp_path}/ADT.tsv", "--hto", f"{tmp_path}/HTO.tsv", "--fragments", f"{tmp_path}/f.tsv.gz", "--sizes", f"{tmp_path}/sizes", "--peaks", f"{tmp_path}/peaks.bed", "--bin-size", "1000"]) == 0
    prefix = f"{tmp_path}/out/run"
    rows, cols, n = mtx.shape(spark, f"{prefix}_chromatin_clean.mtx")
    assert cols == 5 and 36 <= rows <= 42 and n == mtx.read(spark, f"{prefix}_chromatin_clean.mtx").count()
    assert mtx.shape(spark, f"{prefix}_bin_chromatin_clean.mtx")[1] == 16
    assert delimited.tsv(spark, f"{prefix}_fragment_counts.tsv").count() == 44


def test_qc_chain_can_call_peaks(spark):
    data = qc_chain.clean(toy.fragments(spark), toy.cells(spark), toy.sizes(spark), bin_size=1000)
    assert data.cells.count() == 40 and data.peaks.count() >= 2 and data.peak_counts.count() > 0


def test_matching(spark):
    rows = [(f"c{k}", m, m.removeprefix("chrom_"), [float(k % 10), float(k // 10), float(len(m))]) for m in ("rna", "chrom_A", "chrom_B") for k in range(20)]
    emb = spark.createDataFrame(rows, "cell string, modality_key string, mark string, emb array<double>")
    labels = emb.select(F.concat_ws("::", "modality_key", "cell").alias("obs_id"), F.lit("monocyte").alias("harmonized_coarse"), F.lit(0.9).alias("coarse_confidence"))
    samples, pairs, summary = matching.match(emb, labels, "harmonized_coarse", "monocyte", ["A", "B"], 6)
    got = samples.collect()
    assert [r.anchor_rank for r in got] == list(range(1, 7)) and all(r.cell_rna == r.cell_A == r.cell_B for r in got)
    assert pairs.count() == 12 and summary.count() == 2
    for n in (0, 21):
        with pytest.raises(SchemaError):
            matching.match(emb, labels, "harmonized_coarse", "monocyte", ["A", "B"], n)


def test_cli_graphs(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.normal(size=120)
    rows = [(f"s{k:03}", float(a[k]), float(a[k] + 0.2 * rng.normal()), 9.0) for k in range(120)]
    spark.createDataFrame(rows, "sample_id string, `chr1:1-2__H3K27ac` double, expr__G_log1p double, libsize__rna double").write.parquet(f"{tmp_path}/m")
    assert cli.main(["graph", "--out", f"{tmp_path}/g", "--matrix", f"{tmp_path}/m", "--method", "pc"]) == 0
    assert (tmp_path / "g/pc_edges.tsv").read_text().count("\n") == 2
    cli.main(["sweep", "--out", f"{tmp_path}/s", "--matrix", f"{tmp_path}/m", "--depths", "0", "1", "--test", "fisherz", "--methods", "pc"])
    assert len(list((tmp_path / "s").glob("*/summary.json"))) == 2
    cli.main(["plot", "--out", f"{tmp_path}/p", "--edges", f"{tmp_path}/g/pc_edges.tsv", "--gene-node", "expr__G_log1p"])
    assert (tmp_path / "p/graph.graphml").exists()
    assert cli.window_suffix(300_000) == "300kb" and cli.window_suffix(2_000_000) == "2mb" and cli.window_suffix(1500) == "1500bp"


def test_streaming_equals_batch(spark, tmp_path):
    from cellweft.operators import counting, qc

    batch = toy.fragments(spark)
    batch.repartition(3).write.option("sep", "\t").csv(f"{tmp_path}/in")
    source = stream.read(spark, f"{tmp_path}/in", 1)
    listed = spark.createDataFrame([(r.barcode.removesuffix("-1"),) for r in toy.cells(spark).limit(5).collect()], "barcode string")
    stream.run_available(stream.counts(stream.filtered(source, listed)), "toy_counts", f"{tmp_path}/c1")
    want = qc.fragment_counts(qc.keep_listed(batch, listed))
    assert spark.table("toy_counts").exceptAll(want).count() == 0 and want.count() == 5
    stream.run_available(stream.bin_counts(source, 1000), "toy_bins", f"{tmp_path}/c2")
    assert spark.table("toy_bins").count() == counting.bin_counts(batch, 1000).count()


def test_entry_has_a_stable_schema(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["cell", "feature", "value", "donor_id"] and got.count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
