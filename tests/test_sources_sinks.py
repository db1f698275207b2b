import gzip
import io
import tarfile
import xml.etree.ElementTree as ET
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweft import recovery
from cellweft.schema import SchemaError
from cellweft.sinks import tables
from cellweft.sources import archive, bundle, delimited, discovery, mtx, toy


def put(path, text):
    (gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")).write(text)
    return str(path)


def test_fragments_skip_comments_and_short_rows(spark, tmp_path):
    path = put(tmp_path / "f.tsv.gz", "# head\nchr1\t1\t5\tA-1\t2\nchr1\t2\t9\nchr2\t3\t4\tB\n")
    assert sorted(map(tuple, delimited.fragments(spark, path).collect())) == [("chr1", 1, 5, "A-1", 2), ("chr2", 3, 4, "B", None)]
    lines = delimited.fragment_lines(spark, path)
    assert sorted(r.value for r in lines.collect()) == ["chr1\t1\t5\tA-1\t2", "chr2\t3\t4\tB"]


def test_counts_sizes_and_whitelists(spark, tmp_path):
    counts = delimited.fragment_counts(spark, put(tmp_path / "c.tsv", "barcode\tn_fragments\nA\t12.0\nB\tabc\nC\t\nD\t7\n"))
    assert sorted(map(tuple, counts.collect())) == [("A", 12), ("D", 7)]
    with pytest.raises(SchemaError):
        delimited.fragment_counts(spark, put(tmp_path / "d.tsv", "barcode\tother\nA\t1\n"))
    sizes = delimited.chrom_sizes(spark, put(tmp_path / "s.txt", "#c\nchr1\t5\nchr1\t9\nchr2\t0\nchr3\tx\n"))
    assert [tuple(r) for r in sizes.collect()] == [("chr1", 9)]
    path = put(tmp_path / "w.tsv", "barcode\nA-1\nA.1\n \nB\n")
    assert sorted(r.barcode for r in delimited.whitelist(spark, path).collect()) == ["A", "B"]
    assert {"A-1", "A", "A.1", "B", "B-1", "B.1"} == {r.barcode for r in delimited.expanded_whitelist(spark, path).collect()}
    with pytest.raises(SchemaError):
        delimited.expanded_whitelist(spark, put(tmp_path / "e.tsv", "barcode\n"))


@pytest.mark.parametrize(("text", "cells", "first"), [
    ("feature\tA-1\tB-1\nf1\t1\t2\nf2\t3\n\nf3\t4\t5\t6\n", ["A-1", "B-1"], ["1", "2"]),
    ("A-1\tB-1\nf1\t1\t2\nf2\t3\nf3\t4\t5\n", ["A-1", "B-1"], ["1", "2"]),
    ("feature,A,B\nf1,1,\nf2,3\nf3,4,5\n", ["A", "B"], ["1", ""]),
    ("feature A B\nf1  1   2\nf2 3\nf3 4 5\n", ["A", "B"], ["1", "2"]),
])
def test_wide_matrix(spark, tmp_path, text, cells, first):
    long = delimited.wide_matrix(spark, put(tmp_path / "m.txt", text)).orderBy("row_pos", "col_pos").collect()
    assert [r.barcode for r in long[:2]] == cells and [r.value for r in long[:2]] == first
    assert [(r.feature, r.value) for r in long[2:4]] == [("f2", "3"), ("f2", "0")] and len(long) == 6
    with pytest.raises(SchemaError):
        delimited.wide_matrix(spark, put(tmp_path / "bad.txt", "feature\tA\tB\tC\nf1\t1\n"))


def test_wide_matrix_round_trip_keeps_order_spelling_and_repeats(spark, tmp_path):
    from cellweft.operators import qc

    long = delimited.wide_matrix(spark, put(tmp_path / "m.tsv", "id\tB-1\tA-1\tB-1\tC\nf2\t1\t2\t3\t4\nf1\t5\t6\t7\t8\n"))
    kept = qc.keep_listed(long, spark.createDataFrame([("B",), ("A",)], "barcode string"))
    tables.write_wide_matrix(kept, tmp_path / "o.tsv", "id")
    assert (tmp_path / "o.tsv").read_text() == "id\tB-1\tA-1\tB-1\nf2\t1\t2\t3\nf1\t5\t6\t7\n"


@pytest.mark.parametrize("header", ["%%MatrixMarket matrix coordinate integer general", "%%MatrixMarket matrix coordinate unsigned-integer general"])
def test_mtx(spark, tmp_path, header):
    path = put(tmp_path / "a.mtx", f"{header}\n%\n2 3 3\n1 1 5\n2 3 7\n1 2 1\n")
    assert mtx.shape(spark, path) == (2, 3, 3)
    assert sorted(map(tuple, mtx.read(spark, path).collect())) == [(0, 0, 5.0), (0, 1, 1.0), (1, 2, 7.0)]
    assert [tuple(r) for r in mtx.read(spark, path, spark.createDataFrame([(1,), (5,)], "row_idx bigint")).collect()] == [(1, 2, 7.0)]
    cells = spark.createDataFrame([(0, "c0"), (1, "c1")], "idx bigint, name string")
    features = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx bigint, name string")
    assert ("c1", "c", 7.0) in set(map(tuple, mtx.read_triple(spark, path, cells, features).collect()))
    with pytest.raises(SchemaError):
        mtx.read_triple(spark, path, cells, features.limit(2))
    with pytest.raises(Exception, match="outside"):
        mtx.read(spark, put(tmp_path / "b.mtx", f"{header}\n1 1 1\n2 1 1\n")).collect()


def test_mtx_writer_round_trip(spark, tmp_path):
    names = spark.createDataFrame([("b",), ("a",), ("c",)], "barcode string").repartition(3)
    cells = tables.index_names(names, "barcode")
    assert sorted(map(tuple, cells.collect())) == [(0, "a"), (1, "b"), (2, "c")]
    entries = spark.createDataFrame([(2, 1, 3.0), (0, 0, 1.0)], "row_idx bigint, col_idx bigint, value double")
    assert tables.write_mtx(entries, cells, cells.limit(2), tmp_path / "x") == (3, 2, 2)
    assert (tmp_path / "x.mtx").read_text().splitlines()[2:] == ["3 2 2", "1 1 1", "3 2 3"]
    assert (tmp_path / "x_barcodes.tsv").read_text() == "barcode\na\nb\nc\n"
    assert set(map(tuple, mtx.read(spark, f"{tmp_path}/x.mtx").collect())) == {(0, 0, 1.0), (2, 1, 3.0)}


def test_csr(spark):
    got = mtx.csr_to_entries([0, 2, 2, 3], [0, 2, 1], [1.0, 2.0, 3.0], spark)
    assert sorted(map(tuple, got.collect())) == [(0, 0, 1.0), (0, 2, 2.0), (2, 1, 3.0)]


def test_gtf_and_genes(spark, tmp_path):
    from cellweft.operators import guidance

    rows = ["chr1\tx\tgene\t11\t20\t.\t+\t.\tgene_id \"G1.3\"; gene_name \"A\"; gene_type \"p\";", "chr1\tx\tgene\t31\t40\t.\t-\t.\tgene_id \"G2\"; gene_type \"p\";", "chr2\tx\ttranscript\t5\t9\t.\t-\t.\tgene_id \"G3\"; gene_name \"C\";", "chr2\tx\tgene\t1\t2\t.\t+\t.\tgene_id \"G1.9\"; gene_name \"late\";"]
    table = delimited.gtf(spark, put(tmp_path / "g.gtf.gz", "#!x\n" + "\n".join(rows) + "\n"))
    assert [(r.chrom, r.tss, r.gene_name, r.gene_id) for r in guidance.tss_table(table).collect()] == [("chr1", 10, "A", "G1"), ("chr1", 39, "G2", "G2")]
    assert sorted((r.gene_id, r.start, r.end) for r in guidance.coordinates(table).collect()) == [("G1", 10, 20), ("G2", 30, 40), ("G3", 4, 9)]
    with_tss = delimited.gene_coordinates(spark.createDataFrame([("chr1", "5", "+", "A")], "chrom string, tss string, strand string, gene_name string"))
    assert tuple(with_tss.first()) == ("A", "A", "chr1", 5, 6, "+")
    with pytest.raises(SchemaError):
        delimited.gene_coordinates(spark.createDataFrame([("chr1",)], "chrom string"))


def test_panels_manifests_and_evidence(spark, tmp_path):
    head = "gene\tchrom\ttss\tstrand\tcell_type\tcurated_locus_config\n"
    panel = delimited.gene_panel(spark, put(tmp_path / "p.tsv", head + "A\tchr1\t5\t+\tmonocyte\tx\n"))
    assert panel.first().tss == 5 and delimited.panel_genes(spark, str(tmp_path / "p.tsv")) == ["A"]
    for bad in ("A\tchr1\t5\t+\tmonocyte\tx\nA\tchr1\t5\t+\tmonocyte\tx\n", "A\tchr1\t5\t+\tB cell\tx\n"):
        with pytest.raises(SchemaError):
            delimited.gene_panel(spark, put(tmp_path / "q.tsv", head + bad))
    manifest = delimited.tsv(spark, put(tmp_path / "m.tsv", "mark\tprefix\nH1\ta\nH2\tb\n"))
    assert delimited.parse_marks(manifest, "H2, H1,H2") == ["H2", "H1"] and delimited.manifest_row(manifest, "H2")["prefix"] == "b"
    for f in (lambda: delimited.parse_marks(manifest, "H3"), lambda: delimited.manifest_row(manifest, "H3")):
        with pytest.raises(SchemaError):
            f()
    ev = delimited.evidence(spark, put(tmp_path / "e.tsv", "chrom\tstart\tend\tgene\nchr1\t1\t2\t\n"), "atlas").first()
    assert (ev.start, ev.gene, ev.notes, ev.source) == (1, "", "", "atlas")
    loci = "\t".join(delimited.LOCUS_COLUMNS) + "\nL\tA\tchr1\t1\t2\t+\tr\tpromoter\nL\tB\tchr1\t1\t2\t+\tr\tpromoter\n"
    with pytest.raises(SchemaError):
        delimited.curated_loci(spark, put(tmp_path / "l.tsv", loci))
    names = delimited.sample_barcodes(spark, put(tmp_path / "s.csv", "s1,A\ns2,A\ns1,B\n"))
    assert sorted(map(tuple, names.collect())) == [("s1", "A"), ("s1", "B")]
    with pytest.raises(SchemaError):
        delimited.tsv(spark, str(tmp_path / "m.tsv"), ["nope"])


def test_archive(spark, tmp_path):
    text = b"barcode,coarse_cell_type,fine_cell_type,cell_count_in_model\nA-1,T,CD4,3\nA-2,B,naive,4\nC-1,T,CD8,5\n"
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        info = tarfile.TarInfo(archive.MEMBER)
        info.size = len(text)
        tar.addfile(info, io.BytesIO(text))
    got = archive.cell_types(spark, f"{tmp_path}/a.tar.gz").collect()
    assert sorted((r.core, r.fine_cell_type) for r in got) == [("A", "CD4"), ("C", "CD8")]


def test_bundle(spark, tmp_path):
    obs = spark.createDataFrame([("c1",), ("c2",)], "cell string")
    emb = spark.createDataFrame([("c1", "latent", [1.0, 2.0])], "cell string, key string, emb array<double>")
    entries = spark.createDataFrame([(0, 0, 1.0)], "row_idx bigint, col_idx bigint, value double")
    bundle.write(f"{tmp_path}/b", obs, obs, {"counts": entries}, emb, {"a": [1]})
    assert bundle.read_obs(spark, f"{tmp_path}/b").count() == bundle.read_var(spark, f"{tmp_path}/b").count() == 2
    assert bundle.read_layer(spark, f"{tmp_path}/b").first().value == 1.0 and bundle.read_uns(spark, f"{tmp_path}/b") == {"a": [1]}
    wide = bundle.embeddings_wide(bundle.read_embedding(spark, f"{tmp_path}/b", "latent"), "LAT", 2)
    assert bundle.embeddings_long(wide, "LAT").first().emb == [1.0, 2.0]
    both = bundle.concat_modalities({"rna": obs, "chrom_H": obs.withColumn("mark", F.lit("H"))})
    assert both.count() == 4 and both.where("mark is null").count() == 2


def test_discovery(spark, tmp_path):
    folder = tmp_path / "s1"
    folder.mkdir()
    for n in ("x_ADT_counts.tsv", "x_HTO_counts.tsv.gz", "fragments.tsv.gz", "y_ADT_counts.tsv"):
        (folder / n).touch()
    assert [s["prefix"] for s in discovery.samples(tmp_path)] == ["x"]
    mark = tmp_path / "H1"
    mark.mkdir()
    for suffix in discovery.MANIFEST.values():
        (mark / f"run{suffix}").touch()
    rows = discovery.workspace(tmp_path, ["H1", "H2"])
    assert [r["prefix"] for r in rows] == ["run"] and discovery.manifest_frame(spark, rows).count() == 1
    assert [r["status"] for r in discovery.check({"a": str(mark), "b": "/none"})] == ["OK", "MISSING"]
    assert discovery.gene_list("A, B,A", put(tmp_path / "g", "C\n\nB\n")) == ["A", "B", "C"]
    put(mark / "fci_edges.tsv", "")
    assert discovery.graph_method(mark) == "fci"
    with pytest.raises(FileNotFoundError):
        discovery.first_existing(["/none"])


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", None, 2.5), ("a", "x", float("nan"))], "k string, v string, n double")
    assert tables.write_tsv(df, tmp_path / "t.tsv.gz", ["k"]) == 2
    assert gzip.open(tmp_path / "t.tsv.gz", "rt").read() == "k\tv\tn\na\tx\t\nb\t\t2.5\n"
    tables.write_tsv_folder(df, f"{tmp_path}/folder", "gzip")
    assert delimited.tsv(spark, f"{tmp_path}/folder").count() == 2
    bed = tables.bed6(spark.createDataFrame([("chr1", 1, 2, "p", None)], "chrom string, start bigint, end bigint, name string, strand string"))
    assert tuple(bed.first()) == ("chr1", 1, 2, "p", 0, ".")
    bins = tables.bins_bed(spark.createDataFrame([("chr1:5-9",), ("bad",)], "feature string"))
    assert [tuple(r) for r in bins.collect()] == [("chr1", 5, 9, "chr1:5-9")]
    nodes = spark.createDataFrame([("a&b", "gene")], "node string, node_type string")
    edges = spark.createDataFrame([("a&b", "a&b", 0.5)], "source string, target string, weight double")
    tables.write_graphml(nodes, edges, tmp_path / "g.graphml")
    root = ET.parse(tmp_path / "g.graphml").getroot()
    assert [e.get("source") for e in root.iter() if e.tag.endswith("edge")] == ["a&b"]
    tables.write_json({"a": np.float64(1.5), "b": np.arange(2), "c": {3}}, tmp_path / "j.json")
    assert '"b": [\n    0,\n    1\n  ]' in (tmp_path / "j.json").read_text()
    assert "| b |  | 2.5 |" in tables.markdown_report("T", {"S": df})


def test_toy_experiment(spark):
    counts = toy.fragments(spark).groupBy("barcode").count().groupBy("count").count().collect()
    assert {r[0]: r[1] for r in counts} == {170: 40, 180: 2, 50: 2}
    assert toy.cells(spark).select("barcode").distinct().count() == 44
    assert toy.counts(spark, ["HTO_A", "HTO_B"], "hto").count() == 88


def test_folder_keeps_blanks_and_empty_text(spark, tmp_path):
    df = spark.createDataFrame([("  ", "a "), ("", "b"), (None, " c")], "x string, y string")
    tables.write_tsv_folder(df.coalesce(1), f"{tmp_path}/folder")
    tables.write_tsv(df, tmp_path / "file.tsv")
    parts = [p.read_text() for p in (tmp_path / "folder").glob("part-*")]
    assert parts == [(tmp_path / "file.tsv").read_text()] == ["x\ty\n  \ta \n\tb\n\t c\n"]


@pytest.mark.parametrize("inside", [True, False])
@pytest.mark.parametrize("name", ["t.tsv", "t.tsv.gz"])
def test_no_row_of_a_single_file_goes_to_the_driver(spark, tmp_path, monkeypatch, inside, name):
    def fail(*a, **b):
        raise AssertionError("rows go to the driver")

    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", fail)
    path = Path(recovery.scratch(spark, "single").removeprefix("file://")) if inside else tmp_path / "single"
    path.mkdir(parents=True)
    df = spark.range(5000).selectExpr("5000 - id as k", "if(id % 3 = 0, null, id / 7) as x", "concat('ä', id) as t").repartition(7)
    assert tables.write_tsv(df, path / name, ["k"]) == 5000
    data = (path / name).read_bytes()
    lines = (gzip.decompress(data) if name.endswith(".gz") else data).decode().split("\n")
    assert lines == ["k\tx\tt", *("\t".join([str(k), "" if (5000 - k) % 3 == 0 else str((5000 - k) / 7), f"ä{5000 - k}"]) for k in range(1, 5001)), ""]
