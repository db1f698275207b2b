"""Command line over tables: qc, match, dataset, graph, sweep, dagma-sweep, plot, support, families.

Tables are Parquet folders or TSV files; results go where --out says.
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import dataset, families, support
from ..operators.causal import runner
from ..sinks import tables
from ..sources import delimited
from . import matching, qc_chain


def read(spark: SparkSession, path: str) -> DataFrame:
    return delimited.tsv(spark, path) if path.endswith((".tsv", ".tsv.gz")) else spark.read.parquet(path)


def long_of(wide: DataFrame, row: str = "sample_id") -> DataFrame:
    """(row, variable, value) of a wide matrix; the columns that name a cell or a distance are no variables."""
    names = [c for c in wide.columns if c.startswith(("expr__", "libsize__")) or "__H3" in c]
    return wide.select(F.col(row).alias("row"), *(F.col(f"`{c}`").try_cast("double").alias(c) for c in names)).unpivot("row", names, "variable", "value")


def window_suffix(bp: int) -> str:
    return f"{bp // 1_000_000}mb" if bp % 1_000_000 == 0 else f"{bp // 1000}kb" if bp % 1000 == 0 else f"{bp}bp"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cellweft", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, **options):
        s = sub.add_parser(name)
        s.add_argument("--out", required=True)
        for key, value in options.items():
            flag = "--" + key.replace("_", "-")
            if value is None:
                s.add_argument(flag, required=True)
            elif isinstance(value, bool):
                s.add_argument(flag, action=argparse.BooleanOptionalAction, default=value)
            elif isinstance(value, list):
                s.add_argument(flag, nargs="+", type=type(value[0]) if value else str, default=value)
            else:
                s.add_argument(flag, type=type(value), default=value)

    add("qc", adt=None, hto=None, fragments=None, sizes=None, peaks="", min_fragments=100, bin_size=5000, q=0.01)
    add("match", embeddings=None, labels=None, label_column="harmonized_coarse", cell_type="monocyte", min_confidence=0.5, marks=["H3K27ac"], n_pairs=0)
    add("dataset", samples=None, rna=None, genes=None, peaks=None, signals=None, window_bp=10000, target_sum=1e4, quant_mode="log1p_norm")
    graph = {"matrix": None, "alpha": 0.05, "test": "kci", "stable": True, "transform": "none", "standardise": True, "background": "tiered_distal_promoter_expr", "min_unique": 2, "min_std": 1e-8}
    add("graph", **graph, method="pc", max_depth=2, family="gaussian", lambda1=0.03, threshold=0.3, stages=5)
    add("sweep", **graph, methods=["pc", "fci"], depths=[1, 2, 3, 4, 5])
    add("dagma-sweep", matrix=None, families=["gaussian"], lambda1=[0.03], threshold=[0.3], stages=[5], background="tiered_distal_promoter_expr")
    add("plot", edges=None, gene_node="", curated="", max_edges=30)
    add("support", nodes=None, evidence=[""], names=[""], min_overlap=1)
    add("families", counts=None)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("cellweft").getOrCreate()
    out = Path(a.out)
    out.mkdir(parents=True, exist_ok=True)

    def spec(**more) -> runner.Spec:
        return runner.Spec(alpha=a.alpha, test={"kci": "kernel"}.get(a.test, a.test), stable=a.stable, transform=a.transform, standardise=a.standardise, background=a.background, min_unique=a.min_unique, min_std=a.min_std, **more)

    if a.command == "qc":
        qc_chain.run(spark, a.adt, a.hto, a.fragments, a.sizes, str(out / "run"), a.peaks or None, min_fragments=a.min_fragments, bin_size=a.bin_size, q=a.q)
    elif a.command == "match":
        samples, pairs, summary = matching.match(read(spark, a.embeddings), read(spark, a.labels), a.label_column, a.cell_type, a.marks, a.n_pairs or None, a.min_confidence)
        for name, df in (("samples", samples), ("pairs", pairs), ("summary", summary)):
            tables.write_tsv(df, out / f"{name}.tsv")
    elif a.command == "dataset":
        genes, peaks = read(spark, a.genes), read(spark, a.peaks)
        near = dataset.nearby_peaks(peaks, genes, a.window_bp)
        entries = spark.read.parquet(a.signals)
        marks = [r.mark for r in near.select("mark").distinct().orderBy("mark").collect()]
        signals = {m: (entries.where(F.col("mark") == m), peaks.where(F.col("mark") == m)) for m in marks}
        for gene in [r.gene for r in genes.select("gene").collect()]:
            own = near.where(F.col("gene") == gene)
            names = [r.variable_name for r in own.orderBy(*dataset.PEAK_ORDER).select("variable_name").collect()]
            long = dataset.locus_matrix(read(spark, a.samples), spark.read.parquet(a.rna), gene, own, signals, a.target_sum, a.quant_mode)
            wide = long.groupBy("sample_id").pivot("variable", dataset.column_order(gene, marks, names)).agg(F.first("value"))
            tables.write_tsv(wide, out / f"{ids.sanitize(gene)}_{window_suffix(a.window_bp)}_matrix.tsv", ["sample_id"])
            tables.write_tsv(own, out / f"{ids.sanitize(gene)}_peaks.tsv", dataset.PEAK_ORDER)
    elif a.command in ("graph", "sweep"):
        long = long_of(read(spark, a.matrix))
        specs = [spec(method=a.method, max_depth=a.max_depth, family=a.family, lambda1=a.lambda1, threshold=a.threshold, stages=a.stages)] if a.command == "graph" else runner.depth_grid(a.methods, a.depths, spec())
        for s in specs:
            edges, summary = runner.run(long, s)
            folder = out if a.command == "graph" else out / runner.run_name(s)
            folder.mkdir(parents=True, exist_ok=True)
            tables.write_tsv(edges, folder / f"{s.method}_edges.tsv", ["node1", "node2"])
            tables.write_json(summary, folder / "summary.json")
    elif a.command == "dagma-sweep":
        wide = read(spark, a.matrix)
        for mode in ("log1p", "raw_counts"):
            presets = [f for f in a.families if runner.quant_mode_of(f) == mode]
            if presets:
                names = runner.select_columns(wide.columns, mode)
                found = runner.sweep(wide.select(*names).na.drop(), names, runner.dagma_grid(presets, a.lambda1, a.threshold, a.stages, runner.Spec(background=a.background)))
                tables.write_tsv(found, out / f"dagma_{mode}_edges.tsv", ["run", F.desc("abs_weight")])
    elif a.command == "plot":
        curated = read(spark, a.curated) if a.curated else spark.createDataFrame([], "node string")
        chosen = support.plot_edges(read(spark, a.edges), a.gene_node, curated, a.max_edges)
        tables.write_tsv(chosen, out / "plot_edges.tsv")
        nodes = chosen.select(F.explode(F.array("node1", "node2")).alias("node")).distinct()
        tables.write_graphml(nodes, chosen.select(F.col("node1").alias("source"), F.col("node2").alias("target"), "endpoint1", "endpoint2"), out / "graph.graphml")
    elif a.command == "support":
        found = None
        for path, name in zip(a.evidence, a.names, strict=True):
            one = delimited.evidence(spark, path, name)
            found = one if found is None else found.unionByName(one)
        nodes = support.nodes(read(spark, a.nodes))
        hits = support.matches(nodes, found, a.min_overlap)
        tables.write_tsv(hits, out / "matches.tsv", ["node", "source"])
        tables.write_tsv(support.summary(nodes, hits, *(a.names + a.names)[:2]), out / "support.tsv", ["node"])
    elif a.command == "families":
        compared = families.compare(families.size_factors(read(spark, a.counts).select("gene", F.col("y").cast("double").alias("y"), F.col("library").cast("double").alias("library"))))
        best = families.best_family(compared)
        tables.write_tsv(compared, out / "families.tsv", ["gene", "family"])
        (out / "report.md").write_text(tables.markdown_report("Count families", {"AIC": compared.orderBy("gene", "family"), "Best": best.orderBy("gene")}) + f"\nRecommended: {families.recommend(best)}\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
