"""Which files belong to which sample or mark; paths only, nothing is read."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

MANIFEST = {"bin_mtx": "_bin_chromatin_clean.mtx", "bin_barcodes": "_bin_chromatin_clean_barcodes.tsv", "bin_features": "_bin_chromatin_clean_features.tsv", "clean_cells": "_clean_cells.tsv"}


def samples(folder: str | Path) -> list[dict[str, str]]:
    """ADT, HTO and fragment files by prefix; samples that lack one are left out."""
    out = []
    for adt in sorted([*Path(folder).glob("*/*_ADT_counts.tsv"), *Path(folder).glob("*/*_ADT_counts.tsv.gz")]):
        prefix = adt.name.split("_ADT_counts.tsv")[0]
        hto = next((p for s in ("", ".gz") if (p := adt.parent / f"{prefix}_HTO_counts.tsv{s}").exists()), None)
        names = [f"{prefix}_fragments.tsv.gz", f"{prefix}_fragments.tsv", "fragments.tsv.gz", "fragments.tsv"]
        fragments = next((adt.parent / n for n in names if (adt.parent / n).exists()), None)
        if hto and fragments:
            out.append({"prefix": prefix, "adt": str(adt), "hto": str(hto), "fragments": str(fragments)})
    return out


def workspace(root: str | Path, marks: list[str]) -> list[dict[str, str]]:
    """Manifest rows: of each mark's folder the first prefix with every required file."""
    out = []
    for mark in marks:
        folder = Path(root) / mark
        for first in sorted(folder.glob("*" + MANIFEST["bin_mtx"])):
            prefix = first.name.removesuffix(MANIFEST["bin_mtx"])
            paths = {k: folder / (prefix + s) for k, s in MANIFEST.items()}
            if all(p.exists() for p in paths.values()):
                bed = {"bins_bed": folder / f"{prefix}_bins.bed", "peaks_bed": folder / f"{prefix}_peaks.bed"}
                out.append({"mark": mark, "prefix": prefix, **{k: str(p) for k, p in paths.items()}, **{k: str(p) if p.exists() else "" for k, p in bed.items()}})
                break
    return out


def check(items: dict[str, str]) -> list[dict[str, str]]:
    """item, path and status of files that should be there."""
    return [{"item": k, "path": p, "status": "OK" if p and Path(p).exists() else "MISSING"} for k, p in items.items()]


def manifest_frame(spark: SparkSession, rows: list[dict[str, str]]) -> DataFrame:
    names = ["mark", "prefix", *MANIFEST, "bins_bed", "peaks_bed"]
    return spark.createDataFrame([tuple(r.get(n, "") for n in names) for r in rows], ", ".join(f"{n} string" for n in names))


def first_existing(candidates: list[str | Path]) -> str:
    for c in candidates:
        if Path(c).exists():
            return str(c)
    raise FileNotFoundError("none of: " + ", ".join(map(str, candidates)))


def gene_list(text: str | None = None, path: str | Path | None = None) -> list[str]:
    """Genes of a comma-separated text and of a file, in order, once each."""
    names = (text or "").split(",") + (Path(path).read_text().split("\n") if path else [])
    return list(dict.fromkeys(n.strip() for n in names if n.strip()))


def graph_method(folder: str | Path) -> str:
    """Method of a saved graph by its files."""
    for m in ("dagma", "fci", "pc"):
        if (Path(folder) / f"{m}_edges.tsv").exists():
            return m
    raise FileNotFoundError(f"{folder} holds no graph")


def peaks_path(root: str | Path, mark: str, prefix: str) -> str:
    return str(Path(root) / mark / f"{prefix}_peaks.bed")


def saved_graph(spark: SparkSession, folder: str | Path) -> tuple[str, DataFrame, list[str]]:
    """Method, edges and nodes of a saved graph: nodes from its summary, else from the edges."""
    import json

    from . import delimited

    method = graph_method(folder)
    edges = delimited.tsv(spark, str(Path(folder) / f"{method}_edges.tsv"), ["node1", "endpoint1", "node2", "endpoint2"])
    summary = Path(folder) / "summary.json"
    if summary.exists():
        return method, edges, json.loads(summary.read_text())["variables"]
    return method, edges, sorted({n for r in edges.select("node1", "node2").distinct().collect() for n in r})


def quant_mode(summary: str | Path) -> str | None:
    """Scale of a dataset by its summary, if it has one."""
    import json

    path = Path(summary)
    return json.loads(path.read_text()).get("quant_mode") if path.exists() else None
