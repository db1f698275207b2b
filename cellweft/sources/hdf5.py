"""10x and annotated-matrix HDF5 files; they need h5py, which Spark has no equal of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .mtx import csr_to_entries

try:
    import h5py
except ImportError:  # exports as Parquet or MatrixMarket are read without it
    h5py = None


def _text(values) -> list[str]:
    return [v.decode() if isinstance(v, bytes) else str(v) for v in values]


def _open(path: str):
    if h5py is None:
        raise ImportError("h5py is not installed; export the matrix as MatrixMarket or Parquet and use sources.mtx or sources.bundle")
    return h5py.File(path, "r")


def read_10x(spark: SparkSession, path: str) -> DataFrame:
    """barcode, feature, gene_id, value of a 10x matrix (features by cells, compressed by cell)."""
    with _open(path) as f:
        m = f["matrix"]
        cells, names, gene_ids = _text(m["barcodes"][:]), _text(m["features/name"][:]), _text(m["features/id"][:])
        entries = csr_to_entries(m["indptr"][:].tolist(), m["indices"][:].tolist(), m["data"][:].astype(float).tolist(), spark)
    rows = spark.createDataFrame(list(enumerate(cells)), "row_idx bigint, barcode string")
    cols = spark.createDataFrame([(k, n, g) for k, (n, g) in enumerate(zip(names, gene_ids, strict=True))], "col_idx bigint, feature string, gene_id string")
    return entries.join(rows, "row_idx").join(cols, "col_idx").select("barcode", "feature", "gene_id", "value")


def read_annotated(spark: SparkSession, path: str, layer: str = "counts") -> DataFrame:
    """cell, feature, value of a layer stored by row."""
    with _open(path) as f:
        obs, var = (f[k][f[k].attrs.get("_index", "_index")][:] for k in ("obs", "var"))
        g = f["layers"][layer] if layer in f.get("layers", {}) else f["X"]
        entries = csr_to_entries(g["indptr"][:].tolist(), g["indices"][:].tolist(), g["data"][:].astype(float).tolist(), spark)
    rows = spark.createDataFrame(list(enumerate(_text(obs))), "row_idx bigint, cell string")
    cols = spark.createDataFrame(list(enumerate(_text(var))), "col_idx bigint, feature string")
    return entries.join(rows, "row_idx").join(cols, "col_idx").select("cell", "feature", "value")


def pick(candidates: list[str]) -> str:
    from .discovery import first_existing

    return first_existing(candidates)
