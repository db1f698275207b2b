"""Cell annotations inside tar archives."""

from __future__ import annotations

import csv
import io
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..schema import SchemaError
from .delimited import first_per

MEMBER = "cell_types/cell_types.csv"


def cell_types(spark: SparkSession, path: str, member: str = MEMBER) -> DataFrame:
    """barcode, core, coarse_cell_type, fine_cell_type, cell_count_in_model of the annotation table in a tar.gz.

    Archives are read where Spark reads them; the first row of a core barcode holds.
    """
    fields = ("barcode", "coarse_cell_type", "fine_cell_type", "cell_count_in_model")

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for content in batch.column("content").to_pylist():
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    file = tar.extractfile(member)
                    table = csv.DictReader(io.TextIOWrapper(file, "utf-8"))
                    missing = set(fields[:3]) - set(table.fieldnames or ())
                    if missing:
                        raise SchemaError(f"{member} lacks {sorted(missing)}")
                    out += [(k, *(r.get(f) for f in fields)) for k, r in enumerate(table)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[k + 1] for r in out], pa.string()) for k in range(4))], names=["_line", *fields])

    got = spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "_line bigint, " + ", ".join(f"{f} string" for f in fields))
    got = got.withColumn("core", ids.strip_10x_suffix(F.col("barcode")))
    return first_per(got, ["core"], ["_line"]).drop("_line")
