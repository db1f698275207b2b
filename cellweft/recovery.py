"""Where intermediate tables go, so that a lost executor costs only its running tasks."""

from __future__ import annotations

import atexit
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_DEFAULT_DIR = "/tmp/checkpoints/cellweft"
_RUN = uuid.uuid4().hex[:12]
_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named in ``spark.checkpoint.dir`` (or set on the context);
    only where neither is set and the master is local, as in tests, a local default is set.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", sc.master or ""):
            raise ValueError("executors share no folder: name one in spark.checkpoint.dir")
        where = _DEFAULT_DIR
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; local ones go when Python ends."""
    root = f"{shared_dir(spark)}/cellweft-{_RUN}"
    if root not in _made:
        _made.add(root)
        local = root.removeprefix("file://") if root.startswith("file:///") else root
        if local.startswith("/"):
            atexit.register(shutil.rmtree, local, True)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage.

    ``schema`` may give columns another type of the same layout, such as a vector for its struct.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def looked_up(df: DataFrame, name: str, most: int = 1_000_000) -> DataFrame:
    """``df``, which has a row a key, stored, and broadcast to joins if these are at most ``most``, so that few large keys don't gather rows in few tasks."""
    kept = keep(df, name)
    return F.broadcast(kept) if kept.count() <= most else kept
