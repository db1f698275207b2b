"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of a text is a blob, named by its SHA-256.  The ledger is a
Parquet table with one row for each blob and rule version scanned so far.  A
scan hashes all rows, keeps one copy of each blob that the ledger lacks under
the current rule version, runs the rules over these only, appends the findings
and joins the ledger back to all rows (paths) that hold a blob.  Scans at once may
append a blob twice; its entries are alike and count as one when read.

Rules: the three base kinds, then kinds the method adds; each finds leftmost
non-overlapping spans, in code points, end exclusive.

Defined cases: a null text is the empty blob; repeated rows share their blob's
findings; texts of any length are scanned whole; spans that begin together come
as the kinds are listed; an empty table gives an empty result; extra columns, such
as spans, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ._store import scratch

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: A run is found whole, so asking for 16 (after AKIA 14) characters equals dropping shorter runs.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_MORE = [
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), "-----BEGIN"),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), "eyJ"),
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), "gh"),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), "xox"),
    ("url", re.compile(r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@"), "://"),
]
BASE = ("assign", "access", "hex")
KINDS = (*BASE, *(k for k, _, _ in _MORE))
RULES = "1"
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as listed."""
    if not text:
        return []
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for k, (_, pattern, needs) in enumerate(_MORE, 3):
        if needs in text:
            found += [(m.start(), k, m.end()) for m in pattern.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t.as_py())] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(spans, kind)], names=["blob", "spans"])


def scan(documents: DataFrame, ledger: str | None = None, rules: str = RULES) -> DataFrame:
    """doc_id, blob and spans of every row; ``ledger`` (a folder) is read and added to.

    Without a ledger a fresh one is made in the shared folder.
    """
    spark = documents.sparkSession
    paths = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paths = paths.withColumn("blob", F.sha2("text", 256))
    known = None
    if ledger is None:
        ledger = scratch(spark, "ledger")
    else:
        try:
            known = spark.read.schema(f"blob string, spans {_SPANS}, rules string").parquet(ledger).where(F.col("rules") == rules).select("blob")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    unseen = paths.select("blob", "text")
    if known is not None:
        unseen = unseen.join(known, "blob", "left_anti")
    unseen = unseen.groupBy("blob").agg(F.first("text").alias("text"))
    unseen.select("blob", "text").mapInArrow(_scan, f"blob string, spans {_SPANS}").withColumn("rules", F.lit(rules)).write.mode("append").parquet(ledger)
    entries = spark.read.schema(f"blob string, spans {_SPANS}, rules string").parquet(ledger).where((F.col("rules") == rules) & (F.size("spans") > 0)).groupBy("blob").agg(F.first("spans").alias("spans"))
    found = paths.select("doc_id", "blob").join(entries, "blob", "left")
    return found.select("doc_id", "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and span strings of each row of ``scan``."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def sha256(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()
