"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written
and read again before the next.  All but the last return the columns of
documents, extra ones included, whatever their names; the last returns them with
``copy`` (1, 2, ...; a row for each time the mix takes the document), ``size`` and
``target``, which replace columns of these names.  An empty table stays empty, and
texts of any length are handled whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.llm import decontam, langid, linededup, mixing, neardup
from cellweft.llm._store import keep, once, without


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go.

    Null and empty texts and those without a letter are rejected; repeated rows go
    or stay alike; equal compressed sizes are a rejection; where no language can be
    learned all documents go, where one can all with a letter stay.
    """
    return langid.keep_identified(docs, langid.train(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the first document that has them; no document goes.

    Null texts stay null and empty ones empty; rows that share a doc_id, or have
    none, are one document; a line between templates of equally many documents
    belongs to that of least hash.
    """
    return linededup.dedup(docs).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of least doc_id.

    Null, empty and wordless texts are alike, so one of them stays; rows that share a
    doc_id, or have none, are judged by their own texts; of rows alike in doc_id and
    text one stays; null doc_ids come last, and of texts under one doc_id that of
    least hash stays.
    """
    classes = keep(neardup.near_duplicates(docs), "near")
    stays = (F.col("text_key") == F.col("keeper")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    names = [F.col("doc_id").cast("bigint").alias("doc_id"), neardup.text_key().alias("text_key")]
    gone = keep(classes.where(~stays).select("doc_id", "text_key").distinct(), "gone")
    again = keep(classes.where(stays).groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"), "again")
    kept = without(docs, names, gone)
    return kept if again.isEmpty() else once(kept, names, again)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go.

    Null, empty and wordless texts have no window and stay; repeated rows go or stay
    alike; with an empty benchmark all stay.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document.

    Null, empty and wordless texts have size 0 and are not taken; null sources are
    one source; rows alike in doc_id, source and text are one document, taken as often
    as all of them are; ties between documents follow hashes.
    """
    names = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), neardup.text_key().alias("key")]
    keys = ["doc_id", "source", "key"]
    decided = keep(mixing.mix(docs, key=neardup.text_key()).select(*keys, "size", "copies", "target"), "decided")
    taken = keep(decided.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("copies").cast("int").alias("copies"), F.first("size").alias("size"), F.first("target").alias("target")).where("copies > 0"), "taken")
    again = keep(taken.where("n > 1").select(*keys), "again")
    rows = docs if again.isEmpty() else once(docs, names, again)
    row = rows.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct(*names).alias("own"))
    found = taken.select(F.struct(*keys).alias("other"), "copies", "size", "target")
    got = row.join(found, F.col("own") == F.col("other")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    own: list[Column] = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("copy", "size", "target")]
    return got.select(*own, "copy", "size", "target")


STAGES = [
    ("language identification", identify_language),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Language models, line templates and random rounding have no SQL form; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
