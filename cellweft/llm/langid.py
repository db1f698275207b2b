"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of its texts.  A text
is lower-cased, what is no letter becomes a space and a word repeated at once
counts once; then it is cut into pieces of ``PIECE`` bytes, every piece is
compressed with each dictionary, and the language of the smallest total wins.
A narrow margin between the two smallest is a rejection.

Learning: texts and non-null lang of rows whose crc32(doc_id as text) mod 4 is
not 2; per language at most ``per_language`` doc_ids (of least hash), the whole of
one text (the least) of each.

Defined cases: null texts and texts without a letter are ``und`` with score 0
and rejected; with one learned language it is predicted with score 0; with none
every text is ``und``; ties go to the language that sorts first; repeated rows
get the same result; texts of any length are compressed whole; extra columns,
such as score, are ignored by ``predict`` and kept by ``keep_identified``; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._store import keep as stored
from ._store import text_keys, without
from .toxicity import held_out

UNKNOWN = "und"
#: Bytes of text that are compressed at once; the dictionary is what tells languages apart, so pieces stay short.
PIECE = 1024
LEVEL = 5
#: Share by which the smallest total must be below the second, else the text is rejected.
MARGIN = 0.01
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def train(documents: DataFrame, per_language: int = 48) -> dict[str, bytes]:
    """Dictionary content by language."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    able = docs.where("lang is not null and doc_id is not null and text <> ''").where(~held_out(F.col("doc_id")))
    # the least of each of many parts first, so no task ranks a language
    order = [F.xxhash64("doc_id", F.lit(5)), F.col("doc_id")]
    part = able.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(64)).alias("part"))
    part = part.withColumn("place", F.dense_rank().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= per_language)
    ids = part.select("doc_id", "lang").distinct().withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= per_language)
    rows = able.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("lang", "place").agg(F.min("text").alias("text")).collect()
    by: dict[str, list[tuple[int, str]]] = {}
    for r in rows:
        by.setdefault(r.lang, []).append((r.place, r.text))
    return {lang: b" ".join(normalise(t) for _, t in sorted(by[lang])) for lang in sorted(by)}


def normalise(text: str) -> bytes:
    """Lower-cased words of letters, one space between; runs of one word count once."""
    return b" ".join(word for word, _ in groupby(text.lower().encode().translate(_LETTERS).split()))


def framed(piece: bytes) -> bytes:
    """A piece with spaces round it: the format never matches a block's last bytes, so these shouldn't be the text's."""
    return b"  " + piece + b" " * 24


def compressors(dictionaries: dict[str, bytes]) -> list:
    able = []
    for content in dictionaries.values():
        content = content or b" "
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=PIECE, dict_size=len(content), min_match=3, strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_checksum=0)
        content = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=params)
        able.append(zstandard.ZstdCompressor(compression_params=params, dict_data=content).compress)
    return able


def _bounds(text: bytes) -> list[tuple[int, int]]:
    """Pieces of about equal length, at most PIECE bytes."""
    n = -(-len(text) // PIECE) or 1
    cut = [len(text) * k // n for k in range(n + 1)]
    return list(zip(cut, cut[1:], strict=False))


def predict(documents: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """Columns doc_id, held_out, lang_pred, score (share saved against the second), rejected."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(dictionaries)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_predictor(shared, margin, ["doc_id", "held_out"]), "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")
    return stored(got, "languages")


def _predictor(shared, margin: float, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(shared.value)
        able = compressors(shared.value)
        for batch in batches:
            column = batch.column("text")
            letter = np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False), bool)
            data, offsets = T.buffers(column)
            view = data.tobytes()
            pred, scores, rejected = [], np.zeros(len(batch)), np.ones(len(batch), bool)
            for d in range(len(batch)):
                if not letter[d] or not names:
                    pred.append(UNKNOWN)
                    continue
                text = normalise(view[offsets[d] : offsets[d + 1]].decode())
                parts = [framed(text[a:b]) for a, b in _bounds(text)]
                total = [sum(len(c(p)) for p in parts) for c in able]
                best = min(range(len(names)), key=total.__getitem__)
                pred.append(names[best])
                if len(names) > 1:
                    second = min(t for k, t in enumerate(total) if k != best)
                    scores[d] = 1 - total[best] / second
                    rejected[d] = scores[d] < margin
                else:
                    rejected[d] = False
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(pred, pa.string()), pa.array(scores), pa.array(rejected)], names=[*keep, "lang_pred", "score", "rejected"])

    return run


def keep_identified(documents: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The documents, all columns as they are, whose language is not rejected.

    A prediction follows from the text alone, so rejected texts are found by their
    keys, and documents do not travel to Python and back.
    """
    shared = documents.sparkSession.sparkContext.broadcast(dictionaries)
    texts = documents.select(*text_keys(), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(_predictor(shared, margin, ["key1", "key2"]), "key1 bigint, key2 bigint, lang_pred string, score double, rejected boolean")
    return without(documents, text_keys(), stored(found.where("rejected").select("key1", "key2").distinct(), "rejected"))
