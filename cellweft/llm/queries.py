"""The thin queries of the operators, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, hardneg, langid, licenses, linededup, mixing, packing, quality, secrets, simhash, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licenses.scan(_table(spark, sf_dir, "documents"))
    best = F.get("licenses", F.lit(0))
    return got.select("doc_id", "n_words", F.size("licenses").cast("bigint").alias("n_licenses"), F.array_join(F.array_sort(F.transform("licenses", lambda x: x["license"])), ",").alias("licenses"), best["license"].alias("best_license"), F.round(best["coverage"], 6).alias("best_coverage"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = linededup.dedup(_table(spark, sf_dir, "documents"))
    return got.select(F.col("row.doc_id").alias("doc_id"), F.col("n_lines").cast("bigint").alias("n_lines"), F.size("dropped").cast("bigint").alias("n_dropped"), F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("text_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 256))
    finite = F.forall(F.col("embedding").cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    got = hardneg.mine(rows.where(finite).select("vec_id", vector.alias("vector"), label.alias("label")), F.col("vec_id") % 50 == 0)
    return got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_quality, op3_toxicity, op4_simhash, op5_langid, op6_decontaminate, op7_secrets, op8_mix, op9_licenses, op10_line_dedup, op11_hard_negatives, op12_divergence, op13_packing)
}

ORACLES: dict[str, str] = {
    "op1_warc": """
        with p as (select page_id, coalesce(html, '') as body from pages),
        d as (select page_id, octet_length(encode(body)) as n, sha1(body) as digest from p),
        k as (select *, max(page_id) over (partition by digest) as keeper from d)
        select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
               case when n >= 1000 and page_id is distinct from keeper then 'revisit' else 'response' end as record_type,
               case when n >= 1000 and page_id is distinct from keeper then keeper end as refers_to
        from k""",
    "op6_decontaminate": r"""
        with doc as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        item as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        win as (select item_id, least(len(w), 10) as k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i, w from item where len(w) > 0),
        probe as (select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') as g from win),
        sizes as (select distinct k from probe),
        span as (select r, k, unnest(range(1, len(w) - k + 2)) as i, w from doc, sizes where len(w) >= k),
        hit as (select r, s.k, i, item_id from span s join probe p on s.k = p.k and array_to_string(w[i : i + s.k - 1], ' ') = p.g),
        word as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + k)) as j from hit) group by r),
        named as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hit group by r)
        select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
               sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from doc left join word using (r) left join named using (r)""",
    "op12_divergence": r"""
        with doc as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
        word as (select r, lang, source, unnest(w) as term from doc),
        vocab as (select lang, term from word group by lang, term having count(distinct r) >= 10),
        size as (select lang, (select count(*) from vocab v where v.lang = g.lang) as v from (select distinct lang from doc) g),
        held as (select lang, source, term, count(*) as n from word join vocab using (lang, term) group by all),
        groups as (select g.lang, g.source, v, (select coalesce(sum(n), 0) from held h where h.lang = g.lang and h.source = g.source) as total from (select distinct lang, source from doc) g join size using (lang)),
        wholes as (select lang, v, sum(total) as total from groups group by lang, v),
        share as (select g.lang, g.source, t.term, coalesce(n, 0) as n, cast(1 + (1000000000::hugeint * (coalesce(n, 0) + 2)) // (total + 2 * v)::hugeint as hugeint) as p
                  from groups g join vocab t using (lang) left join held h on h.lang = g.lang and h.source = g.source and h.term = t.term),
        whole as (select w.lang, t.term, cast(1 + (1000000000::hugeint * (t.n + 2)) // (total + 2 * v)::hugeint as hugeint) as q
                  from wholes w join (select lang, term, sum(n) as n from held group by all) t using (lang)),
        pair as (select a.lang, a.source, b.source as item, coalesce((select sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) from share x join share y using (lang, term) where x.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value
                 from groups a join groups b using (lang) where a.source <> b.source),
        term as (select lang, source, term as item, ((p - q) * (p - q)) // (p + q) as value from share join whole using (lang, term) where n > 0 and p > q),
        every as (select *, 'pair' as part from pair union all by name select *, 'term' as part from term),
        ranked as (select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from every)
        select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10""",
}
