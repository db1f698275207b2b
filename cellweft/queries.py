"""Driver queries of the engine's own operators over the star-schema stand-ins.

A cell is an order, a feature a part, a count a quantity; parts are peaks and
suppliers genes on twenty chromosomes; embeddings are cells with labels.  Each
query runs over its whole tables.  Where DuckDB can say the same, SQL stands
beside it; results that are floats are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import recovery
from .functions import ids, intervals, scores
from .operators import assignment, clusters, counting, dataset, demux, embedding, families, guidance, guided, joins, latent, matrix, metacells, neighbours, peaks, qc, range_joins, support, transforms, umap
from .operators.causal import priors, random_features, runner
from .sources.delimited import expand_barcodes, first_per, guidance_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Stand-ins, in Spark and in SQL.


def _fragments(s: SparkSession, d: str) -> DataFrame:
    start = F.col("l_partkey") * 100 + F.col("l_linenumber") * 7
    return table(s, d, "lineitem").select(F.concat(F.lit("chr"), F.col("l_suppkey") % 20).alias("chrom"), start.alias("start"), (start + 30 + F.col("l_quantity").cast("bigint")).alias("end"), F.col("l_orderkey").cast("string").alias("barcode"))


FRAGMENTS = "frag as (select 'chr' || (l_suppkey % 20) as chrom, l_partkey * 100 + l_linenumber * 7 as s, l_partkey * 100 + l_linenumber * 7 + 30 + cast(l_quantity as bigint) as e, cast(l_orderkey as varchar) as barcode, row_number() over () as id from lineitem)"


def _peaks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.concat(F.lit("chr"), F.col("p_partkey") % 20).alias("chrom"), (F.col("p_partkey") * 100).alias("start"), (F.col("p_partkey") * 100 + 50 + F.col("p_size")).alias("end"), F.concat(F.lit("peak_"), F.col("p_partkey")).alias("name"), F.element_at(F.array(F.lit("H3K27ac"), F.lit("H3K4me3"), F.lit("H3K27me3")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("mark"))


PEAKS = "peak as (select 'chr' || (p_partkey % 20) as chrom, p_partkey * 100 as s, p_partkey * 100 + 50 + p_size as e, 'peak_' || p_partkey as name, (['H3K27ac', 'H3K4me3', 'H3K27me3'])[p_partkey % 3 + 1] as mark from part)"


def _genes(s: SparkSession, d: str) -> DataFrame:
    tss = F.col("s_suppkey") * 2000 + 500
    plus = F.col("s_nationkey") % 2 == 0
    return table(s, d, "supplier").select(F.concat(F.lit("chr"), F.col("s_suppkey") % 20).alias("chrom"), tss.alias("tss"), F.when(plus, "+").otherwise("-").alias("strand"), F.col("s_name").alias("gene_name"), F.col("s_name").alias("gene"), F.when(plus, tss).otherwise(tss - 1499).alias("start"), F.when(plus, tss + 1500).otherwise(tss + 1).alias("end"))


GENES = "gene as (select 'chr' || (s_suppkey % 20) as chrom, s_suppkey * 2000 + 500 as tss, case when s_nationkey % 2 = 0 then '+' else '-' end as strand, s_name as gene, case when s_nationkey % 2 = 0 then s_suppkey * 2000 + 500 else s_suppkey * 2000 + 500 - 1499 end as s, case when s_nationkey % 2 = 0 then s_suppkey * 2000 + 2000 else s_suppkey * 2000 + 501 end as e from supplier)"


def _entries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("feature")).agg(F.sum("l_quantity").alias("value"))


ENTRIES = "ent as (select l_orderkey as cell, l_partkey as feature, sum(l_quantity) as value from lineitem group by all)"


def _points(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("emb"), F.col("label").cast("string").alias("label"))


POINTS = "pt as (select vec_id as id, cast(embedding as double[]) as emb, cast(label as varchar) as label from embeddings)"


# Counts and quality control.


@query("select cast(user_id as varchar) as barcode, count(*) as n from events group by all")
def fragment_counts(s, d):
    return qc.fragment_counts(table(s, d, "events").select(F.col("user_id").cast("string").alias("barcode")))


@query("""with raw as (select cast(user_id as varchar) || case when event_id % 2 = 0 then '-1' else '.2' end as b, count(*) as n from events group by all)
select regexp_replace(regexp_replace(b, '\\.\\d+$', ''), '-\\d+$', '') as barcode, max(n) as n from raw group by all""")
def normalized_barcode_max(s, d):
    suffix = F.when(F.col("event_id") % 2 == 0, "-1").otherwise(".2")
    return qc.normalized_counts(qc.fragment_counts(table(s, d, "events").select(F.concat(F.col("user_id"), suffix).alias("barcode"))))


@query("""select o_orderkey::varchar as barcode, case o_orderstatus when 'P' then 'Doublet' else 'Singlet' end as hto_classification, o_orderpriority as donor_id, n as n_cuttag_fragments
from orders join (select l_orderkey, count(*) as n from lineitem group by all) c on o_orderkey = l_orderkey
where o_orderstatus <> 'P' and o_orderpriority not like '5%' and n >= 3""")
def clean_cells(s, d):
    meta = table(s, d, "orders").select(
        F.concat(F.lit(" "), F.col("o_orderkey"), F.lit("-1")).alias("barcode"), F.when(F.col("o_orderstatus") == "P", "Doublet").otherwise("Singlet").alias("hto_classification"), F.when(F.col("o_orderpriority").startswith("5"), " nan ").otherwise(F.col("o_orderpriority")).alias("donor_id")
    )
    counts = qc.fragment_counts(_fragments(s, d))
    return qc.clean_cells(meta, counts, 3)


@query("""select l_orderkey::varchar as barcode, sum(l_quantity) as adt_total, cast(sum(l_linenumber) as double) as hto_total from lineitem group by all having sum(l_quantity) >= 100 and sum(l_linenumber) >= 6""")
def count_thresholds(s, d):
    rows = table(s, d, "lineitem").withColumn("barcode", F.col("l_orderkey").cast("string"))
    return qc.count_thresholds(rows.withColumn("count", F.col("l_quantity")), rows.withColumn("count", F.col("l_linenumber").cast("double")), 100, 6)


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority like '1%')")
def whitelist_semi(s, d):
    listed = table(s, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").cast("string").alias("barcode"))
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.col("l_orderkey"), F.lit("-2")).alias("barcode"))
    return qc.keep_listed(rows, listed).drop("barcode")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderpriority like '1%')")
def whitelist_anti(s, d):
    listed = table(s, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").cast("string").alias("barcode"))
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").cast("string").alias("barcode"))
    return qc.drop_listed(rows, listed).drop("barcode")


@query("""select distinct unnest([c_custkey || '-7', c_custkey || '', c_custkey || '-1', c_custkey || '.1']) as barcode from customer""")
def suffix_expand_join(s, d):
    return expand_barcodes(table(s, d, "customer").select(F.concat(F.col("c_custkey"), F.lit("-7")).alias("barcode")))


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts, event_id) = 1")
def first_occurrence(s, d):
    return first_per(table(s, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""select o_orderkey as id, o_orderstatus = 'F' as singlet_flag, o_orderstatus = 'P' as doublet_flag, o_orderstatus = 'O' as negative_flag from orders""")
def class_flags(s, d):
    cls = F.when(F.col("o_orderstatus") == "F", "Singlet").when(F.col("o_orderstatus") == "P", "Doublet").otherwise("Negative")
    return qc.class_flags(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), cls.alias("hto_classification"))).drop("hto_classification")


@query(f"""with {ENTRIES}, f as (select feature from ent where value > 0 group by all having count(distinct cell) >= 20), e as (select * from ent where feature in (select feature from f)),
c as (select cell from e where value > 0 group by all having count(distinct feature) >= 3) select cell, feature, value from e where cell in (select cell from c)""")
def filter_matrix(s, d):
    return qc.filter_matrix(_entries(s, d), 20, 3, unique=True)


@query("""with t as (select l_orderkey as metacell, count(*) filter (l_returnflag = 'A') as a, count(*) filter (l_returnflag = 'N') as n, count(*) filter (l_returnflag = 'R') as r from lineitem group by all)
select metacell, a >= 2 and n >= 1 and r >= 1 as qc_pass from t""")
def metacell_qc(s, d):
    n = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("metacell"), F.col("l_returnflag").alias("modality")).agg(F.count("*").alias("n"))
    return qc.metacell_pass(n, ["A", "N", "R"], "A", 2, 1)


@query()
def capped_sample(s, d):
    return qc.capped_sample(table(s, d, "events").select("event_id", "event_type"), "event_type", "event_id", 200, 7)


# Matrices of counts.


@query(f"with {ENTRIES} select cell, feature, value from ent")
def cell_feature_counts(s, d):
    return _entries(s, d)


@query(f"""with {FRAGMENTS}, hit as (select barcode, chrom, unnest(list_distinct([s // 5000, (e - 1) // 5000])) as b from frag)
select barcode as cell, chrom || ':' || (b * 5000) || '-' || ((b + 1) * 5000) as feature, cast(count(*) as double) as value from hit group by all""")
def fixed_bins(s, d):
    return counting.bin_counts(_fragments(s, d), 5000)


@query("""with sz as (select 'chr' || (p_partkey % 20) as chrom, max(p_partkey) * 100 + 777 as size from part group by all), b as (select chrom, size, unnest(range(0, (size - 1) // 5000 + 1)) as k from sz)
select chrom, k * 5000 as start, least((k + 1) * 5000, size) as end, chrom || ':' || (k * 5000) || '-' || least((k + 1) * 5000, size) as name from b""")
def bin_universe(s, d):
    sizes = table(s, d, "part").groupBy(F.concat(F.lit("chr"), F.col("p_partkey") % 20).alias("chrom")).agg((F.max("p_partkey") * 100 + 777).alias("size"))
    return counting.bin_universe(sizes, 5000)


@query(f"""with {FRAGMENTS}, {PEAKS}, ends as (select id, barcode, chrom, unnest(list_distinct([s, e - 1])) as p from frag)
select barcode as cell, name as feature, cast(count(distinct id) as double) as value from ends join peak on ends.chrom = peak.chrom and p >= peak.s and p < peak.e group by all""")
def peak_counts(s, d):
    return counting.peak_counts(_fragments(s, d), _peaks(s, d))


@query(f"with {ENTRIES} select cell, sum(value) as library from ent group by all")
def library_size(s, d):
    return counting.library_sizes(_entries(s, d))


@query(f"with {ENTRIES} select cell, feature, round(ln(1 + value * 1e4 / sum(value) over (partition by cell)), 6) as value from ent")
def log1p_norm(s, d):
    return counting.normalise(_entries(s, d)).select("cell", "feature", F.round("value", 6).alias("value"))


def _regions(s: SparkSession, d: str) -> DataFrame:
    return _genes(s, d).select("chrom", F.greatest(F.col("tss") - 4000, F.lit(0)).alias("start"), (F.col("tss") + 4000).alias("end"), F.col("gene").alias("region"))


REGIONS = f"{GENES}, region as (select chrom, greatest(tss - 4000, 0) as s, tss + 4000 as e, gene as region from gene)"


@query(f"""with {PEAKS}, {REGIONS}, ov as (select region, name from peak join region on peak.chrom = region.chrom and peak.s < region.e and peak.e > region.s)
select region, count(*) as n_bins, array_to_string(list_slice(list_sort(list(name)), 1, 3), ';') as bin_features, count(*) > 3 as bin_features_truncated from ov group by all""")
def region_bin_list(s, d):
    return counting.bin_lists(counting.bins_of_regions(_peaks(s, d), _regions(s, d)), 3)


@query(f"""with {PEAKS}, {REGIONS}, ov as (select region, name from peak join region on peak.chrom = region.chrom and peak.s < region.e and peak.e > region.s),
ent as (select l_orderkey as cell, 'peak_' || l_partkey as feature, sum(l_quantity) as value from lineitem group by all), lib as (select cell, sum(value) as library from ent group by all),
nb as (select region, count(*) as n from ov group by all), tot as (select cell, region, sum(value) as t from ent join ov on feature = name group by all)
select lib.cell, region.region, round(case when coalesce(n, 0) > 0 then ln(1 + coalesce(t, 0) / n * 1e4 / case when library > 0 then library else 1 end) end, 6) as score, library
from lib cross join region left join nb using (region) left join tot on tot.cell = lib.cell and tot.region = region.region""")
def region_scores(s, d):
    regions = _regions(s, d)
    entries = _entries(s, d).withColumn("feature", F.concat(F.lit("peak_"), F.col("feature")))
    got = counting.region_scores(entries, counting.bins_of_regions(_peaks(s, d), regions), regions, entries.select("cell").distinct())
    # rounding goes by decimals, which takes longer than all else where most scores are zero
    return got.select("cell", "region", F.when(F.col("score") != 0, F.round("score", 6)).otherwise(F.col("score")).alias("score"), "library")


# Interval joins.


@query(f"""with {FRAGMENTS}, {PEAKS} select barcode, frag.s as start, name from frag join peak on frag.chrom = peak.chrom and frag.s < peak.e and frag.e > peak.s""")
def overlap_join(s, d):
    got = range_joins.overlap_join(_fragments(s, d), _peaks(s, d), tile=500)
    return got.select(F.col("a_barcode").alias("barcode"), F.col("a_start").alias("start"), F.col("b_name").alias("name"))


@query(f"""with {FRAGMENTS}, {PEAKS} select barcode, frag.s as start, name, least(frag.e, peak.e) - greatest(frag.s, peak.s) as length from frag join peak on frag.chrom = peak.chrom and least(frag.e, peak.e) - greatest(frag.s, peak.s) >= 40""")
def min_overlap_join(s, d):
    got = range_joins.overlap_join(_fragments(s, d), _peaks(s, d), 40, tile=500)
    return got.select(F.col("a_barcode").alias("barcode"), F.col("a_start").alias("start"), F.col("b_name").alias("name"), intervals.overlap_length(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")).alias("length"))


DISTANCE = "case when not (gene.e <= peak.s or gene.s >= peak.e) then 0 when peak.s >= gene.e then peak.s - gene.e + 1 else peak.e - gene.s - 1 end"


@query(f"""with {PEAKS}, {GENES} select gene, name, {DISTANCE} as distance from gene join peak on gene.chrom = peak.chrom and abs({DISTANCE}) <= 8000""")
def window_distance_join(s, d):
    got = range_joins.window_join(_genes(s, d), _peaks(s, d), 8000)
    return got.select(F.col("a_gene").alias("gene"), F.col("b_name").alias("name"), "distance")


@query(f"""with {PEAKS}, {GENES} select gene, name, cast(abs(tss - (peak.s + peak.e) // 2) as bigint) as distance from gene join peak on gene.chrom = peak.chrom and abs(tss - (peak.s + peak.e) // 2) <= 6000""")
def center_tss_join(s, d):
    got = range_joins.center_tss_join(_peaks(s, d), _genes(s, d), 6000)
    return got.select(F.col("b_gene").alias("gene"), F.col("a_name").alias("name"), "distance")


LINKS = f"link as (select name as feature, gene, abs({DISTANCE}) as distance, round(exp(-abs({DISTANCE}) / 20000.0), 6) as weight, mark from gene join peak on gene.chrom = peak.chrom and abs({DISTANCE}) <= 30000)"


def _links(s: SparkSession, d: str, k: int = 0) -> DataFrame:
    regions = guidance.regions(_genes(s, d), "gene_body")
    got = guidance.links(_peaks(s, d), regions, "", 30000, "exp", 1.0, 20000.0, k).drop("mark")
    return got.join(_peaks(s, d).select(F.col("name").alias("feature"), "mark"), "feature").withColumn("weight", F.round("weight", 6))


@query(f"""with {PEAKS}, {GENES}, {LINKS} select feature, gene, distance, weight from link qualify row_number() over (partition by feature order by distance, gene) <= 2""")
def nearest_k_per_bin(s, d):
    return _links(s, d, 2).select("feature", "gene", "distance", "weight")


EDGES = """edge as (select gene as source, feature as target, weight, case mark when 'H3K27me3' then -1 else 1 end as sign, distance as distance_bp, mark, 'fwd' as type from link
union all select feature, gene, weight, case mark when 'H3K27me3' then -1 else 1 end, distance, mark, 'rev' from link
union all select name, name, 1.0, 1, 0, 'self', 'loop' from peak union all select gene, gene, 1.0, 1, 0, 'self', 'loop' from gene)"""


def _edges(s: SparkSession, d: str) -> DataFrame:
    signs = {m: v[0] for m, v in guidance.MARK_DEFAULTS.items()}
    return guidance.edges(_links(s, d), signs, _peaks(s, d).select(F.col("name").alias("feature"), "mark"), _genes(s, d).select("gene"))


@query(f"with {PEAKS}, {GENES}, {LINKS}, {EDGES} select source, target, cast(weight as double) as weight, sign, cast(distance_bp as bigint) as distance_bp, mark, type from edge")
def guidance_edges(s, d):
    return _edges(s, d)


@query(f"with {PEAKS}, {GENES}, {LINKS} select mark, count(*) as n_links, count(distinct gene) as n_genes, count(distinct feature) as n_bins from link group by all")
def guidance_stats(s, d):
    return guidance.graph_stats(_edges(s, d))


@query(f"with {PEAKS}, {GENES}, {LINKS} select distinct feature from link where gene = (select min(s_name) from supplier) and mark = 'H3K27ac'")
def linked_features(s, d):
    gene = table(s, d, "supplier").agg(F.min("s_name")).first()[0]
    return guidance.linked_features(_edges(s, d), gene, "H3K27ac")


@query(f"""with {GENES}, r as (select gene, greatest(case when strand = '-' then e - 1 else s - 600 end, 0) as ps, case when strand = '-' then e + 600 else s + 1 end as pe,
greatest(case when strand = '-' then s else s - 600 end, 0) as cs, case when strand = '-' then e + 600 else e end as ce from gene) select gene, ps as promoter_start, pe as promoter_end, cs as combined_start, ce as combined_end from r""")
def gene_region(s, d):
    p, c = (intervals.gene_region(F.col("start"), F.col("end"), F.col("strand"), k, 600) for k in ("promoter", "combined"))
    return _genes(s, d).select("gene", p["start"].alias("promoter_start"), p["end"].alias("promoter_end"), c["start"].alias("combined_start"), c["end"].alias("combined_end"))


@query(f"with {PEAKS} select name, chrom, s as start, e as end from peak")
def interval_parse(s, d):
    text = ids.namespaced(F.col("mark"), intervals.format_name(F.col("chrom"), F.col("start"), F.col("end")))
    return _peaks(s, d).select("name", intervals.parse(text).alias("at")).select("name", "at.chrom", "at.start", "at.end")


@query("""select case when value < 0 then -1 else 1 end as sign, count(*) as n, round(sum(least(w, 1.0)), 4) as weight from (select value, case when event_id % 7 = 0 then null when event_id % 5 = 0 then 0.0 else abs(value) / 50 end as w from events) where w is not null and w > 0 group by all""")
def graph_cleaning(s, d):
    w = F.when(F.col("event_id") % 7 == 0, F.when(F.col("event_id") % 2 == 0, float("nan"))).when(F.col("event_id") % 5 == 0, 0.0).otherwise(F.abs("value") / 50)
    got = guidance_graph(table(s, d, "events").select(w.alias("weight"), F.col("value").alias("sign")))
    return got.groupBy("sign").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query(f"""with {PEAKS}, {GENES} select gene, mark, peak.chrom || ':' || peak.s || '-' || peak.e || '__' || mark as variable_name, peak.chrom, peak.s as start, peak.e as end,
cast(((peak.s + peak.e) // 2 - tss) * case when strand = '+' then 1 else -1 end as bigint) as signed_distance_to_tss from peak join gene on peak.chrom = gene.chrom and peak.e > greatest(tss - 5000, 0) and peak.s < tss + 5000""")
def nearby_peaks(s, d):
    return dataset.nearby_peaks(_peaks(s, d), _genes(s, d), 5000)


# Sparse statistics.


@query("""select l_returnflag as variable, count(distinct l_quantity) as n_unique, round(stddev_samp(l_quantity), 6) as std, round(avg(cast(l_quantity = 0 as int)), 6) as zero_fraction, 0.0::double as missing_fraction, min(l_quantity) as min, max(l_quantity) as max, round(avg(l_quantity), 6) as mean from lineitem group by all""")
def feature_stats(s, d):
    got = matrix.column_stats(table(s, d, "lineitem").select(F.col("l_returnflag").alias("variable"), F.col("l_quantity").alias("value")))
    return got.withColumns({c: F.round(c, 6) for c in ("std", "zero_fraction", "mean")})


@query(f"""with {ENTRIES}, n as (select count(distinct cell) as n from ent), m as (select feature, sum(value) / any_value(n) as mean, sum(value * value) / any_value(n) as sq from ent cross join n group by all), v as (select *, sqrt(greatest(sq - mean * mean, 0)) as sd from m)
select feature, round(mean, 6) as mean, round(case when sd < 1e-6 then 1 else sd end, 6) as std from v""")
def sparse_feature_stats(s, d):
    e = _entries(s, d)
    n = e.select("cell").distinct().count()
    return matrix.sparse_feature_stats(e, n).select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""with {ENTRIES}, r as (select cell, sum(value) as t from ent group by all), c as (select feature, count(*) as df from ent where value > 0 group by all), n as (select count(distinct cell) as n from ent)
select cell, feature, round(value / t * ln(1 + n / df), 6) as value from ent join r using (cell) join c using (feature) cross join n""")
def tfidf(s, d):
    e = _entries(s, d)
    n = e.select("cell").distinct().count()
    return matrix.tf_idf(e, n).select("cell", "feature", F.round("value", 6).alias("value"))


@query(f"with {ENTRIES} select feature, sum(value) as total from ent group by all order by total desc, feature limit 100")
def top_features(s, d):
    return matrix.top_features(_entries(s, d), 100)


@query(f"with {ENTRIES} select feature, sum(value) as total, count(*) filter (value > 0) as n_cells from ent group by all")
def feature_totals(s, d):
    return counting.feature_totals(_entries(s, d))


@query("""with e as (select l_orderkey as cell, 'peak_' || l_partkey as feature, sum(l_quantity) as value from lineitem group by all), """ + f"{PEAKS}, {GENES}, {LINKS}" + """
select cell, gene, round(sum(value * weight), 6) as value from e join link using (feature) group by all having sum(value * weight) <> 0""")
def gene_score_product(s, d):
    e = _entries(s, d).withColumn("feature", F.concat(F.lit("peak_"), F.col("feature")))
    return matrix.gene_scores(e, _links(s, d)).withColumn("value", F.round("value", 6))


@query(f"""with {ENTRIES}, t as (select p_partkey as feature, row_number() over (order by p_partkey) - 1 as idx from part where p_size <= 25)
select feature, idx, feature in (select feature from ent) as feature_available from t""")
def feature_align(s, d):
    target = guidance.indexed(table(s, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("feature")), ["feature"]).withColumn("idx", F.col("idx").cast("bigint"))
    return matrix.align_features(_entries(s, d), target)[1]


@query("""select l_suppkey as supplier, count(*) filter (l_returnflag = 'A') as "A", count(*) filter (l_returnflag = 'N') as "N", count(*) filter (l_returnflag = 'R') as "R" from lineitem group by all""")
def crosstab(s, d):
    return matrix.crosstab(table(s, d, "lineitem").withColumnRenamed("l_suppkey", "supplier"), "supplier", "l_returnflag", ["A", "N", "R"])


@query("""select l_suppkey as supplier, round(avg(cast(l_returnflag = 'A' as int)), 6) as "A", round(avg(cast(l_returnflag = 'N' as int)), 6) as "N", round(avg(cast(l_returnflag = 'R' as int)), 6) as "R" from lineitem group by all""")
def crosstab_fraction(s, d):
    got = matrix.row_fractions(crosstab(s, d), ["A", "N", "R"])
    return got.select("supplier", *(F.round(c, 6).alias(c) for c in "ANR"))


@query("""with v as (select l_suppkey as query, l_returnflag as label, count(*) as n, min(l_orderkey * 10 + l_linenumber) as first from lineitem group by all)
select query, label, round(n / sum(n) over (partition by query), 6) as share from v qualify row_number() over (partition by query order by n desc, first) = 1""")
def majority_label(s, d):
    votes = table(s, d, "lineitem").select(F.col("l_suppkey").alias("query"), F.col("l_returnflag").alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank"))
    return neighbours.majority(votes, "query", "label").withColumn("share", F.round("share", 6))


@query("select l_returnflag as mark, count(*) as n, round(avg(l_extendedprice), 4) as mean_distance, round(median(l_extendedprice), 4) as median_distance, max(l_extendedprice) as max_distance from lineitem group by all")
def match_summary(s, d):
    got = assignment.match_summary(table(s, d, "lineitem").select(F.col("l_returnflag").alias("mark"), F.col("l_extendedprice").alias("match_distance")))
    return got.withColumns({c: F.round(c, 4) for c in ("mean_distance", "median_distance")})


@query("""select c_custkey, coalesce(n_name, c_mktsegment) as harmonized_coarse, coalesce(cast(n_regionkey as varchar), cast(c_nationkey as varchar)) as harmonized_fine, n_name is null as unmapped
from customer left join (select * from nation where n_regionkey < 3) on c_nationkey = n_nationkey""")
def label_harmonize(s, d):
    cells = table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("coarse_cell_type"), F.col("c_nationkey").cast("string").alias("fine_cell_type"))
    lookup = table(s, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("fine_cell_type"), F.col("n_name").alias("harmonized_coarse"), F.col("n_regionkey").cast("string").alias("harmonized_fine"))
    lookup = lookup.join(cells.select("coarse_cell_type").distinct())
    return dataset.harmonise(cells, lookup).select("c_custkey", "harmonized_coarse", "harmonized_fine", "unmapped")


@query("""with s as (select o_custkey || '-' || (o_orderkey % 3) as barcode, o_custkey::varchar as core, min(o_orderstatus) as sample_id from orders group by all), c as (select core, min_by(sample_id, barcode) as by_core from s group by all)
select c_custkey, coalesce(s.sample_id, by_core, 'rna') as sample_id from customer left join s on c_custkey || '-1' = s.barcode left join c on c_custkey::varchar = c.core""")
def two_step_fallback_join(s, d):
    core = F.col("o_custkey").cast("string")
    samples = table(s, d, "orders").groupBy(F.concat(core, F.lit("-"), F.col("o_orderkey") % 3).alias("barcode"), core.alias("core")).agg(F.min("o_orderstatus").alias("sample_id"))
    cells = table(s, d, "customer").select("c_custkey")
    barcode = F.concat(F.col("c_custkey"), F.lit("-1"))
    return dataset.two_step(cells, samples, barcode, ids.strip_10x_suffix(barcode), "rna")


# Neighbours.


@query(f"""with {POINTS}, p as (select a.id as query, b.id as neighbour, list_distance(a.emb, b.emb) as distance from pt a join pt b on a.id <> b.id)
select query, neighbour, round(distance, 6) as distance, row_number() over (partition by query order by distance, neighbour) as rank from p qualify rank <= 10""")
def knn_topk(s, d):
    p = _points(s, d).select("id", "emb")
    return neighbours.knn(p, p, 10, skip_self=True).select("query", "neighbour", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""with {POINTS}, p as (select a.id, b.label, min(list_distance(a.emb, b.emb)) as m from pt a join pt b on a.label = '0' and b.label <> '0' group by all)
select id, round(avg(m), 6) as support_mean, round(max(m), 6) as support_max, count(*) as n_marks from p group by all""")
def nn_support(s, d):
    p = _points(s, d)
    got = neighbours.nearest_support(p.where("label = '0'").select("id", "emb"), p.where("label <> '0'").withColumnRenamed("label", "mark"))
    return got.withColumns({c: F.round(c, 6) for c in ("support_mean", "support_max")})


@query(f"""with {POINTS}, r as (select id, emb, 'c' || (cast(label as int) % 3) as coarse, 'f' || label as fine from pt where id % 2 = 0), q as (select id, emb from pt where id % 2 = 1),
v as (select q.id as query, coarse, fine, row_number() over (partition by q.id order by list_distance(q.emb, r.emb), r.id) as rank from q cross join r qualify rank <= 15),
c as (select query, coarse, count(*) as n, min(rank) as f from v group by all), cb as (select query, coarse, n / 15 as conf from c qualify row_number() over (partition by query order by n desc, f) = 1),
p as (select v.query, v.fine, v.rank from v join cb on v.query = cb.query and v.coarse = cb.coarse), fc as (select query, fine, count(*) as n, min(rank) as f from p group by all),
fb as (select query, fine, n / sum(n) over (partition by query) as conf from fc qualify row_number() over (partition by query order by n desc, f) = 1)
select cb.query, case when cb.conf >= 0.5 then coarse else 'unknown' end as coarse, case when fb.conf >= 0.5 then fine else 'unknown' end as fine, round(cb.conf, 6) as coarse_confidence, round(fb.conf, 6) as fine_confidence from cb join fb using (query)""")
def label_transfer(s, d):
    p = _points(s, d)
    refs = p.where("id % 2 = 0")
    near = neighbours.knn(p.where("id % 2 = 1").select("id", "emb"), refs.select("id", "emb"), 15)
    labels = refs.select("id", F.concat(F.lit("c"), F.col("label").cast("int") % 3).alias("coarse"), F.concat(F.lit("f"), F.col("label")).alias("fine"), F.lit(None).cast("string").alias("ontology"))
    got = neighbours.transfer_labels(near, labels, 0.5).drop("ontology")
    return got.withColumns({c: F.round(c, 6) for c in ("coarse_confidence", "fine_confidence")})


@query(f"""with {POINTS}, n as (select a.id, a.label = b.label as same from pt a join pt b on a.id <> b.id qualify row_number() over (partition by a.id order by list_distance(a.emb, b.emb), b.id) <= 15), f as (select id, avg(cast(same as int)) as x from n group by all)
select round(avg(x), 6) as same_fraction from f""")
def same_modality_fraction(s, d):
    return neighbours.same_label_fraction(_points(s, d), "label", 15).select(F.round("same_fraction", 6).alias("same_fraction"))


@query(f"""with {POINTS}, g as (select a.id, a.label as own, b.label, sum(list_distance(a.emb, b.emb)) as t, count(*) as n from pt a cross join pt b group by all),
p as (select id, max(case when label = own and n > 1 then t / (n - 1) end) as a, min(case when label <> own then t / n end) as b from g group by all)
select round(avg(case when a is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from p""")
def silhouette(s, d):
    return neighbours.silhouette(_points(s, d), "label").select(F.round("silhouette", 6).alias("silhouette"))


def _pairs(s, d):
    """The best supported points of label 0 as anchors, as many as each other label has points, and their matches in every label."""
    p = _points(s, d)
    own, cells = p.where("label = '0'").select("id", "emb"), p.where("label <> '0'").withColumnRenamed("label", "mark")
    n = min([own.count(), *(r[0] for r in cells.groupBy("mark").count().select("count").collect())])
    anchors = neighbours.select_anchors(neighbours.nearest_support(own, cells), n).select("sample_id", "id")
    return recovery.keep(anchors.join(own, "id"), "anchors"), cells


@query("""with n as (select label, count(*) as n from embeddings where label is not null group by label)
select cast(label as varchar) as mark, (select min(n) from n) as pairs, (select min(n) from n) as samples, (select min(n) from n) as cells, true as at_least_nearest from n where label <> 0""")
def assign_one_to_one(s, d):
    """Matches by mark: all samples, no cell twice, and in all at least as far as everyone's nearest cell."""
    anchors, cells = _pairs(s, d)
    found = recovery.keep(assignment.match(anchors, cells), "pairs")
    near = neighbours.knn(anchors.select(F.col("sample_id").alias("id"), "emb"), cells, 1, group="mark").groupBy("mark").agg(F.sum("distance").alias("floor"))
    mine = found.groupBy("mark").agg(F.count("*").alias("pairs"), F.count_distinct("sample_id").alias("samples"), F.count_distinct("matched_cell").alias("cells"), F.sum("match_distance").alias("total"))
    return mine.join(near, "mark").select("mark", "pairs", "samples", "cells", (F.col("total") >= F.col("floor") - 1e-9).alias("at_least_nearest"))


@query()
def metacell_summary(s, d):
    assigned, _ = metacells.cluster(_points(s, d).select("id", "emb"), 12, rounds=1)
    return metacells.summary(assigned)


@query("""with n as (select l_suppkey as label, count(*) as n from lineitem group by all) select label, printf('MC_%03d', row_number() over (order by n desc, label)) as metacell from n""")
def relabel_by_size(s, d):
    return metacells.relabel(table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("label")))


@query("""with n as (select l_suppkey, count(*) as n from lineitem group by all) select min(n) as min, median(n) as median, round(avg(n), 6) as mean, max(n) as max from n""")
def cluster_size_stats(s, d):
    return metacells.size_stats(table(s, d, "lineitem"), "l_suppkey").withColumn("mean", F.round("mean", 6))


# Transforms, screens and families.


@query("""select l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) over w) / nullif(stddev_samp(l_quantity) over w, 0), 6) as z from lineitem window w as (partition by l_suppkey)""")
def zscore(s, d):
    return matrix.zscore(table(s, d, "lineitem"), "l_suppkey", "l_quantity").select("l_orderkey", "l_linenumber", F.round("z", 6).alias("z"))


@query("""select l_orderkey, l_linenumber, rank() over (partition by l_suppkey order by l_quantity) + (count(*) over (partition by l_suppkey, l_quantity) - 1) / 2 as rank from lineitem""")
def rank_average(s, d):
    return matrix.average_rank(table(s, d, "lineitem"), "l_suppkey", "l_quantity").select("l_orderkey", "l_linenumber", "rank")


def _quantile_sql(p: str) -> str:
    def ratio(part: str, x: str) -> str:
        top, bottom = (reduce(lambda sum_, c: f"({sum_} * {x} + {c!r})", cs[1:], repr(cs[0])) for cs in transforms.QUANTILE[part])
        return f"{top} / {bottom}"

    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    outer = f"case when {r} <= 5 then {ratio('tail', f'({r} - 1.6)')} else {ratio('far tail', f'({r} - 5)')} end"
    return f"case when abs({p} - 0.5) <= 0.425 then ({p} - 0.5) * {ratio('centre', f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))')} else sign({p} - 0.5) * ({outer}) end"


@query(f"""with r as (select l_orderkey, l_linenumber, l_returnflag as variable, cast(l_quantity as double) as q, (rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2 - 0.5) / count(*) over (partition by l_returnflag) as p0 from lineitem),
b as (select *, cast(least(greatest(p0, 1e-6), 1 - 1e-6) as double) as p from r) select l_orderkey, l_linenumber, variable, round({_quantile_sql("p")}, 6) as value from b""")
def rank_gaussian(s, d):
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("variable"), F.col("l_quantity").alias("value"))
    return transforms.rank_gaussian(rows).withColumn("value", F.round("value", 6))


@query("""select p_brand as gene, round(sum(l_quantity) / sum(l_extendedprice / 1000), 6) as rate from lineitem join part on l_partkey = p_partkey group by all""")
def poisson_rate(s, d):
    got = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("gene"), F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 1000).alias("size"))
    return families.poisson_rates(got).withColumn("rate", F.round("rate", 6))


@query("""with m as (select l_suppkey as gene, avg(l_quantity) as mean, var_samp(l_quantity) as v from lineitem group by all)
select gene, round(mean, 6) as mean, round(v, 4) as variance, round(case when v > mean and mean > 0 then least(greatest(mean * mean / (v - mean), 1e-6), 1e6) else 1e6 end, 4) as dispersion from m""")
def nb2_dispersion(s, d):
    got = families.dispersions(table(s, d, "lineitem").select(F.col("l_suppkey").alias("gene"), F.col("l_quantity").alias("y")))
    return got.select("gene", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("dispersion", 4).alias("dispersion"))


def _counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_returnflag").alias("gene"), F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 1000).alias("library"))


LIKELIHOODS = """c as (select l_returnflag as gene, l_quantity as y, greatest(l_extendedprice / 1000 / (select greatest(median(l_extendedprice / 1000), 1) from lineitem where l_extendedprice > 0), 1e-6) as size from lineitem),
r as (select gene, sum(y) / sum(size) as rate from c group by all), m as (select gene, y, greatest(size * rate, 1e-12) as mu from c join r using (gene)),
g as (select unnest(range(200)) as k), ll as (select gene, 'poisson' as family, null::double as parameter, 0 as k, sum(y * ln(mu) - mu - lgamma(y + 1)) as ll from m group by all
union all select gene, 'nb2', t, k, sum(lgamma(y + t) - lgamma(t) - lgamma(y + 1) + t * (ln(t) - ln(t + mu)) + y * (ln(mu) - ln(t + mu))) from m cross join (select k, power(10, -2 + 8.0 * k / 199) as t from g) group by all
union all select gene, 'nb1', a, k, sum(lgamma(y + mu / a) - lgamma(mu / a) - lgamma(y + 1) - mu / a * ln(1 + a) + y * (ln(a) - ln(1 + a))) from m cross join (select k, power(10, -4 + 8.0 * k / 199) as a from g) group by all)"""


@query(f"""with {LIKELIHOODS}
select gene, family, cast(arg_max(k, ll) as bigint) as grid_point, round(max(ll) / 1000, 3) as kilo_log_likelihood from ll group by all""")
def family_grid(s, d):
    ll = families.log_likelihoods(families.size_factors(_counts(s, d)))
    point = F.when(F.col("family") == "poisson", 0).when(F.col("family") == "nb2", F.col("k") - 1).otherwise(F.col("k") - 201)
    return ll.withColumn("point", point.cast("bigint")).groupBy("gene", "family").agg(F.max_by("point", "ll").alias("grid_point"), F.round(F.max("ll") / 1000, 3).alias("kilo_log_likelihood"))


@query(f"""with {LIKELIHOODS}, f as (select gene, family, case family when 'poisson' then 2 else 4 end - 2 * max(ll) as aic from ll group by gene, family)
select gene, family as best_family, round(aic, 2) as aic from f qualify row_number() over (partition by gene order by aic, case family when 'nb2' then 0 when 'nb1' then 1 else 2 end) = 1""")
def family_aic(s, d):
    return families.best_family(families.compare(families.size_factors(_counts(s, d)))).withColumn("aic", F.round("aic", 2))


@query("""with v as (select 'v' || (event_id % 6) as variable, case event_id % 6 when 0 then 'text' when 1 then '3' when 2 then (1 + (event_id % 4) * 1e-12)::varchar else value::varchar end as value from events),
t as (select variable, count(*) filter (value is not null and try_cast(value as double) is null) as bad, count(distinct try_cast(value as double)) as n_unique, coalesce(stddev_samp(try_cast(value as double)), 0) as sd from v group by all)
select variable, n_unique, case when bad > 0 then 'non_numeric' when n_unique < 2 then 'too_few_unique' when sd <= 1e-8 then 'near_constant' end as drop_reason from t""")
def column_screen(s, d):
    k = F.col("event_id") % 6
    value = F.when(k == 0, "text").when(k == 1, "3").when(k == 2, (1 + (F.col("event_id") % 4) * 1e-12).cast("string")).otherwise(F.col("value").cast("string"))
    rows = table(s, d, "events").select(F.concat(F.lit("v"), k).alias("variable"), value.alias("value"))
    return matrix.drop_constant(rows).drop("std")


ROLES = """node as (select case n_nationkey % 4 when 0 then 'expr__' || n_name when 1 then 'promoter_' || n_name || '__H3K4me3' when 2 then 'enhancer_' || n_name || '__H3K27ac' else 'chr1:1-' || (n_nationkey + 2) || '__H3K9me3' end as node,
(['expr', 'promoter', 'distal', 'other'])[n_nationkey % 4 + 1] as role from nation)"""


def _nodes(s: SparkSession, d: str) -> DataFrame:
    k, n = F.col("n_nationkey") % 4, F.col("n_name")
    name = F.when(k == 0, F.concat(F.lit("expr__"), n)).when(k == 1, F.concat(F.lit("promoter_"), n, F.lit("__H3K4me3"))).when(k == 2, F.concat(F.lit("enhancer_"), n, F.lit("__H3K27ac"))).otherwise(F.concat(F.lit("chr1:1-"), F.col("n_nationkey") + 2, F.lit("__H3K9me3")))
    return table(s, d, "nation").select(name.alias("node"))


@query(f"""with {ROLES} select 'forbidden' as rule_type, a.node as "from", b.node as "to", case when a.role = 'expr' then 'expression_not_parent_of_histone' else 'promoter_not_parent_of_distal' end as reason
from node a, node b where a.role = 'expr' and b.role <> 'expr' or a.role = 'promoter' and b.role = 'distal'""")
def background_rules(s, d):
    return priors.rules(_nodes(s, d), "tiered_distal_promoter_expr")


EVIDENCE = "ev as (select 'chr' || (s_suppkey % 20) as chrom, s_suppkey * 2000 as s, s_suppkey * 2000 + 900 as e, s_name as gene, case when s_nationkey % 2 = 0 then 'atlas' else 'screen' end as source, case when s_suppkey % 3 = 0 then '' else 'lab' || (s_suppkey % 4) end as support_label from supplier)"


@query(f"""with {PEAKS}, {EVIDENCE}, n as (select peak.chrom || ':' || s || '-' || e || '__' || mark as node, chrom, s, e from peak),
m as (select node, source, support_label from n join ev on n.chrom = ev.chrom and least(n.e, ev.e) - greatest(n.s, ev.s) >= 20)
select n.node, count(source) as n_matches, coalesce(string_agg(distinct source, '|' order by source), '') as sources, coalesce(string_agg(distinct support_label, '|' order by support_label) filter (support_label <> ''), '') as labels,
case when count(source) = 0 then 'none' when count(distinct source) = 2 then 'both' else min(source) end as highlight from n left join m on n.node = m.node group by all""")
def evidence_support(s, d):
    ev = table(s, d, "supplier").select(
        F.concat(F.lit("chr"), F.col("s_suppkey") % 20).alias("chrom"), (F.col("s_suppkey") * 2000).alias("start"), (F.col("s_suppkey") * 2000 + 900).alias("end"), F.col("s_name").alias("gene"), F.when(F.col("s_nationkey") % 2 == 0, "atlas").otherwise("screen").alias("source"),
        F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("lab"), F.col("s_suppkey") % 4)).alias("support_label"), F.lit("").alias("external_id"), F.lit("").alias("biosample"), F.lit("").alias("notes"),
    )
    names = _peaks(s, d).select(F.concat(intervals.format_name(F.col("chrom"), F.col("start"), F.col("end")), F.lit("__"), F.col("mark")).alias("node"))
    nodes = support.nodes(names)
    return support.summary(nodes, support.matches(nodes, ev, 20), "atlas", "screen").select("node", "n_matches", "sources", "labels", "highlight")


@query("""with e as (select 'n' || (l_partkey % 50) as node1, case l_linenumber % 3 when 0 then 'ARROW' else 'TAIL' end as endpoint1, 'n' || (l_suppkey % 50) as node2, case l_linenumber % 2 when 0 then 'ARROW' else 'TAIL' end as endpoint2, l_orderkey || '/' || l_linenumber as edge_text from lineitem)
select edge_text, cast(node1 = 'n7' or node2 = 'n7' as int) as touches_gene, cast(node1 in ('n1', 'n2') or node2 in ('n1', 'n2') as int) as touches_curated,
case when endpoint1 = 'TAIL' and endpoint2 = 'TAIL' then 0 when endpoint1 <> endpoint2 then 2 else 1 end as kind_score from e order by touches_gene desc, touches_curated desc, kind_score desc, edge_text desc limit 30""")
def plot_edges(s, d):
    e = table(s, d, "lineitem").select(
        F.concat(F.lit("n"), F.col("l_partkey") % 50).alias("node1"), F.when(F.col("l_linenumber") % 3 == 0, "ARROW").otherwise("TAIL").alias("endpoint1"), F.concat(F.lit("n"), F.col("l_suppkey") % 50).alias("node2"), F.when(F.col("l_linenumber") % 2 == 0, "ARROW").otherwise("TAIL").alias("endpoint2"),
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("edge_text"),
    )
    curated = s.createDataFrame([("n1",), ("n2",)], "node string")
    return support.plot_edges(e, "n7", curated, 30).select("edge_text", "touches_gene", "touches_curated", "kind_score")


@query("""with a as (select distinct least(l_partkey % 97, l_suppkey % 89) as x, greatest(l_partkey % 97, l_suppkey % 89) as y from lineitem where l_returnflag = 'A'), b as (select distinct least(l_partkey % 97, l_suppkey % 89) as x, greatest(l_partkey % 97, l_suppkey % 89) as y from lineitem where l_returnflag = 'R'),
s as (select count(*) as n from (select * from a intersect select * from b)), t as (select count(*) as n from (select * from a union select * from b)) select s.n as shared, t.n as total, round(s.n / t.n, 6) as jaccard from s, t""")
def edge_jaccard(s, d):
    rows = table(s, d, "lineitem").select("l_returnflag", (F.col("l_partkey") % 97).alias("node1"), (F.col("l_suppkey") % 89).alias("node2"))
    return support.edge_jaccard(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'")).withColumn("jaccard", F.round("jaccard", 6))


@query("""with e as (select l_linenumber as run, l_partkey % 31 as a, l_suppkey % 29 as b from lineitem), g as (select least(a, b) as x, greatest(a, b) as y, count(distinct run) as n_runs, count(*) as n, count(*) filter (a < b) as n_forward from e group by all)
select x, y, n_runs, n, n_forward, round(greatest(n_forward, n - n_forward) / n, 6) as stability from g""")
def orientation_stability(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_linenumber").alias("run"), (F.col("l_partkey") % 31).alias("source"), (F.col("l_suppkey") % 29).alias("target"))
    return support.orientation_stability(rows).withColumn("stability", F.round("stability", 6))


@query()
def permuted_null(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), "o_custkey", "o_orderstatus")
    return support.permuted_pairs(rows, "o_custkey", "o_orderstatus", 3)


# Searches, demultiplexing, peaks and embeddings.


def _features(s: SparkSession, d: str) -> DataFrame:
    """An order's price beside counts that make it up, as expression beside signals."""
    signals = {"lines": F.count("*").cast("double"), "quantity": F.sum("l_quantity"), "discount": F.avg("l_discount"), "tax": F.avg("l_tax"), "flags": F.count_distinct("l_returnflag").cast("double")}
    names = {f"chr1:{k}-{k + 1}__H3K27ac": e for k, e in enumerate(signals.values())}
    wide = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("row")).agg((F.sum("l_extendedprice") / 1e4).alias("expr__G_log1p"), *(e.alias(n) for n, e in names.items()))
    return wide.unpivot("row", [f"`{c}`" for c in wide.columns[1:]], "variable", "value")


@query()
def pc_graph(s, d):
    return runner.run(_features(s, d), runner.Spec(background="minimal_expr_sink", max_depth=2))[0]


@query("""with x as (select count(distinct l_orderkey) as n from lineitem) select 'line' as given, true as linked, true as parted from x""")
def nonlinear_independence(s, d):
    """Random features over all lines: a price follows its quantity though squares hide it from correlation, and given the quantity not the line's number."""
    rows = table(s, d, "lineitem").select(F.pow(F.col("l_quantity") - 25.5, F.lit(2)).alias("square"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_linenumber").cast("double").alias("line"))
    test = random_features.RandomFeatureTest(rows, ["square", "quantity", "line"])
    test.ahead([(0, 1, ()), (0, 2, (1,)), (0, 1, (2,))])
    return s.createDataFrame([("line", test(0, 1, (2,)) < 1e-6 and test(0, 1) < 1e-6, test(0, 2, (1,)) > 1e-3)], "given string, linked boolean, parted boolean")


@query()
def fci_graph(s, d):
    return runner.run(_features(s, d), runner.Spec(method="fci", background="minimal_expr_sink", max_depth=2, transform="rank_gaussian"))[0]


@query()
def dagma_graph(s, d):
    return runner.run(_features(s, d), runner.Spec(method="dagma", background="minimal_expr_sink", threshold=0.1))[0]


@query()
def hashtag_demux(s, d):
    # an event type is a tag; users with few events of a type have it as background
    e = table(s, d, "events").groupBy(F.col("event_type").alias("feature"), F.col("user_id").cast("string").alias("barcode")).agg(F.count("*").cast("double").alias("count"))
    return demux.demux(e).select("barcode", "hto_classification", "donor_id", F.round("hto_margin", 6).alias("hto_margin"))


@query(f"""with {FRAGMENTS}, ev as (select chrom, s as pos, 1 as d from frag union all select chrom, e, -1 from frag), a as (select chrom, pos, sum(d) as d from ev group by all),
r as (select chrom, pos as start, lead(pos) over w as e, sum(d) over w as depth from a window w as (partition by chrom order by pos)) select chrom, start, e as "end", cast(depth as bigint) as depth from r where e is not null and depth > 0""")
def pileup(s, d):
    return peaks.pileup(_fragments(s, d).select("chrom", F.col("start").alias("s"), F.col("end").alias("e")))


@query()
def call_peaks(s, d):
    # fragments that crowd in stretches of 150 positions, two thousand apart
    start = (F.col("l_partkey") % 50) * 2000 + F.col("l_orderkey") % 150
    crowded = table(s, d, "lineitem").select(F.concat(F.lit("chr"), F.col("l_suppkey") % 4).alias("chrom"), start.alias("start"), (start + 60).alias("end"), F.lit("c").alias("barcode"))
    return peaks.call(crowded, 4e5).select("chrom", "start", "end", "summit", "depth", F.round("neg_log10_p", 4).alias("neg_log10_p"))


@query("""with m as (select l_suppkey as feature, sum(l_quantity) / 1000 as mean, (sum(l_quantity * l_quantity) - sum(l_quantity) * sum(l_quantity) / 1000) / 999 as variance from lineitem group by all) select feature from m order by variance desc, feature limit 20""")
def variable_features(s, d):
    e = table(s, d, "lineitem").select(F.col("l_suppkey").alias("feature"), F.col("l_quantity").alias("value"))
    return embedding.variable_by_variance(embedding.feature_moments(e, 1000), 20)


@query(f"""with {ENTRIES}, n as (select count(distinct cell) as n from ent), m as (select feature, sum(value) as t, sum(value * value) as tt from ent group by all),
base as (select feature, t / n as mean, ((tt - n * (t / n) * (t / n)) / (n - 1)) / (t / n) as dispersion from m cross join n where t > 0),
cut as (select unnest(quantile_cont(mean, [{", ".join(f"{i / 20}" for i in range(1, 20))}])) as c from base), binned as (select feature, dispersion, count(*) filter (mean > c) as bin from base cross join cut group by all),
mid as (select bin, median(dispersion) as mid from binned group by all), away as (select feature, bin, dispersion, mid, abs(dispersion - mid) as away from binned join mid using (bin)),
mad as (select bin, median(away) * 1.4826 as mad from away group by all), scored as (select feature, case when mad > 0 then (dispersion - mid) / mad else 0 end as score from away join mad using (bin))
select feature, round(score, 6) as score from scored order by scored.score desc, feature limit 50""")
def variable_by_dispersion(s, d):
    e = _entries(s, d)
    return embedding.variable_by_dispersion(embedding.feature_moments(e, e.select("cell").distinct().count()), 50).withColumn("score", F.round("score", 6))


def _length(emb: str):
    """Length of an embedding, which no turn of its axes changes."""
    return F.round(F.sqrt(F.aggregate(emb, F.lit(0.0), lambda t, v: t + v * v)), 4).alias("length")


@query()
def lsi_embedding(s, d):
    e = recovery.keep(table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.col("l_partkey").alias("feature")).agg(F.sum("l_quantity").alias("value")), "entries")
    f = guidance.indexed(e.select("feature").distinct(), ["feature"])
    return embedding.lsi(e, e.select("cell").distinct().count(), f, 8).select("cell", F.size("emb").alias("dims"), _length("emb"))


@query()
def pca_embedding(s, d):
    e = recovery.keep(table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.col("l_partkey").alias("feature")).agg(F.sum("l_quantity").alias("value")), "entries")
    f = guidance.indexed(e.select("feature").distinct(), ["feature"])
    return embedding.pca(e, f, 8).select("cell", F.size("emb").alias("dims"), _length("emb"))


# Scalars.


@query("""select distinct c_mktsegment as name, coalesce(nullif(trim(regexp_replace(lower(c_mktsegment || ' (x)'), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'value') as token from customer""")
def sanitize_tokens(s, d):
    return table(s, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct().withColumn("token", ids.sanitize_token(F.concat(F.col("name"), F.lit(" (x)"))))


@query("""select l_orderkey, l_linenumber, round(ln(greatest(l_quantity - 10, 1)), 6) as off, cast(l_quantity > 25 as double) as high, greatest(least((l_quantity - 25) / 4, 3.0), -3.0) as clipped from lineitem""")
def count_transforms(s, d):
    q = F.col("l_quantity")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(scores.count_offset(q - 10), 6).alias("off"), scores.binarise(q, 25).alias("high"), scores.clip((q - 25) / 4, 3.0).alias("clipped"))


@query("""select l_orderkey, l_linenumber, round(0.7 * exp(-l_partkey / greatest(1.0, 500.0)), 6) as exp_weight, round(power((l_partkey + 1000) / 1000.0, -0.75), 6) as power_weight from lineitem""")
def edge_weights(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(intervals.edge_weight(F.col("l_partkey"), "exp", 0.7, 500.0), 6).alias("exp_weight"), F.round(intervals.edge_weight(F.col("l_partkey"), "power"), 6).alias("power_weight"))


# Joins that attach tables, and further statistics.


@query("""select l_orderkey || '-1' as barcode, l_linenumber, o_orderpriority as priority, o_orderkey is not null as matched from lineitem left join (select * from orders where o_orderstatus = 'F') on l_orderkey = o_orderkey""")
def attach_metadata(s, d):
    obs = table(s, d, "lineitem").select(F.concat(F.col("l_orderkey"), F.lit("-1")).alias("barcode"), "l_linenumber")
    cells = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.col("o_orderkey"), F.lit("-3")).alias("barcode"), F.col("o_orderpriority").alias("priority"))
    return joins.attach_metadata(obs, cells)


@query("""with m as (select o_orderkey is not null as hit from lineitem left join (select * from orders where o_orderstatus = 'F') on l_orderkey = o_orderkey) select count(*) as n, count(*) filter (hit) as n_matched, round(count(*) filter (hit) / count(*), 6) as fraction from m""")
def matched_fraction(s, d):
    return joins.matched_fraction(attach_metadata(s, d)).withColumn("fraction", F.round("fraction", 6))


@query("""select p_partkey, p_partkey in (select l_partkey from lineitem where l_quantity >= 48) as popular from part""")
def flag_lookup(s, d):
    flags = table(s, d, "lineitem").where("l_quantity >= 48").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("popular", F.lit(True))
    return joins.flag_lookup(table(s, d, "part").select("p_partkey"), flags, "p_partkey", "popular")


@query("""with c as (select case when c_acctbal < 0 then null when c_nationkey = 3 then 'unknown' else c_mktsegment end as coarse, case when c_nationkey = 5 then null else c_name end as fine from customer)
select 'coarse' as "column", count(*) filter (coarse is null) as n_null, count(*) filter (coarse = 'unknown') as n_unknown, count(*) as n from c union all select 'fine', count(*) filter (fine is null), count(*) filter (fine = 'unknown'), count(*) from c""")
def unmapped_counts(s, d):
    coarse = F.when(F.col("c_acctbal") < 0, None).when(F.col("c_nationkey") == 3, "unknown").otherwise(F.col("c_mktsegment"))
    rows = table(s, d, "customer").select(coarse.alias("coarse"), F.when(F.col("c_nationkey") != 5, F.col("c_name")).alias("fine"))
    return joins.unmapped_counts(rows, ["coarse", "fine"])


@query("""select count(*) as n, round(avg(cast(a.m = b.m as int)), 6) as agreement from (select o_orderkey, o_orderstatus as m from orders) a join (select l_orderkey, min(l_linestatus) as m from lineitem group by all) b on o_orderkey = l_orderkey""")
def label_agreement(s, d):
    a = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("label"))
    b = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.min("l_linestatus").alias("label"))
    return joins.label_agreement(a, b, "key", "label").withColumn("agreement", F.round("agreement", 6))


@query(f"""with {POINTS}, n as (select a.id as q, b.id as r from pt a join pt b on a.id <> b.id qualify row_number() over (partition by a.id order by list_distance(a.emb, b.emb), b.id) <= 8)
select least(q, r) as a, greatest(q, r) as b, cast(count(*) as double) as weight from n group by all""")
def neighbour_graph(s, d):
    return clusters.neighbour_graph(_points(s, d), 8)


@query()
def communities(s, d):
    return clusters.label_propagation(clusters.neighbour_graph(_points(s, d), 8))


@query("""select count(*) as nodes, true as connected, true as as_good_as_propagation, true as above_zero from embeddings""")
def modularity_communities(s, d):
    """Communities by modularity of the neighbour graph, by what must hold of them."""
    graph = recovery.keep(clusters.neighbour_graph(_points(s, d), 8), "neighbours")
    found = recovery.keep(clusters.leiden(graph, passes=1), "communities")
    inner = graph.join(found.select(F.col("id").alias("a"), F.col("cluster").alias("x")), "a").join(found.select(F.col("id").alias("b"), F.col("cluster").alias("y")), "b").where("x = y")
    pieces = clusters.connected(inner.select("a", "b")).groupBy("root").count().count()
    ours, theirs = (clusters.modularity(graph, x) for x in (found, clusters.label_propagation(graph)))
    said = found.agg(F.count("*").alias("nodes"), F.count_distinct("cluster").alias("n"), F.count_distinct(F.when(F.col("id") != F.col("cluster"), F.col("cluster"))).alias("large"))
    return said.select("nodes", (F.col("large") == pieces).alias("connected"), F.lit(ours >= theirs - 1e-9).alias("as_good_as_propagation"), F.lit(ours > 0).alias("above_zero"))


@query("""select vec_id as id, cast(3 as double) as total, cast(1 as double) as nearest from embeddings""")
def neighbour_strengths(s, d):
    """What the strengths of a point's eight neighbours add up to, and the largest."""
    points = _points(s, d).select("id", "emb")
    found = neighbours.knn(points, points, 8, skip_self=True)
    near = found.groupBy(F.col("query").alias("id")).agg(F.collect_list(F.struct(F.col("neighbour").alias("other"), "distance")).alias("near"))
    return umap.strengths(near).groupBy("id").agg(F.round(F.sum("strength"), 5).alias("total"), F.round(F.max("strength"), 5).alias("nearest"))


@query("""select vec_id as id, true as placed from embeddings""")
def neighbour_layout(s, d):
    points = _points(s, d).select("id", "emb")
    got = umap.layout(points, umap.fuzzy_graph(points, 8), epochs=12)
    return got.select("id", (F.col("x").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") + F.abs("y") < 1e6)).alias("placed"))


def _guided_space(s, d):
    """Odd orders as cells with counts of parts (bins), even ones with counts of suppliers (genes), and the links between."""
    line = table(s, d, "lineitem")
    rna = F.col("l_orderkey") % 2 == 0
    gene, bin_ = F.concat(F.lit("gene_"), F.col("l_suppkey")), F.concat(F.lit("peak_"), F.col("l_partkey"))
    entries = line.select(F.col("l_orderkey").alias("cell"), F.when(rna, gene).otherwise(bin_).alias("feature"), F.col("l_quantity").cast("double").alias("value"))
    cells = table(s, d, "orders").select(F.col("o_orderkey").alias("cell"), F.when(F.col("o_orderkey") % 2 == 0, "rna").otherwise("chrom").alias("modality"))
    genes = table(s, d, "supplier").select(F.concat(F.lit("gene_"), F.col("s_suppkey")).alias("feature"), F.lit("rna").alias("modality"))
    bins = _peaks(s, d).select(F.col("name").alias("feature"), F.lit("chrom").alias("modality"))
    linked = _links(s, d).select(F.concat(F.lit("gene_"), F.regexp_extract("gene", r"(\d+)$", 1).cast("bigint")).alias("source"), F.col("feature").alias("target"), "weight", F.when(F.col("mark") == "H3K27me3", -1).otherwise(1).alias("sign"))
    return guided.prepare(entries, cells, genes.union(bins), linked)


@query(f"""with {PEAKS}, {GENES}, {LINKS} select (select count(*) from supplier) + (select count(*) from part) as features, (select count(*) from orders) as cells, (select count(*) from (select distinct gene, feature from link)) as edges, true as loss_falls""")
def guided_training(s, d):
    space = _guided_space(s, d)
    _, losses = guided.fit(space, guided.Settings(dims=8, steps=6))
    return s.createDataFrame([(space.n, int(space.n_cells.sum()), space.n_edges, bool(losses[-1] < losses[0]))], "features bigint, cells bigint, edges bigint, loss_falls boolean")


@query("""select o_orderkey as cell, case when o_orderkey % 2 = 0 then 'rna' else 'chrom' end as modality, 8 as dims, cast(1 as double) as length from orders""")
def guided_embedding(s, d):
    space = _guided_space(s, d)
    state, _ = guided.fit(space, guided.Settings(dims=8, steps=6))
    return guided.encode(space, state, 8).select("cell", "modality", F.size("emb").alias("dims"), _length("emb"))


@query("""with n as (select o_custkey % 50 as metacell, o_orderstatus as label, count(*) as n from orders where o_orderpriority not like '1%' group by all)
select metacell, label as majority_label, round(n / sum(n) over (partition by metacell), 6) as purity from n qualify row_number() over (partition by metacell order by n desc, label) = 1""")
def metacell_purity(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("metacell"), "o_orderstatus", "o_orderpriority")
    got = metacells.purity(rows.select("id", "metacell"), rows.where("o_orderpriority not like '1%'").select("id", F.col("o_orderstatus").alias("label")))
    return got.withColumn("purity", F.round("purity", 6))


@query("""with m as (select greatest(median(l_extendedprice) filter (l_extendedprice > 0), 1) as mid from lineitem) select l_orderkey, l_linenumber, round(greatest(l_extendedprice / mid, 1e-6), 6) as size from lineitem cross join m""")
def size_factors(s, d):
    return families.size_factors(table(s, d, "lineitem").withColumn("library", F.col("l_extendedprice"))).select("l_orderkey", "l_linenumber", F.round("size", 6).alias("size"))


@query(f"""with {PEAKS}, {GENES}, n as (select gene, peak.chrom || ':' || peak.s || '-' || peak.e || '__' || mark as v, peak.chrom, peak.s, peak.e from peak join gene on peak.chrom = gene.chrom and peak.e > greatest(tss - 5000, 0) and peak.s < tss + 5000),
c as (select gene, chrom, tss + k * 1000 as s, tss + k * 1000 + 700 as e, 'r' || k as name, k from gene, (select unnest([0, 1, 2]) as k))
select n.gene, v as variable_name, coalesce(string_agg(name, ';' order by k), '') as curated_regions, count(name) > 0 as overlaps_curated from n left join c on n.gene = c.gene and n.chrom = c.chrom and n.s < c.e and n.e > c.s group by all""")
def curated_overlaps(s, d):
    k = F.explode(F.array(*map(F.lit, range(3))))
    loci = _genes(s, d).select("gene", "chrom", "tss", k.alias("pos")).select("gene", "chrom", (F.col("tss") + F.col("pos") * 1000).alias("start"), (F.col("tss") + F.col("pos") * 1000 + 700).alias("end"), F.concat(F.lit("r"), F.col("pos")).alias("region_name"), "pos")
    return dataset.curated_overlaps(nearby_peaks(s, d), loci).select("gene", "variable_name", "curated_regions", "overlaps_curated")


@query(f"""with {PEAKS}, {GENES}, {LINKS} select s_name as feature, cast(count(distinct feature) > 0 as int) as feature_available, cast(count(distinct feature) as int) as n_peak_links from supplier left join link on s_name = gene group by all""")
def feature_availability(s, d):
    return guidance.availability(table(s, d, "supplier").select(F.col("s_name").alias("feature")), _links(s, d))


@query(f"""with {PEAKS}, {GENES}, {LINKS} select mark, count(*) as n_pairs, count(distinct feature) as n_peaks, count(distinct gene) as n_genes from link group by all""")
def link_stats(s, d):
    return guidance.link_stats(_links(s, d))


@query("""select l_suppkey as variable, cast(l_linenumber as bigint) as k, round(case when s > 0 then (x - m) / s else x - m end, 6) as value from (select l_suppkey, l_linenumber, x, avg(x) over w as m, stddev_samp(x) over w as s from (select l_suppkey, l_linenumber, sum(l_quantity) as x from lineitem group by all) window w as (partition by l_suppkey))""")
def centre_and_scale(s, d):
    rows = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("variable"), F.col("l_linenumber").cast("bigint").alias("k")).agg(F.sum("l_quantity").alias("value"))
    return transforms.centre_and_scale(rows).select("variable", "k", F.round("value", 6).alias("value"))


@query()
def latent_space(s, d):
    half = F.when(F.col("id") % 2 == 0, "rna").otherwise("chrom_A")
    x = F.col("emb")
    cells = _points(s, d).select(F.col("id").alias("cell"), half.alias("modality_key"), x.alias("x"), F.transform(x, lambda v: F.lit(1.0)).alias("available"))
    model, _ = latent.fit(cells, cells.select(F.max(F.size("x"))).first()[0] or 0, latent=4, hidden=16, epochs=10)
    return latent.encode(cells, model).select("cell", "modality_key", F.size("emb").alias("dims"), _length("emb"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Clean cells and their library-normalised feature counts, end to end."""
    cells = clean_cells(s, d).select(F.col("barcode").cast("bigint").alias("cell"), "donor_id")
    return counting.normalise(_entries(s, d).join(cells, "cell", "left_semi")).join(cells, "cell")
