"""Further driver queries: joins, labels, genes, matrices and names that ``queries`` leaves out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids, intervals, scores
from .operators import assignment, counting, dataset, families, guidance, joins, matrix, metacells, neighbours, qc, support, transforms
from .queries import ENTRIES, GENES, LINKS, PEAKS, POINTS, _entries, _genes, _links, _peaks, _points, capped_sample, nearby_peaks, permuted_null, query, table

# Cells and their labels.


@query("""with a as (select cast(o_custkey as varchar) as key, o_custkey || '-' || (o_orderkey % 3) as b, min(o_orderkey) as pos from orders group by all), f as (select * from a qualify row_number() over (partition by key order by pos) = 1)
select key, b as adt_barcode, pos as adt_pos, c_custkey || '.1' as hto_barcode, c_custkey as hto_pos from f join customer on key = cast(c_custkey as varchar)""")
def shared_cells(s, d):
    spelled = table(s, d, "orders").select(F.concat("o_custkey", F.lit("-"), F.col("o_orderkey") % 3).alias("barcode"), F.col("o_orderkey").alias("col_pos"))
    hto = table(s, d, "customer").select(F.concat("c_custkey", F.lit(".1")).alias("barcode"), F.col("c_custkey").alias("col_pos"))
    return qc.shared_cells(spelled, hto)


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_orderkey % 5 <> 0 and o_totalprice >= 200000")
def label_threshold(s, d):
    confidence = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") / 400000)
    rows = table(s, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("fine_cell_type"), confidence.alias("fine_confidence"))
    return dataset.labelled(rows, "fine_cell_type", "F", 0.5).select("o_orderkey", "o_totalprice")


@query("select l_suppkey as cell, l_partkey as feature, l_quantity - 25 as value from lineitem qualify sum(l_quantity - 25) over (partition by l_suppkey) > 0")
def non_empty_cells(s, d):
    return qc.non_empty_cells(table(s, d, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_partkey").alias("feature"), (F.col("l_quantity") - 25).alias("value")))


@query("select vec_id as id from embeddings where vec_id % 7 not in (1, 2, 3)")
def finite_vectors(s, d):
    bad = F.when(F.col("id") % 7 == 1, float("nan")).when(F.col("id") % 7 == 2, float("inf")).when(F.col("id") % 7 != 3, 0.5)
    return qc.finite_vectors(_points(s, d).select("id", F.concat("emb", F.array(bad.cast("double"))).alias("emb"))).select("id")


@query("""with l as (select l_suppkey as "row", cast(l_linenumber as varchar) as variable, sum(l_quantity) as value from lineitem where l_discount < 0.05 group by all) select "row", variable, value from l qualify count(*) over (partition by "row") = 7""")
def complete_rows(s, d):
    rows = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_linenumber").cast("string").alias("variable")).agg(F.sum(F.when(F.col("l_discount") < 0.05, F.col("l_quantity"))).alias("value"))
    return transforms.complete_rows(rows, 7).select("row", "variable", "value")


@query("""select printf('row_%05d', row_number() over (order by c_acctbal, c_custkey)) as row_id, c_custkey from customer""")
def row_ids(s, d):
    return joins.row_ids(table(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"]).select("row_id", "c_custkey")


@query("select o_orderkey as obs_id, o_custkey, o_orderstatus as status, case when o_orderkey % 2 = 0 then o_orderpriority end as status_label from orders")
def join_labels(s, d):
    o = table(s, d, "orders")
    left = o.select(F.col("o_orderkey").alias("obs_id"), "o_custkey", F.col("o_orderstatus").alias("status"))
    return joins.join_labels(left, o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("obs_id"), F.col("o_orderpriority").alias("status")))


@query("select c_custkey as cell, c_nationkey as feature, row_number() over (order by c_custkey) - 1 as idx from customer")
def row_positions(s, d):
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").alias("feature"))
    return joins.positions(rows, guidance.indexed(rows.select("cell"), ["cell"]).withColumn("idx", F.col("idx").cast("bigint")), "cell")


@query("""select event_type, least(count(*), 200) as n, least(count(*), 200) as n_known from events group by all""")
def capped_sample_sizes(s, d):
    sample = capped_sample(s, d).join(table(s, d, "events").select("event_id", F.col("event_type").alias("own")), "event_id", "left")
    return sample.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("own") == F.col("event_type"), F.col("event_id"))).alias("n_known"))


@query("select o_orderstatus, o_custkey, count(*) as n from orders group by all")
def permuted_null_pairs(s, d):
    return permuted_null(s, d).groupBy("o_orderstatus", "o_custkey").agg(F.count("*").alias("n"))


# Matches and metacells.


@query("""with m as (select cast(l_orderkey as varchar) as sample_id, l_returnflag as mark, avg(l_quantity) as x, max(l_partkey) as c from lineitem group by all)
select sample_id, max(case when mark = 'A' then c end) as "cell_A", round(max(case when mark = 'A' then x end), 6) as "distance_A", max(case when mark = 'R' then c end) as "cell_R", round(max(case when mark = 'R' then x end), 6) as "distance_R",
round(avg(x), 6) as mean_match_distance, round(max(x), 6) as max_match_distance from m group by all""")
def wide_matches(s, d):
    rows = table(s, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("sample_id"), F.col("l_returnflag").alias("mark")).agg(F.avg("l_quantity").alias("match_distance"), F.max("l_partkey").alias("matched_cell"))
    got = assignment.wide_matches(rows, ["A", "R"])
    return got.withColumns({c: F.round(c, 6) for c in ("distance_A", "distance_R", "mean_match_distance", "max_match_distance")})


@query(f"""with {POINTS}, p as (select a.id, b.label, min(list_distance(a.emb, b.emb)) as m from pt a join pt b on a.label = '0' and b.label <> '0' group by all), u as (select id, avg(m) as mean, max(m) as most from p group by all),
r as (select id, row_number() over (order by mean, most, id) as r from u) select id, printf('PAIR_%04d', r) as sample_id from r where r <= 10""")
def chosen_anchors(s, d):
    p = _points(s, d)
    near = neighbours.nearest_support(p.where("label = '0'").select("id", "emb"), p.where("label <> '0'").withColumnRenamed("label", "mark"))
    return neighbours.select_anchors(near, 10).select("id", "sample_id")


@query("select o_custkey % 40 as metacell, cast(l_suppkey as varchar) as variable, round(avg(l_quantity), 6) as value from lineitem join orders on l_orderkey = o_orderkey group by all")
def metacell_means(s, d):
    assigned = table(s, d, "orders").select(F.lit("rna").alias("modality_key"), F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("metacell"))
    values = table(s, d, "lineitem").select(F.lit("rna").alias("modality_key"), F.col("l_orderkey").alias("id"), F.col("l_suppkey").cast("string").alias("variable"), F.col("l_quantity").alias("value"))
    return metacells.mean_by_metacell(values, assigned).withColumn("value", F.round("value", 6))


# Genes, graphs and matrices.


@query(f"""with {GENES} select gene as rna_gene, gene as gene_name, gene || '.2' as gene_id, chrom, s as start, e as "end", strand from gene where cast(regexp_extract(gene, '(\\d+)$', 1) as int) % 2 = 0""")
def gene_mapping(s, d):
    genes = _genes(s, d).select("gene_name", F.concat("gene", F.lit(".2")).alias("gene_id"), "chrom", "start", "end", "strand")
    by_id = table(s, d, "supplier").where("s_suppkey % 2 = 0").select(F.concat("s_name", F.lit(".7")).alias("feature"))
    return guidance.map_genes(by_id.select(ids.trim_version(F.col("feature")).alias("feature")), genes).select("rna_gene", "gene_name", "gene_id", "chrom", "start", "end", "strand")


@query(f"""with {PEAKS}, {GENES}, {LINKS}, u as (select *, cast(regexp_extract(gene, '(\\d+)$', 1) as int) as k from gene), h as (select *, k % 3 = 0 as here from u where k % 3 = 0 or gene in (select gene from link where distance < 100))
select case when here then 'rna_' || gene else gene end as feature_id, gene as gene_name, here as present_in_rna, cast(row_number() over (order by chrom, s, gene) - 1 as int) as gene_index from h""")
def gene_feature_universe(s, d):
    genes = _genes(s, d).withColumn("gene_id", F.concat(F.lit("G"), F.regexp_extract("gene", r"(\d+)$", 1)))
    rna = genes.where(F.substring("gene_id", 2, 20).cast("int") % 3 == 0).select(F.concat(F.lit("rna_"), "gene").alias("feature"), "gene_id")
    got = guidance.universe(rna, genes.select("gene_id", "gene_name", "chrom", "start", "end", "strand"), _links(s, d).where("distance < 100"), "union_linked")
    return got.select("feature_id", "gene_name", "present_in_rna", "gene_index")


@query(f"""with {PEAKS}, {GENES}, {LINKS} select gene as source, feature as target, weight from link where gene in (select s_name from supplier where s_suppkey % 2 = 0) and feature in (select 'peak_' || p_partkey from part where p_size < 20)""")
def pair_subgraph(s, d):
    edges = _links(s, d).select(F.col("gene").alias("source"), F.col("feature").alias("target"), "weight")
    nodes = table(s, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_name").alias("node")).unionByName(table(s, d, "part").where("p_size < 20").select(F.concat(F.lit("peak_"), "p_partkey").alias("node")))
    return guidance.subgraph(edges, nodes)


@query(f"""with {ENTRIES}, lib as (select cell, sum(value) as library from ent group by all), x as (select cell, library, coalesce((select sum(value) from ent where ent.cell = lib.cell and feature = 7), 0) as x from lib)
select cell, 'expr__7_log1p' as variable, round(ln(1 + x * 1e4 / library), 6) as value from x union all select cell, 'expr__7_raw_counts', round(x, 6) from x union all select cell, 'libsize__rna', round(library, 6) from x""")
def gene_expression(s, d):
    e = _entries(s, d).withColumn("feature", F.col("feature").cast("string"))
    return dataset.expression(e, e.select("cell").distinct(), "7").withColumn("value", F.round("value", 6))


@query("select round(avg(l_extendedprice), 4) as mean, round(stddev_samp(l_extendedprice), 4) as std, min(l_extendedprice) as min, max(l_extendedprice) as max from lineitem")
def library_statistics(s, d):
    return families.library_stats(table(s, d, "lineitem").withColumn("library", F.col("l_extendedprice"))).withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query(f"""with {ENTRIES}, n as (select count(distinct cell) as n from ent), st as (select feature, sum(value) / max(n) as m, greatest(sum(value * value) / max(n) - (sum(value) / max(n)) * (sum(value) / max(n)), 0) as v from ent cross join n group by all)
select cell, feature, round((value - m) / case when sqrt(v) < 1e-6 then 1 else sqrt(v) end, 5) as value from ent join st using (feature)""")
def standardised_entries(s, d):
    e = _entries(s, d)
    stats = matrix.sparse_feature_stats(e, e.select("cell").distinct().count())
    return e.join(stats, "feature").select("cell", "feature", F.round(scores.standardise(F.col("value"), F.col("mean"), F.col("std")), 5).alias("value"))


@query(f"""with {PEAKS}, z as (select 'chr' || k as chrom, 60000 + k * 5000 as size from range(20) r(k)) select name, chrom, ((s + 7000) % greatest(size - (e - s), 1)) as start, ((s + 7000) % greatest(size - (e - s), 1)) + (e - s) as "end" from peak join z using (chrom)""")
def shifted_regions(s, d):
    sizes = s.range(20).select(F.concat(F.lit("chr"), "id").alias("chrom"), (F.col("id") * 5000 + 60000).alias("size"))
    return support.shifted_regions(_peaks(s, d).select("name", "chrom", "start", "end"), sizes, 7000)


def _locus(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Peaks near genes, and peaks as bins."""
    return nearby_peaks(s, d), _peaks(s, d).select("chrom", "start", "end", "name")


@query(f"""with {PEAKS}, {GENES}, n as (select distinct peak.chrom || ':' || peak.s || '-' || peak.e || '__' || mark as v, peak.chrom, peak.s, peak.e from peak join gene on peak.chrom = gene.chrom and peak.e > greatest(tss - 5000, 0) and peak.s < tss + 5000)
select v as variable_name, count(*) as n_bins, string_agg(name, ';' order by name) as bin_features from n join peak on peak.chrom = n.chrom and peak.s < n.e and peak.e > n.s group by all""")
def peak_metadata(s, d):
    near, bins = _locus(s, d)
    own = near.select("variable_name", "chrom", "start", "end").distinct()
    lists = counting.bin_lists(counting.bins_of_regions(bins, own.withColumnRenamed("variable_name", "region")))
    long = own.select(F.col("variable_name").alias("variable"), F.lit(1.0).alias("value"))
    return dataset.metadata(own, lists, long).select("variable_name", "n_bins", "bin_features")


@query(f"""with {PEAKS}, {GENES}, {ENTRIES}, lib as (select cell, sum(value) as library from ent group by all), n as (select distinct peak.chrom || ':' || peak.s || '-' || peak.e || '__' || mark as v, peak.chrom, peak.s, peak.e from peak join gene on peak.chrom = gene.chrom and peak.e > greatest(tss - 5000, 0) and peak.s < tss + 5000 where gene = 'Supplier#000000003'),
ov as (select v, name from n join peak on peak.chrom = n.chrom and peak.s < n.e and peak.e > n.s), nb as (select v, count(*) as n from ov group by all), tot as (select cell, v, sum(value) as t from ent join ov on 'peak_' || feature = name group by all), raw as (select cell, value from ent where feature = 7)
select 'S' || lib.cell as sample_id, v as variable, round(ln(1 + coalesce(t, 0) / nb.n * 1e4 / library), 6) as value from lib cross join nb left join tot using (cell, v)
union all select 'S' || cell, unnest(['expr__7_log1p', 'expr__7_raw_counts', 'libsize__rna', 'libsize__H3K27ac']), round(unnest([ln(1 + coalesce(value, 0) * 1e4 / library), coalesce(value, 0), library, library]), 6) from lib left join raw using (cell)""")
def locus_matrix(s, d):
    near, bins = _locus(s, d)
    e = _entries(s, d)
    samples = e.select("cell").distinct().select(F.concat(F.lit("S"), "cell").alias("sample_id"), F.col("cell").alias("cell_rna"), F.col("cell").alias("cell_H3K27ac"))
    regions = near.where("gene = 'Supplier#000000003'").select("variable_name", "chrom", "start", "end").distinct()
    signal = e.withColumn("feature", F.concat(F.lit("peak_"), "feature"))
    got = dataset.locus_matrix(samples, e.withColumn("feature", F.col("feature").cast("string")), "7", regions, {"H3K27ac": (signal, bins)})
    return got.withColumn("value", F.round("value", 6))


@query("""with a as (select o_orderkey as id, o_orderkey % 2 = 0 as rna, o_custkey % 40 as metacell from orders), lib as (select l_orderkey as id, sum(l_quantity) as library from lineitem group by all),
x as (select l_orderkey as id, ln(1 + sum(l_quantity) * 1e4 / library) as x from lineitem join lib on l_orderkey = lib.id where l_partkey = 7 group by l_orderkey, library),
y as (select id, sum(y) as y from (select l_orderkey as id, ln(1 + sum(l_quantity) * 1e4 / library) as y from lineitem join lib on l_orderkey = lib.id where l_suppkey < 5 group by l_orderkey, l_suppkey, library) group by all)
select metacell, count(*) filter (rna) as n_rna, count(*) filter (not rna) as n_chrom_H3K4me3, round(avg(coalesce(x, 0)) filter (rna), 6) as "expr__7", round(avg(coalesce(y, 0)) filter (not rna), 6) as "linked__H3K4me3", count(*) filter (rna) >= 5 and count(*) filter (not rna) >= 2 as qc_pass
from a left join x using (id) left join y using (id) group by all""")
def causal_export(s, d):
    key = F.when(F.col("o_orderkey") % 2 == 0, "rna").otherwise("chrom_H3K4me3")
    assigned = table(s, d, "orders").select(key.alias("modality_key"), F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("metacell"))
    feature = F.concat(F.lit("f"), "l_suppkey")
    signal = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell"), feature.alias("feature")).agg(F.sum("l_quantity").alias("value"))
    edges = table(s, d, "supplier").where("s_suppkey < 5").select(F.lit("7").alias("source"), F.concat(F.lit("f"), "s_suppkey").alias("target"), F.lit("H3K4me3").alias("mark"), F.lit("fwd").alias("type"))
    got = dataset.causal_export("7", _entries(s, d).withColumn("feature", F.col("feature").cast("string")), edges, {"H3K4me3": signal}, assigned)
    return got.withColumns({c: F.round(c, 6) for c in ("expr__7", "linked__H3K4me3")})


# Names and coordinates.


@query("""select p_partkey, case when p_size > 5 then 'chr' || p_size end as chrom, case when p_size > 5 then cast(100 as bigint) end as start, p_size || '' as removed, 'chr' || p_size as added from part""")
def interval_names(s, d):
    name = F.concat(F.lit("m::chr"), "p_size", F.lit(":100-"), F.when(F.col("p_size") > 5, F.lit(200)).otherwise(F.lit(100)))
    at = intervals.parse_positive(name)
    chrom = F.concat(F.when(F.col("p_partkey") % 2 == 0, "chr").otherwise(""), "p_size")
    return table(s, d, "part").select("p_partkey", at["chrom"].alias("chrom"), at["start"].alias("start"), intervals.normalize_chrom(chrom, "remove_chr").alias("removed"), intervals.normalize_chrom(chrom, "add_chr").alias("added"))


@query("""select p_partkey, case p_partkey % 3 when 0 then 'expr' when 1 then 'promoter' else 'distal' end as role, case when p_partkey % 3 = 0 then p_brand end as gene, case when p_partkey % 3 <> 0 then 'H3K27ac' end as mark from part""")
def node_names(s, d):
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.concat(F.lit("expr__"), "p_brand", F.lit("_log1p"))).when(k == 1, F.concat("p_brand", F.lit("_Promoter__H3K27ac"))).otherwise(F.concat(F.lit("Enhancer_"), "p_partkey", F.lit("__H3K27ac")))
    role = scores.node_role(name)
    return table(s, d, "part").select("p_partkey", role.alias("role"), F.when(role == "expr", scores.gene_base_name(name)).alias("gene"), F.when(role != "expr", scores.peak_mark(name)).alias("mark"))


@query("""select * from (values ('H3K27ac', 1, 150000, 75000.0::double, 1.0::double), ('H3K4me3', 1, 25000, 10000.0, 1.0), ('H3K27me3', -1, 500000, 200000.0, 1.0), ('ATAC', 1, 150000, 75000.0, 1.0)) t(mark, sign, "window", decay, alpha)""")
def shared_track_defaults(s, d):
    return s.createDataFrame([(m, *guidance.mark_defaults(m, "shared_gene")) for m in ("H3K27ac", "H3K4me3", "H3K27me3", "ATAC")], "mark string, sign int, window int, decay double, alpha double")


@query("select c_custkey, coalesce(case when c_nationkey < 10 then c_mktsegment end, c_name) as chosen, case when c_custkey % 2 = 0 then 1 else 0 end as global from customer")
def class_choice(s, d):
    rows = table(s, d, "customer").select("c_custkey", F.coalesce(F.when(F.col("c_nationkey") < 10, F.col("c_mktsegment")), "c_name").alias("hto_assignment"), (F.col("c_custkey") % 2 == 0).cast("int").alias("even"))
    own = rows.withColumn("hto_classification_global", F.when(F.col("even") == 1, 1).otherwise(0))
    return own.select("c_custkey", qc.choose_class(rows).alias("chosen"), qc.choose_class(own).alias("global"))
