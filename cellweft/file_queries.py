"""Driver queries that send the stand-ins through files: a writer, then the reader under test.

Files lie in the shared folder.  Formats whose writer makes one file lay parts into it by their bytes, so for these that
folder must be mounted.
"""

from __future__ import annotations

import io
import tarfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids
from .operators import guidance, qc
from .queries import ENTRIES, FRAGMENTS, GENES, PEAKS, _entries, _fragments, _genes, _peaks, query, table
from .recovery import scratch
from .sinks import tables
from .sources import archive, bundle, delimited, mtx, mtx_index


def _lines(df: DataFrame, name: str, compression: str = "gzip") -> str:
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).text(path)
    return path


def _tsv(df: DataFrame, name: str, header: bool = True) -> str:
    path = scratch(df.sparkSession, name)
    tables.write_tsv_folder(df, path, header=header)
    return path


def _file(s: SparkSession, name: str) -> str:
    """A path for a single file, which takes a mounted folder."""
    where = scratch(s, name).removeprefix("file://")
    if not where.startswith("/"):
        raise ValueError(f"{where} is not a mounted folder: single files cannot be written there")
    path = Path(where)
    path.mkdir(parents=True)
    return str(path / name)


def _tab(*columns: str) -> F.Column:
    return F.concat_ws("\t", *(F.col(c).cast("string") for c in columns))


# Readers.


def _fragment_file(s: SparkSession, d: str) -> str:
    rows = _fragments(s, d).select(F.concat_ws("\t", "chrom", "start", "end", "barcode", F.lit(1)).alias("value"))
    odd = s.createDataFrame([("# made of line items",), ("chr1\t5\t9",)], "value string")
    return _lines(rows.unionByName(odd), "fragments")


@query(f"""with {FRAGMENTS} select chrom, s as start, e as "end", barcode, 1 as dup from frag""")
def read_fragments(s, d):
    return delimited.fragments(s, _fragment_file(s, d))


@query(f"""with {FRAGMENTS} select chrom || chr(9) || s || chr(9) || e || chr(9) || barcode || chr(9) || '1' as line from frag where cast(barcode as bigint) % 3 = 0""")
def write_kept_fragments(s, d):
    listed = table(s, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("barcode"))
    path = scratch(s, "kept_fragments")
    tables.write_fragment_lines(qc.keep_listed(delimited.fragment_lines(s, _fragment_file(s, d)), listed), path)
    return s.read.text(path).withColumnRenamed("value", "line")


@query("select cast(c_custkey as varchar) || '-1' as barcode, cast(trunc(c_acctbal) as bigint) as n from customer where c_custkey % 7 <> 0")
def read_fragment_counts(s, d):
    n = F.when(F.col("c_custkey") % 7 == 0, "many").otherwise(F.col("c_acctbal").cast("string"))
    rows = table(s, d, "customer").select(F.concat("c_custkey", F.lit("-1")).alias("barcode"), n.alias("n_fragments"))
    return delimited.fragment_counts(s, _tsv(rows, "counts"))


@query("select 'chr' || s_suppkey as chrom, cast(s_nationkey * 1000 - 2000 as bigint) as size from supplier where s_nationkey > 2 and s_suppkey % 5 <> 0")
def read_chrom_sizes(s, d):
    size = F.when(F.col("s_suppkey") % 5 == 0, "unknown").otherwise((F.col("s_nationkey") * 1000 - 2000).cast("string"))
    return delimited.chrom_sizes(s, _lines(table(s, d, "supplier").select(F.concat_ws("\t", F.concat(F.lit("chr"), "s_suppkey"), size).alias("value")), "sizes", "none"))


@query("select distinct cast(o_custkey as varchar) as barcode from orders")
def read_whitelist(s, d):
    end = F.when(F.col("o_orderkey") % 2 == 0, "-1").otherwise(".2")
    return delimited.whitelist(s, _tsv(table(s, d, "orders").select(F.concat("o_custkey", end).alias("barcode")), "whitelist"))


@query("""with c as (select distinct o_orderpriority as barcode from orders), f as (select distinct o_custkey as feature from orders), n as (select o_custkey as feature, o_orderpriority as barcode, count(*) as n from orders group by all)
select cast(feature as varchar) as feature, barcode, cast(coalesce(n, 0) as double) as count from f cross join c left join n using (feature, barcode)""")
def read_wide_matrix(s, d):
    cells = sorted(r[0] for r in table(s, d, "orders").select("o_orderpriority").distinct().collect())
    place = F.array_position(F.array(*map(F.lit, cells)), F.col("barcode"))
    counts = table(s, d, "orders").groupBy(F.col("o_custkey").alias("row_pos")).pivot("o_orderpriority", cells).count().na.fill(0)
    long = counts.unpivot("row_pos", [f"`{c}`" for c in cells], "barcode", "n").select("row_pos", F.col("row_pos").cast("string").alias("feature"), place.alias("col_pos"), "barcode", F.col("n").cast("string").alias("value"))
    path = _file(s, "matrix.tsv.gz")
    tables.write_wide_matrix(long, path)
    return delimited.numeric_matrix(s, path).select("feature", "barcode", "count")


@query(f"with {ENTRIES} select cast(cell as varchar) as barcode, cast(feature as varchar) as feature, value from ent")
def read_matrix_market(s, d):
    e = _entries(s, d).select(F.col("cell").cast("string").alias("cell"), F.col("feature").cast("string").alias("feature"), "value")
    cells, features = tables.index_names(e, "cell"), tables.index_names(e, "feature")
    placed = e.join(cells.select(F.col("name").alias("cell"), F.col("idx").alias("row_idx")), "cell").join(features.select(F.col("name").alias("feature"), F.col("idx").alias("col_idx")), "feature")
    path = _file(s, "counts")
    tables.write_mtx(placed.select("row_idx", "col_idx", "value"), cells, features, path)
    return mtx.read_triple(s, f"{path}.mtx", cells, features)


@query(f"""with {ENTRIES}, c as (select distinct cell, cast(cell as varchar) as name from ent), f as (select distinct feature, cast(feature as varchar) as name from ent),
ci as (select cell, row_number() over (order by name) - 1 as row_idx from c), fi as (select feature, row_number() over (order by name) - 1 as col_idx from f)
select row_idx, col_idx, value from ent join ci using (cell) join fi using (feature) where row_idx between 100 and 149 or row_idx = 7""")
def read_matrix_rows(s, d):
    """Some rows of a matrix through the indexed source, which skips the spans of others."""
    e = _entries(s, d)
    cells, features = (tables.index_names(e.select(F.col(c).cast("string").alias(c)), c) for c in ("cell", "feature"))
    placed = e.join(cells.select(F.col("name").cast("bigint").alias("cell"), F.col("idx").alias("row_idx")), "cell").join(features.select(F.col("name").cast("bigint").alias("feature"), F.col("idx").alias("col_idx")), "feature")
    path = _file(s, "rows")
    tables.write_mtx(placed.select("row_idx", "col_idx", "value"), cells, features, path)
    got = mtx_index.read(s, f"{path}.mtx", mtx_index.index(s, f"{path}.mtx"))
    return got.where("row_idx between 100 and 149").union(got.where("row_idx = 7"))


@query(f"""with {PEAKS} select chrom, s as start, e as "end", name, 'H3K27ac' as mark from peak""")
def read_peaks_bed(s, d):
    narrow = _peaks(s, d).select("chrom", "start", "end", "name", F.lit(0), F.lit("."), F.lit(1.5), F.lit(2.5), F.lit(3.5), F.lit(7))
    cut = tables.bed4(delimited.narrow_peaks(s, _tsv(narrow, "narrow_peaks", header=False)))
    return delimited.bed(s, _tsv(cut, "peaks", header=False), "H3K27ac")


def _gtf(s: SparkSession, d: str) -> DataFrame:
    rows = _genes(s, d).withColumn("id", F.concat(F.lit("G"), F.regexp_extract("gene", r"(\d+)$", 1), F.lit(".4")))
    name = F.when(F.col("tss") % 3000 == 500, F.lit("")).otherwise(F.concat(F.lit(' gene_name "'), "gene", F.lit('";')))
    records = rows.select(F.concat_ws("\t", "chrom", F.lit("made"), F.lit("gene"), F.col("start") + 1, "end", F.lit("."), "strand", F.lit("."), F.concat(F.lit('gene_id "'), "id", F.lit('"; gene_type "protein_coding";'), name)).alias("value"))
    odd = s.createDataFrame([("#!made of suppliers",), ('chr1\tmade\texon\t1\t5\t.\t+\t.\tgene_id "G0.4";',), ('chr1\tmade\tgene\t1\t5\t.\t+\t.\tgene_type "protein_coding";',)], "value string")
    return delimited.gtf(s, _lines(records.unionByName(odd), "gtf"))


GTF = f"{GENES}, g as (select *, 'G' || regexp_extract(gene, '(\\d+)$', 1) as gene_id, case when tss % 3000 = 500 then 'G' || regexp_extract(gene, '(\\d+)$', 1) else gene end as gene_name from gene)"


@query(f"with {GTF} select chrom, case when strand = '-' then e - 1 else s end as tss, gene_name, gene_id, strand from g")
def read_gtf_tss(s, d):
    return guidance.tss_table(_gtf(s, d), ["protein_coding"])


@query(f"""with {GTF} select chrom, s as start, e as "end", strand, gene_name, gene_id from g where e > s""")
def read_gtf_coordinates(s, d):
    return guidance.coordinates(_gtf(s, d))


@query("select cast(c_nationkey as varchar) as sample_id, cast(c_custkey as varchar) as barcode from customer")
def read_sample_barcodes(s, d):
    rows = table(s, d, "customer").select("c_nationkey", "c_custkey")
    path = scratch(s, "sample_barcodes")
    rows.unionByName(rows.where("c_custkey % 4 = 0")).write.csv(path)
    return delimited.sample_barcodes(s, path)


@query("select cast(c_custkey as varchar) as id from customer")
def read_named_column(s, d):
    rows = delimited.tsv(s, _tsv(table(s, d, "customer").select("c_custkey", "c_name"), "names"))
    return delimited.named_column(rows, "id")


def _manifest(s: SparkSession, d: str) -> DataFrame:
    return delimited.tsv(s, _tsv(table(s, d, "region").select(F.col("r_name").alias("mark"), F.concat(F.lit("/data/"), "r_regionkey").alias("path")), "manifest"), ["mark"])


@query("select r_name as mark, '/data/' || r_regionkey as path from region where r_name in ('ASIA', 'EUROPE')")
def read_manifest_rows(s, d):
    manifest = _manifest(s, d)
    return s.createDataFrame([delimited.manifest_row(manifest, m) for m in delimited.parse_marks(manifest, "EUROPE, ASIA,EUROPE")], "mark string, path string")


@query(f"with {GENES} select gene, chrom, tss, strand, 'monocyte' as cell_type, gene || '.tsv' as curated_locus_config from gene")
def read_gene_panel(s, d):
    rows = _genes(s, d).select("gene", "chrom", "tss", "strand", F.lit("monocyte").alias("cell_type"), F.concat("gene", F.lit(".tsv")).alias("curated_locus_config"))
    return delimited.gene_panel(s, _tsv(rows, "panel"))


@query("select s_name as gene from supplier where s_suppkey % 3 <> 0")
def read_light_panel(s, d):
    gene = F.when(F.col("s_suppkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "s_name"))
    return s.createDataFrame([(g,) for g in delimited.panel_genes(s, _tsv(table(s, d, "supplier").select(gene.alias("gene"), "s_suppkey"), "light_panel"))], "gene string")


@query(f"""with {GENES} select 'L_' || gene as locus_id, gene, chrom, s as start, e as "end", strand, 'enhancer_1' as region_name, 'enhancer' as region_type from gene""")
def read_curated_loci(s, d):
    rows = _genes(s, d).select(F.concat(F.lit("L_"), "gene").alias("locus_id"), "gene", "chrom", "start", "end", "strand", F.lit("enhancer_1").alias("region_name"), F.lit("enhancer").alias("region_type"))
    return delimited.curated_loci(s, _tsv(rows, "loci"))


@query(f"""with {PEAKS} select chrom, s as start, e as "end", '' as gene, case when mark = 'H3K27ac' then mark else '' end as support_label, '' as external_id, '' as biosample, '' as notes, 'ENCODE' as source from peak""")
def read_evidence(s, d):
    label = F.when(F.col("mark") == "H3K27ac", F.col("mark"))
    return delimited.evidence(s, _tsv(_peaks(s, d).select("chrom", "start", "end", label.alias("support_label")), "evidence"), "ENCODE")


@query("select n_name as coarse_cell_type, cast(n_nationkey as varchar) as fine_cell_type, 'R' || n_regionkey as harmonized_coarse, n_name as harmonized_fine from nation")
def read_harmonisation(s, d):
    rows = table(s, d, "nation").select(F.col("n_name").alias("coarse_cell_type"), F.col("n_nationkey").alias("fine_cell_type"), F.concat(F.lit("R"), "n_regionkey").alias("harmonized_coarse"), F.col("n_name").alias("harmonized_fine"))
    return delimited.harmonisation(s, _tsv(rows, "harmonisation"))


@query(f"""with {GENES} select gene as gene_name, gene as gene_id, chrom, s as start, e as "end", strand from gene union all select gene, 'id_' || gene, chrom, tss, tss + 1, strand from gene""")
def read_gene_coordinates(s, d):
    genes = _genes(s, d)
    bodies = delimited.tsv(s, _tsv(genes.select("gene_name", "chrom", F.col("start").alias("chromStart"), F.col("end").alias("chromEnd"), "strand"), "bodies"))
    starts = delimited.tss_table(s, _tsv(genes.select("gene_name", F.concat(F.lit("id_"), "gene").alias("gene_id"), "chrom", "tss", "strand"), "starts"))
    return delimited.gene_coordinates(bodies).unionByName(delimited.gene_coordinates(starts))


@query("select p_partkey as gene_index, 'f' || p_partkey as feature_id, 'f' || p_partkey as gene_name, 'f' || p_partkey as gene_id, case when p_size > 25 then 'f' || p_partkey end as rna_gene, p_size > 25 as present_in_rna from part")
def read_gene_universe(s, d):
    feature, here = F.concat(F.lit("f"), "p_partkey"), F.col("p_size") > 25
    rows = table(s, d, "part").select(feature.alias("feature_id"), F.when(here, feature).alias("rna_gene"), F.when(here, "True").otherwise("False").alias("present_in_rna"), F.col("p_partkey").alias("gene_index"))
    return delimited.gene_universe(s, _tsv(rows, "universe"))


@query("select cast(c_custkey as varchar) as barcode, cast(c_custkey as varchar) as core, c_mktsegment as coarse_cell_type, c_name as fine_cell_type, cast(c_nationkey as varchar) as cell_count_in_model from customer")
def read_cell_type_archive(s, d):
    path = _file(s, "annotation.tar.gz")
    text = io.StringIO("barcode,coarse_cell_type,fine_cell_type,cell_count_in_model\n")
    text.seek(0, io.SEEK_END)
    for r in table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_name", "c_nationkey").toLocalIterator():
        text.write(",".join(map(str, r)) + "\n")
    content = text.getvalue().encode()
    with tarfile.open(path, "w:gz") as tar:
        member = tarfile.TarInfo(archive.MEMBER)
        member.size = len(content)
        tar.addfile(member, io.BytesIO(content))
    return archive.cell_types(s, path)


# Writers.


@query("select cast(o_orderkey as varchar) as o_orderkey, o_orderstatus, o_orderpriority from orders")
def write_tsv(s, d):
    path = _file(s, "orders.tsv.gz")
    tables.write_tsv(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path, ["o_orderkey"])
    return delimited.tsv(s, path)


@query("select cast(row_number() over (order by b) as bigint) as place, b as barcode, n from (select cast(user_id as varchar) as b, count(*) as n from events group by all)")
def write_counts(s, d):
    path = _file(s, "counts.tsv")
    tables.write_counts(qc.fragment_counts(table(s, d, "events").select(F.col("user_id").cast("string").alias("barcode"))), path)
    # one small file is one partition, so its lines are numbered as they stand
    return delimited.fragment_counts(s, path).select((F.monotonically_increasing_id() + 1).alias("place"), "barcode", "n")


@query(f"""with {PEAKS} select chrom, s as start, e as "end", chrom || ':' || s || '-' || e as name from peak""")
def write_bins_bed(s, d):
    at = F.concat("chrom", F.lit(":"), "start", F.lit("-"), "end")
    names = _peaks(s, d).select(at.alias("feature")).unionByName(table(s, d, "nation").select(F.col("n_name").alias("feature")))
    return delimited.bed(s, _tsv(tables.bins_bed(names), "bins", header=False))


@query(f"""with {GENES} select chrom, s as start, e as "end", gene as name, 0 as score, strand from gene union all select chrom, s, e, gene, 0, '.' from gene""")
def write_bed6(s, d):
    genes = _genes(s, d).withColumn("name", F.col("gene"))
    rows = tables.bed6(genes).unionByName(tables.bed6(genes.drop("strand")))
    return s.read.csv(_tsv(rows, "bed6", header=False), sep="\t", schema="chrom string, start bigint, end bigint, name string, score int, strand string")


@query(f"""with {PEAKS}, {GENES} select gene, name, s as start from (select gene, peak.name, peak.s from peak join gene on peak.chrom = gene.chrom and peak.e > tss - 3000 and peak.s < tss + 3000)""")
def write_links(s, d):
    from .operators.range_joins import overlap_join

    near = overlap_join(_peaks(s, d), _genes(s, d).select("chrom", (F.col("tss") - 3000).alias("start"), (F.col("tss") + 3000).alias("end"), "gene"))
    path = scratch(s, "links")
    tables.write_tsv_folder(near.select(F.col("b_gene").alias("gene"), F.col("a_name").alias("name"), F.col("a_start").alias("start")), path, "gzip")
    return delimited.tsv(s, path).withColumn("start", F.col("start").cast("bigint"))


@query(f"with {ENTRIES} select o_custkey, cell, feature, value from ent join orders on cell = o_orderkey")
def write_bundle(s, d):
    path = scratch(s, "bundle")
    e = _entries(s, d)
    bundle.write(path, table(s, d, "orders").select(F.col("o_orderkey").alias("cell"), "o_custkey"), e.select("feature").distinct(), {"counts": e}, uns={"made": "of orders"})
    return bundle.read_layer(s, path).join(bundle.read_obs(s, path), "cell").select("o_custkey", "cell", "feature", "value")


@query("""select 'a' as modality_key, vec_id as id, round(cast(embedding[1] as double), 4) as "first", round(cast(embedding[len(embedding)] as double), 4) as "last" from embeddings where vec_id % 2 = 0
union all select 'b', vec_id, round(cast(embedding[1] as double), 4), round(cast(embedding[len(embedding)] as double), 4) from embeddings where vec_id % 2 = 1""")
def concat_modalities(s, d):
    size = table(s, d, "embeddings").select(F.max(F.size("embedding"))).first()[0] or 0
    emb = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"))
    there = bundle.embeddings_long(bundle.embeddings_wide(emb, "X_glue", size), "X_glue")
    whole = bundle.concat_modalities({"a": there.where("id % 2 = 0"), "b": there.where("id % 2 = 1")})
    return whole.select("modality_key", "id", F.round(F.get("emb", F.lit(0)), 4).alias("first"), F.round(F.element_at("emb", -1), 4).alias("last"))


@query("select c_custkey, lower(trim(c_mktsegment)) in ('building', 'x') as flag, case when c_nationkey % 5 = 0 then '__missing__' else c_mktsegment end as covariate from customer")
def missing_words(s, d):
    word = F.when(F.col("c_nationkey") % 10 == 0, " NaN ").when(F.col("c_nationkey") % 5 == 0, None).otherwise(F.col("c_mktsegment"))
    truth = F.when(F.col("c_mktsegment") == "BUILDING", F.element_at(F.array(*map(F.lit, (" True", "t", "1", "YES "))), (F.col("c_custkey") % 4 + 1).cast("int"))).when(F.col("c_custkey") % 2 == 0, "no")
    return table(s, d, "customer").select("c_custkey", ids.to_bool(truth).alias("flag"), ids.covariate(word).alias("covariate"))
