"""Queries that write the tables as the files the readers take, and read those: the readers' rows against DuckDB's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.plans.tables import new_path
from kinfold.queries import query, table
from kinfold.sources import hits, sequences, text_tables


def _tsv(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]).alias("value")


def _written(lines: DataFrame, name: str) -> str:
    """The folder of ``lines`` (value) as text; files are named in order of the partitions, so sorted lines stay sorted."""
    path = new_path(lines.sparkSession, name)
    lines.select("value").write.text(path)
    return path


@query("""
WITH last AS (SELECT * FROM (SELECT l_partkey AS q, l_suppkey AS r, l_extendedprice AS bitscore, l_quantity * 2 AS identity,
  row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC) AS nth FROM lineitem WHERE l_partkey <> l_suppkey) WHERE nth = 1)
SELECT a.p_brand AS q_genome, b.p_brand AS r_genome, q, r, identity, bitscore, CAST(a.p_size AS BIGINT) * b.p_size AS len_product FROM last JOIN part a ON q = a.p_partkey JOIN part b ON r = b.p_partkey
""")
def hits_of_files(spark, d):
    """Search results as files: each line is a hit of a part on the part of its supplier's number; of a repeated pair the last line counts, self hits go, as do END and what doesn't parse."""
    one = F.lit(1)
    values = [F.col("l_quantity") * 2, one, one, one, one, one, one, one, F.lit(1e-9), F.col("l_extendedprice")]
    order = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"]
    lines = table(spark, d, "lineitem").select(*order, _tsv("l_partkey", "l_suppkey", *values))
    odd = lines.limit(1).select(*order, F.explode(F.array(F.lit("END"), F.lit("no\thit"), F.lit(""))).alias("value"))
    good, _ = hits.read_outfmt6(spark, _written(lines.unionByName(odd).orderBy(*order), "hits"))
    part = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("gene_code"), F.col("p_brand").alias("genome_id"), F.col("p_partkey").alias("gene_idx"), F.col("p_size").alias("seq_len"))
    return hits.genome_hits(good, part)


@query("SELECT 'P' || CAST(p_partkey AS VARCHAR) AS orig_id, p_size AS seq_len, count(*) OVER (PARTITION BY p_brand, p_partkey // 1000) AS n_genes FROM part")
def genes_of_fasta(spark, d):
    """Parts as FASTA, a file for each brand's parts of a thousand numbers: every record with its length and the number of its genome's records."""
    record = F.concat(F.lit(">P"), F.col("p_partkey"), F.lit(" of "), F.col("p_brand"), F.lit("\n"), F.repeat(F.lit("M"), F.col("p_size")))
    files = table(spark, d, "part").groupBy("p_brand", F.expr("p_partkey div 1000")).agg(F.array_join(F.collect_list(record), "\n").alias("value"))
    path = new_path(spark, "fasta")
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    genomes, genes = sequences.recode(sequences.read_fasta(spark, path, ("txt",)))
    return genes.join(genomes.select("genome_id", "n_genes"), "genome_id").select("orig_id", "seq_len", "n_genes")


@query("""
WITH a AS (SELECT 'GCA' || CAST(c_custkey % 1000 AS VARCHAR) AS accession, c_mktsegment AS genus, 'n' || CAST(c_nationkey % 3 AS VARCHAR) AS species, 'K' || CAST(c_custkey AS VARCHAR) AS strain,
  row_number() OVER (PARTITION BY c_custkey % 1000 ORDER BY c_custkey DESC) AS nth FROM customer)
SELECT accession, genus, species, strain, 'ftp://h/' || accession || '_v1/' || accession || '_v1_genomic.fna.gz' AS url FROM a WHERE nth = 1 AND genus = 'BUILDING' AND species = 'n1'
""")
def assemblies_of_file(spark, d):
    """Customers as an assembly summary with a heading and short lines: the last line of each accession, then one species."""
    x = F.lit("x")
    name = F.concat(F.lit("GCA"), F.col("c_custkey") % 1000)
    organism = F.concat("c_mktsegment", F.lit(" n"), F.col("c_nationkey") % 3, F.lit(" more"))
    fields = [name, *[x] * 6, organism, F.concat(F.lit("strain=K"), "c_custkey"), x, x, F.lit("Complete"), x, x, F.lit("2020/01/02"), *[x] * 4, F.concat(F.lit("ftp://h/"), name, F.lit("_v1")), x]
    lines = table(spark, d, "customer").select("c_custkey", _tsv(*fields))
    odd = lines.limit(1).select("c_custkey", F.explode(F.array(F.lit("# accession\tand more"), F.lit("GCA1\tshort"))).alias("value"))
    found = text_tables.read_assemblies(spark, _written(lines.unionByName(odd).orderBy("c_custkey"), "assemblies"))
    return text_tables.of_species(found, "BUILDING n1").select("accession", "genus", "species", "strain", "url")


@query("SELECT DISTINCT 'P' || CAST(p_partkey AS VARCHAR) AS gene, 'COG' || CAST(p_size AS VARCHAR) AS cog FROM part UNION SELECT 'Q' || CAST(p_partkey AS VARCHAR), 'COG' || p_type FROM part")
def cog_ids_of_text(spark, d):
    """Ids and their COGs found in lines of text, two in each."""
    said = lambda mark, cog: F.concat(F.lit(mark), F.col("p_partkey"), F.lit(" eggNOG\tCOG"), F.col(cog), F.lit(" COG eggNOG. "))
    lines = table(spark, d, "part").select(F.concat(F.lit("seen: "), said("P", "p_size"), said("Q", "p_type")).alias("value"))
    return text_tables.read_cog_ids(spark, _written(lines, "cogs"))


@query("SELECT event_id AS participant_id, value AS metric_x, user_id AS metric_y, 0.5 AS stderr_x, 0.25 AS stderr_y, 'x' || CAST(event_id // 1000 AS VARCHAR) AS x_axis, 'y' AS y_axis FROM events")
def benchmark_of_json(spark, d):
    """Events as benchmark result files, each of up to a thousand participants: a row for each participant with its file's axes."""
    p = F.struct(F.col("event_id").alias("participant_id"), F.col("value").alias("metric_x"), F.col("user_id").alias("metric_y"), F.lit(0.5).alias("stderr_x"), F.lit(0.25).alias("stderr_y"))
    of = F.expr("event_id div 1000")
    rows = table(spark, d, "events").groupBy(of.alias("f")).agg(F.collect_list(p).alias("challenge_participants"))
    shown = F.struct(F.concat(F.lit("x"), F.col("f")).alias("x_axis"), F.lit("y").alias("y_axis")).alias("visualization")
    path = new_path(spark, "results")
    rows.select(F.struct(F.struct(shown, "challenge_participants").alias("inline_data")).alias("datalink")).write.option("maxRecordsPerFile", 1).json(path)
    return text_tables.read_benchmark_json(spark, path)
