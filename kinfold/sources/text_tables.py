"""Group files, label lists, metadata and other small text formats; and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions.scalars import after_pipe


def place_in_file() -> Column:
    """Orders a file's lines: where a line's split begins, and its place in that. Tasks may read splits in any order."""
    return F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), place_in_file().alias("place")).alias("line_no"))


def _fields(df: DataFrame, *names: str, sep: str = "\t") -> DataFrame:
    parts = F.split("value", sep)
    return df.select("line_no", F.size(parts).alias("n_fields"), *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(og, gene) from ``og, genome_num, gene_num, genes`` lines: genes as the token after the pipe; a repeated gene's last group holds."""
    rows = _fields(_lines(spark, path), "og", "genome_num", "gene_num", "genes").filter("genes IS NOT NULL")
    members = rows.select("og", "line_no", F.explode(F.split(F.trim("genes"), " +")).alias("g")).select("og", "line_no", after_pipe(F.col("g")).alias("gene"))
    return members.groupBy("gene").agg(F.max_by("og", "line_no").alias("og")).select("og", "gene")


def read_external_groups(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """(og, pos, gene) from ``name: gene gene ...`` lines with at least ``least`` genes."""
    rows = _lines(spark, path).filter(F.contains("value", F.lit(":")))
    genes = F.split(F.trim(F.substring_index("value", ":", -1)), " +")
    return rows.filter(F.size(genes) >= least).select(F.trim(F.split_part("value", F.lit(":"), F.lit(1))).alias("og"), F.posexplode(genes).alias("pos", "gene"))


def read_external_groups_table(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """(og, pos, gene) from a table with a heading: the group's name, then a column for each genome with genes split by commas."""
    cells = _lines(spark, path).select("value", F.split("value", "\t").alias("f"))
    heading = F.col("f")[0].isin("Orthogroup", "HOG", "OG")
    genes = F.filter(F.transform(F.flatten(F.transform(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))), lambda x: F.split(x, ","))), lambda g: F.trim(g)), lambda g: g != "")
    return cells.filter(~heading).select(F.trim(F.col("f")[0]).alias("og"), genes.alias("genes")).filter(F.size("genes") >= least).select("og", F.posexplode("genes").alias("pos", "gene"))


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """(orig_id, gene) from ``gene <tab> original id`` lines, the original id up to its first space; an id's last line holds."""
    rows = _fields(_lines(spark, path), "gene", "orig").filter("orig IS NOT NULL")
    return rows.groupBy(F.split_part(F.trim("orig"), F.lit(" "), F.lit(1)).alias("orig_id")).agg(F.max_by(F.trim("gene"), "line_no").alias("gene"))


def single_copy(groups: DataFrame, genomes: int) -> DataFrame:
    """Groups (og, gene) with one gene of each of ``genomes`` genomes; a gene's genome follows the last ``_`` of its last pipe field."""
    genome = F.element_at(F.split(F.element_at(F.split("gene", r"\|"), -1), "_"), -1)
    keep = groups.groupBy("og").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(genome).alias("g")).filter((F.col("n") == genomes) & (F.col("g") == genomes))
    return groups.join(keep.select("og"), "og", "left_semi")


def read_labelled_pairs(spark: SparkSession, path: str, marker: str | None = "TreeFamA") -> DataFrame:
    """(gene_a, gene_b, label) of the lines that contain ``marker``, which is then their first field; without one, of all lines."""
    rows = _lines(spark, path)
    if marker:
        return _fields(rows.filter(F.contains("value", F.lit(marker))), "tag", "gene_a", "gene_b", "label").filter("label IS NOT NULL").select("gene_a", "gene_b", F.trim("label").alias("label"))
    return _fields(rows, "gene_a", "gene_b", "label").filter("label IS NOT NULL").select("gene_a", "gene_b", F.trim("label").alias("label"))


def read_assemblies(spark: SparkSession, path: str) -> DataFrame:
    """(accession, genus, species, strain, level, released, url) of assembly summaries: header and short lines go, an accession's last line holds."""
    rows = _lines(spark, path).filter(~F.col("value").startswith("#"))
    p = F.split("value", "\t")
    got = rows.filter(F.size(p) >= 20).select("line_no", p[0].alias("accession"), F.split(p[7], " ").alias("o"), p[8].alias("infra"), p[11].alias("level"), p[14].alias("released"), p[19].alias("ftp")).filter("size(o) > 1")
    url = F.concat("ftp", F.lit("/"), F.element_at(F.split("ftp", "/"), -1), F.lit("_genomic.fna.gz"))
    strain = F.when(F.contains("infra", F.lit("strain=")), F.split_part("infra", F.lit("strain="), F.lit(2)))
    got = got.select("line_no", "accession", F.col("o")[0].alias("genus"), F.col("o")[1].alias("species"), strain.alias("strain"), "level", "released", url.alias("url"))
    last = Window.partitionBy("accession").orderBy(F.desc("line_no"))
    return got.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "line_no")


def of_species(assemblies: DataFrame, name: str) -> DataFrame:
    return assemblies.filter(F.concat_ws(" ", "genus", "species") == name)


def read_genome_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(accession, source) from the second column: GCA accessions, and others under ``IMG`` names."""
    acc = F.get(F.split("value", "\t"), F.lit(1))
    rows = _lines(spark, path).select(acc.alias("a")).filter("a IS NOT NULL")
    gca = F.contains("a", F.lit("GCA"))
    return rows.select(F.when(gca, F.col("a")).otherwise(F.concat(F.lit("IMG"), "a")).alias("accession"), F.when(gca, "assembly").otherwise("img").alias("source"))


def read_cog_ids(spark: SparkSession, path: str) -> DataFrame:
    """(gene, cog) of every ``<id> eggNOG <tab> COG...`` in the text."""
    found = F.expr(r"explode(regexp_extract_all(value, '(\\w+\\seggNOG\\tCOG\\w+)', 1))")
    rows = _lines(spark, path).select(found.alias("m"))
    return rows.select(F.regexp_extract("m", r"^(\w+)", 1).alias("gene"), F.regexp_extract("m", r"(COG\w+)$", 1).alias("cog")).distinct()


def read_cog_categories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((cog, category), lines that aren't two fields)."""
    rows = _lines(spark, path)
    return _fields(rows, "cog", "category").filter("n_fields >= 2").select("cog", "category"), rows.filter(F.size(F.split("value", "\t")) < 2).select("value")


def read_group_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(og, cog_id, cog_c, genes, pathway, genes_num): the name up to its dot, the category's first letter."""
    got = _fields(_lines(spark, path), "og", "cog_id", "cog_c", "genes", "pathway", "genes_num").filter("n_fields >= 6")
    letter = F.when(F.col("cog_c") == "None", F.lit("None")).otherwise(F.substring("cog_c", 1, 1))
    return got.select(F.split_part("og", F.lit("."), F.lit(1)).alias("og"), "cog_id", letter.alias("cog_c"), "genes", "pathway", F.trim("genes_num").try_cast("int").alias("genes_num"))


def read_benchmark_json(spark: SparkSession, path: str) -> DataFrame:
    """(participant_id, metric_x, metric_y, stderr_x, stderr_y, x_axis, y_axis) of benchmark result files."""
    d = spark.read.option("multiLine", True).json(path).select(F.col("datalink.inline_data").alias("d"))
    rows = d.select(F.col("d.visualization").alias("v"), F.explode("d.challenge_participants").alias("p"))
    return rows.select(*[F.col(f"p.{c}").alias(c) for c in ("participant_id", "metric_x", "metric_y", "stderr_x", "stderr_y")], F.col("v.x_axis").alias("x_axis"), F.col("v.y_axis").alias("y_axis"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("quote", "\u0000").csv(path)


def group_members(groups: DataFrame, genes: DataFrame) -> DataFrame:
    """(og_id, genome_num, gene_num, place, and the columns of ``genes``): a row for each gene of a group, ``place`` its place there. ``genes`` has gene_code."""
    return groups.select("og_id", "genome_num", "gene_num", F.posexplode("gene_ids").alias("place", "gene_code")).join(genes, "gene_code")


def write_groups(groups: DataFrame, path: str, genes: DataFrame | None = None) -> None:
    """og, genome number, gene number and genes joined by spaces: their original ids if ``genes`` (gene_code, orig_id) is given, else their codes."""
    if genes is None:
        named = groups.select("og_id", "genome_num", "gene_num", F.array_join("gene_ids", " ").alias("genes"))
    else:
        members = group_members(groups, genes.select("gene_code", "orig_id")).groupBy("og_id", "genome_num", "gene_num").agg(F.array_sort(F.collect_list(F.struct("place", "orig_id"))).alias("m"))
        named = members.select("og_id", "genome_num", "gene_num", F.array_join(F.col("m.orig_id"), " ").alias("genes"))
    write_tsv(named, path)


def write_group_sequences(groups: DataFrame, genes: DataFrame, path: str, genes_per_file: int = 100_000) -> None:
    """The sequences of each group as FASTA in a folder of its own; larger groups have several files, so that no task writes more of one group. ``genes`` has (gene_code, orig_id, seq)."""
    from kinfold.sources.sequences import write_fasta

    members = group_members(groups, genes.select("gene_code", "orig_id", "seq")).withColumn("part", F.expr(f"place div {int(genes_per_file)}"))
    dealt = members.repartition("og_id", "part").sortWithinPartitions("og_id", "place")
    write_fasta(dealt.select("og_id", F.col("orig_id").alias("header"), "seq"), path, by="og_id")


def group_totals(groups: DataFrame) -> DataFrame:
    """Distinct genes against occurrences: they differ where groups overlap."""
    return groups.select(F.explode("gene_ids").alias("g"), F.lit(1).alias("o")).agg(F.count_distinct("g").alias("genes"), F.sum("o").alias("occurrences"))


def write_pairs(pairs: DataFrame, genes: DataFrame, path: str) -> None:
    """Original ids (after the pipe) and codes of ortholog pairs; ``genes`` has (gene_code, orig_id)."""
    a = genes.select(F.col("gene_code").alias("gene_a"), after_pipe(F.col("orig_id")).alias("id_a"))
    b = genes.select(F.col("gene_code").alias("gene_b"), after_pipe(F.col("orig_id")).alias("id_b"))
    write_tsv(pairs.join(a, "gene_a").join(b, "gene_b").select("id_a", "id_b", "gene_a", "gene_b"), path)
