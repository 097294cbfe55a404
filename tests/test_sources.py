"""File formats: read, written, read again."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.operators import annotate
from kinfold.plans.tables import numbered
from kinfold.sources import gml, hits, sequences, text_tables
from kinfold.streaming.incremental import follow_hits


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    put(tmp_path / "g" / "b.faa", ">sp|P1|A_X first gene\nMKV\nLL\n>sp|P2|B_X\nMM\n")
    put(tmp_path / "g" / "a.fa", ">q1\nAAAA\n")
    put(tmp_path / "g" / "notes.txt", ">no\nX\n")
    put(tmp_path / "g" / "c.fna", ">dna\nACGT\n")
    rec = sequences.read_fasta(spark, str(tmp_path / "g"))
    genomes, genes = sequences.recode(rec)
    assert [tuple(r) for r in genomes.orderBy("genome_id").collect()] == [(0, "G0", "a.fa", 1), (1, "G1", "b.faa", 2)]
    assert [tuple(r) for r in genes.orderBy("gene_code").collect()] == [(0, 0, "G0|g0", "q1", 4, "AAAA"), (1, 0, "G1|g0", "sp|P1|A_X", 5, "MKVLL"), (1, 1, "G1|g1", "sp|P2|B_X", 2, "MM")]
    assert {r.file for r in sequences.read_fasta(spark, str(tmp_path / "g"), sequences.ANNOTATION_EXTENSIONS).collect()} == {"b.faa", "c.fna"}
    assert {r.orig_id for r in sequences.recode_reference(rec).collect()} == {"sp|P1|A_X_b", "sp|P2|B_X_b", "q1_a"}
    sequences.write_fasta(rec.select("header", "seq", F.lit("OG000000").alias("og")), str(tmp_path / "out"), by="og")
    again = sequences.read_fasta(spark, str(tmp_path / "out" / "og=OG000000"), ("txt",))
    assert sorted((r.header, r.seq) for r in again.collect()) == sorted((r.header, r.seq) for r in rec.collect())
    twice = spark.createDataFrame([("f", 1, "h", "A"), ("f", 2, "h", "B")], "file string, pos long, header string, seq string")
    assert sequences.last_of_header(twice).first().seq == "B"


def test_fasta_of_several_splits(spark, tmp_path):
    """Headers may contain ``>``; records keep the file's order however it is split."""
    n = 400
    text = "".join(f">g{i} enzyme A->B like > {i}\n{'MKV' * (i % 7 + 1)}\nLL\n" for i in range(n))
    put(tmp_path / "g" / "a.faa", "\n" + text)
    put(tmp_path / "g" / "b.faa", text.replace("\n", "\r\n"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rec = sequences.read_fasta(spark, str(tmp_path / "g"))
        assert rec.rdd.getNumPartitions() > 5
        _, genes = sequences.recode(rec)
        rows = genes.select("genome_id", "gene_idx", "orig_id", "seq").collect()
        hit = put(tmp_path / "h" / "x.out", "".join(f"a\tb\t90\t10\t0\t0\t1\t10\t10\t1\t1e-5\t{i}\n" for i in range(300)) + "LEGEND1\tEND\t90\t10\t0\t0\t1\t10\t10\t1\t1e-5\t7\n END \n")
        good, bad = hits.read_outfmt6(spark, hit)
        last = good.filter("query = 'a'").orderBy(F.desc("line_no")).first().bitscore
        assert good.count() == 301 and bad.count() == 0 and last == 299.0
        p = put(tmp_path / "og.tsv", "".join(f"OG{i}\t1\t1\tx|same\n" for i in range(300)))
        assert [tuple(r) for r in text_tables.read_groups(spark, p).collect()] == [("OG299", "same")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(tuple(r) for r in rows) == sorted((g, i, f"g{i}", "MKV" * (i % 7 + 1) + "LL") for g in (0, 1) for i in range(n))


def test_other_group_files(spark, tmp_path):
    p = put(tmp_path / "t.tsv", "Orthogroup\tA\tB\nOG1\ta1, a2\tb1\nOG2\t\tb2\n")
    assert sorted(map(tuple, text_tables.read_external_groups_table(spark, p).collect())) == [("OG1", 0, "a1"), ("OG1", 1, "a2"), ("OG1", 2, "b1"), ("OG2", 0, "b2")]
    assert {r.og for r in text_tables.read_external_groups_table(spark, p, 2).collect()} == {"OG1"}
    p = put(tmp_path / "ids.tsv", "G0|g0\tsp|P1 first\nG0|g1\tP2\nG1|g5\tP2\nshort\n")
    assert sorted(map(tuple, text_tables.read_id_map(spark, p).collect())) == [("P2", "G1|g5"), ("sp|P1", "G0|g0")]


def test_hits(spark, tmp_path):
    line = lambda q, s, bits: f"{q}\t{s}\t90\t10\t0\t0\t1\t10\t10\t1\t1e-5\t{bits}\n"
    put(tmp_path / "h" / "G0-G1.out", line("G0|g0", "G1|g0", 50) + line("G0|g0", "G1|g0", 40) + line("G0|g0", "G0|g0", 99) + "G0|g0\tG1|g1\tbad\n" + line("G0|g0", "G9|g9", 1) + "END\n")
    good, bad = hits.read_outfmt6(spark, str(tmp_path / "h"))
    assert good.count() == 4 and [r.value for r in bad.collect()] == ["G0|g0\tG1|g1\tbad"]
    genes = spark.createDataFrame([("G0|g0", 0, 0, 10), ("G1|g0", 1, 0, 20)], "gene_code string, genome_id int, gene_idx int, seq_len int")
    assert [tuple(r) for r in hits.genome_hits(good, genes).collect()] == [(0, 1, 0, 0, 90.0, 40.0, 200)]
    q = follow_hits(spark, str(tmp_path / "h"), str(tmp_path / "t"), str(tmp_path / "c"), once=True)
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    q = follow_hits(spark, str(tmp_path / "h"), str(tmp_path / "t"), str(tmp_path / "c"), once=True)
    q.awaitTermination(60)
    followed = spark.read.parquet(str(tmp_path / "t"))
    assert followed.count() == 3
    assert [tuple(r) for r in hits.genome_hits(followed, genes).collect()] == [(0, 1, 0, 0, 90.0, 40.0, 200)]
    # An epoch that ran but wasn't committed runs again and adds nothing; a later file's line replaces an earlier one's.
    for f in (tmp_path / "c" / "commits").glob("*0*"):
        f.unlink()
    put(tmp_path / "h" / "G0-G2.out", line("G0|g0", "G1|g0", 45))
    for _ in range(2):
        follow_hits(spark, str(tmp_path / "h"), str(tmp_path / "t"), str(tmp_path / "c"), once=True).awaitTermination(60)
    followed = spark.read.parquet(str(tmp_path / "t"))
    assert followed.count() == 4
    assert [tuple(r) for r in hits.genome_hits(followed, genes).collect()] == [(0, 1, 0, 0, 90.0, 45.0, 200)]


def test_unfinished_results(spark):
    lines = spark.createDataFrame([("a", 0, "x"), ("a", 1, " END "), ("b", 0, "g\tLEGEND1\t90"), ("c", 0, "END"), ("c", 1, "x")], "genome string, line_no int, line string")
    genomes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "genome string")
    assert {r.genome for r in annotate.unfinished(genomes, lines).collect()} == {"b", "c", "d"}


def test_text_tables(spark, tmp_path):
    p = put(tmp_path / "og.tsv", "OG0\t2\t2\tsp|P1|A sp|P2|B\nOG1\t1\t1\tP2\n")
    assert sorted(map(tuple, text_tables.read_groups(spark, p).collect())) == [("OG0", "P1"), ("OG1", "P2")]
    p = put(tmp_path / "ext.txt", "A: x_1 y_2\nB: z_1\n")
    assert sorted(map(tuple, text_tables.read_external_groups(spark, p, least=2).collect())) == [("A", 0, "x_1"), ("A", 1, "y_2")]
    assert {r.og for r in text_tables.single_copy(text_tables.read_external_groups(spark, p), 2).collect()} == {"A"}
    p = put(tmp_path / "pairs.tsv", "TreeFamA\ta\tb\tTP\nother\tc\td\tFN\n")
    assert [tuple(r) for r in text_tables.read_labelled_pairs(spark, p).collect()] == [("a", "b", "TP")]
    assert text_tables.read_labelled_pairs(spark, put(tmp_path / "p2.tsv", "a\tb\tFP\nshort\n"), None).count() == 1
    row = lambda acc, org: "\t".join([acc, *["x"] * 6, org, "strain=K", "x", "x", "Complete", "x", "x", "2020/01/02", *["x"] * 4, f"ftp://h/{acc}_v1", "type"])
    p = put(tmp_path / "asm.txt", "# head\n" + row("GCA1", "Genus species one") + "\nshort\tline\n" + row("GCA1", "Genus other") + "\n" + row("GCA2", "Genus species") + "\n")
    asm = text_tables.read_assemblies(spark, p)
    assert {(r.accession, r.species, r.strain, r.url) for r in asm.collect()} == {("GCA1", "other", "K", "ftp://h/GCA1_v1/GCA1_v1_genomic.fna.gz"), ("GCA2", "species", "K", "ftp://h/GCA2_v1/GCA2_v1_genomic.fna.gz")}
    assert [r.accession for r in text_tables.of_species(asm, "Genus species").collect()] == ["GCA2"]
    p = put(tmp_path / "meta.tsv", "a\tGCA_1\nb\t77\nshort\n")
    assert sorted(map(tuple, text_tables.read_genome_metadata(spark, p).collect())) == [("GCA_1", "assembly"), ("IMG77", "img")]
    p = put(tmp_path / "cog.txt", "P1 eggNOG\tCOG12 P9 eggNOG\tCOG3\nnothing\n")
    assert sorted(map(tuple, text_tables.read_cog_ids(spark, p).collect())) == [("P1", "COG12"), ("P9", "COG3")]
    good, bad = text_tables.read_cog_categories(spark, put(tmp_path / "cat.tsv", "COG1\tJ\nbroken\n"))
    assert [tuple(r) for r in good.collect()] == [("COG1", "J")] and [r.value for r in bad.collect()] == ["broken"]
    p = put(tmp_path / "ann.tsv", "OG1.fa\tCOG1\tJK\tg\tp\t3\nOG2.fa\tNone\tNone\tg\tp\t4\n")
    assert [(r.og, r.cog_c, r.genes_num) for r in text_tables.read_group_annotations(spark, p).orderBy("og").collect()] == [("OG1", "J", 3), ("OG2", "None", 4)]
    doc = {"datalink": {"inline_data": {"visualization": {"x_axis": "X", "y_axis": "Y"}, "challenge_participants": [{"participant_id": "m", "metric_x": 1.0, "metric_y": 2.0, "stderr_x": 0.1, "stderr_y": 0.2}]}}}
    p = put(tmp_path / "b.json", json.dumps(doc, indent=1))
    assert [tuple(r) for r in text_tables.read_benchmark_json(spark, p).collect()] == [("m", 1.0, 2.0, 0.1, 0.2, "X", "Y")]


def test_gml(spark, tmp_path):
    v = spark.createDataFrame([(0, 'G0|g0 "x"', 3, None), (1, "b", 1, "I"), (2, "a]b [c] &quot; &#93;\n  ]\n  node", 2, "")], "id long, name string, genesNum int, Event string")
    e = spark.createDataFrame([(0, 1, 0.5)], "source long, target long, NBS double")
    gml.write_gml(v, e, str(tmp_path / "g"))
    v2, e2 = gml.read_gml(spark, str(tmp_path / "g"), {"name": T.StringType(), "genesNum": T.IntegerType(), "Event": T.StringType()}, {"NBS": T.DoubleType()})
    assert sorted(map(tuple, v2.collect())) == sorted(map(tuple, v.collect())) and [tuple(r) for r in e2.collect()] == [(0, 1, 0.5)]


def test_annotation(spark):
    cols = "query string, subject string, pident double, qstart int, qend int, sstart int, send int, q_len int, s_len int, evalue double, bitscore double"
    rows = [("a", "s1", 50.0, 1, 81, 81, 1, 100, 100, 1e-5, 10.0), ("a", "s2", 50.0, 1, 81, 1, 81, 100, 100, 1e-6, 5.0), ("a", "s3", 99.0, 1, 11, 1, 81, 100, 100, 0.0, 99.0), ("b", "s1", 39.9, 1, 99, 1, 99, 100, 100, 0.0, 1.0), ("c", "s1", 40.0, 1, 21, 21, 1, 100, 100, 1.0, 1.0)]
    got = {r.query: (r.subject, r.coverage) for r in annotate.best_annotation(spark.createDataFrame(rows, cols), 0.4, 20).collect()}
    assert got == {"a": ("s2", 80.0), "c": ("s1", 20.0)}
    lines = spark.createDataFrame([("g1", 1, "x"), ("g1", 2, "END"), ("g2", 1, "END x"), ("g2", 2, "y")], "genome string, line_no int, line string")
    assert [r.genome for r in annotate.unfinished(spark.createDataFrame([("g1",), ("g2",), ("g3",)], "genome string"), lines).orderBy("genome").collect()] == ["g2", "g3"]


def test_numbers(spark):
    df = spark.range(1000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(97)))
    rows = sorted(numbered(df, [F.desc("k"), F.asc("id")]).collect(), key=lambda r: r.number)
    assert [r.number for r in rows] == list(range(1000)) and [(-r.k, r.id) for r in rows] == sorted((-r.k, r.id) for r in rows)
