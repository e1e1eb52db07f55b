"""Readers, writers, audits and streams on small files."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladewise.operators import alignment as al
from cladewise.operators import tables as ta
from cladewise.sources import files, newick
from cladewise.streaming import running


def test_tree_set(spark, tmp_path):
    (tmp_path / "a.nwk").write_text("((A,B),\n(C,D));\n(A,(B,(C,D)));\n")
    sets = newick.read_tree_set(spark, str(tmp_path / "a.nwk"))
    nodes = newick.parse_trees(sets)
    assert nodes.where("is_tip").count() == 8 and nodes.where("error is not null").count() == 0
    assert sorted(r.newick for r in newick.dump_trees(nodes).collect()) == ["((A,B),(C,D));", "(A,(B,(C,D)));"]


def test_broken_trees_give_rows(spark):
    bad = spark.createDataFrame([("x", "((A,B);"), ("y", None)], "tree_id string, newick string")
    rows = newick.parse_trees(bad).collect()
    assert len(rows) == 2 and all(r.error for r in rows)


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">A one\nAC\nGT\n>B\nAC-\n>B\n\n")
    rows = files.read_fasta(spark, str(tmp_path / "a.fasta"))
    assert [(r.taxon, r.seq) for r in rows.orderBy("ord").collect()] == [("A", "ACGT"), ("B", "AC-"), ("B", "")]
    assert {r.problem for r in files.fasta_problems(rows).collect()} >= {"repeated", "empty"}
    sites = al.melt(rows.where("seq <> ''").select("aln_id", "taxon", "seq"))
    assert al.sequences(sites).count() == 2


def test_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("name\ttaxon\tvalue\n x \tA\t1\ny\tB\t\n")
    rows = files.read_taxon_table(spark, str(tmp_path / "t.tsv"))
    assert rows.columns == ["taxon", "name", "value"]
    assert {(r.taxon, r.trait) for r in ta.missing_cells(rows, ["name", "value"]).collect()} == {("B", "value")}
    files.write_taxon_table(rows.withColumn("flag", F.lit(True)), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).where("value like '%true'").collect())


def test_partitions(spark, tmp_path):
    (tmp_path / "p.txt").write_text("DNA, one = 1-9\\3, 20\ncharset two = 4-6;\n")
    rows = files.read_partitions(spark, str(tmp_path / "p.txt"))
    assert sorted((r.locus, r.start, r.stop, r.step) for r in rows.collect()) == [("one", 1, 9, 3), ("one", 20, 20, 1), ("two", 4, 6, 1)]
    assert [tuple(r) for r in files.partition_overlaps(rows).collect()] == [("one", "two", 1)]


def test_traces(spark, tmp_path):
    (tmp_path / "b.log").write_text("# beast\nstate\tposterior\tx\n0\t-1.5\t2\n10\t-1.0\t3\n")
    assert files.read_beast_log(spark, str(tmp_path / "b.log")).count() == 4
    (tmp_path / "m.p").write_text("[ID: 1]\nGen\tLnL\tTL{all}\n0\t-1\t2\n")
    assert {r.parameter for r in files.read_mrbayes_trace(spark, str(tmp_path / "m.p")).collect()} == {"LnL", "TL{all}"}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0)], "chain long, iteration int, value double").write.parquet(str(tmp_path / "in"))
    source = running.stream(spark, str(tmp_path / "in"), "chain long, iteration int, value double")
    query = running.running_summary(source).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [tuple(r)[:3] for r in spark.table("running").collect()] == [(1, 2, 3.0)]


def test_profiles_on_empty(spark):
    empty = spark.createDataFrame([], "aln_id long, taxon string, site int, residue string")
    for f in (al.base_frequency, al.site_classes, al.windows, al.identity, al.site_patterns, al.translate):
        assert f(empty).count() == 0
