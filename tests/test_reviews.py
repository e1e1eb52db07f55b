"""Reviews, moves and tree files on small inputs worked by hand or in plain Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from cladewise.functions.lineage import ranked
from cladewise.operators import alignment, moves, reviews, traces
from cladewise.sources import nexus


def sites(spark, rows):
    return alignment.melt(spark.createDataFrame(rows, "aln_id long, taxon string, seq string"))


def nodes(spark):
    """((A:1,B:1)X:2,(C:3,(D:1,E:1)Y:0.1)Z:1)root"""
    rows = [("root", None, 0.0, 0, False, 1, 9, 0.0), ("X", "root", 2.0, 1, False, 2, 4, 2.0), ("A", "X", 1.0, 2, True, 3, 3, 3.0), ("B", "X", 1.0, 2, True, 4, 4, 3.0), ("Z", "root", 1.0, 1, False, 5, 9, 1.0),
            ("C", "Z", 3.0, 2, True, 6, 6, 4.0), ("Y", "Z", 0.1, 2, False, 7, 9, 1.1), ("D", "Y", 1.0, 3, True, 8, 8, 2.1), ("E", "Y", 1.0, 3, True, 9, 9, 2.1)]
    return spark.createDataFrame([(1, *r) for r in rows], "tree_id long, name string, parent string, branch_length double, level int, is_tip boolean, pre int, post int, root_dist double")


def test_ranks_and_running_sums_over_ranges(spark):
    rng = random.Random(1)
    values = [(rng.randrange(50), i) for i in range(500)]
    got = ranked(spark.createDataFrame(values, "v long, id long").repartition(7), [F.desc("v"), F.col("id")], "rank", {"upto": "v"}).collect()
    order = sorted(values, key=lambda x: (-x[0], x[1]))
    assert {(r.v, r.id): r.rank for r in got} == {x: i + 1 for i, x in enumerate(order)}
    assert {r.rank: r.upto for r in got} == {i + 1: sum(v for v, _ in order[: i + 1]) for i in range(500)}


def test_effective_size_goes_on_past_its_first_lags(spark):
    slow = [float(i // 40) for i in range(400)]
    rows = [(1, i + 1, v) for i, v in enumerate(slow)] + [(2, 1, 1.0), (3, 1, 2.0), (3, 2, 2.0)]
    got = {r.chain: r for r in traces.effective_sample_size(spark.createDataFrame(rows, "chain long, iteration int, value double")).collect()}
    n, mean = len(slow), sum(slow) / len(slow)
    d = [v - mean for v in slow]
    tau, k = 1.0, 1
    while k < n and (rho := sum(a * b for a, b in zip(d[k:], d, strict=False)) / sum(x * x for x in d)) > 0:
        tau, k = tau + 2 * rho, k + 1
    assert k > 60 and abs(got[1].tau - tau) < 1e-3 and got[2].ess == 1 and got[3].tau == 1


def test_duplicates_are_whole_sequences(spark):
    s = sites(spark, [(1, "A", "ACGTACGT"), (1, "B", "ACGTACGA"), (1, "C", "ACGTACGT"), (1, "D", "ACG")])
    assert [r.taxa for r in alignment.duplicates(s).collect()] == ["A|C"]


def test_alignment_reviews(spark):
    s = sites(spark, [(1, "A", "ACGT-"), (1, "B", "ACG??"), (2, "A", "ACGU"), (3, "A", "MKV*"), (4, "A", "AC!T"), (4, "B", "ACT")])
    assert {r.aln_id: r.alphabet for r in reviews.alphabet(s).collect()} == {1: "dna", 2: "rna", 3: "protein", 4: "unknown"}
    assert {r.aln_id: r.kind for r in reviews.classify(s).collect()} == {1: "aligned", 2: "equal", 3: "equal", 4: "unaligned"}
    assert [(r.taxon, r.comparable, r.excess) for r in reviews.frameshifts(s.where("aln_id = 1")).collect()] == [("A", 4, 1)]
    loci = spark.createDataFrame([(1, k, t, i + 1, c) for k, t, q in ((1, "A", "AC"), (1, "B", "AG"), (2, "A", "TTT")) for i, c in enumerate(q)], "matrix long, locus long, taxon string, site int, residue string")
    whole = {r.taxon: r.seq for r in alignment.sequences(reviews.concatenate(loci).withColumnRenamed("matrix", "aln_id")).collect()}
    assert whole == {"A": "ACTTT", "B": "AG---"}
    assert [(r.locus, r.start, r.stop, r.taxa) for r in reviews.partition_summary(loci).orderBy("locus").collect()] == [(1, 1, 2, 2), (2, 3, 5, 1)]


def test_moves(spark):
    n = nodes(spark)
    m = moves.midpoints(n).first()
    assert (m.left, m.right, m.distance, m.branch, m.offset) == ("A", "C", 7.0, "Z", 0.5)
    assert {r.name: (r.new_parent, r.new_length) for r in moves.collapse(n, 0.5).collect()}["D"] == ("Z", 1.1)
    assert "Y" not in {r.name for r in moves.collapse(n, 0.5).collect()}
    order = [r.name for r in moves.ladderize(n).orderBy("new_pre").collect()]
    assert order == ["root", "X", "A", "B", "Z", "C", "Y", "D", "E"]
    state = lambda ones: spark.createDataFrame([(1, t, "1" if t in ones else "0") for t in "ABCDE"], "tree_id long, name string, state string")
    for ones, gains, dollo in (("DE", 1, (1, 0)), ("ADE", 2, (1, 2)), ("", 0, (0, 0)), ("ABCDE", 1, (1, 0)), ("CD", 2, (1, 1))):
        assert moves.camin_sokal(n, state(ones)).first().gains == gains
        d = moves.dollo(n, state(ones)).first()
        assert (d.gains, d.losses) == dollo
    assert {(r.left, r.right): r.distance for r in reviews.tip_distances(n).collect()}[("C", "D")] == 4.1


def test_tree_files(spark):
    from cladewise.sources import tokens

    text = "#NEXUS\nBegin trees;\n Translate 1 'Homo sapiens'x, 2 Pan,\n 3 Mus;\n tree a = [&R] ((1:1,2:2):0.5,3:1);\n tree b = [&U] (1,(2,3));\nEnd;\n"
    rows = {r.name: r for r in tokens.nexus_trees(spark.createDataFrame([("f", text.replace("'Homo sapiens'x", "Homo"))], "file string, text string")).collect()}
    assert rows["a"].newick == "((Homo:1,Pan:2):0.5,Mus:1);" and rows["a"].rooted and rows["b"].newick == "(Homo,(Pan,Mus));" and not rows["b"].rooted
    plain = spark.createDataFrame([("f", "#nexus begin trees; tree x = (A,B); end;"), ("g", ""), ("h", "(A,B);"), ("i", None)], "file string, text string")
    assert [(r.file, r.newick) for r in tokens.nexus_trees(plain).collect()] == [("f", "(A,B);")]
    assert {r.file: r.k for r in plain.select("file", nexus.tree_format(F.col("text")).alias("k")).collect()} == {"f": "nexus", "g": "unknown", "h": "newick", "i": "unknown"}


def sites_of(spark, rows):
    """(aln_id, taxon, sequence) as cells."""
    cells = [(a, t, i + 1, r) for a, t, seq in rows for i, r in enumerate(seq)]
    return spark.createDataFrame(cells, "aln_id long, taxon string, site int, residue string")


def test_length_outliers_by_hand(spark):
    rows = [(1, "a", "ACGTACGTAC"), (1, "b", "ACGTACGTAC"), (1, "c", "ACGTACGT--"), (1, "d", "ACGTACGTA-"), (2, "a", "AC"), (2, "b", "A-")]
    got = {(r.aln_id, r.taxon): (r.raw_length, r.median_length, r.outlier, r.note) for r in reviews.length_outliers(sites_of(spark, rows)).collect()}
    # lengths 10, 10, 8, 9: median 9.5, deviations 0.5 0.5 1.5 0.5, median 0.5; z of c is 0.67449 * -1.5 / 0.5 = -2.02; 1.5 is less than 1.9
    assert got[(1, "c")] == (8, 9.5, False, None) and not any(x[2] for x in got.values())
    far = reviews.length_outliers(sites_of(spark, [*rows, (1, "e", "ACG-------")])).where("outlier").collect()
    assert [(r.aln_id, r.taxon, r.note) for r in far] == [(1, "e", "shorter than baseline")]  # 3 of a median of 9


def test_missing_concentration_by_hand(spark):
    rows = [(1, "a", "A??A??A?"), (1, "b", "A?AA??AA"), (2, "a", "ACGT"), (2, "b", "ACGT")]
    got = {r.aln_id: r for r in reviews.missing_concentration(sites_of(spark, rows), 0.5).collect()}
    # shares: 0 1 .5 0 1 1 0 .5: columns 2 3 5 6 8; runs 2-3, 5-6, 8
    r = got[1]
    assert (r.concentrated, r.concentrated_fraction, r.longest_run, r.run_start, r.run_end, r.most, r.worst_columns, r.first_worst) == (5, 0.625, 2, 2, 3, 1.0, 3, 2)
    r = got[2]
    assert (r.concentrated, r.longest_run, r.run_start, r.most) == (0, 0, None, 0.0)


def test_sequence_types_by_hand(spark):
    rows = [(1, "a", "ACGT"), (1, "b", "AC-N"), (2, "a", "ACGU"), (2, "b", "ACG?"), (3, "a", "ACGT"), (3, "b", "ACGU"), (4, "a", "MLEF"), (4, "b", "ACGT"), (5, "a", "AC@T"), (5, "b", "ACGT"), (6, "a", "ACGN"), (7, "a", "MLEF"), (7, "b", "ACGU")]
    got = {r.aln_id: (r.kind, r.confidence) for r in reviews.sequence_types(sites_of(spark, rows)).collect()}
    assert got == {1: ("dna", "medium"), 2: ("rna", "high"), 3: ("mixed", "blocked"), 4: ("protein", "high"), 5: ("invalid", "blocked"), 6: ("dna", "low"), 7: ("mixed", "blocked")}


def test_quality_score_by_hand(spark):
    from cladewise.operators import alignment as al

    s = sites_of(spark, [(1, "a", "AAAA-"), (1, "b", "AAAA-"), (1, "c", "CACA?"), (1, "d", "CATAG")])
    r = reviews.quality_score(al.summary(s), al.composition_outliers(s).withColumn("outlier", F.lit(False)), al.duplicates(s)).first()
    # 20 cells: 1 missing, 2 gaps; one pair of equal sequences of 4; column 1 is informative: 1 / 5 / 0.2 = 1
    assert (r.missingness, r.gap_burden, r.composition, r.duplicates, r.density) == (0.95, 0.9, 1.0, 0.75, 1.0) and r.score == 92.0


def test_low_information_by_hand(spark):
    summary = spark.createDataFrame([(1, 10, 0, 0), (2, 10, 1, 0), (3, 10, 5, 5)], "aln_id long, sites long, variable long, informative long")
    assert {r.aln_id: r.low_information for r in reviews.low_information(summary).collect()} == {1: True, 2: False, 3: False}
    assert {r.aln_id: r.reasons for r in reviews.low_information(summary, 1, 0.1).collect()} == {1: 2, 2: 0, 3: 0}


def test_support_classes_by_hand(spark):
    clades = [(t, "A|B") for t in range(10)] + [(t, "C|D") for t in range(5)] + [(t, "B|C") for t in (5,)] + [(9, "E|F"), (8, "E|F")]
    of = reviews.support_classes(spark.createDataFrame(clades, "tree_id long, clade string"), spark.range(10).toDF("tree_id"))
    # A|B meets B|C, so it is no longer robust; E|F meets nothing
    assert {r.clade: (r.conflicts, r.support) for r in of.collect()} == {"A|B": (1, "credibility-conflicted"), "C|D": (1, "intermediate-support"), "B|C": (2, "credibility-conflicted"), "E|F": (0, "weak-support")}
    alone = reviews.support_classes(spark.createDataFrame(clades[:10], "tree_id long, clade string"), spark.range(10).toDF("tree_id")).first()
    assert alone.support == "robust"


def test_compare_diversity_by_hand(spark):
    s = "tree_id long, clade string"
    left = spark.createDataFrame([(1, "A|B"), (2, "A|B"), (3, "B|C"), (4, "A|B")], s)
    right = spark.createDataFrame([(1, "A|B"), (2, "A|B")], s)
    got = {r.side: r for r in reviews.compare_diversity(left, left, right, right).collect()}
    # 6 pairs on the left, 3 of them at a distance of 2; entropy of 3/4 and 1/4
    assert (got["left"].trees, got["left"].topologies, got["left"].dominant, got["left"].effective, got["left"].mean_distance) == (4, 2, 0.75, 1.754765, 1.0)
    assert (got["right"].effective, got["right"].mean_distance) == (1.0, 0.0)


def test_outlier_clades_by_hand(spark):
    n = nodes(spark)
    rows = {r.name: r for r in reviews.diversification_outliers(n).collect()}
    rates = [r.rate for r in rows.values()]
    mean = sum(rates) / len(rates)
    sd = (sum((x - mean) ** 2 for x in rates) / len(rates)) ** 0.5
    for r in rows.values():
        z = (r.rate - mean) / sd
        assert abs(r.z - z) < 1e-4 and r.kind == ("high" if z >= 1 else "low" if z <= -1 else "baseline")


def test_ranks_and_namespaces_by_hand(spark):
    from cladewise.operators import tables as ta

    want = {
        "NC_012345.1": ("accession", "accession_id"), "Homo sapiens": ("species", "species_name"), "Homo_sapiens_idaltu": ("species", "species_name"), "Homo": ("genus", "user_defined_label"), "strain 7": ("sample", "isolate_id"),
        "voucher x": ("sample", "sample_id"), "tip-12": ("sample", "sample_id"), "north pop": ("population", "user_defined_label"), "x9": ("unknown", "user_defined_label"), "Clade-a": ("genus", "user_defined_label"),
    }
    rows = spark.createDataFrame([(x,) for x in want], "label string").select("label", reviews.rank_of(F.col("label")).alias("r"), ta.namespace("label").alias("n")).collect()
    assert {r.label: (r.r, r.n) for r in rows} == want


def test_sampling_and_switches_by_hand(spark):
    tips = spark.createDataFrame([(1, t) for t in "abcdef"] + [(2, "a")], "grp long, taxon string")
    given = spark.createDataFrame([(1, "a", "0.5"), (1, "b", " 0.25"), (1, "c", ""), (1, "d", "x"), (1, "e", "1.5"), (2, "a", "1")], "grp long, taxon string, fraction string")
    got = {r.grp: (r.matched, r.missing_taxa, r.missing, r.invalid, r.out_of_range, r.fraction, r.heterogeneous, r.complete) for r in reviews.sampling_fractions(tips, given).collect()}
    assert got == {1: (5, 1, 1, 1, 1, 0.375, True, False), 2: (1, 0, 0, 0, 0, 1.0, False, True)}
    edges = spark.createDataFrame([("x", "y", ["x"], ["y"], 0.9), ("x", "y", ["x"], ["x", "y"], 0.5), ("x", "y", ["x", "z"], ["y"], 0.5), ("x", "x", ["x"], ["x"], 1.0)], "parent_state string, child_state string, parent_set array<string>, child_set array<string>, support double")
    allowed = spark.createDataFrame([("x", "y")], "parent_state string, child_state string")
    assert {(r.certainty, r.switches, r.allowed) for r in reviews.switches(edges, allowed).collect()} == {("certain_switch", 1, True), ("uncertain_switch", 2, True)}
    p = spark.createDataFrame([(0.9,), (0.6,), (0.59,)], "p double").select(reviews.sure_of(F.col("p")).alias("s")).collect()
    assert [r.s for r in p] == ["strong", "moderate", "weak"]
