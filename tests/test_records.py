"""FASTA records over many splits, repair by hand-worked rows, codons against plain Python."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cladewise.functions import lineage
from cladewise.operators import coding
from cladewise.operators.alignment import melt
from cladewise.sources import fasta


def _rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def _read(path):
    """Identifiers and sequences of one file, line by line."""
    found = []
    for line in path.read_text().splitlines():
        line = line.strip()
        if line.startswith(">"):
            found.append([line[1:].strip(), ""])
        elif line:
            found[-1][1] += line
    return [(i, *r) for i, r in enumerate(found, 1)]


def test_records_over_many_splits(spark, tmp_path):
    rng = random.Random(3)
    for name in ("a", "b"):
        text = ""
        for i in range(300):
            text += f"> id {rng.randrange(40)} \r\n" + "".join(f" {''.join(rng.choices('ACGT', k=rng.randrange(1, 60)))}\n\n" for _ in range(rng.randrange(4)))
        (tmp_path / f"{name}.fa").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = fasta.records(fasta.read_lines(spark, str(tmp_path)))
            for name in ("a", "b"):
                assert _rows(got.where(F.col("file").endswith(f"{name}.fa")), "record", "identifier", "sequence") == _read(tmp_path / f"{name}.fa")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_file_problems(spark, tmp_path):
    for name, text in {"good": ">a\nAC\n", "blank": "\n \n", "empty": "", "early": "\nAC\n>a\nAC\n", "bare": "AC\n"}.items():
        (tmp_path / f"{name}.fa").write_text(text)
    got = fasta.file_problems(spark, str(tmp_path)).select(F.regexp_extract("file", r"(\w+)\.fa", 1).alias("f"), "problem")
    early = "sequence before any header"
    assert _rows(got, "f", "problem") == [("bare", early), ("blank", "no records"), ("early", early), ("empty", "no records")]


def _frame(spark, rows):
    return spark.createDataFrame([("f", i, *r) for i, r in enumerate(rows, 1)], "file string, record long, identifier string, sequence string")


def test_repair_suffixes_in_file_order(spark):
    rows = _frame(spark, [("a b", "ACGT"), ("a_b", ""), ("a--b", "AC"), ("a  b", "JO"), ("a/b", "AC-?"), ("..", "acgn"), ("a b", "TT")])
    kept = fasta.repair(rows, "dna", remove=True)
    assert _rows(kept, "record", "repaired", "reason") == [(1, "a_b", None), (2, None, "empty-sequence"), (3, "a--b", None), (4, None, "illegal-characters"), (5, "a_b_2", None), (6, "sequence", None), (7, "a_b_3", None)]
    notes = dict(_rows(kept.where("note is not null"), "record", "note"))
    assert set(notes) == {1, 5, 6, 7} and notes[5].endswith("duplicate collision") and notes[1] == "normalized identifier"
    plain = fasta.repair(rows, "dna", normalize=False)
    assert _rows(plain, "record", "repaired") == [(i, n) for i, n in enumerate(["a b", "a_b", "a--b", "a  b", "a/b", "..", "a b"], 1)]
    other = fasta.repair(_frame(spark, [("x", "ACGU"), ("y", "ACGT")]), "dna", remove=True)
    assert _rows(other, "record", "reason") == [(1, "illegal-characters+sequence-type-mismatch"), (2, None)]
    with pytest.raises(ValueError):
        fasta.repair(rows, "codon")


@pytest.mark.parametrize("sequences,kind", [(["ACGT", "acg"], "dna"), (["ACGU", "AC"], "rna"), (["ACGU", "ACGT"], "mixed"), (["MKL*", "ACG"], "protein"), (["ACG", "JA"], "invalid"), (["AC.G"], "invalid"), (["", "-?"], "dna"), (["EFU"], "invalid")])
def test_file_kinds(spark, sequences, kind):
    rows = _frame(spark, [(str(i), s) for i, s in enumerate(sequences)])
    assert _rows(fasta.file_kinds(rows), "kind") == [(kind,)]
    if kind == "mixed":
        assert {r.reason for r in fasta.repair(rows).collect()} == {"conflicting-types"}


def test_illegal_positions_and_empty_tables(spark):
    rows = _frame(spark, [("a", "AC!GJ"), ("b", "ACGT")])
    assert _rows(fasta.illegal_characters(rows, "dna"), "record", "position", "character") == [(1, 3, "!"), (1, 5, "J")]
    none = rows.where("false")
    for made in (fasta.illegal_characters(none), fasta.repair(none), fasta.alignment_problems(none), fasta.file_kinds(none)):
        assert made.collect() == []


def _lines(spark, folder):
    (folder / "a.fa").write_text("".join(f">{'xy'[i % 2]}\n{'ACGT' * (1 + i % 3)}\n{'-' if i % 5 else 'J'}\n" for i in range(40)))
    return fasta.read_lines(spark, str(folder))


def test_records_leave_no_copy_of_the_lines(spark, tmp_path):
    folder = Path(lineage._folder(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    assert fasta.records(_lines(spark, tmp_path)).count() == 40
    assert (set(folder.iterdir()) if folder.exists() else set()) == before


def test_lines_are_read_once(spark, tmp_path):
    rows = fasta.records(_lines(spark, tmp_path))
    problems, illegal = fasta.alignment_problems(rows), fasta.illegal_characters(rows)
    for made in (problems, illegal):
        assert "Scan text" not in made._jdf.queryExecution().executedPlan().toString()
    assert _rows(problems.drop("file"), "problem", "detail") == [("duplicate identifier", "x"), ("duplicate identifier", "y"), ("unequal lengths", "5-13")]
    assert _rows(illegal, "record", "position", "character") == [(i + 1, 4 * (1 + i % 3) + 1, "J") for i in range(0, 40, 5)]


def test_names_are_numbered_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(fasta, "_RUN", 3)
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a b", "c"]), rng.choice(["ACGT", "", "AC"])) for _ in range(60)]
    seen, want = {}, []
    for i, (name, sequence) in enumerate(rows, 1):
        clean = name.replace(" ", "_")
        if sequence:
            seen[clean] = seen.get(clean, 0) + 1
        want.append((i, (clean + (f"_{seen[clean]}" if seen[clean] > 1 else "")) if sequence else None))
    got = fasta.repair(_frame(spark, rows), "dna", remove=True).orderBy("record").collect()
    assert [(r.record, r.repaired) for r in got] == want
    assert fasta.repair(_frame(spark, rows), "dna", remove=True)._jdf.queryExecution().executedPlan().toString().count("RDD") == 0


def _sites(spark, sequences):
    return melt(spark.createDataFrame([(1, k, v) for k, v in sequences.items()], "aln_id long, taxon string, seq string"))


def test_genetic_codes():
    assert coding.genetic_code() == coding.genetic_code(1) == coding.genetic_code("standard")
    stops = {n: sorted(k for k, v in coding.genetic_code(n).items() if v == "*") for n in coding.CODE_NAMES}
    assert stops[1] == ["TAA", "TAG", "TGA"] and stops[2] == ["AGA", "AGG", "TAA", "TAG"] and stops[6] == ["TGA"] and stops[10] == ["TAA", "TAG"]
    assert all(len(coding.genetic_code(n)) == 64 for n in coding.CODE_NAMES)
    with pytest.raises(ValueError):
        coding.genetic_code(99)


def test_behaviour_and_exclusions(spark):
    sites = _sites(spark, {"fine": "ATG-CC?CTAA", "frame": "ATGCC", "odd": "ATGCN-CTAA", "early": "ATGTAACCC", "gaps": "--?", "rna": "AUGUAAC--", "weird": "AT!CCC"})
    got = coding.exclusions(coding.behaviour(sites))
    want = {"fine": None, "frame": "frame-error", "odd": "invalid-codon", "early": "internal-stop-codon", "gaps": "empty-coding-sequence", "rna": "frame-error", "weird": "invalid-codon"}
    assert {r.taxon: r.reason for r in got.collect()} == want
    of = {r.taxon: r for r in coding.behaviour(sites).collect()}
    assert (of["fine"].terminal_stops, of["fine"].premature_stops) == (1, 0) and of["gaps"].note.startswith("sequence contains no comparable")
    # TAA is the last whole codon though a base follows
    assert (of["rna"].terminal_stops, of["rna"].premature_stops, of["rna"].remainder) == (1, 0, 1)
    assert {r.taxon: r.reason for r in coding.invalid_codons(coding.codons(sites)).collect()} == {"odd": "ambiguous-codon", "weird": "unsupported-residue:!"}


def test_back_translation_is_inverse(spark):
    rng = random.Random(5)
    table = coding.genetic_code()
    sense = [k for k, v in table.items() if v != "*"]
    genes = {f"t{i}": "".join(rng.choices(sense, k=rng.randrange(1, 30))) for i in range(12)}
    genes = {k: v + ("TAA" if i % 2 else "") for i, (k, v) in enumerate(genes.items())}
    triplets = coding.prepared(_sites(spark, genes))
    protein = {k: "".join("X" if table[v[i : i + 3]] == "*" else table[v[i : i + 3]] for i in range(0, len(v), 3)) for k, v in genes.items()}
    guide = {}
    for r in coding.guide(triplets).collect():
        guide.setdefault(r.taxon, {})[r.site] = r.residue
    assert {k: "".join(v[i] for i in sorted(v)) for k, v in guide.items()} == protein
    gapped = {k: "".join(c + "-" * rng.randrange(3) for c in "-" + v)[1:] for k, v in protein.items()}
    back = coding.back_translate(_sites(spark, gapped), triplets)
    found = {}
    for r in back.collect():
        found.setdefault(r.taxon, {})[r.site] = r.residue
    found = {k: "".join(v[i] for i in sorted(v)) for k, v in found.items()}
    assert {k: v.replace("-", "") for k, v in found.items()} == genes
    assert all(["---" == found[k][3 * i : 3 * i + 3] for i in range(len(g))] == [c == "-" for c in g] for k, g in gapped.items())
    # translating the codons under the guide gives the guide again
    seen = {}
    for r in coding.observations(_sites(spark, found)).collect():
        seen.setdefault(r.taxon, {})[r.codon] = "X" if r.amino_acid == "*" else r.amino_acid
    assert {k: "".join(v[i] for i in sorted(v)) for k, v in seen.items()} == gapped


def test_back_translation_problems(spark):
    triplets = coding.prepared(_sites(spark, {"a": "ATGCCC", "b": "ATGCCC", "c": "ATGCCC"}))
    aligned = _sites(spark, {"a": "M-P", "b": "MPP", "c": "M--", "d": "MP-"})
    assert _rows(coding.back_translation_problems(aligned, triplets), "taxon", "problem") == [("b", "more residues than codons"), ("c", "codons left over"), ("d", "no coding sequence")]
    assert {r.taxon for r in coding.back_translate(aligned, triplets).collect()} == {"a"}
    none = triplets.where("false")
    assert coding.back_translate(aligned.where("false"), none).collect() == []


def test_observation_states(spark):
    got = coding.observations(_sites(spark, {"a": "ATG---TAAA?GNTGTAA", "b": "ATGTAACCCCCCCCCC?-"}))
    of = {(r.taxon, r.codon): (r.amino_acid, r.status) for r in got.collect()}
    assert of["a", 2] == ("-", "missing-or-gap-codon") and of["a", 3] == ("*", "internal-stop-codon") and of["a", 4] == ("X", "ambiguous-or-invalid-codon")
    assert of["a", 6] == ("*", "terminal-stop-codon") and of["b", 1] == ("M", "translated") and of["b", 6] == ("X", "ambiguous-or-invalid-codon")
