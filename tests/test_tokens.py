"""Trees read as tokens: against the Newick reader, and hand-worked NEXUS, BEAST and PhyloXML texts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from cladewise.sources import newick, tokens

TREES = "tree_id string, newick string"


def text_of(n, rng):
    parts = [rng.choice(["A", "b_1", "'it''s, (x)'", "''"]) + rng.choice(["", ":1.5", ":1e-3", " : 2"]) for _ in range(n)]
    while len(parts) > 1:
        k = min(len(parts), rng.randint(1, 4))
        at = rng.randrange(len(parts) - k + 1)
        parts[at : at + k] = ["(" + " ,".join(parts[at : at + k]) + ")" + rng.choice(["", "0.9", "'in side'"]) + rng.choice(["", ":3"])]
    return parts[0] + ";"


def test_same_rows_as_the_reader(spark):
    rng = random.Random(1)
    texts = [(str(i), text_of(rng.randint(1, 40), rng)) for i in range(60)] + [("deep", "(" * 400 + "A:1" + ",B:2):1" * 400 + ";")]
    got = tokens.node_rows(spark.createDataFrame(texts, TREES)).collect()
    want = {(i, r["pre"]): (r["parent_id"], r["name"], r["branch_length"], r["is_tip"], r["level"], r["post"]) for i, x in texts for r in newick.node_rows(newick.parse(x))}
    assert {(r.tree_id, r.pre): (r.parent, r.name, r.branch_length, r.is_tip, r.level, r.post) for r in got} == want and len(got) == len(want)


def test_problems(spark):
    bad = {
        "": "no tree", ";": "no tree", "(A,B)": "no semicolon at the end", "((A,B);": "brackets do not close", "(A,B));": "a bracket too many", "A,B;": "a comma outside brackets", "(A,B);C;": "text after the tree", "(A:x,B);": "not a length",
        "(A B,C);": "two labels on one node", "(A(B,C));": "an opening bracket after a label", "(A,'B);": "a quoted label or comment does not end", "(A,[B);": "a quoted label or comment does not end", "(A:,B);": "not a length",
    }
    good = ["(A,B);", "A;", "(A[x]:[&r=1]2,B)c[&k={1,2}]:[y]3;", "[&R] (A,B);", "((A,B),);"]
    trees = spark.createDataFrame([(x, x) for x in [*bad, *good]] + [("null", None)], TREES)
    assert {r.tree_id: r.error for r in tokens.problems(tokens.tokens(trees)).collect()} == bad | {"null": "no tree"}
    assert {r.tree_id for r in tokens.node_rows(trees).collect()} == set(good)
    assert tokens.node_rows(trees.where("false")).count() == 0


def test_comments_and_lengths(spark):
    trees = spark.createDataFrame([("x", "(A[&rate=0.1,hpd={1,2}]:[&z=7]2,'B c'[note]:3)r[&rate=0.2,rate=0.3]:1;")], TREES)
    rows = {r.name: r for r in tokens.node_rows(trees).withColumn("of", tokens.annotations(F.col("comments"))).collect()}
    assert rows["A"].branch_length == 2 and rows["A"].of == {"rate": "0.1", "hpd": "{1,2}", "z": "7"}
    assert rows["B c"].branch_length == 3 and rows["B c"].comments == ["note"] and rows["B c"].of == {}
    assert rows["r"].branch_length == 1 and rows["r"].of == {"rate": "0.3"} and rows["r"].parent is None


NEXUS = """#NEXUS
Begin taxa; dimensions ntax=3; end;
Begin trees;
  Translate 1 'Homo sapiens', 2 Pan_t, 3 'it''s; odd', 1 Again;
  tree STATE_0 [&lnP=-1] = [&R] ((1[&rate=0.1]:1,2:2)[&posterior=1]:0.5,3:1);
  utree gen.100 = [&U] (1,(2,3));
  tree 'third one' = [&UTREE=x] (3,2,9);
End;
"""


def test_nexus(spark):
    files = spark.createDataFrame([("f", NEXUS), ("g", "#nexus begin trees; tree x = (A,B); end;"), ("h", ""), ("i", None)], "file string, text string")
    assert {r.token: r.label for r in tokens.translations(files).collect()} == {"1": "Homo sapiens", "2": "Pan_t", "3": "it's; odd"}
    rows = tokens.nexus_nodes(files).orderBy("file", "tree", "pre").collect()
    tips = {}
    for r in rows:
        if r.is_tip:
            tips.setdefault((r.file, r.tree, r.rooted), []).append((r.name, r.branch_length))
    assert tips == {
        ("f", "STATE_0", True): [("Homo sapiens", 1.0), ("Pan_t", 2.0), ("it's; odd", 1.0)], ("f", "gen.100", False): [("Homo sapiens", None), ("Pan_t", None), ("it's; odd", None)],
        ("f", "third one", None): [("it's; odd", None), ("Pan_t", None), ("9", None)], ("g", "x", None): [("A", None), ("B", None)],
    }
    assert next(r for r in rows if r.name == "Homo sapiens" and r.tree == "STATE_0").comments == ["&rate=0.1"]
    kept = tokens.posterior_samples(files, 0.4).orderBy("file", "i").collect()
    assert [(r.file, r.name, r.state, r.rooted) for r in kept] == [("f", "gen.100", 100, False), ("f", "third one", None, True), ("g", "x", None, True)]


PHYLOXML = """<?xml version="1.0"?><phy:phyloxml xmlns:phy="x"><phylogeny rooted="true"><name>tree &amp; co</name><clade><name>root</name>
<clade><name>A</name><!-- <branch_length>9</branch_length> --></clade><clade branch_length="0.5"><confidence type="bootstrap">88</confidence>
<clade><branch_length> 2 </branch_length><taxonomy><scientific_name>x</scientific_name></taxonomy><name>B &lt;1&gt;</name><sequence><name>gene</name></sequence></clade>
<clade><name>C</name><branch_length>3</branch_length></clade></clade><clade branch_length="4"/></clade></phylogeny><phylogeny><clade><name>only</name></clade></phylogeny></phy:phyloxml>"""


def test_phyloxml(spark):
    files = spark.createDataFrame([("f", PHYLOXML), ("g", ""), ("h", None), ("i", "<phyloxml/>")], "file string, text string")
    rows = tokens.phyloxml_nodes(files).orderBy("phylogeny", "pre").collect()
    got = [(r.phylogeny, r.pre, r.post, r.parent, r.name, r.branch_length, r.confidence, r.is_tip, r.level) for r in rows]
    assert got == [
        (0, 1, 6, None, "root", None, None, False, 0), (0, 2, 2, 1, "A", None, None, True, 1), (0, 3, 5, 1, "", 0.5, 88.0, False, 1), (0, 4, 4, 3, "B <1>", 2.0, None, True, 2),
        (0, 5, 5, 3, "C", 3.0, None, True, 2), (0, 6, 6, 1, "", 4.0, None, True, 1), (1, 1, 1, None, "only", None, None, True, 0),
    ]


def test_records_of_files(spark, tmp_path):
    path = tmp_path / "set.nwk"
    path.write_text("(A,B);\n((A,\nB),C);\n\n" + "".join(f"(t{i},u);\n" for i in range(500)))
    rows = tokens.read_records(spark, str(path)).orderBy("start").collect()
    assert len(rows) == 502 and rows[1].record == "\n((A,\nB),C);"
    assert [r.record.strip() for r in rows[2:]] == [f"(t{i},u);" for i in range(500)]
