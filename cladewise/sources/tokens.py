"""Newick, NEXUS and PhyloXML as tokens: brackets are matched by a running depth, so trees become node rows without a parser.

A tree text is cut into tokens by one pattern. Every opening bracket and comma begins a node, so running counts give
preorder numbers, and the running depth is the level. A label, length or comment belongs to the node that began last at its
depth; a closing bracket ends the node that it leads back to. Windows hold the tokens of one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A quoted label ('' is a quote in it), a comment, a sign, or a plain label.
TOKEN = r"'(?:[^']|'')*'|\[[^\]]*\]|[(),:;]|[^\s()\[\],:;']+|'[^']*$|\[[^\]]*$"
#: NEXUS statements: text up to a semicolon that is in no quotes or comment.
STATEMENT = r"((?:'(?:[^']|'')*'|\[[^\]]*\]|[^;'\[])+);"


def read_records(spark: SparkSession, path: str, end: str = ";") -> DataFrame:
    """(file, start, record): the texts of files between semicolons, in files of any size (splits are read apart).

    ``start`` grows along a file. Labels and comments must not hold the separator.
    """
    rows = spark.read.option("lineSep", end).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("_row"), "value")
    return rows.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").select("file", F.struct("_block", "_row").alias("start"), F.concat("value", F.lit(end)).alias("record"))


def tokens(trees: DataFrame, text: str = "newick") -> DataFrame:
    """(tree_id, pos, token, depth, node): tokens with the depth after them and the number of nodes begun so far."""
    cut = trees.select("tree_id", F.posexplode_outer(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    here = Window.partitionBy("tree_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0)
    begins = F.col("token").isin("(", ",").cast("int")
    return cut.select("*", F.sum(step).over(here).cast("int").alias("depth"), (F.sum(begins).over(here) + 1).cast("long").alias("node"), F.lag("token").over(Window.partitionBy("tree_id").orderBy("pos")).alias("before"))


def problems(marked: DataFrame) -> DataFrame:
    """(tree_id, error) of the texts that are no tree; ``marked`` comes from :func:`tokens`."""
    token, before = F.col("token"), F.col("before")
    word = ~token.rlike(r"^[(),:;]$|^\[")
    after = F.lead("token").over(Window.partitionBy("tree_id").orderBy("pos"))
    of = marked.withColumns({"_word": word, "_after": after}).groupBy("tree_id").agg(
        F.max("token").isNull().alias("empty"),
        (F.max_by("depth", "pos") != 0).alias("open"),
        F.bool_or(F.col("depth") < 0).alias("closed"),
        (F.max_by("token", "pos") != ";").alias("unfinished"),
        (F.count_if(token == ";") > 1).alias("more"),
        F.bool_or((token == ",") & (F.col("depth") == 0)).alias("comma"),
        F.bool_or((before == ":") & (~F.col("_word") | token.try_cast("double").isNull()) & ~token.startswith("[")).alias("length"),
        F.bool_or(token.rlike(r"^'(?:[^']|'')*$") & ~token.rlike(r"^'(?:[^']|'')*'$") | token.rlike(r"^\[[^\]]*$")).alias("quote"),
        F.bool_or(F.col("_word") & ~before.isin(":", "(", ",", ")") & ~before.startswith("[") & before.isNotNull()).alias("labels"),
        F.bool_or((token == "(") & ~F.coalesce(before, F.lit("(")).isin("(", ",") & ~before.startswith("[")).alias("bracket"),
        F.bool_and(token.isin(";") | token.startswith("[")).alias("nothing"),
    )
    names = {
        "empty": "no tree", "nothing": "no tree", "quote": "a quoted label or comment does not end", "closed": "a bracket too many", "open": "brackets do not close", "comma": "a comma outside brackets", "more": "text after the tree",
        "unfinished": "no semicolon at the end", "length": "not a length", "labels": "two labels on one node", "bracket": "an opening bracket after a label",
    }
    error = F.coalesce(*(F.when(F.col(k), F.lit(v)) for k, v in names.items()))
    return of.select("tree_id", error.alias("error")).where("error is not null")


def _label(token: Column) -> Column:
    """A plain label as it stands; a quoted one without its quotes."""
    return F.when(token.startswith("'"), F.regexp_replace(F.regexp_extract(token, r"(?s)^'(.*)'$", 1), "''", "'")).otherwise(token)


def node_rows(trees: DataFrame, text: str = "newick") -> DataFrame:
    """(tree_id, node, parent, name, branch_length, is_tip, level, pre, post, comments) of the texts that are trees.

    ``node`` is the preorder number. Comments are the texts in square brackets behind a node, in order; :func:`problems`
    names the texts that are left out.
    """
    marked = tokens(trees, text)
    good = marked.join(problems(marked).select("tree_id"), "tree_id", "left_anti")
    along = Window.partitionBy("tree_id", "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = good.withColumns({
        # the root has no token of its own: it is there from the first one on
        "owner": F.coalesce(F.last(F.when(F.col("token").isin("(", ","), F.col("node")), ignorenulls=True).over(along), F.when(F.col("depth") == 0, F.lit(1).cast("long"))),
        "parent": F.last(F.when(F.col("token") == "(", F.col("node") - 1), ignorenulls=True).over(along),
    })
    word = ~F.col("token").rlike(r"^[(),:;]$|^\[")
    length = F.when(word & (F.col("before") == ":"), F.col("token").try_cast("double"))
    # a comment may stand between a colon and its length
    late = F.when(F.col("token").rlike(r"^[-+]?[0-9.]+([eE][-+]?[0-9]+)?$") & F.col("before").startswith("[") & F.col("_colon"), F.col("token").try_cast("double"))
    colon = F.coalesce(F.last(F.when(F.col("token").isin("(", ",", ")", ":"), F.col("token")), ignorenulls=True).over(Window.partitionBy("tree_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit("")) == ":"
    rows = rows.withColumn("_colon", colon)
    of = rows.groupBy("tree_id", F.col("owner").alias("node")).agg(
        F.max("parent").alias("parent"), F.max(F.when(word & ~F.col("_colon"), _label(F.col("token")))).alias("name"), F.max(F.coalesce(length, late)).alias("branch_length"), F.count_if(F.col("token") == ")").alias("_closed"),
        F.max("depth").alias("level"), F.max(F.when(F.col("token") == ")", F.col("node"))).alias("_end"), F.sort_array(F.collect_list(F.when(F.col("token").startswith("["), F.struct("pos", F.expr("substring(token, 2, length(token) - 2)").alias("text"))))).alias("_c"),
    )
    return of.select("tree_id", "node", F.when(F.col("node") > 1, F.col("parent")).alias("parent"), F.coalesce("name", F.lit("")).alias("name"), "branch_length", (F.col("_closed") == 0).alias("is_tip"), "level", F.col("node").alias("pre"), F.coalesce("_end", "node").alias("post"), F.col("_c.text").alias("comments"))


def annotations(comments: Column) -> Column:
    """The values of ``&k=v,k=v`` comments as a map; values in braces keep their commas, of equal keys the last counts."""
    plain = F.filter(comments, lambda c: c.startswith("&"))
    pairs = F.flatten(F.transform(plain, lambda c: F.split(F.regexp_replace(c, r"^&+", ""), r",(?![^{]*\})")))
    entries = F.transform(F.filter(pairs, lambda p: p.contains("=")), lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("value")))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))


# NEXUS


def _statements(files: DataFrame) -> DataFrame:
    """(file, i, statement) inside TREES blocks."""
    block = F.regexp_extract("text", r"(?is)begin\s+trees\s*;(.*?)\bend(?:block)?\s*;", 1)
    return files.select("file", F.posexplode(F.regexp_extract_all(F.coalesce(block, F.lit("")), F.lit(STATEMENT), F.lit(1))).alias("i", "statement"))


def translations(files: DataFrame) -> DataFrame:
    """(file, token, label) of TRANSLATE statements, quotes taken away; of a token that is given twice the first counts."""
    table = _statements(files).where(F.col("statement").rlike(r"(?is)^\s*translate\s"))
    words = table.select("file", F.posexplode(F.regexp_extract_all(F.regexp_replace("statement", r"(?is)^\s*translate\s+|\[[^\]]*\]", ""), F.lit(r"('(?:[^']|'')*'|[^\s,']+)\s+('(?:[^']|'')*'|[^\s,']+)\s*(?:,|$)"), F.lit(0))).alias("at", "pair"))
    one = lambda i: _label(F.regexp_extract("pair", r"(?s)^('(?:[^']|'')*'|[^\s,']+)\s+('(?:[^']|'')*'|[^\s,']+)", i))
    return words.groupBy("file", one(1).alias("token")).agg(F.min_by(one(2), F.col("at")).alias("label"))


def tree_statements(files: DataFrame) -> DataFrame:
    """(file, i, name, rooted, newick) of TREE statements; ``rooted`` is null without a mark [&R] or [&U]."""
    found = _statements(files).where(F.col("statement").rlike(r"(?is)^\s*u?tree\s"))
    part = lambda i: F.regexp_extract("statement", r"(?is)^\s*u?tree\s+\*?\s*('(?:[^']|'')*'|[^=\s]+)\s*(?:\[[^\]]*\]\s*)*=\s*((?:\[[^\]]*\]\s*)*)(.*)$", i)
    mark = F.upper(F.regexp_extract(part(2), r"(?i)\[&([ru])\s*\]", 1))
    return found.select("file", "i", _label(part(1)).alias("name"), F.when(mark == "R", True).when(mark == "U", False).alias("rooted"), F.concat(part(3), F.lit(";")).alias("newick"), part(2).alias("marks"))


def nexus_nodes(files: DataFrame) -> DataFrame:
    """Node rows of all trees of NEXUS texts (file, tree, rooted, then as :func:`node_rows`), labels in place of tokens.

    Tips whose label is no token keep it. Comments stay with their nodes, quotes are taken away.
    """
    trees = tree_statements(files)
    keyed = trees.select(F.struct("file", "i").alias("tree_id"), "newick")
    rows = node_rows(keyed).join(trees.select(F.struct("file", "i").alias("tree_id"), F.col("name").alias("tree"), "rooted"), "tree_id")
    rows = rows.select(F.col("tree_id.file").alias("file"), "tree", "rooted", *(c for c in rows.columns if c not in ("tree_id", "tree", "rooted")))
    labels = translations(files).withColumnRenamed("token", "name")
    named = rows.join(labels, ["file", "name"], "left")
    return named.withColumn("name", F.when(F.col("is_tip"), F.coalesce("label", "name")).otherwise(F.col("name"))).select(rows.columns)


def posterior_samples(files: DataFrame, burnin: float = 0.0) -> DataFrame:
    """(file, i, name, state, rooted, newick, marks) of the trees kept after the first ``burnin`` share of each file's trees.

    ``state`` is the number in names like STATE_1000 or gen.1000, null without one.
    """
    trees = tree_statements(files)
    rank = F.row_number().over(Window.partitionBy("file").orderBy("i"))
    n = F.count("*").over(Window.partitionBy("file"))
    kept = trees.withColumns({"_k": rank, "_n": n}).where(F.col("_k") > F.floor(F.col("_n") * F.lit(burnin)))
    return kept.select("file", "i", "name", F.regexp_extract("name", r"(\d+)$", 1).try_cast("long").alias("state"), F.coalesce("rooted", F.lit(True)).alias("rooted"), "newick", "marks")


# PhyloXML

_TAG = r"(?s)<clade\b[^>]*/?>|</clade\s*>|<name\b[^>]*>.*?</name\s*>|<branch_length\b[^>]*>.*?</branch_length\s*>|<confidence\b[^>]*>.*?</confidence\s*>"


def _plain(text: Column) -> Column:
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return F.trim(text)


def phyloxml_nodes(files: DataFrame) -> DataFrame:
    """(file, phylogeny, node, parent, name, branch_length, confidence, is_tip, level, pre, post) of PhyloXML texts.

    Name, length and confidence are those of the clade itself, not of its sequences or taxonomy; a length may also be an
    attribute. The first value counts where one is given twice.
    """
    clean = F.regexp_replace("text", r"(?s)<!--.*?-->|<(?:\w+:)?(taxonomy|sequence|events|date|distribution|reference|property|binary_characters|node_id|clade_relation|sequence_relation)\b(?:[^>]*/>|.*?</(?:\w+:)?\1\s*>)", "")
    clean = F.regexp_replace(clean, r"<(/?)\w+:", "<$1")
    each = files.select("file", F.posexplode(F.regexp_extract_all(clean, F.lit(r"(?s)<phylogeny\b[^>]*>(.*?)</phylogeny\s*>"), F.lit(1))).alias("phylogeny", "body"))
    cut = each.select("file", "phylogeny", F.posexplode(F.regexp_extract_all("body", F.lit(_TAG), F.lit(0))).alias("pos", "token"))
    empty = F.col("token").rlike(r"^<clade\b[^>]*/>$")
    opens, closes = F.col("token").startswith("<clade"), F.col("token").startswith("</clade")
    whole = Window.partitionBy("file", "phylogeny").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(opens & ~empty, 1).when(closes, -1).otherwise(0)
    rows = cut.withColumns({"_d": F.sum(step).over(whole).cast("int"), "node": F.sum(opens.cast("int")).over(whole).cast("long")})
    # the depth of an element is that of the clade that holds it; a closing tag and an empty clade belong to a clade one deeper
    rows = rows.withColumn("depth", F.col("_d") + F.when(closes | empty, 1).otherwise(0))
    along = Window.partitionBy("file", "phylogeny", "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("owner", F.last(F.when(opens, F.col("node")), ignorenulls=True).over(along)).where("owner is not null")
    value = lambda tag: F.when(F.col("token").startswith(f"<{tag}"), _plain(F.regexp_extract("token", r"(?s)^<[^>]*>(.*)</", 1)))
    attribute = F.when(opens, F.nullif(F.regexp_extract("token", r"""branch_length\s*=\s*["']([^"']*)["']""", 1), F.lit("")))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("pos")))
    of = rows.groupBy("file", "phylogeny", F.col("owner").alias("node")).agg(
        first(value("name")).alias("name"), F.coalesce(first(value("branch_length")), first(attribute)).try_cast("double").alias("branch_length"), first(value("confidence")).try_cast("double").alias("confidence"),
        (F.min("depth") - 1).alias("level"), F.max(F.when(closes, F.col("node"))).alias("_end"),
    )
    of = of.withColumns({"pre": F.col("node"), "post": F.coalesce("_end", "node")})
    # the first child of a node follows it in preorder; the others have the parent of the sibling before
    tree = ["file", "phylogeny"]
    first_child = F.lag("level").over(Window.partitionBy(*tree).orderBy("pre")) == F.col("level") - 1
    along = Window.partitionBy(*tree, "level").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    of = of.withColumn("_first", first_child).withColumn("parent", F.last(F.when(F.col("_first"), F.col("pre") - 1), ignorenulls=True).over(along))
    return of.select(*tree, "node", "parent", F.coalesce("name", F.lit("")).alias("name"), "branch_length", "confidence", (F.col("pre") == F.col("post")).alias("is_tip"), "level", "pre", "post")


def relabelled(trees: DataFrame, labels: DataFrame) -> DataFrame:
    """(tree_id, newick) with the labels of (tree_id, name, label) in place of the tips' names, quoted where they must be; comments stay."""
    marked = tokens(trees)
    tip = ~F.col("token").rlike(r"^[(),:;]$|^\[") & F.coalesce(F.col("before"), F.lit("(")).isin("(", ",")
    named = marked.withColumn("name", F.when(tip, _label(F.col("token")))).join(labels, ["tree_id", "name"], "left")
    quoted = F.when(F.col("label").rlike(r"^[^\s()\[\]{}/\\,;:=*'\"`+<>-]+$"), F.col("label")).otherwise(F.concat(F.lit("'"), F.replace("label", F.lit("'"), F.lit("''")), F.lit("'")))
    made = named.groupBy("tree_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce(quoted, "token").alias("t")))).alias("_t"))
    return made.select("tree_id", F.array_join(F.col("_t.t"), "").alias("newick"))


def nexus_trees(files: DataFrame) -> DataFrame:
    """(file, name, rooted, newick) of TREE statements, with labels in place of tokens."""
    trees = tree_statements(files).withColumn("tree_id", F.struct("file", "i"))
    labels = trees.select("tree_id", "file").join(translations(files), "file").select("tree_id", F.col("token").alias("name"), "label")
    return trees.drop("newick").join(relabelled(trees, labels), "tree_id").select("file", "name", "rooted", "newick")
