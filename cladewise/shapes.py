"""Registered queries on trees of any shape: plain edges, tree texts, levels, structure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise import frames as fr
from cladewise import queries as q
from cladewise.operators import deep, rogue
from cladewise.operators import trees as tree
from cladewise.operators import treesets as se
from cladewise.sources import tokens

_add = q._add
_N = q._N

#: One tree per user: an event hangs below one of the three before it.
DEEP = """
SELECT user_id AS tree_id, CAST(i AS BIGINT) AS node, CAST(CASE WHEN i > 1 THEN GREATEST(i - 1 - event_id % 3, 1) END AS BIGINT) AS parent, CASE WHEN i > 1 THEN CAST(1 + event_id % 5 AS DOUBLE) END AS branch_length
FROM (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) e"""

_WALK = f"""WITH RECURSIVE e AS ({DEEP}),
r AS (SELECT tree_id, node, parent, branch_length, 0 AS level, CAST(0 AS DOUBLE) AS root_dist, [node] AS path FROM e WHERE parent IS NULL
  UNION ALL SELECT e.tree_id, e.node, e.parent, e.branch_length, r.level + 1, r.root_dist + e.branch_length, list_append(r.path, e.node) FROM r JOIN e ON e.tree_id = r.tree_id AND e.parent = r.node),
d AS (SELECT tree_id, a AS node, COUNT(*) AS size FROM (SELECT tree_id, UNNEST(path) AS a FROM r) u GROUP BY 1, 2),
deep AS (SELECT r.tree_id, r.node, r.parent, r.branch_length, size = 1 AS is_tip, CAST(level AS INT) AS level, root_dist, size, ROW_NUMBER() OVER (PARTITION BY r.tree_id ORDER BY path) AS pre FROM r JOIN d ON d.tree_id = r.tree_id AND d.node = r.node)"""

_add("tree_deep_nodes", DEEP, deep.node_rows, f"{_WALK} SELECT *, pre + size - 1 AS post FROM deep")
_add("tree_deep_inspect", DEEP, lambda e: tree.inspect(deep.named(deep.node_rows(e))), f"""{_WALK}, k AS (SELECT tree_id, parent, COUNT(*) AS c FROM deep WHERE parent IS NOT NULL GROUP BY 1, 2),
p AS (SELECT tree_id, CAST(SUM(CAST(c > 2 AS INT)) AS BIGINT) AS polytomies, MAX(c) AS most_children FROM k GROUP BY 1)
SELECT deep.tree_id, COUNT(*) FILTER (is_tip) AS tips, COUNT(*) FILTER (NOT is_tip) AS internal, ROUND(SUM(branch_length), 6) AS total_length, ROUND(MAX(root_dist), 6) AS height, ANY_VALUE(polytomies) AS polytomies, ANY_VALUE(most_children) AS most_children
FROM deep JOIN p ON p.tree_id = deep.tree_id GROUP BY 1""")
_add("tree_edge_problems", f"SELECT * FROM ({DEEP}) d UNION ALL SELECT user_id, 1, CAST(-1 AS BIGINT), CAST(-1 AS DOUBLE) FROM events WHERE event_id % 50 = 0", deep.edge_problems, f"""WITH e AS (SELECT * FROM ({DEEP}) d UNION ALL SELECT user_id, 1, -1, -1 FROM events WHERE event_id % 50 = 0)
SELECT tree_id, node, 'duplicate_node' AS problem FROM e GROUP BY 1, 2 HAVING COUNT(*) > 1 UNION ALL SELECT tree_id, node, 'unknown_parent' FROM e WHERE parent = -1 UNION ALL SELECT tree_id, node, 'negative_length' FROM e WHERE branch_length < 0""")


def written(nodes: DataFrame, tip: Column, inner: Callable[[Column], Column], sep: str = ",") -> DataFrame:
    """(tree_id, text): trees as nested text, one level at a time; ``inner`` takes the children's text."""
    text = nodes.where("level = 3").withColumn("text", tip)
    for level in (2, 1, 0):
        kids = text.groupBy("tree_id", F.col("parent").alias("name")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", "text"))), lambda x: x.text), sep).alias("_k"))
        text = nodes.where(F.col("level") == level).join(kids, ["tree_id", "name"]).withColumn("text", inner(F.col("_k")))
    return text.select("tree_id", "text")


def newick_texts(nodes: DataFrame) -> DataFrame:
    """Quoted labels, a comment behind each and, but for the root, a length."""
    mark = F.concat(F.lit("'"), "name", F.lit("''s'[&rate="), F.col("level").cast("string"), F.lit(",hpd={1,2}]"), F.coalesce(F.concat(F.lit(":"), F.when(F.col("level") > 0, F.col("branch_length")).cast("string")), F.lit("")))
    return written(nodes, mark, lambda kids: F.concat(F.lit("("), kids, F.lit(")"), mark)).select("tree_id", F.concat("text", F.lit(";")).alias("newick"))


def phyloxml_texts(nodes: DataFrame) -> DataFrame:
    head = F.concat(F.lit("<clade><name>"), "name", F.lit(" &amp; co</name>"), F.when(F.col("is_tip"), F.lit("")).otherwise(F.concat(F.lit("<branch_length>"), F.col("branch_length").cast("string"), F.lit("</branch_length>"))))
    body = written(nodes, F.concat(head, F.lit("<sequence><name>gene</name></sequence></clade>")), lambda kids: F.concat(head, kids, F.lit("</clade>")), "\n")
    return body.select(F.col("tree_id").alias("file"), F.concat(F.lit('<phyloxml><phylogeny rooted="true">'), "text", F.lit("</phylogeny></phyloxml>")).alias("text"))


_UPPER = f"{_N}, n AS (SELECT a.*, b.pre AS up FROM nodes a LEFT JOIN nodes b ON b.tree_id = a.tree_id AND b.name = a.parent)"
_add("io_newick_tokens", fr.NODES, lambda n: tokens.node_rows(newick_texts(n)).drop("comments"), f"""{_UPPER}
SELECT tree_id, pre AS node, up AS parent, concat(name, '''s') AS name, CASE WHEN level > 0 THEN branch_length END AS branch_length, is_tip, level, pre, post FROM n""")
_add("io_newick_annotations", fr.NODES, lambda n: tokens.node_rows(newick_texts(n)).select("tree_id", "node", F.explode(tokens.annotations(F.col("comments"))).alias("key", "value")), f"""{_N}
SELECT tree_id, pre AS node, 'rate' AS key, CAST(level AS VARCHAR) AS value FROM nodes UNION ALL SELECT tree_id, pre, 'hpd', '{{1,2}}' FROM nodes""")
_add("io_newick_problems", fr.NODES, lambda n: tokens.problems(tokens.tokens(newick_texts(n).withColumn("newick", F.when(F.col("tree_id") % 4 == 1, F.expr("substring(newick, 2)")).when(F.col("tree_id") % 4 == 2, F.expr("substring(newick, 1, length(newick) - 1)")).otherwise(F.col("newick"))))), f"""{_N}
SELECT DISTINCT tree_id, CASE tree_id % 4 WHEN 1 THEN 'a bracket too many' ELSE 'no semicolon at the end' END AS error FROM nodes WHERE tree_id % 4 IN (1, 2)""")
_add("io_phyloxml_nodes", fr.NODES, lambda n: tokens.phyloxml_nodes(phyloxml_texts(n)), f"""{_UPPER}
SELECT tree_id AS file, 0 AS phylogeny, pre AS node, up AS parent, concat(name, ' & co') AS name, CASE WHEN NOT is_tip THEN branch_length END AS branch_length, CAST(NULL AS DOUBLE) AS confidence, is_tip, level, pre, post FROM n""")

from cladewise.reviews import _TAXA, nexus_files  # noqa: E402

_add("io_nexus_nodes", _TAXA, lambda t: tokens.nexus_nodes(nexus_files(t)).where("is_tip").select("file", "tree", "rooted", "name", "branch_length", "level"), f"SELECT tree_id AS file, 'one' AS tree, TRUE AS rooted, taxon AS name, len AS branch_length, 2 AS level FROM ({_TAXA}) t")

_CHAIN = "SELECT user_id AS file, CAST(i AS BIGINT) AS i, value FROM (SELECT user_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) e"


def chain_files(chain: DataFrame) -> DataFrame:
    """One NEXUS text per chain with a tree for each state."""
    line = F.concat(F.lit("tree STATE_"), (F.col("i") * 100).cast("string"), F.lit(" [&lnP=-"), F.col("i").cast("string"), F.lit("] = "), F.when(F.col("i") % 2 == 0, F.lit("[&R] ")).otherwise(F.lit("")), F.lit("(A:1,B:"), F.col("i").cast("string"), F.lit(");\n"))
    lines = chain.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", line.alias("s")))), lambda x: x.s), "").alias("s"))
    return lines.select("file", F.concat(F.lit("#NEXUS\nbegin trees;\n"), "s", F.lit("end;\n")).alias("text"))


_add("io_posterior_samples", _CHAIN, lambda c: tokens.posterior_samples(chain_files(c), 0.25).select("file", "name", "state", "rooted", "newick"), f"""WITH c AS ({_CHAIN}), n AS (SELECT *, COUNT(*) OVER (PARTITION BY file) AS n FROM c)
SELECT file, concat('STATE_', CAST(i * 100 AS VARCHAR)) AS name, i * 100 AS state, TRUE AS rooted, concat('(A:1,B:', CAST(i AS VARCHAR), ');') AS newick FROM n WHERE i > FLOOR(n * 0.25)""")

# Sankoff parsimony

_STATES = """
SELECT o_custkey AS tree_id, concat('C', CAST(o_orderkey AS VARCHAR(19))) AS name, 'status' AS character, o_orderstatus AS state FROM orders
UNION ALL SELECT o_custkey, concat('C', CAST(o_orderkey AS VARCHAR(19))), 'priority', CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'F' WHEN '2' THEN 'O' ELSE 'P' END FROM orders"""
_COSTS = {"F": {"F": 0, "O": 1, "P": 3}, "O": {"F": 2, "O": 0, "P": 1}, "P": {"F": 2, "O": 2, "P": 0}}


def _sankoff_sql() -> str:
    states = sorted(_COSTS)
    tips = ", ".join(f"CASE WHEN s.state = '{s}' THEN CAST(0 AS DOUBLE) ELSE CAST('Infinity' AS DOUBLE) END AS cost_{i}" for i, s in enumerate(states))
    up = ", ".join(f"SUM(LEAST({', '.join(f'cost_{j} + {_COSTS[s][t]}' for j, t in enumerate(states))})) AS cost_{i}" for i, s in enumerate(states))
    text = f"{_N}, l3 AS (SELECT n.tree_id, n.name, n.parent, s.character, {tips} FROM nodes n JOIN ({_STATES}) s ON s.tree_id = n.tree_id AND s.name = n.name)"
    for level in (2, 1, 0):
        text += f", s{level} AS (SELECT tree_id, parent AS name, character, {up} FROM l{level + 1} GROUP BY 1, 2, 3), l{level} AS (SELECT s{level}.tree_id, s{level}.name, n.parent, character, cost_0, cost_1, cost_2 FROM s{level} JOIN nodes n ON n.tree_id = s{level}.tree_id AND n.name = s{level}.name)"
    text += ", c AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2), b AS (SELECT *, LEAST(cost_0, cost_1, cost_2) AS best FROM c)"
    names = " , ".join(f"CASE WHEN cost_{i} = best THEN '{s}' END" for i, s in enumerate(states))
    return text + f", o AS (SELECT *, concat_ws(',', {names}) AS optimal_states FROM b)"


_add("pars_sankoff_nodes", fr.NODES, lambda n, states: deep.sankoff(n, states, _COSTS), f"{_sankoff_sql()} SELECT tree_id, name, parent, character, cost_0, cost_1, cost_2, best, optimal_states, optimal_states LIKE '%,%' AS tie FROM o", states=_STATES)
_add("pars_sankoff", fr.NODES, lambda n, states, weights: deep.sankoff_scores(deep.sankoff(n, states, _COSTS), weights), f"{_sankoff_sql()} SELECT tree_id, character, best AS cost, best * CASE character WHEN 'status' THEN 2.5 ELSE 1 END AS weighted_cost FROM o WHERE parent IS NULL", states=_STATES, weights="SELECT DISTINCT 'status' AS character, CAST(2.5 AS DOUBLE) AS weight FROM region")

# Structure

#: The same trees with one kind of change by the customer's number: none, lengths, labels inside, a label at a tip, a clade taken apart.
_CHANGED = f"""
SELECT tree_id, CASE WHEN tree_id % 5 = 2 AND level = 1 THEN concat(name, 'x') WHEN tree_id % 5 = 3 AND is_tip AND name = least_tip THEN 'other' ELSE name END AS name, parent,
       CASE WHEN tree_id % 5 = 1 AND is_tip THEN branch_length + 1 ELSE branch_length END AS branch_length, level, is_tip, pre, CASE WHEN tree_id % 5 = 4 AND level = 2 AND pre = least_inner THEN post - 1 ELSE post END AS post
FROM (SELECT *, MIN(CASE WHEN is_tip THEN name END) OVER (PARTITION BY tree_id) AS least_tip, MIN(CASE WHEN level = 2 AND post - pre > 1 THEN pre END) OVER (PARTITION BY tree_id) AS least_inner FROM ({fr.NODES}) n) z
WHERE tree_id % 7 > 0"""
_KEYS = "e{0} AS (SELECT a.tree_id, a.is_tip, STRING_AGG(t.name, '|' ORDER BY t.name) AS key, a.pre, a.post, a.branch_length, a.name FROM {1} a JOIN {1} t ON t.tree_id = a.tree_id AND t.is_tip AND t.pre BETWEEN a.pre AND a.post WHERE a.parent IS NOT NULL GROUP BY ALL), k{0} AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tree_id, is_tip, key ORDER BY post DESC, pre) AS i FROM e{0}) z WHERE i = 1)"
_STRUCTURE = f"""{_N}, changed AS ({_CHANGED}), {_KEYS.format(1, "nodes")}, {_KEYS.format(2, "changed")},
j AS (SELECT COALESCE(a.tree_id, b.tree_id) AS tree_id, COALESCE(a.is_tip, b.is_tip) AS is_tip, a.key IS NOT NULL AND b.key IS NOT NULL AS both_, a.branch_length <> b.branch_length AS len, a.name <> b.name AS lab FROM k1 a FULL JOIN k2 b ON a.tree_id = b.tree_id AND a.is_tip = b.is_tip AND a.key = b.key),
f AS (SELECT tree_id, COUNT(*) FILTER (NOT both_ AND is_tip) AS t, COUNT(*) FILTER (NOT both_ AND NOT is_tip) AS c, COUNT(*) FILTER (both_ AND len) AS lengths, COUNT(*) FILTER (both_ AND NOT is_tip AND lab) AS labels FROM j GROUP BY 1),
s AS (SELECT f.tree_id, CASE WHEN f.tree_id % 7 = 0 THEN 'tree missing' WHEN t > 0 THEN 'tip labels differ' WHEN c > 0 THEN 'clades or splits differ' WHEN lengths > 0 THEN 'branch lengths differ' WHEN labels > 0 THEN 'internal labels differ' END AS reason,
  CASE WHEN f.tree_id % 7 = 0 THEN 0 ELSE lengths END AS lengths, CASE WHEN f.tree_id % 7 = 0 THEN 0 ELSE labels END AS labels FROM f)"""
_add("cmp_structure", fr.NODES, lambda n, changed: deep.compare_structure(n, changed), f"{_STRUCTURE} SELECT tree_id, reason IS NULL AS equivalent, reason, lengths, labels FROM s", changed=_CHANGED)
_add("cmp_structure_sets", fr.NODES, lambda n, changed: deep.compare_sets(n, changed), f"""{_STRUCTURE} SELECT COUNT(*) AS expected_trees, COUNT(*) FILTER (tree_id % 7 > 0) AS observed_trees, COUNT(*) FILTER (reason IS NULL) AS equivalent_pairs,
MIN(CASE WHEN reason IS NOT NULL THEN tree_id END) AS first_different, ARG_MIN(reason, CASE WHEN reason IS NOT NULL THEN tree_id END) AS reason FROM s""", changed=_CHANGED)
#: Trees over years alone, so that many customers share one.
_YEARS = f"SELECT tree_id, CASE WHEN level = 0 THEN name ELSE concat('Y', name) END AS name, parent, branch_length, level, level = 1 AS is_tip, ROW_NUMBER() OVER (PARTITION BY tree_id ORDER BY pre) AS pre, CASE WHEN level = 0 THEN COUNT(*) OVER (PARTITION BY tree_id) ELSE ROW_NUMBER() OVER (PARTITION BY tree_id ORDER BY pre) END AS post FROM ({fr.NODES}) n WHERE level < 2"
_add("tree_equal_classes", _YEARS, lambda n: deep.signatures(n).groupBy("signature").agg(F.min("tree_id").alias("first_tree"), F.count("*").alias("trees")).drop("signature"), f"""WITH t AS (SELECT tree_id, STRING_AGG(name, '|' ORDER BY name) AS tips FROM ({_YEARS}) y WHERE is_tip GROUP BY 1)
SELECT MIN(tree_id) AS first_tree, COUNT(*) AS trees FROM t GROUP BY tips""")

# Dates

_DATED = "SELECT o_custkey AS tree_id, concat('C', CAST(o_orderkey AS VARCHAR(19))) AS tip, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS DOUBLE) AS date, CAST(o_orderkey % 97 + year(o_orderdate) AS DOUBLE) AS distance FROM orders"
_add("rtt_randomization", _DATED, lambda t: deep.date_randomization(t, 19), f"""WITH t AS ({_DATED}), o AS (SELECT tree_id, COUNT(*) AS tips, CASE WHEN COUNT(*) > 1 AND VAR_POP(date) > 0 AND VAR_POP(distance) > 0 THEN ROUND(REGR_R2(distance, date), 9) WHEN VAR_POP(date) > 0 THEN 1.0 END AS r2 FROM t GROUP BY 1),
a AS (SELECT tree_id, distance, ROW_NUMBER() OVER (PARTITION BY tree_id ORDER BY tip) AS i FROM t),
b AS (SELECT tree_id, p, date, ROW_NUMBER() OVER (PARTITION BY tree_id, p ORDER BY md5(concat('17:', CAST(p AS VARCHAR), ':', tip)), tip) AS i FROM t CROSS JOIN (SELECT UNNEST(range(1, 20)) AS p) r),
n AS (SELECT a.tree_id, p, CASE WHEN VAR_POP(date) > 0 AND VAR_POP(distance) > 0 THEN ROUND(REGR_R2(distance, date), 9) WHEN VAR_POP(date) > 0 THEN 1.0 END AS permuted FROM a JOIN b ON b.tree_id = a.tree_id AND b.i = a.i GROUP BY 1, 2)
SELECT n.tree_id, tips, ROUND(r2, 6) AS r2, COUNT(*) FILTER (permuted >= r2) AS at_or_above, ROUND(MIN(permuted), 6) AS null_least, ROUND(AVG(permuted), 6) AS null_mean, ROUND(MAX(permuted), 6) AS null_most,
ROUND((COUNT(*) FILTER (permuted >= r2) + 1) / 20.0, 6) AS p_value FROM n JOIN o ON o.tree_id = n.tree_id WHERE r2 IS NOT NULL GROUP BY 1, 2, r2""")

# Leaving out a taxon

_ROGUE = f"""{q._T}, z AS (SELECT DISTINCT tip FROM tips UNION ALL SELECT ''), n AS (SELECT COUNT(*) AS n FROM trees),
p AS (SELECT DISTINCT z.tip, tree_id, array_to_string(list_filter(string_split(clade, '|'), lambda c: c <> z.tip), '|') AS clade FROM cl CROSS JOIN z),
pc AS (SELECT * FROM p WHERE LEN(string_split(clade, '|')) BETWEEN 2 AND (SELECT COUNT(*) - 2 FROM z) - CAST(tip <> '' AS INT)),
f AS (SELECT tip, clade, 100.0 * COUNT(*) / (SELECT n FROM n) AS share FROM pc GROUP BY 1, 2),
co AS (SELECT z.tip, COUNT(share) AS k, COALESCE(AVG(share), 0) AS support FROM z LEFT JOIN f ON f.tip = z.tip AND share >= 30 GROUP BY 1),
sx AS (SELECT z.tip, t.tree_id, COALESCE(STRING_AGG(clade, ';' ORDER BY clade), '') AS signature FROM z CROSS JOIN trees t LEFT JOIN pc ON pc.tip = z.tip AND pc.tree_id = t.tree_id GROUP BY 1, 2),
tx AS (SELECT tip, signature, COUNT(*) AS w, list_filter(string_split(signature, ';'), lambda c: c <> '') AS cs FROM sx GROUP BY 1, 2),
sh AS (SELECT tip, COUNT(*) AS topologies, ROUND(CAST(MAX(w) AS DOUBLE) / SUM(w), 9) AS dominant FROM tx GROUP BY 1),
rf AS (SELECT a.tip, SUM(CAST(a.w AS DOUBLE) * b.w * (1 - 2.0 * LEN(list_intersect(a.cs, b.cs)) / (LEN(a.cs) + LEN(b.cs)))) / (SELECT CAST(n AS DOUBLE) * (n - 1) / 2 FROM n) AS d FROM tx a JOIN tx b ON a.tip = b.tip AND a.signature < b.signature GROUP BY 1),
g AS (SELECT z.tip, ROUND(CAST(k AS DOUBLE) / ((SELECT COUNT(*) FROM z) - 3 - CAST(z.tip <> '' AS INT)), 9) AS resolution, ROUND(support, 9) AS support, ROUND(COALESCE(d, 0), 9) AS distance, topologies, dominant FROM z JOIN co ON co.tip = z.tip JOIN sh ON sh.tip = z.tip LEFT JOIN rf ON rf.tip = z.tip),
m AS (SELECT tip, ROUND(AVG(n), 9) AS mean_branch_length FROM tips GROUP BY 1),
r AS (SELECT a.tip AS taxon, b.resolution AS baseline_resolution, a.resolution AS pruned_resolution, b.support AS baseline_support, a.support AS pruned_support, b.distance AS baseline_distance, a.distance AS pruned_distance, b.topologies AS baseline_topologies, a.topologies AS pruned_topologies,
  b.dominant AS baseline_dominant, a.dominant AS pruned_dominant, ROUND(a.resolution - b.resolution, 9) AS resolution_gain, ROUND(a.support - b.support, 9) AS support_gain, ROUND(b.distance - a.distance, 9) AS distance_gain, b.topologies - a.topologies AS topologies_gain, ROUND(a.dominant - b.dominant, 9) AS dominant_gain
  FROM g a JOIN g b ON b.tip = '' WHERE a.tip <> '')
SELECT r.*, mean_branch_length, CAST(ROW_NUMBER() OVER (ORDER BY resolution_gain DESC, support_gain DESC, distance_gain DESC, pruned_distance, taxon) AS INT) AS rank FROM r JOIN m ON m.tip = r.taxon"""
_add("set_rogue_taxa", fr.TIPS, lambda t: rogue.drop_one_taxon(se.clades_of_levels(t), t, t.select(F.col("tip").alias("taxon")), 0.3, t.select(F.col("tip").alias("taxon"), F.col("n").cast("double").alias("branch_length"))), _ROGUE)
