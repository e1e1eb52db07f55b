"""Registered queries on the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise import frames as fr
from cladewise.operators import alignment as al
from cladewise.operators import comparative as co
from cladewise.operators import distance as di
from cladewise.operators import tables as ta
from cladewise.operators import traces as tr
from cladewise.operators import trees as tree
from cladewise.operators import treesets as se

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, text: str, f: Callable[..., DataFrame], sql: str | None = None, **more: str) -> None:
    """A query that applies ``f`` to the frame of ``text`` (and to those of ``more``)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(fr.frame(spark, sf_dir, text), **{k: fr.frame(spark, sf_dir, v) for k, v in more.items()})

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


# Alignments

_S = f"WITH sites AS ({fr.SITES})"
_KNOWN = "residue IN ('A','C','G','T','U')"
_AMB = "residue NOT IN ('A','C','G','T','U','-','?')"
_CLASS = f"""{_S}, st AS (SELECT aln_id, site, residue AS state, COUNT(*) AS n FROM sites WHERE {_KNOWN} GROUP BY 1, 2, 3),
ag AS (SELECT aln_id, site, COUNT(*) AS states, SUM(CASE WHEN n >= 2 THEN 1 ELSE 0 END) AS often FROM st GROUP BY 1, 2),
al AS (SELECT aln_id, site, SUM(CASE WHEN residue = '-' THEN 1 ELSE 0 END) AS gaps, SUM(CASE WHEN residue = '?' THEN 1 ELSE 0 END) AS missing,
  SUM(CASE WHEN {_AMB} THEN 1 ELSE 0 END) AS ambiguous FROM sites GROUP BY 1, 2),
classes AS (SELECT al.aln_id, al.site, COALESCE(states, 0) AS states, CAST(gaps AS BIGINT) AS gaps, CAST(missing AS BIGINT) AS missing, CAST(ambiguous AS BIGINT) AS ambiguous,
  COALESCE(states, 0) = 1 AS constant, COALESCE(states, 0) > 1 AS variable, COALESCE(often, 0) >= 2 AS informative
  FROM al LEFT JOIN ag ON al.aln_id = ag.aln_id AND al.site = ag.site)"""

_add("aln_base_frequency", fr.SITES, al.base_frequency, f"""{_S}, c AS (SELECT aln_id, taxon, COUNT(*) AS known, {', '.join(f"SUM(CASE WHEN residue = '{b}' THEN 1 ELSE 0 END) AS {b}" for b in 'ACGT')}
FROM sites WHERE {_KNOWN} GROUP BY GROUPING SETS ((aln_id, taxon), (aln_id)))
SELECT aln_id, taxon, known, {', '.join(f"ROUND(CAST({b} AS DOUBLE) / known, 9) AS freq_{b.lower()}" for b in 'ACGT')} FROM c""")
_add("aln_gc_content", fr.SITES, al.gc_content, f"""{_S} SELECT aln_id, taxon,
ROUND(CAST(SUM(CASE WHEN residue IN ('G','C') THEN 1 ELSE 0 END) AS DOUBLE) / NULLIF(SUM(CASE WHEN {_KNOWN} THEN 1 ELSE 0 END), 0), 9) AS gc,
CAST(SUM(CASE WHEN {_KNOWN} THEN 1 ELSE 0 END) AS BIGINT) AS known FROM sites GROUP BY aln_id, taxon""")
_add("aln_site_classes", fr.SITES, al.site_classes, f"{_CLASS} SELECT * FROM classes")
_add("aln_summary", fr.SITES, al.summary, f"""{_CLASS}, c AS (SELECT aln_id, COUNT(*) AS sites, CAST(SUM(CAST(constant AS INT)) AS BIGINT) AS constant, CAST(SUM(CAST(variable AS INT)) AS BIGINT) AS variable, CAST(SUM(CAST(informative AS INT)) AS BIGINT) AS informative FROM classes GROUP BY 1),
d AS (SELECT aln_id, COUNT(DISTINCT taxon) AS taxa, CAST(SUM(CASE WHEN residue = '-' THEN 1 ELSE 0 END) AS BIGINT) AS gaps, CAST(SUM(CASE WHEN residue = '?' THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(SUM(CASE WHEN {_AMB} THEN 1 ELSE 0 END) AS BIGINT) AS ambiguous FROM sites GROUP BY 1)
SELECT c.*, d.taxa, d.gaps, d.missing, d.ambiguous FROM c JOIN d ON c.aln_id = d.aln_id""")
_add("aln_windows", fr.SITES, al.windows, f"""{_CLASS}, len AS (SELECT aln_id, MAX(site) AS length, COUNT(DISTINCT taxon) AS taxa FROM sites GROUP BY 1),
w AS (SELECT aln_id, taxa, k * 5 + 1 AS start, LEAST(k * 5 + 10, length) AS stop FROM (SELECT aln_id, taxa, length, UNNEST(generate_series(0, CAST(GREATEST(CEIL((length - 10) / 5.0), 0) AS INT))) AS k FROM len) q)
SELECT w.aln_id, CAST(w.start AS INT) AS start, CAST(w.stop AS INT) AS stop, ROUND(CAST(SUM(CAST(variable AS INT)) AS DOUBLE) / COUNT(*), 9) AS variable_fraction,
ROUND(CAST(SUM(gaps) AS DOUBLE) / (COUNT(*) * MAX(taxa)), 9) AS gap_fraction, ROUND(CAST(SUM(missing + ambiguous) AS DOUBLE) / (COUNT(*) * MAX(taxa)), 9) AS missing_fraction
FROM w JOIN classes c ON c.aln_id = w.aln_id AND c.site BETWEEN w.start AND w.stop GROUP BY 1, 2, 3""")
_add("aln_site_patterns", fr.SITES, al.site_patterns, f"""{_S}, c AS (SELECT aln_id, site, STRING_AGG(residue, '' ORDER BY taxon) AS pattern FROM sites GROUP BY 1, 2)
SELECT aln_id, pattern, COUNT(*) AS weight, MIN(site) AS first_site FROM c GROUP BY 1, 2""")
_add("aln_duplicates", fr.SITES, al.duplicates, f"""{_S}, q AS (SELECT aln_id, taxon, STRING_AGG(residue, '' ORDER BY site) AS seq FROM sites GROUP BY 1, 2)
SELECT aln_id, STRING_AGG(taxon, '|' ORDER BY taxon) AS taxa, COUNT(*) AS n FROM q GROUP BY aln_id, seq HAVING COUNT(*) > 1""")
_PAIR = "FROM sites a JOIN sites b ON a.aln_id = b.aln_id AND a.site = b.site AND a.taxon < b.taxon"
_OK2 = "a.residue NOT IN ('-','?') AND b.residue NOT IN ('-','?')"
_IDENT = f"""{_S}, p AS (SELECT a.aln_id, a.taxon AS "left", b.taxon AS "right", SUM(CASE WHEN {_OK2} THEN 1 ELSE 0 END) AS n, SUM(CASE WHEN {_OK2} AND a.residue = b.residue THEN 1 ELSE 0 END) AS same {_PAIR} GROUP BY 1, 2, 3),
ident AS (SELECT aln_id, "left", "right", CAST(n AS BIGINT) AS comparable_sites, ROUND(CASE WHEN n > 0 THEN CAST(same AS DOUBLE) / n ELSE 0 END, 9) AS identity FROM p)"""
_add("aln_identity", fr.SITES, al.identity, f"{_IDENT} SELECT * FROM ident")
_add("aln_near_duplicates", fr.SITES, al.near_duplicates, f"{_IDENT} SELECT * FROM ident WHERE identity >= 0.4")
_add("aln_missing_by_taxon", fr.SITES, al.missing_by_taxon, f"""{_S}, m AS (SELECT aln_id, taxon, ROUND(AVG(CASE WHEN residue = '?' OR {_AMB} THEN 1.0 ELSE 0.0 END), 9) AS missing_fraction FROM sites GROUP BY 1, 2)
SELECT *, missing_fraction > 0.3 AS excessive FROM m""")
_add("aln_missing_by_site", fr.SITES, al.missing_by_site, f"""{_S}, m AS (SELECT aln_id, site, ROUND(AVG(CASE WHEN residue = '?' OR {_AMB} THEN 1.0 ELSE 0.0 END), 9) AS missing_fraction FROM sites GROUP BY 1, 2)
SELECT *, missing_fraction > 0.3 AS excessive FROM m""")
_add("aln_trim_columns", fr.SITES, lambda s: al.trim_columns_above_missingness(s, 0.3), f"""{_S}, m AS (SELECT aln_id, site, AVG(CASE WHEN residue = '?' OR {_AMB} THEN 1.0 ELSE 0.0 END) AS f FROM sites GROUP BY 1, 2),
k AS (SELECT aln_id, site, CAST(ROW_NUMBER() OVER (PARTITION BY aln_id ORDER BY site) AS INT) AS new FROM m WHERE ROUND(f, 9) <= 0.3)
SELECT s.aln_id, s.taxon, k.new AS site, s.residue FROM sites s JOIN k ON k.aln_id = s.aln_id AND k.site = s.site""")
_add("aln_remove_gap_columns", fr.SITES, al.remove_all_gap_columns, f"""{_S}, k AS (SELECT aln_id, site, CAST(ROW_NUMBER() OVER (PARTITION BY aln_id ORDER BY site) AS INT) AS new FROM (SELECT aln_id, site FROM sites GROUP BY 1, 2 HAVING NOT BOOL_AND(residue = '-')) q)
SELECT s.aln_id, s.taxon, k.new AS site, s.residue FROM sites s JOIN k ON k.aln_id = s.aln_id AND k.site = s.site""")
_add("aln_remove_missing_sequences", fr.SITES, lambda s: al.remove_sequences_above_missingness(s, 0.25), f"""{_S}, m AS (SELECT aln_id, taxon FROM sites GROUP BY 1, 2 HAVING ROUND(AVG(CASE WHEN residue = '?' OR {_AMB} THEN 1.0 ELSE 0.0 END), 9) <= 0.25)
SELECT s.* FROM sites s JOIN m ON m.aln_id = s.aln_id AND m.taxon = s.taxon""")
_add("aln_clean_moderate", fr.SITES, lambda s: al.clean(s, "moderate").groupBy("aln_id").agg(F.count("*").alias("cells"), F.countDistinct("taxon").alias("taxa"), F.max("site").alias("sites")), f"""{_S}, mi AS (SELECT *, CASE WHEN residue = '?' OR {_AMB} THEN 1.0 ELSE 0.0 END AS x FROM sites),
k AS (SELECT aln_id, site, CAST(ROW_NUMBER() OVER (PARTITION BY aln_id ORDER BY site) AS INT) AS new FROM (SELECT aln_id, site FROM mi GROUP BY 1, 2 HAVING ROUND(AVG(x), 9) <= 0.5) z), t AS (SELECT mi.aln_id, taxon, new, x FROM mi JOIN k ON k.aln_id = mi.aln_id AND k.site = mi.site),
m AS (SELECT aln_id, taxon FROM t GROUP BY 1, 2 HAVING ROUND(AVG(x), 9) <= 0.4) SELECT t.aln_id, COUNT(*) AS cells, COUNT(DISTINCT t.taxon) AS taxa, MAX(new) AS sites FROM t JOIN m ON m.aln_id = t.aln_id AND m.taxon = t.taxon GROUP BY 1""")
_add("aln_composition_outliers", fr.SITES, al.composition_outliers, f"""{_S}, g AS (SELECT aln_id, taxon, ROUND(CAST(SUM(CASE WHEN residue IN ('G','C') THEN 1 ELSE 0 END) AS DOUBLE) / NULLIF(SUM(CASE WHEN {_KNOWN} THEN 1 ELSE 0 END), 0), 9) AS gc FROM sites GROUP BY 1, 2),
m AS (SELECT aln_id, MEDIAN(gc) AS mid FROM g GROUP BY 1), o AS (SELECT g.*, m.mid, ABS(gc - mid) AS off FROM g JOIN m ON m.aln_id = g.aln_id), d AS (SELECT aln_id, MEDIAN(off) AS mad FROM o GROUP BY 1),
z AS (SELECT o.*, ROUND(0.67449 * (gc - mid) / NULLIF(mad, 0), 6) AS robust_z FROM o JOIN d ON d.aln_id = o.aln_id WHERE gc IS NOT NULL)
SELECT aln_id, taxon, gc, robust_z, off > 0.25 OR COALESCE(ABS(robust_z) >= 3.5, FALSE) AS outlier FROM z""")
_add("aln_occupancy", fr.SITES, al.taxon_occupancy, f"""{_S} SELECT aln_id, taxon, CAST(FLOOR((site - 1) / 10) AS INT) AS locus, ROUND(AVG(CASE WHEN residue NOT IN ('-','?') THEN 1.0 ELSE 0.0 END), 9) AS occupancy FROM sites GROUP BY 1, 2, 3""")
_CODON = ", ".join(f"('{k}','{v}')" for k, v in al.CODONS.items())
_TRANS = f"""{_S}, cod AS (SELECT aln_id, taxon, CAST(FLOOR((site - 1) / 3) AS INT) + 1 AS codon, REPLACE(STRING_AGG(residue, '' ORDER BY site), 'U', 'T') AS triplet FROM sites GROUP BY 1, 2, 3),
tab(c, aa) AS (VALUES {_CODON}), tran AS (SELECT aln_id, taxon, codon, triplet, CASE WHEN triplet = '---' THEN '-' ELSE COALESCE(aa, 'X') END AS amino_acid FROM cod LEFT JOIN tab ON c = triplet WHERE LENGTH(triplet) = 3)"""
_add("aln_translate", fr.SITES, al.translate, f"{_TRANS} SELECT * FROM tran")
_add("aln_stop_codons", fr.SITES, al.stop_codons, f"""{_TRANS} SELECT aln_id, taxon, codon, CASE WHEN codon = last THEN 'terminal' ELSE 'internal' END AS kind
FROM (SELECT *, MAX(codon) OVER (PARTITION BY aln_id, taxon) AS last FROM tran) q WHERE amino_acid = '*'""")
_add("aln_quality_ranking", fr.SITES, al.quality_ranking, f"""{_S}, s AS (SELECT aln_id, taxon, ROUND(AVG(CASE WHEN {_KNOWN} THEN 1.0 ELSE 0.0 END), 9) AS quality FROM sites GROUP BY 1, 2)
SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY aln_id ORDER BY quality DESC, taxon) AS INT) AS rank FROM s""")

# Distances

_PUR = lambda c: f"{c}.residue IN ('A','G')"
_OKB = "a.residue IN ('A','C','G','T') AND b.residue IN ('A','C','G','T')"
_COUNTS = f"""{_S}, k AS (SELECT a.aln_id, a.taxon AS "left", b.taxon AS "right", SUM(CASE WHEN {_OKB} THEN 1 ELSE 0 END) AS n,
SUM(CASE WHEN {_OKB} AND a.residue <> b.residue THEN 1 ELSE 0 END) AS mm,
SUM(CASE WHEN {_OKB} AND a.residue <> b.residue AND ({_PUR('a')}) = ({_PUR('b')}) THEN 1 ELSE 0 END) AS ts,
SUM(CASE WHEN {_OKB} AND a.residue <> b.residue AND ({_PUR('a')}) <> ({_PUR('b')}) THEN 1 ELSE 0 END) AS tv,
SUM(CASE WHEN {_OKB} AND a.residue <> b.residue AND {_PUR('a')} AND {_PUR('b')} THEN 1 ELSE 0 END) AS ag,
SUM(CASE WHEN {_OKB} AND a.residue <> b.residue AND NOT {_PUR('a')} AND NOT {_PUR('b')} THEN 1 ELSE 0 END) AS ct
FROM sites a JOIN sites b ON a.aln_id = b.aln_id AND a.site = b.site AND a.taxon <= b.taxon GROUP BY 1, 2, 3),
f AS (SELECT aln_id, {', '.join(f"CAST(SUM(CASE WHEN residue = '{b}' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS p{b}" for b in 'ACGT')} FROM sites WHERE residue IN ('A','C','G','T') GROUP BY 1),
c AS (SELECT k.*, CAST(mm AS DOUBLE) / NULLIF(n, 0) AS p, CAST(ts AS DOUBLE) / NULLIF(n, 0) AS pp, CAST(tv AS DOUBLE) / NULLIF(n, 0) AS q, CAST(ag AS DOUBLE) / NULLIF(n, 0) AS p1, CAST(ct AS DOUBLE) / NULLIF(n, 0) AS p2,
  1 - (pA * pA + pC * pC + pG * pG + pT * pT) AS b, pA + pG AS r, pC + pT AS y, 2 * pA * pG / (pA + pG) AS k1, 2 * pC * pT / (pC + pT) AS k2,
  2 * ((pA + pG) * (pC + pT) - pA * pG * (pC + pT) / (pA + pG) - pC * pT * (pA + pG) / (pC + pT)) AS k3 FROM k JOIN f ON f.aln_id = k.aln_id)"""
_LN = lambda x: f"CASE WHEN {x} > 0 THEN LN({x}) END"
_FORMULA = {
    "p": "p",
    "jc69": f"CASE WHEN mm = 0 THEN CASE WHEN n > 0 THEN 0.0 END ELSE -0.75 * {_LN('(1 - p * 4 / 3)')} END",
    "k80": f"-0.5 * {_LN('(1 - 2 * pp - q)')} - 0.25 * {_LN('(1 - 2 * q)')}",
    "f81": f"CASE WHEN mm = 0 THEN CASE WHEN n > 0 THEN 0.0 END ELSE -b * {_LN('(1 - p / b)')} END",
    "tn93": f"CASE WHEN mm = 0 THEN CASE WHEN n > 0 THEN 0.0 END ELSE -k1 * {_LN('(1 - p1 / k1 - q / (2 * r))')} - k2 * {_LN('(1 - p2 / k2 - q / (2 * y))')} - k3 * {_LN('(1 - q / (2 * r * y))')} END",
}
_DIST = lambda m: f"""SELECT aln_id, "left", "right", CAST(n AS BIGINT) AS comparable_sites, ROUND({_FORMULA[m]}, 9) AS distance FROM c"""
for _m in _FORMULA:
    _add(f"dist_{_m}", fr.SITES, lambda s, m=_m: di.distances(s, m), f"{_COUNTS} {_DIST(_m)}")
_add("dist_saturation", fr.SITES, di.saturation, f"""{_COUNTS}, d AS ({_DIST('jc69')}) SELECT aln_id, CAST(SUM(CASE WHEN distance IS NULL AND comparable_sites > 0 THEN 1 ELSE 0 END) AS BIGINT) AS saturated, COUNT(*) AS pairs FROM d GROUP BY 1""")
_E = f"""{_COUNTS}, d AS ({_DIST('p')}), e AS (SELECT * FROM d WHERE "left" < "right"), w AS (SELECT aln_id, "left" AS a, "right" AS b, distance AS x FROM e UNION ALL SELECT aln_id, "right", "left", distance FROM e)"""
_add("dist_ultrametricity", fr.SITES, lambda s: di.ultrametricity(di.distances(s)), f"""{_E}, t AS (SELECT p.aln_id, p.distance AS ab, q.distance AS ac, r.distance AS bc FROM e p JOIN e q ON p.aln_id = q.aln_id AND p."left" = q."left" AND p."right" < q."right"
JOIN e r ON r.aln_id = p.aln_id AND r."left" = p."right" AND r."right" = q."right"), o AS (SELECT aln_id, ab IS NOT NULL AND ac IS NOT NULL AND bc IS NOT NULL AS known, list_sort([ab, ac, bc]) AS s FROM t)
SELECT aln_id, COUNT(*) AS triples, CAST(SUM(CAST(NOT known AS INT)) AS BIGINT) AS undefined, CAST(SUM(CASE WHEN known AND s[3] - s[2] > 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM o GROUP BY 1""")
_add("dist_additivity", fr.SITES, lambda s: di.additivity(di.distances(s)), f"""{_E}, t AS (SELECT DISTINCT aln_id, taxon AS t FROM sites),
q AS (SELECT a.aln_id, a.t AS a, b.t AS b, c.t AS c, d.t AS d FROM t a JOIN t b ON a.aln_id = b.aln_id AND a.t < b.t JOIN t c ON c.aln_id = a.aln_id AND b.t < c.t JOIN t d ON d.aln_id = a.aln_id AND c.t < d.t),
x AS (SELECT q.aln_id, ab.x + cd.x AS s1, ac.x + bd.x AS s2, ad.x + bc.x AS s3 FROM q JOIN w ab ON ab.aln_id = q.aln_id AND ab.a = q.a AND ab.b = q.b JOIN w cd ON cd.aln_id = q.aln_id AND cd.a = q.c AND cd.b = q.d
JOIN w ac ON ac.aln_id = q.aln_id AND ac.a = q.a AND ac.b = q.c JOIN w bd ON bd.aln_id = q.aln_id AND bd.a = q.b AND bd.b = q.d JOIN w ad ON ad.aln_id = q.aln_id AND ad.a = q.a AND ad.b = q.d JOIN w bc ON bc.aln_id = q.aln_id AND bc.a = q.b AND bc.b = q.c),
o AS (SELECT aln_id, s1 IS NOT NULL AND s2 IS NOT NULL AND s3 IS NOT NULL AS known, list_sort([s1, s2, s3]) AS s FROM x)
SELECT aln_id, COUNT(*) AS quartets, CAST(SUM(CAST(NOT known AS INT)) AS BIGINT) AS undefined, CAST(SUM(CASE WHEN known AND s[3] - s[2] > 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM o GROUP BY 1""")
_add("dist_quality", fr.SITES, lambda s: di.quality(di.distances(s)), f"""{_E}, t AS (SELECT p.aln_id, COUNT(*) AS v FROM w p JOIN w q ON p.aln_id = q.aln_id AND p.b = q.a AND p.a < q.b JOIN w r ON r.aln_id = p.aln_id AND r.a = p.a AND r.b = q.b WHERE r.x > p.x + q.x + 1e-9 GROUP BY 1),
b AS (SELECT aln_id, COUNT(*) AS pairs, CAST(SUM(CAST(distance IS NULL AS INT)) AS BIGINT) AS undefined, MIN(distance) AS least, MAX(distance) AS most FROM e GROUP BY 1)
SELECT b.*, COALESCE(v, 0) AS triangle_violations FROM b LEFT JOIN t ON t.aln_id = b.aln_id""")
_add("dist_compare_models", fr.SITES, di.compare_models, f"""{_COUNTS}, x AS ({_DIST('p')}), y AS ({_DIST('jc69')})
SELECT x.aln_id, COUNT(*) AS pairs, CAST(SUM(CASE WHEN x.distance IS NOT NULL AND y.distance IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS defined, ROUND(AVG(y.distance - x.distance), 6) AS mean_difference
FROM x JOIN y ON x.aln_id = y.aln_id AND x."left" = y."left" AND x."right" = y."right" WHERE x."left" < x."right" GROUP BY 1""")
_add("dist_nearest", fr.SITES, lambda s: di.nearest(di.distances(s)), f"""{_E} SELECT aln_id, a AS taxon, b AS nearest, x AS distance FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY aln_id, a ORDER BY x, b) AS i FROM w WHERE x IS NOT NULL) q WHERE i = 1""")

# Trees

_N = f"WITH nodes AS ({fr.NODES})"
_UP = "SELECT n.tree_id, n.name AS tip, a.name AS ancestor, a.level AS al, a.root_dist AS ad, n.root_dist AS td FROM nodes n JOIN nodes a ON a.tree_id = n.tree_id AND n.pre BETWEEN a.pre AND a.post AND NOT a.is_tip WHERE n.is_tip"
_add("tree_depths", fr.NODES, tree.depths, f"{_N} SELECT tree_id, name, level, root_dist AS depth, is_tip FROM nodes")
_add("tree_inspect", fr.NODES, tree.inspect, f"""{_N}, k AS (SELECT tree_id, parent, COUNT(*) AS c FROM nodes WHERE parent IS NOT NULL GROUP BY 1, 2), p AS (SELECT tree_id, CAST(SUM(CAST(c > 2 AS INT)) AS BIGINT) AS polytomies, MAX(c) AS most_children FROM k GROUP BY 1),
b AS (SELECT tree_id, CAST(SUM(CAST(is_tip AS INT)) AS BIGINT) AS tips, CAST(SUM(CAST(NOT is_tip AS INT)) AS BIGINT) AS internal, ROUND(SUM(branch_length), 6) AS total_length, ROUND(MAX(root_dist), 6) AS height FROM nodes GROUP BY 1)
SELECT b.*, polytomies, most_children FROM b JOIN p ON p.tree_id = b.tree_id""")
_add("tree_ultrametricity", fr.NODES, tree.ultrametricity, f"""{_N} SELECT tree_id, MIN(root_dist) AS least, MAX(root_dist) AS most, ROUND(AVG(root_dist), 6) AS mean, ROUND(MAX(root_dist) - MIN(root_dist), 6) AS spread, ROUND(MAX(root_dist) - MIN(root_dist), 6) <= 1e-6 AS ultrametric FROM nodes WHERE is_tip GROUP BY 1""")
_SIZE = "size AS (SELECT a.tree_id, a.name, COUNT(*) AS tips FROM nodes a JOIN nodes t ON t.tree_id = a.tree_id AND t.is_tip AND t.pre BETWEEN a.pre AND a.post GROUP BY 1, 2)"
_add("tree_shape", fr.NODES, tree.shape, f"""{_N}, {_SIZE}, k AS (SELECT n.tree_id, n.parent, COUNT(*) AS c, BOOL_AND(n.is_tip) AS tipped, MAX(s.tips) - MIN(s.tips) AS im FROM nodes n JOIN size s ON s.tree_id = n.tree_id AND s.name = n.name WHERE n.parent IS NOT NULL GROUP BY 1, 2),
o AS (SELECT tree_id, CAST(SUM(CASE WHEN c = 2 AND tipped THEN 1 ELSE 0 END) AS BIGINT) AS cherries, BOOL_AND(c = 2) AS bin, SUM(im) AS im FROM k GROUP BY 1), t AS (SELECT tree_id, CAST(SUM(level) AS BIGINT) AS sackin, COUNT(*) AS tips FROM nodes WHERE is_tip GROUP BY 1)
SELECT t.tree_id, t.tips, t.sackin, o.cherries, CASE WHEN bin THEN CAST(im AS BIGINT) END AS colless FROM t JOIN o ON o.tree_id = t.tree_id""")
_add("tree_tip_counts", fr.NODES, lambda n: tree.tip_counts(n).select("tree_id", "name", "tips"), f"{_N}, {_SIZE} SELECT * FROM size")
_add("tree_clades", fr.NODES, tree.clades, f"""{_N}, u AS ({_UP}) SELECT tree_id, ancestor AS name, al AS level, COUNT(*) AS tips, ROUND(AVG(td - ad), 6) AS mean_depth, MIN(tip) AS first_tip, MAX(tip) AS last_tip FROM u GROUP BY 1, 2, 3""")
_GROUPS = "SELECT o_custkey AS tree_id, o_orderpriority AS \"group\", concat('C', CAST(o_orderkey AS VARCHAR(19))) AS tip FROM orders"
_GROUPS_SPARK = _GROUPS.replace('"group"', "`group`")
_MRCA = f"""{_N}, g AS ({_GROUPS}), s AS (SELECT g.tree_id, g."group", MIN(pre) AS lo, MAX(pre) AS hi, COUNT(*) AS members FROM g JOIN nodes n ON n.tree_id = g.tree_id AND n.name = g.tip AND n.is_tip GROUP BY 1, 2),
o AS (SELECT s.tree_id, s."group", s.members, n.name, n.level, n.root_dist, ROW_NUMBER() OVER (PARTITION BY s.tree_id, s."group" ORDER BY n.level DESC) AS i FROM s JOIN nodes n ON n.tree_id = s.tree_id AND NOT n.is_tip AND n.pre <= lo AND n.post >= hi)"""
_add("tree_mrca", fr.NODES, tree.mrca, f"""{_MRCA} SELECT tree_id, "group", name AS mrca, root_dist AS mrca_depth, members FROM o WHERE i = 1""", groups=_GROUPS_SPARK)
_add("tree_monophyly", fr.NODES, tree.monophyly, f"""{_MRCA}, {_SIZE} SELECT o.tree_id, "group", o.name AS mrca, members, tips, members = tips AS monophyletic FROM o JOIN size ON size.tree_id = o.tree_id AND size.name = o.name WHERE i = 1""", groups=_GROUPS_SPARK)
_add("tree_clade_distances", fr.NODES, lambda n: tree.patristic_to_root_clades(n, 2), f"""{_N}, u AS ({_UP}), m AS (SELECT u.tree_id, u.ancestor AS name, n.parent, AVG(td) AS m FROM u JOIN nodes n ON n.tree_id = u.tree_id AND n.name = u.ancestor WHERE al = 2 GROUP BY 1, 2, 3),
x AS (SELECT m.*, p.root_dist AS pd FROM m JOIN nodes p ON p.tree_id = m.tree_id AND p.name = m.parent)
SELECT a.tree_id, a.name AS "left", b.name AS "right", ROUND(a.m + b.m - 2 * CASE WHEN a.parent = b.parent THEN a.pd ELSE 0 END, 6) AS mean_distance FROM x a JOIN x b ON a.tree_id = b.tree_id AND a.name < b.name""")
_AGE = "h AS (SELECT tree_id, MAX(root_dist) AS height FROM nodes GROUP BY 1), age AS (SELECT n.tree_id, n.name, ROUND(height - root_dist, 9) AS age FROM nodes n JOIN h ON h.tree_id = n.tree_id WHERE NOT is_tip)"
_add("tree_branching_times", fr.NODES, tree.branching_times, f"{_N}, {_AGE} SELECT * FROM age")
_add("div_ltt", fr.NODES, tree.lineages_through_time, f"""{_N}, {_AGE}, k AS (SELECT tree_id, parent, COUNT(*) AS c FROM nodes WHERE parent IS NOT NULL GROUP BY 1, 2)
SELECT age.tree_id, age.name, age.age, CAST(SUM(c - 1) OVER (PARTITION BY age.tree_id ORDER BY age.age DESC, age.name ROWS UNBOUNDED PRECEDING) AS BIGINT) + 1 AS lineages FROM age JOIN k ON k.tree_id = age.tree_id AND k.parent = age.name""")
_TIMES = "SELECT o_custkey AS tree_id, ROUND(o_totalprice / 1000, 3) AS age FROM orders GROUP BY o_custkey, ROUND(o_totalprice / 1000, 3)"
_add("div_gamma", _TIMES, tree.gamma_statistic, f"""WITH t AS ({_TIMES}), g AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tree_id ORDER BY age DESC) + 1 AS k, age - COALESCE(LEAD(age) OVER (PARTITION BY tree_id ORDER BY age DESC), 0) AS gap FROM t),
r AS (SELECT *, SUM(k * gap) OVER (PARTITION BY tree_id ORDER BY age DESC ROWS UNBOUNDED PRECEDING) AS tt FROM g), o AS (SELECT tree_id, MAX(k) AS n, MAX(tt) AS total, SUM(tt) AS all_t FROM r GROUP BY 1)
SELECT tree_id, n, ROUND(((all_t - total) / (n - 2) - total / 2) / (total * SQRT(1 / (12.0 * (n - 2)))), 6) AS gamma FROM o WHERE n > 2""")
_SCALE = {
    "lambda": ("CASE WHEN is_tip THEN branch_length + (1 - 0.5) * p ELSE branch_length * 0.5 END", 0.5),
    "kappa": ("CASE WHEN branch_length > 0 THEN POWER(branch_length, 0.5) ELSE 0 END", 0.5),
    "delta": ("h * (POWER(root_dist / h, 2) - POWER(p / h, 2))", 2.0),
    "ou": ("(EXP(-0.2 * (h - root_dist)) * (1 - EXP(-0.2 * root_dist)) - EXP(-0.2 * (h - p)) * (1 - EXP(-0.2 * p))) / 0.2", 0.1),
    "early_burst": ("(EXP(-0.2 * p) - EXP(-0.2 * root_dist)) / 0.2", 0.2),
    "white": ("CASE WHEN is_tip THEN 1.0 ELSE 0.0 END", 1.0),
    "speciational": ("CASE WHEN branch_length > 0 THEN 1.0 ELSE 0.0 END", 1.0),
}
for _m, (_f, _v) in _SCALE.items():
    _add(f"tree_rescale_{_m}", fr.NODES, lambda n, m=_m, v=_v: tree.rescale(n, m, v), f"""{_N}, q AS (SELECT *, root_dist - branch_length AS p, MAX(root_dist) OVER (PARTITION BY tree_id) AS h FROM nodes) SELECT tree_id, name, branch_length, ROUND(CAST({_f} AS DOUBLE), 9) AS new_length FROM q""")
_RTT = "SELECT CAST(o_custkey % 25 AS BIGINT) AS tree_id, CAST(year(o_orderdate) AS DOUBLE) + CAST(dayofyear(o_orderdate) AS DOUBLE) / 365.25 AS date, o_totalprice / 1000 AS distance FROM orders"
_add("rtt_regression", _RTT, tree.root_to_tip, f"""WITH t AS ({_RTT}) SELECT tree_id, COUNT(*) AS n, ROUND(REGR_SLOPE(distance, date), 6) AS slope, ROUND(REGR_INTERCEPT(distance, date), 6) AS intercept, ROUND(REGR_R2(distance, date), 6) AS r2, ROUND(-REGR_INTERCEPT(distance, date) / NULLIF(REGR_SLOPE(distance, date), 0), 4) AS origin FROM t GROUP BY 1""")
_KEEP = "SELECT o_custkey AS tree_id, concat('C', CAST(o_orderkey AS VARCHAR(19))) AS name FROM orders WHERE o_orderkey % 3 <> 0"
_add("tree_prune", fr.NODES, tree.prune, f"""{_N}, keep AS ({_KEEP}), t AS (SELECT n.* FROM nodes n JOIN keep k ON k.tree_id = n.tree_id AND k.name = n.name WHERE n.is_tip),
br AS (SELECT t.tree_id, c.parent AS anc, COUNT(DISTINCT c.name) AS k FROM t JOIN nodes c ON c.tree_id = t.tree_id AND t.pre BETWEEN c.pre AND c.post AND c.parent IS NOT NULL GROUP BY 1, 2),
o AS (SELECT t.tree_id, t.name, a.name AS anc, t.root_dist - a.root_dist AS bl, ROW_NUMBER() OVER (PARTITION BY t.tree_id, t.name ORDER BY a.level DESC) AS i FROM t JOIN nodes a ON a.tree_id = t.tree_id AND NOT a.is_tip AND t.pre BETWEEN a.pre AND a.post JOIN br ON br.tree_id = a.tree_id AND br.anc = a.name AND br.k > 1)
SELECT tree_id, name, anc AS new_parent, ROUND(bl, 9) AS branch_length FROM o WHERE i = 1""", keep=_KEEP)

# Tree sets

_T = f"""WITH tips AS ({fr.TIPS}), trees AS (SELECT DISTINCT tree_id FROM tips),
cl AS (SELECT DISTINCT tree_id, clade, size FROM (SELECT tree_id, STRING_AGG(tip, '|' ORDER BY tip) AS clade, COUNT(*) AS size FROM tips GROUP BY tree_id, a
  UNION ALL SELECT tree_id, STRING_AGG(tip, '|' ORDER BY tip), COUNT(*) FROM tips GROUP BY tree_id, a, b) q WHERE size > 1 AND size < (SELECT COUNT(DISTINCT tip) FROM tips)),
fq AS (SELECT clade, COUNT(*) AS tree_count, ROUND(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM trees), 9) AS frequency FROM cl GROUP BY 1)"""
_TOPO = f"""{_T}, sg AS (SELECT t.tree_id, COALESCE(STRING_AGG(clade, ';' ORDER BY clade), '') AS signature FROM trees t LEFT JOIN cl ON cl.tree_id = t.tree_id GROUP BY 1),
tp AS (SELECT signature, COUNT(*) AS tree_count, MIN(tree_id) AS first_tree FROM sg GROUP BY 1)"""


def _set(f: Callable[..., DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda tips: f(se.clades_of_levels(tips), tips)


_add("set_clades", fr.TIPS, se.clades_of_levels, f"{_T} SELECT * FROM cl")
_add("set_clade_frequencies", fr.TIPS, _set(se.clade_frequencies), f"{_T} SELECT * FROM fq")
_add("set_consensus", fr.TIPS, _set(lambda c, t: se.consensus(c, t, 0.1)), f"{_T} SELECT * FROM fq WHERE frequency >= 0.1")
_add("set_mcc", fr.TIPS, _set(se.maximum_clade_credibility), f"{_T} SELECT tree_id, ROUND(SUM(frequency), 6) AS score FROM cl JOIN fq ON fq.clade = cl.clade GROUP BY 1 ORDER BY score DESC, tree_id LIMIT 1")
_add("set_credible", fr.TIPS, _set(se.credible_set), f"""{_T}, r AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY frequency DESC, clade) AS INT) AS rank, clade, frequency, ROUND(SUM(frequency) OVER (ORDER BY frequency DESC, clade ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM fq) SELECT * FROM r WHERE cumulative - frequency < 0.95""")
_add("set_topologies", fr.TIPS, _set(se.topologies), f"{_TOPO} SELECT * FROM tp")
_add("set_topology_diversity", fr.TIPS, _set(se.topology_diversity), f"""{_TOPO}, p AS (SELECT CAST(tree_count AS DOUBLE) / (SELECT SUM(tree_count) FROM tp) AS p FROM tp) SELECT COUNT(*) AS topologies, ROUND(EXP(-SUM(p * LN(p))), 6) AS effective, ROUND(MAX(p), 9) AS largest_share FROM p""")
_add("set_multimodality", fr.TIPS, _set(lambda c, t: se.multimodality(c, t, 0.01)), f"""{_TOPO}, p AS (SELECT signature, tree_count, ROUND(CAST(tree_count AS DOUBLE) / (SELECT SUM(tree_count) FROM tp), 9) AS share FROM tp) SELECT * FROM p WHERE share >= 0.01""")
_add("set_rf_to_consensus", fr.TIPS, _set(lambda c, t: se.robinson_foulds_to(c, t, se.consensus(c, t, 0.1))), f"""{_T}, rf AS (SELECT clade FROM fq WHERE frequency >= 0.1), l AS (SELECT t.tree_id, COUNT(cl.clade) AS ls, COUNT(rf.clade) AS shared FROM trees t LEFT JOIN cl ON cl.tree_id = t.tree_id LEFT JOIN rf ON rf.clade = cl.clade GROUP BY 1),
d AS (SELECT tree_id, shared, ls + (SELECT COUNT(*) FROM rf) - 2 * shared AS distance, ls + (SELECT COUNT(*) FROM rf) AS tot FROM l) SELECT tree_id, shared, distance, ROUND(CASE WHEN tot > 0 THEN CAST(distance AS DOUBLE) / tot ELSE 0 END, 9) AS normalised FROM d""")
_add("set_rf_matrix", fr.TIPS, _set(se.topology_distance_matrix), f"""{_TOPO}, s AS (SELECT LEFT(SHA256(signature), 12) AS t, list_filter(string_split(signature, ';'), lambda x: x <> '') AS c FROM tp)
SELECT a.t AS "left", b.t AS "right", CAST(LEN(a.c) + LEN(b.c) - 2 * LEN(list_intersect(a.c, b.c)) AS INT) AS distance FROM s a JOIN s b ON a.t < b.t""")
_COMPAT = f"""{_T}, pr AS (SELECT a.clade AS "left", b.clade AS "right", LEN(list_intersect(string_split(a.clade, '|'), string_split(b.clade, '|'))) AS k, LEN(string_split(a.clade, '|')) AS l, LEN(string_split(b.clade, '|')) AS r, ROUND(LEAST(a.frequency, b.frequency), 9) AS weaker FROM fq a JOIN fq b ON a.clade < b.clade)"""
_add("set_compatibility", fr.TIPS, _set(se.compatibility), f"""{_COMPAT} SELECT "left", "right", k = 0 OR k = l OR k = r AS compatible, weaker FROM pr""")
_add("set_conflicts", fr.TIPS, _set(lambda c, t: se.conflicts(c, t, 0.05)), f"""{_COMPAT} SELECT "left", "right", weaker FROM pr WHERE NOT (k = 0 OR k = l OR k = r) AND weaker >= 0.05""")
_add("set_clade_correlation", fr.TIPS, _set(se.cooccurrence), f"""{_T}, b AS (SELECT a.clade AS "left", b.clade AS "right", COUNT(*) AS together FROM cl a JOIN cl b ON a.tree_id = b.tree_id AND a.clade < b.clade GROUP BY 1, 2), n AS (SELECT COUNT(*) AS n FROM trees),
v AS (SELECT b.*, x.tree_count AS x, y.tree_count AS y, n FROM b JOIN fq x ON x.clade = b."left" JOIN fq y ON y.clade = b."right" CROSS JOIN n)
SELECT "left", "right", together, ROUND((n * together - x * y) / NULLIF(SQRT(CAST(x AS DOUBLE) * (n - x) * y * (n - y)), 0), 6) AS phi FROM v""")
_add("set_unstable_taxa", fr.TIPS, se.unstable_taxa, f"""{_T}, g AS (SELECT tree_id, a, STRING_AGG(tip, '|' ORDER BY tip) AS company FROM tips GROUP BY 1, 2), p AS (SELECT tip, company, COUNT(*) AS n FROM tips JOIN g ON g.tree_id = tips.tree_id AND g.a = tips.a GROUP BY 1, 2)
SELECT tip, CAST(SUM(n) AS BIGINT) AS trees, COUNT(*) AS placements, ROUND(1 - CAST(MAX(n) AS DOUBLE) / SUM(n), 9) AS instability FROM p GROUP BY 1""")


def _halves(tips: DataFrame) -> DataFrame:
    low, high = tips.where("n <= 2"), tips.where("n > 2")
    return se.compare_sets(se.clades_of_levels(low), low, se.clades_of_levels(high), high)


_part = lambda x, where: f"""{x} AS (SELECT * FROM tips WHERE {where}), {x}c AS (SELECT DISTINCT c.tree_id, clade FROM (SELECT tree_id, STRING_AGG(tip, '|' ORDER BY tip) AS clade, COUNT(*) AS size FROM {x} GROUP BY tree_id, a
  UNION ALL SELECT tree_id, STRING_AGG(tip, '|' ORDER BY tip), COUNT(*) FROM {x} GROUP BY tree_id, a, b) c JOIN (SELECT tree_id, COUNT(*) AS taxa FROM {x} GROUP BY 1) z ON z.tree_id = c.tree_id WHERE size > 1 AND size < taxa),
{x}f AS (SELECT clade, ROUND(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(DISTINCT tree_id) FROM {x}), 9) AS f FROM {x}c GROUP BY 1)"""  # noqa: E731
_add("set_compare", fr.TIPS, _halves, f"""WITH tips AS ({fr.TIPS}), {_part('lo', 'n <= 2')}, {_part('hi', 'n > 2')}
SELECT COALESCE(lof.clade, hif.clade) AS clade, COALESCE(lof.f, 0) AS left_frequency, COALESCE(hif.f, 0) AS right_frequency, ROUND(COALESCE(hif.f, 0) - COALESCE(lof.f, 0), 9) AS delta FROM lof FULL JOIN hif ON hif.clade = lof.clade""")

# Traces

_TR = f"WITH tr AS ({fr.TRACE})"
_MOM = f"{_TR}, d AS (SELECT chain, iteration, value - AVG(value) OVER (PARTITION BY chain) AS d, COUNT(*) OVER (PARTITION BY chain) AS n FROM tr)"
_acf = lambda most: f"{_MOM}, lg AS (SELECT UNNEST(generate_series(0, {most})) AS lag), s AS (SELECT a.chain, CAST(lg.lag AS INT) AS lag, SUM(a.d * b.d) AS s FROM d a CROSS JOIN lg JOIN d b ON b.chain = a.chain AND b.iteration = a.iteration - lg.lag GROUP BY 1, 2), acf AS (SELECT s.chain, s.lag, ROUND(s.s / NULLIF(z.s, 0), 6) AS rho FROM s JOIN s z ON z.chain = s.chain AND z.lag = 0)"
_add("mcmc_acf", fr.TRACE, tr.autocorrelation, f"{_acf(10)} SELECT * FROM acf")
_add("mcmc_ess", fr.TRACE, tr.effective_sample_size, f"""{_MOM}, s AS (SELECT a.chain, a.iteration - b.iteration AS lag, SUM(a.d * b.d) AS s FROM d a JOIN d b ON b.chain = a.chain AND b.iteration <= a.iteration GROUP BY 1, 2), acf AS (SELECT s.chain, s.lag, ROUND(s.s / NULLIF(z.s, 0), 6) AS rho FROM s JOIN s z ON z.chain = s.chain AND z.lag = 0), e AS (SELECT *, MAX(CASE WHEN rho <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY chain ORDER BY lag ROWS UNBOUNDED PRECEDING) AS ended FROM acf WHERE lag > 0), t AS (SELECT chain, 1 + 2 * SUM(rho) AS tau FROM e WHERE ended = 0 GROUP BY 1), n AS (SELECT chain, COUNT(*) AS n FROM tr GROUP BY 1)
SELECT n.chain, n, ROUND(COALESCE(tau, 1), 6) AS tau, ROUND(n / COALESCE(tau, 1), 4) AS ess FROM n LEFT JOIN t ON t.chain = n.chain""")
_add("mcmc_hpd", fr.TRACE, tr.highest_density_interval, f"""{_TR}, s AS (SELECT chain, value, ROW_NUMBER() OVER (PARTITION BY chain ORDER BY value, iteration) AS i, COUNT(*) OVER (PARTITION BY chain) AS n FROM tr), p AS (SELECT a.chain, a.i, a.value AS lower, b.value AS upper, ROUND(b.value - a.value, 9) AS width FROM s a JOIN s b ON b.chain = a.chain AND b.i = a.i + CAST(CEIL(a.n * 0.95) AS INT) - 1),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chain ORDER BY width, i) AS k FROM p) SELECT chain, lower, upper, width FROM r WHERE k = 1""")
_add("mcmc_eti", fr.TRACE, tr.equal_tail_interval, f"{_TR} SELECT chain, ROUND(QUANTILE_CONT(value, 0.025), 6) AS lower, ROUND(QUANTILE_CONT(value, 0.5), 6) AS median, ROUND(QUANTILE_CONT(value, 0.975), 6) AS upper FROM tr GROUP BY 1")
_add("mcmc_summary", fr.TRACE, tr.summary, f"{_TR} SELECT chain, COUNT(*) AS n, ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_SAMP(value), 6) AS sd, MIN(value) AS least, MAX(value) AS most FROM tr GROUP BY 1")
_add("mcmc_burnin", fr.TRACE, lambda t: tr.summary(tr.discard_burnin(t, 0.25)), f"{_TR}, b AS (SELECT *, COUNT(*) OVER (PARTITION BY chain) AS nn FROM tr) SELECT chain, COUNT(*) AS n, ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_SAMP(value), 6) AS sd, MIN(value) AS least, MAX(value) AS most FROM b WHERE iteration > FLOOR(nn * 0.25) GROUP BY 1")
_add("mcmc_burnin_shifts", fr.TRACE, tr.burnin_shifts, f"""{_TR}, b AS (SELECT *, COUNT(*) OVER (PARTITION BY chain) AS nn, AVG(value) OVER (PARTITION BY chain) AS whole FROM tr), f(burnin) AS (VALUES (CAST(0.1 AS DOUBLE)), (0.25), (0.5))
SELECT chain, burnin, ROUND(AVG(value), 6) AS mean, ROUND(AVG(value) - MAX(whole), 6) AS shift FROM b JOIN f ON iteration > FLOOR(nn * burnin) GROUP BY 1, 2""")
_add("mcmc_mean_shift", fr.TRACE, tr.standardised_mean_shift, f"{_TR}, b AS (SELECT *, iteration > FLOOR(COUNT(*) OVER (PARTITION BY chain) / 2) AS late FROM tr) SELECT chain, ROUND((AVG(CASE WHEN late THEN value END) - AVG(CASE WHEN NOT late THEN value END)) / NULLIF(STDDEV_SAMP(value), 0), 6) AS shift FROM b GROUP BY 1")
_add("mcmc_gelman_rubin", fr.TRACE, tr.gelman_rubin, f"""{_TR}, m AS (SELECT MIN(k) AS m FROM (SELECT COUNT(*) AS k FROM tr GROUP BY chain) q), c AS (SELECT chain, AVG(value) AS mean, VAR_SAMP(value) AS v FROM tr, m WHERE iteration <= m GROUP BY 1), r AS (SELECT COUNT(*) AS chains, AVG(v) AS w, VAR_SAMP(mean) AS b FROM c)
SELECT chains, m, ROUND(SQRT((CAST(m - 1 AS DOUBLE) / m * w + b) / NULLIF(w, 0)), 6) AS r_hat FROM r, m""")
_add("mcmc_running_mean", fr.TRACE, tr.running_mean, f"{_TR} SELECT chain, iteration, ROUND(AVG(value) OVER (PARTITION BY chain ORDER BY iteration ROWS UNBOUNDED PRECEDING), 8) AS running_mean FROM tr")
_OBS = "SELECT user_id AS chain, MAX(value) / 2 AS observed FROM events GROUP BY user_id"
_add("mcmc_predictive_p", fr.TRACE, tr.predictive_p_values, f"{_TR}, o AS ({_OBS}) SELECT tr.chain, ROUND(AVG(CASE WHEN value >= observed THEN 1.0 ELSE 0.0 END), 9) AS p_upper, ROUND(AVG(CASE WHEN value <= observed THEN 1.0 ELSE 0.0 END), 9) AS p_lower FROM tr JOIN o ON o.chain = tr.chain GROUP BY 1", observed=_OBS)

# Tables

_LEFT, _RIGHT = "SELECT CAST(doc_id AS VARCHAR(19)) AS taxon FROM documents", "SELECT CAST(doc_id AS VARCHAR(19)) AS taxon FROM labels"
_THIRD = "SELECT CAST(vec_id AS VARCHAR(19)) AS taxon FROM embeddings"
_add("tbl_name_check", _LEFT, ta.name_check, f"WITH a AS ({_LEFT}), b AS ({_RIGHT}) SELECT DISTINCT taxon, 'left_only' AS side FROM a WHERE taxon NOT IN (SELECT taxon FROM b) UNION ALL SELECT DISTINCT taxon, 'right_only' FROM b WHERE taxon NOT IN (SELECT taxon FROM a)", right=_RIGHT)
_add("tbl_link", _RIGHT, ta.link, f"WITH a AS (SELECT DISTINCT taxon FROM ({_RIGHT}) q), b AS (SELECT DISTINCT taxon FROM ({_THIRD}) q) SELECT COALESCE(a.taxon, b.taxon) AS taxon, CASE WHEN a.taxon IS NOT NULL AND b.taxon IS NOT NULL THEN 'matched' WHEN a.taxon IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS status FROM a FULL JOIN b ON a.taxon = b.taxon", right=_THIRD)
_X = f"WITH x AS (SELECT taxon, 'documents' AS s FROM ({_LEFT}) q UNION ALL SELECT taxon, 'labels' FROM ({_RIGHT}) q UNION ALL SELECT taxon, 'vectors' FROM ({_THIRD}) q), cw AS (SELECT taxon, BOOL_OR(s = 'documents') AS in_documents, BOOL_OR(s = 'labels') AS in_labels, BOOL_OR(s = 'vectors') AS in_vectors, COUNT(DISTINCT s) AS surfaces FROM x GROUP BY 1)"
_surfaces = lambda a, b, c: {"documents": a, "labels": b, "vectors": c}
_add("tbl_crosswalk", _LEFT, lambda a, b, c: ta.crosswalk(_surfaces(a, b, c)), f"{_X} SELECT * FROM cw", b=_RIGHT, c=_THIRD)
_add("tbl_mismatches", _LEFT, lambda a, b, c: ta.mismatches(_surfaces(a, b, c)), f"{_X} SELECT taxon, CONCAT_WS('|', CASE WHEN NOT in_documents THEN 'documents' END, CASE WHEN NOT in_labels THEN 'labels' END, CASE WHEN NOT in_vectors THEN 'vectors' END) AS missing FROM cw WHERE NOT (in_documents AND in_labels AND in_vectors)", b=_RIGHT, c=_THIRD)
_add("tbl_first_loss", _LEFT, lambda a, b, c: ta.first_loss(_surfaces(a, b, c)), f"{_X} SELECT CASE WHEN NOT in_labels THEN 'labels' WHEN NOT in_vectors THEN 'vectors' ELSE 'kept' END AS lost_at, COUNT(*) AS taxa FROM cw WHERE in_documents GROUP BY 1", b=_RIGHT, c=_THIRD)
_add("tbl_prune", _LEFT, ta.prune_to, f"{_LEFT.replace('SELECT', 'SELECT', 1)} WHERE doc_id IN (SELECT doc_id FROM labels)", taxa=_RIGHT)
_add("tbl_drop", _LEFT, ta.drop_taxa, f"{_LEFT} WHERE doc_id NOT IN (SELECT doc_id FROM labels)", taxa=_RIGHT)
_TRAITS = "SELECT CAST(p_partkey AS VARCHAR(19)) AS taxon, p_name AS name, p_brand AS brand, CAST(p_size AS VARCHAR(9)) AS size, CASE WHEN p_size > 10 THEN CAST(p_retailprice AS VARCHAR(19)) ELSE '' END AS price, CASE WHEN p_size % 2 = 0 THEN '0' ELSE '1' END AS flag, '' AS note FROM part"
_COLS = ["name", "brand", "size", "price", "flag", "note"]
_CELLS = f"WITH t AS ({_TRAITS}), c AS ({' UNION ALL '.join(f'''SELECT taxon, '{c}' AS trait, "{c}" AS value FROM t''' for c in _COLS)}), k AS (SELECT trait, CAST(SUM(CAST(value <> '' AS INT)) AS BIGINT) AS filled, CAST(SUM(CAST(value = '' AS INT)) AS BIGINT) AS missing, COUNT(DISTINCT CASE WHEN value <> '' THEN value END) AS distinct_values, BOOL_AND(CASE WHEN value <> '' THEN TRY_CAST(value AS DOUBLE) IS NOT NULL END) AS nu, BOOL_OR(CASE WHEN value <> '' THEN value LIKE '% %' END) AS sp FROM c GROUP BY 1)"
_add("tbl_trait_kinds", _TRAITS, lambda t: ta.trait_kinds(t, _COLS), f"{_CELLS} SELECT trait, filled, missing, distinct_values, CASE WHEN filled = 0 THEN 'empty' WHEN nu THEN 'numeric' WHEN sp THEN 'text' ELSE 'categorical' END AS kind FROM k")
_add("tbl_completeness", _TRAITS, lambda t: ta.completeness(t, _COLS), f"{_CELLS} SELECT trait, ROUND(CAST(filled AS DOUBLE) / (filled + missing), 9) AS completeness FROM k")
_add("tbl_missing_cells", _TRAITS, lambda t: ta.missing_cells(t, _COLS), f"{_CELLS} SELECT taxon, trait FROM c WHERE value = ''")
_KEYS = "SELECT c_name AS taxon FROM customer UNION ALL SELECT 'Customer#000000001' AS taxon FROM customer WHERE c_custkey % 50 = 0"
_add("tbl_key_audit", _KEYS, ta.key_audit, f"SELECT taxon, COUNT(*) AS n FROM ({_KEYS}) q GROUP BY 1 HAVING COUNT(*) > 1 OR taxon IS NULL OR taxon = ''")
_NAMES = "SELECT concat(p_name, ' ', p_brand, ' (', p_type, ')') AS name FROM part"
_add("taxa_keys", _NAMES, lambda t: t.select("name", ta.taxon_key("name").alias("taxon_key")), f"SELECT name, TRIM(REGEXP_REPLACE(name, '[^0-9A-Za-z._-]+', '_', 'g'), '_') AS taxon_key FROM ({_NAMES}) q")
_add("taxa_collisions", _NAMES, lambda t: ta.key_collisions(t.unionByName(t.select(F.replace("name", F.lit(" "), F.lit("_")).alias("name"))), "name"), f"WITH n AS (SELECT name FROM ({_NAMES}) q UNION SELECT REPLACE(name, ' ', '_') FROM ({_NAMES}) r) SELECT TRIM(REGEXP_REPLACE(name, '[^0-9A-Za-z._-]+', '_', 'g'), '_') AS key, COUNT(*) AS labels, MIN(name) AS first_label FROM n GROUP BY 1 HAVING COUNT(*) > 1")
_ALL = "SELECT c_name AS name FROM customer UNION ALL SELECT p_name AS name FROM part UNION ALL SELECT n_name AS name FROM nation UNION ALL SELECT concat('Homo_', lower(n_name)) AS name FROM nation UNION ALL SELECT concat('XY', CAST(n_nationkey + 10000 AS VARCHAR(9)), '.1') AS name FROM nation UNION ALL SELECT concat('strain ', n_name) AS name FROM nation UNION ALL SELECT concat('tip-', CAST(n_nationkey + 10 AS VARCHAR(9))) AS name FROM nation"
_add("taxa_namespaces", _ALL, lambda t: ta.namespaces(t, "name"), r"""SELECT CASE WHEN REGEXP_MATCHES(name, '^[A-Z]{1,4}_?\d{4,}(?:\.\d+)?$|^[A-Z]{2}\d{6,}(?:\.\d+)?$') THEN 'accession_id' WHEN REGEXP_MATCHES(name, '^[A-Z][a-z]+(?:[ _][a-z][a-z-]+){1,2}$') THEN 'species_name' WHEN REGEXP_MATCHES(lower(name), 'isolate|strain|clone|cultivar|lineage') THEN 'isolate_id'
WHEN REGEXP_MATCHES(lower(name), 'sample|specimen|individual|indiv|voucher') OR REGEXP_MATCHES(name, '^[A-Za-z]+[-_]\d{2,}$') THEN 'sample_id' ELSE 'user_defined_label' END AS namespace, COUNT(*) AS n, COUNT(DISTINCT name) AS labels FROM (""" + f"{_ALL}) q GROUP BY 1")
_LAB, _SYN = "SELECT p_name AS label FROM part", "SELECT DISTINCT p_name AS raw, p_type AS accepted FROM part WHERE p_size < 4"
_add("taxa_synonyms", _LAB, ta.resolve_synonyms, f"""WITH s AS (SELECT raw, COUNT(DISTINCT accepted) AS k, MIN(accepted) AS accepted FROM ({_SYN}) q GROUP BY 1), r AS (SELECT l.label, s.accepted, CASE WHEN k IS NULL THEN 'unlisted' WHEN k > 1 THEN 'ambiguous' WHEN accepted = label THEN 'accepted' ELSE 'renamed' END AS status FROM (SELECT DISTINCT label FROM ({_LAB}) q) l LEFT JOIN s ON s.raw = l.label)
SELECT label, CASE WHEN status = 'ambiguous' THEN label ELSE COALESCE(accepted, label) END AS accepted, status FROM r""", synonyms=_SYN)
_O1, _O2 = "SELECT n_name AS taxon, COUNT(*) AS position FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name", "SELECT n_name AS taxon, COUNT(*) * 1000 + MIN(n_nationkey) AS position FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name"
_O1 = _O1.replace("COUNT(*) AS", "COUNT(*) * 1000 + MIN(n_nationkey) AS")
_add("tbl_ordering_drift", _O1, ta.ordering_drift, f"WITH j AS (SELECT a.taxon, CAST(ROW_NUMBER() OVER (ORDER BY a.position) AS INT) AS rank, CAST(ROW_NUMBER() OVER (ORDER BY b.position) AS INT) AS other_rank FROM ({_O1}) a JOIN ({_O2}) b ON a.taxon = b.taxon) SELECT * FROM j WHERE rank <> other_rank", other=_O2)

# Comparative statistics

_TV = "SELECT p_brand AS clade, p_type AS kind, p_retailprice AS value FROM part"
_add("trait_summary", _TV, lambda t: co.trait_summary(t, ["clade", "kind"]), f"SELECT clade, kind, COUNT(value) AS n, ROUND(AVG(value), 6) AS mean, ROUND(VAR_SAMP(value), 4) AS variance, MIN(value) AS least, MAX(value) AS most FROM ({_TV}) q GROUP BY 1, 2")
_add("trait_disparity", _TV, lambda t: co.disparity(t, ["clade"]), f"SELECT clade, COUNT(value) AS n, ROUND(2 * VAR_SAMP(value), 4) AS disparity FROM ({_TV}) q GROUP BY 1")
_add("trait_relative_disparity", _TV, lambda t: co.relative_disparity(t, ["clade"]), f"SELECT clade, COUNT(value) AS n, ROUND(VAR_SAMP(value) / NULLIF((SELECT VAR_SAMP(value) FROM ({_TV}) r), 0), 6) AS relative_disparity FROM ({_TV}) q GROUP BY 1")
_add("trait_anova", _TV, lambda t: co.one_way_anova(t, "clade"), f"""WITH t AS ({_TV}), g AS (SELECT clade, COUNT(*) AS n, AVG(value) AS m, VAR_SAMP(value) AS v FROM t GROUP BY 1), s AS (SELECT COUNT(*) AS groups, CAST(SUM(n) AS BIGINT) AS total, SUM(n * POWER(m - (SELECT AVG(value) FROM t), 2)) AS b, SUM((n - 1) * COALESCE(v, 0)) AS w FROM g)
SELECT groups, total, ROUND((b / (groups - 1)) / (w / (total - groups)), 6) AS f FROM s""")
_OT = "SELECT c_nationkey AS clade, c_custkey AS taxon, c_acctbal AS value FROM customer"
_add("trait_outliers", _OT, lambda t: co.outliers(t, ["clade"], 1.7), f"SELECT * FROM (SELECT *, ROUND((value - AVG(value) OVER (PARTITION BY clade)) / NULLIF(STDDEV_SAMP(value) OVER (PARTITION BY clade), 0), 6) AS z FROM ({_OT}) q) r WHERE ABS(z) >= 1.7")
_ST = "SELECT c_nationkey AS clade, c_mktsegment AS state FROM customer"
_add("state_imbalance", _ST, lambda t: co.state_imbalance(t, ["clade"], 0.18), f"WITH n AS (SELECT clade, state, COUNT(*) AS n FROM ({_ST}) q GROUP BY 1, 2), s AS (SELECT *, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY clade) AS sh FROM n) SELECT clade, state, n, ROUND(sh, 9) AS share, sh < 0.18 AS rare FROM s")
_CO = "SELECT a.c_nationkey AS clade, a.c_acctbal - b.c_acctbal AS x, a.c_custkey % 7 - b.c_custkey % 7 AS y FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 AND a.c_nationkey = b.c_nationkey"
_add("pic_regression", _CO, lambda t: co.regression_through_origin(t, ["clade"]), f"SELECT clade, COUNT(*) AS n, ROUND(SUM(x * y) / NULLIF(SUM(x * x), 0), 6) AS slope FROM ({_CO}) q GROUP BY 1")
_PC = "SELECT a.c_custkey AS taxon, a.c_acctbal AS left_value, b.c_acctbal AS right_value, CAST(1 + a.c_custkey % 7 AS DOUBLE) AS left_length, CAST(1 + b.c_custkey % 7 AS DOUBLE) AS right_length FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1"
_add("pic_sisters", _PC, co.sister_contrasts, f"SELECT *, ROUND((left_value - right_value) / SQRT(left_length + right_length), 9) AS contrast FROM ({_PC}) q")
_FITS = "SELECT p_brand AS dataset, p_type AS model, -CAST(SUM(CAST(p_retailprice * 100 AS BIGINT) % 9973) AS DOUBLE) / 64 AS lnl, COUNT(DISTINCT p_size) % 5 + 1 AS k, COUNT(*) AS n FROM part GROUP BY p_brand, p_type"
_add("stat_aicc_weights", _FITS, lambda t: co.rank_models(t, ["dataset"]), f"""WITH f AS (SELECT * FROM ({_FITS}) q WHERE lnl IS NOT NULL), a AS (SELECT *, ROUND(2 * k - 2 * lnl, 6) AS aic, ROUND(CASE WHEN n - k - 1 > 0 THEN 2 * k - 2 * lnl + 2 * k * (k + 1) / CAST(n - k - 1 AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END, 6) AS aicc FROM f),
r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY dataset ORDER BY aicc, aic, model) AS INT) AS rank, ROUND(aicc - MIN(aicc) OVER (PARTITION BY dataset), 6) AS delta FROM a)
SELECT *, ROUND(EXP(-delta / 2) / SUM(EXP(-delta / 2)) OVER (PARTITION BY dataset), 6) AS weight FROM r""")
_TESTS = "SELECT p_brand AS family, p_partkey AS test, ROUND(CAST(p_partkey * 7919 % 10007 AS DOUBLE) / 10007, 9) AS p FROM part"
_add("stat_bh", _TESTS, lambda t: co.benjamini_hochberg(t, ["family"]), f"""WITH t AS ({_TESTS}), r AS (SELECT *, COUNT(*) OVER (PARTITION BY family) AS m, CAST(ROW_NUMBER() OVER (PARTITION BY family ORDER BY p, test) AS INT) AS i FROM t),
q AS (SELECT *, ROUND(MIN(LEAST(1.0, p * m / i)) OVER (PARTITION BY family ORDER BY i DESC ROWS UNBOUNDED PRECEDING), 9) AS q FROM r) SELECT family, test, p, i, q, q <= 0.05 AS significant FROM q""")
_CH = "SELECT concat('size', CAST(p_size % 10 AS INT)) AS character, p_partkey AS taxon, p_brand AS state FROM part"
_add("pars_bounds", _CH, co.consistency_bounds, f"WITH n AS (SELECT \"character\", state, COUNT(*) AS n FROM ({_CH.replace('AS character', 'AS \"character\"')}) q GROUP BY 1, 2) SELECT \"character\", COUNT(*) - 1 AS min_steps, CAST(SUM(n) - MAX(n) AS BIGINT) AS max_steps, CAST(SUM(n) AS BIGINT) AS taxa FROM n GROUP BY 1")
_FI = "SELECT o_custkey AS tree_id, o_orderpriority AS grp, o_orderpriority AS grp_order, o_orderkey AS tip_order, o_orderstatus AS state FROM orders"
_FOLD = "lambda a, x: CASE WHEN len(list_intersect(a.s, x.s)) > 0 THEN {'s': list_intersect(a.s, x.s), 'steps': a.steps + x.steps} ELSE {'s': list_distinct(list_concat(a.s, x.s)), 'steps': a.steps + x.steps + 1} END"
_add("pars_fitch", _FI, co.fitch_two_level, f"""WITH t AS ({_FI}), g AS (SELECT tree_id, grp, grp_order, list_reduce(list({{'s': [state], 'steps': CAST(0 AS BIGINT)}} ORDER BY tip_order), {_FOLD}) AS f FROM t GROUP BY 1, 2, 3),
r AS (SELECT tree_id, list_reduce(list(f ORDER BY grp_order), {_FOLD}) AS f FROM g GROUP BY 1) SELECT tree_id, f.steps AS steps, array_to_string(list_sort(f.s), '|') AS root_states FROM r""")
_ED = "SELECT n.c_mktsegment AS parent_state, c.c_mktsegment AS child_state FROM customer n JOIN customer c ON c.c_custkey = n.c_custkey + 25 AND n.c_nationkey <= c.c_nationkey"
_add("anc_transitions", _ED, co.transitions, f"SELECT parent_state, child_state, COUNT(*) AS n FROM ({_ED}) q WHERE parent_state <> child_state GROUP BY 1, 2")
_GEO = "SELECT a.c_custkey AS taxon, CAST(a.c_custkey * 37 % 180 - 90 AS DOUBLE) AS lat1, CAST(a.c_custkey * 53 % 360 - 180 AS DOUBLE) AS lon1, CAST(a.c_nationkey * 7 - 85 AS DOUBLE) AS lat2, CAST(a.c_nationkey * 14 - 170 AS DOUBLE) AS lon2 FROM customer a"
_add("geo_great_circle", _GEO, lambda t: t.select("taxon", F.round(co.great_circle_km(*(F.col(c) for c in ("lat1", "lon1", "lat2", "lon2"))), 4).alias("km")), f"SELECT taxon, ROUND(2 * 6371.0088 * ASIN(SQRT(LEAST(POWER(SIN((RADIANS(lat2) - RADIANS(lat1)) / 2), 2) + COS(RADIANS(lat1)) * COS(RADIANS(lat2)) * POWER(SIN((RADIANS(lon2) - RADIANS(lon1)) / 2), 2), 1.0))), 4) AS km FROM ({_GEO}) q")

# Numeric work per alignment or tree: checked by tests, not by SQL

from cladewise.plans import comparative as pc  # noqa: E402
from cladewise.plans import joining, likelihood, parsimony, sampling  # noqa: E402
from cladewise.sources import newick  # noqa: E402

for _m in joining.METHODS:
    _add(f"dist_tree_{_m}", fr.SITES, lambda s, m=_m: joining.trees(di.distances(s), m))
_add("dist_merges", fr.SITES, lambda s: joining.merges(di.distances(s)))
_add("dist_residuals", fr.SITES, lambda s: joining.residuals(di.distances(s)))
_add("dist_bootstrap", fr.SITES, joining.bootstrap)


def _trees(sites: DataFrame, method: str = "upgma") -> DataFrame:
    return joining.trees(di.distances(sites), method).select(F.col("aln_id").alias("tree_id"), "newick")


def _scored(sites: DataFrame) -> DataFrame:
    own = joining.trees(di.distances(sites), "upgma").select("aln_id", "newick")
    return likelihood.site_likelihoods(sites, own)


_add("lik_models", fr.SITES, likelihood.fit_models)
_add("lik_model_ranking", fr.SITES, lambda s: co.rank_models(likelihood.fit_models(s), ["aln_id"]))
_add("lik_sites", fr.SITES, _scored)
_PLN = lambda x: f"LN(GREATEST({x}, 1e-300))"
_add("lik_two_taxa", fr.SITES, lambda s: likelihood.two_taxon_jc69(di.distances(s)), f"""{_COUNTS}, d AS ({_DIST('p')}) SELECT aln_id, "left", "right", ROUND(CASE WHEN distance < 1 THEN (1 - distance) * comparable_sites * LN(0.25 * GREATEST(1 - distance, 1e-300)) ELSE 0 END + CASE WHEN distance > 0 THEN distance * comparable_sites * LN(GREATEST(distance, 1e-300) / 12) ELSE 0 END, 6) AS lnl
FROM d WHERE "left" < "right" AND comparable_sites > 0 AND distance < 0.75""")


def _characters(sites: DataFrame) -> DataFrame:
    states = sites.select(F.col("aln_id").alias("tree_id"), F.col("site").cast("string").alias("character"), "taxon", F.when(F.col("residue").isin("A", "G"), "1").otherwise("0").alias("state"))
    return parsimony.scores(_trees(sites), states)


_add("pars_scores", fr.SITES, _characters)
_TRAITS_OF = "SELECT l_suppkey AS tree_id, concat(l_returnflag, l_linestatus) AS taxon, AVG(l_extendedprice) / 1000 AS value, AVG(l_quantity) AS quantity, AVG(l_discount) AS discount FROM lineitem GROUP BY l_suppkey, concat(l_returnflag, l_linestatus)"
_add("pgls_fit", fr.SITES, lambda s, traits: pc.pgls(_trees(s), traits, "value", ["quantity", "discount"]), traits=_TRAITS_OF)
_add("signal", fr.SITES, lambda s, traits: pc.signal(_trees(s), traits), traits=_TRAITS_OF)
_add("pic_trees", fr.SITES, lambda s, traits: pc.independent_contrasts(_trees(s), traits), traits=_TRAITS_OF)
_add("trait_modes", fr.SITES, lambda s, traits: co.rank_models(pc.modes(_trees(s), traits), ["tree_id"]), traits=_TRAITS_OF)
_add("anc_continuous", fr.SITES, lambda s, traits: pc.reconstruct(_trees(s), traits), traits=_TRAITS_OF)
_add("mk_fit", fr.SITES, lambda s, traits: pc.fit_mk(_trees(s), traits.withColumn("state", F.when(F.col("quantity") > 25.5, "high").otherwise("low"))), traits=_TRAITS_OF)
_add("sim_traits", fr.SITES, lambda s: sampling.simulate_traits(_trees(s)))
_add("sim_dna", fr.SITES, lambda s: sampling.simulate_dna(_trees(s)))
_add("sim_histories", fr.SITES, lambda s: sampling.simulate_histories(_trees(s)))
_add("sim_birth_death", "SELECT o_custkey AS tree_id, CAST(2 + COUNT(*) % 20 AS INT) AS tips FROM orders GROUP BY o_custkey", sampling.simulate_trees)
_add("mcmc_chains", "SELECT user_id AS chain, value FROM events", lambda e: tr.summary(tr.discard_burnin(sampling.mean_chains(e), 0.25).select("chain", "iteration", "value")))
_add("io_newick_nodes", fr.SITES, lambda s: newick.parse_trees(_trees(s)).select("tree_id", "node_id", "parent_id", "name", "is_tip", F.round("branch_length", 9).alias("branch_length"), "pre", "post", "level"))
_add("io_newick_roundtrip", fr.SITES, lambda s: newick.dump_trees(newick.parse_trees(_trees(s))).join(_trees(s).select(F.col("tree_id").cast("string").alias("tree_id"), F.col("newick").alias("before")), "tree_id").select("tree_id", (F.col("before") == F.col("newick")).alias("same")))

from cladewise.plans import reconcile, topology  # noqa: E402


def _both(sites: DataFrame) -> DataFrame:
    """(tree_id, a, b): the trees of two methods for each alignment."""
    return _trees(sites, "nj").withColumnRenamed("newick", "a").join(_trees(sites, "upgma").withColumnRenamed("newick", "b"), "tree_id")


def _each(columns: str, f: Callable[..., list[tuple]]) -> Callable[[DataFrame], DataFrame]:
    """Rows of ``f(tree_id, a, b)`` for each alignment's two trees."""
    import pandas as pd

    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [r for i, a, b in zip(batch["tree_id"], batch["a"], batch["b"], strict=True) for r in f(i, newick.parse(a), newick.parse(b))]
            yield pd.DataFrame(rows, columns=names)

    return lambda sites: _both(sites).select("tree_id", "a", "b").mapInPandas(run, columns)


def _compare(i, a, b):
    c = topology.compare(topology.reroot_at_midpoint(a), b)
    return [(i, c["shared_tips"], c["distance"], round(c["normalised"], 9), None if c["branch_score"] is None else round(c["branch_score"], 9))]


def _consensus(i, a, b):
    counts: dict[str, int] = {}
    for t in (topology.reroot_at_midpoint(a), b):
        for c in joining.clades(t):
            counts[c] = counts.get(c, 0) + 1
    tree_, blocked = topology.extended_consensus(sorted(topology.tips(b)), counts, 2)
    return [(i, newick.dump(tree_), len(blocked))]


def _reconciled(i, a, b):
    gene, species = topology.reroot_at_midpoint(a), b
    d, losses = reconcile.duplications_losses(gene, species)
    return [(i, reconcile.deep_coalescences(gene, species), d, losses, reconcile.transfer_cost(gene, species))]


_add("cmp_trees", fr.SITES, _each("tree_id long, shared_tips int, distance int, normalised double, branch_score double", _compare))
_add("cmp_quartets", fr.SITES, _each("tree_id long, agreeing int, conflicting int, unresolved int", lambda i, a, b: [(i, *topology.quartet_agreement(topology.reroot_at_midpoint(a), b))]))
_add("cmp_agreement_subtree", fr.SITES, _each("tree_id long, tips int, members string", lambda i, a, b: [(i, len(m := topology.agreement_subtree([topology.reroot_at_midpoint(a), b])), "|".join(m))]))
_add("set_extended_consensus", fr.SITES, _each("tree_id long, newick string, blocked int", _consensus))
_add("reconcile", fr.SITES, _each("tree_id long, deep_coalescences int, duplications int, losses int, transfer_cost double", _reconciled))
_add("bayes_priors", fr.SITES, _each("tree_id long, yule double, coalescent double, lengths double, topology double", lambda i, a, b: [(i, round(reconcile.yule_log_prior(b, 1.0), 6), round(reconcile.coalescent_log_prior(b, 1.0), 6), round(reconcile.branch_length_log_prior(b, "exponential", 10.0), 6), round(reconcile.topology_log_prior(len(topology.tips(b))), 6))]))
_add("tree_neighborhoods", fr.SITES, lambda s: topology.neighborhoods(_trees(s)))
_add("tree_midpoint", fr.SITES, lambda s: topology.transformed(_trees(s, "nj"), topology.reroot_at_midpoint))
_add("tree_unroot", fr.SITES, lambda s: topology.transformed(_trees(s), topology.unroot))
_add("tree_ladderize", fr.SITES, lambda s: topology.transformed(_trees(s), topology.ladderize))
_add("tree_collapse", fr.SITES, lambda s: topology.transformed(_trees(s), lambda t: topology.collapse_short(t, 0.02)))
_add("tree_outgroup", fr.SITES, lambda s: topology.transformed(_trees(s, "nj"), lambda t: topology.reroot_on_outgroup(t, [min(topology.tips(t))])))

from cladewise.plans import discrete, leastsquares  # noqa: E402

_BANDS = "SELECT l_suppkey AS tree_id, concat(l_returnflag, l_linestatus) AS taxon, CASE WHEN AVG(l_quantity) < 25 THEN 'low' WHEN AVG(l_quantity) < 26 THEN 'middle' ELSE 'high' END AS state FROM lineitem GROUP BY l_suppkey, concat(l_returnflag, l_linestatus)"
_BINARY = "SELECT l_suppkey AS tree_id, concat(l_returnflag, l_linestatus) AS taxon, CASE WHEN AVG(l_quantity) < 25.5 THEN 0 ELSE 1 END AS x, CASE WHEN AVG(l_discount) < 0.05 THEN 0 ELSE 1 END AS y FROM lineitem GROUP BY l_suppkey, concat(l_returnflag, l_linestatus)"
_add("mk_models", fr.SITES, lambda s, states: co.rank_models(discrete.model_fits(_trees(s), states), ["tree_id"]), states=_BANDS)
_add("anc_discrete", fr.SITES, lambda s, states: discrete.ancestral(_trees(s), states), states=_BANDS)
_add("anc_discrete_certainty", fr.SITES, lambda s, states: discrete.state_transitions(discrete.ancestral(_trees(s), states)), states=_BANDS)
_add("stochastic_maps", fr.SITES, lambda s, states: discrete.maps(_trees(s), states), states=_BANDS)
_add("correlated_traits", fr.SITES, lambda s, traits: discrete.correlated(_trees(s), traits), traits=_BINARY)
_add("dist_least_squares", fr.SITES, lambda s: leastsquares.fits(di.distances(s)))
_add("dist_bme_search", fr.SITES, lambda s: leastsquares.search(di.distances(s)))
_add("dist_influence", fr.SITES, lambda s: leastsquares.influence(di.distances(s)))

from cladewise import reviews as _reviews  # noqa: E402, F401
from cladewise import shapes as _shapes  # noqa: E402, F401
from cladewise import records as _records  # noqa: E402, F401
from cladewise import diffusion as _diffusion  # noqa: E402, F401
