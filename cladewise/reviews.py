"""Registered queries of the reviews, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise import frames as fr
from cladewise import queries as q
from cladewise.operators import alignment as al
from cladewise.operators import distance as di
from cladewise.operators import moves as mv
from cladewise.operators import reviews as rv
from cladewise.operators import tables as ta
from cladewise.operators import traces as tr
from cladewise.operators import trees as tree
from cladewise.operators import treesets as se
from cladewise.sources import nexus, tokens

_add, _S, _N, _T, _KNOWN, _AMB = q._add, q._S, q._N, q._T, q._KNOWN, q._AMB

# Alignments

_PLAIN, _AMINO = (", ".join(f"'{c}'" for c in letters) for letters in ("ACGTUN-?", "ACDEFGHIKLMNPQRSTVWYBXZ*-?"))
_add("aln_alphabet", fr.SITES, rv.alphabet, f"""{_S} SELECT aln_id, CASE WHEN BOOL_AND(residue IN ({_PLAIN})) AND NOT BOOL_OR(residue = 'U') THEN 'dna' WHEN BOOL_AND(residue IN ({_PLAIN})) AND NOT BOOL_OR(residue = 'T') THEN 'rna'
WHEN BOOL_AND(residue IN ({_AMINO})) THEN 'protein' ELSE 'unknown' END AS alphabet FROM sites GROUP BY 1""")
_add("aln_invalid_characters", fr.SITES, rv.invalid_characters, f"{_S} SELECT aln_id, taxon, site, residue FROM sites WHERE residue NOT IN ('A','C','G','T','-')")
_ACIDS = ", ".join(f"'{c}'" for c in "ACDEFGHIKLMNPQRSTVWY")
_add("aln_amino_acids", fr.SITES, lambda s: rv.amino_acid_composition(al.translate(s)), f"""{q._TRANS}, n AS (SELECT aln_id, amino_acid, COUNT(*) AS n FROM tran WHERE amino_acid IN ({_ACIDS}) GROUP BY 1, 2)
SELECT aln_id, amino_acid, n, ROUND(CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY aln_id), 9) AS share FROM n""")
_RAW = f"{_S}, raw AS (SELECT aln_id, taxon, CAST(SUM(CASE WHEN residue <> '-' THEN 1 ELSE 0 END) AS BIGINT) AS raw_length, COUNT(*) AS length FROM sites GROUP BY 1, 2)"
_add("aln_raw_lengths", fr.SITES, rv.raw_lengths, f"{_RAW} SELECT * FROM raw")
_add("aln_kinds", fr.SITES, rv.classify, f"""{_RAW} SELECT aln_id, MIN(length) AS least, MAX(length) AS most, BOOL_OR(raw_length < length) AS gapped,
CASE WHEN MIN(length) < MAX(length) THEN 'unaligned' WHEN BOOL_OR(raw_length < length) THEN 'aligned' ELSE 'equal' END AS kind FROM raw GROUP BY 1""")
_add("aln_length_outliers", fr.SITES, rv.length_outliers, f"""{_RAW}, m AS (SELECT aln_id, MEDIAN(raw_length) AS mid, COUNT(*) AS records FROM raw GROUP BY 1), o AS (SELECT raw.*, mid, records, ABS(raw_length - mid) AS off FROM raw JOIN m ON m.aln_id = raw.aln_id), d AS (SELECT aln_id, MEDIAN(off) AS mad FROM o GROUP BY 1),
z AS (SELECT o.*, ROUND(0.6744897501960817 * (raw_length - mid) / NULLIF(mad, 0), 6) AS robust_z FROM o JOIN d ON d.aln_id = o.aln_id), f AS (SELECT *, records >= 3 AND mid > 0 AND (off >= 0.2 * mid OR COALESCE(ABS(robust_z) >= 3.5, FALSE)) AS outlier FROM z)
SELECT aln_id, taxon, raw_length, mid AS median_length, robust_z, outlier, CASE WHEN outlier THEN CASE WHEN raw_length > mid THEN 'longer than baseline' ELSE 'shorter than baseline' END END AS note FROM f""")
_add("aln_over_aligned", fr.SITES, lambda s: rv.over_aligned(al.windows(s)), f"""WITH w AS ({q.SQL['aln_windows']}) SELECT aln_id, start, stop, ROUND(gap_fraction + missing_fraction, 9) AS uncertainty, variable_fraction FROM w WHERE ROUND(gap_fraction + missing_fraction, 9) >= 0.4 AND variable_fraction <= 0.2""")
_add("aln_disagreement", fr.SITES, rv.site_disagreement, f"{_S}, n AS (SELECT aln_id, site, residue, COUNT(*) AS n FROM sites WHERE {_KNOWN} GROUP BY 1, 2, 3) SELECT aln_id, site, ROUND(1 - CAST(MAX(n) AS DOUBLE) / SUM(n), 9) AS disagreement FROM n GROUP BY 1, 2")
_add("aln_low_information", fr.SITES, lambda s: rv.low_information(al.summary(s)), f"""WITH s AS ({q.SQL['aln_summary']}), f AS (SELECT aln_id, sites, variable, informative, ROUND(CAST(informative AS DOUBLE) / sites, 9) AS informative_fraction FROM s)
SELECT *, variable = 0 AND informative < 1 AS low_information, CASE WHEN variable = 0 AND informative < 1 THEN 1 ELSE 0 END AS reasons FROM f""")
_add("aln_missing_concentration", fr.SITES, lambda s: rv.missing_concentration(s, 0.3), f"""{_S}, m AS (SELECT aln_id, site, AVG(CASE WHEN residue = '?' OR {_AMB} THEN 1.0 ELSE 0.0 END) AS share FROM sites GROUP BY 1, 2),
w AS (SELECT aln_id, COUNT(*) AS sites, MAX(share) AS most, COUNT(*) FILTER (share >= 0.3) AS concentrated FROM m GROUP BY 1),
x AS (SELECT m.aln_id, COUNT(*) AS worst_columns, MIN(site) AS first_worst FROM m JOIN w ON w.aln_id = m.aln_id AND m.share = w.most GROUP BY 1),
r AS (SELECT aln_id, COUNT(*) AS n, MIN(site) AS a, MAX(site) AS b FROM (SELECT *, site - ROW_NUMBER() OVER (PARTITION BY aln_id ORDER BY site) AS i FROM m WHERE share >= 0.3) z GROUP BY aln_id, i),
l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY aln_id ORDER BY n DESC, a) AS k FROM r)
SELECT w.aln_id, concentrated, ROUND(CAST(concentrated AS DOUBLE) / sites, 9) AS concentrated_fraction, COALESCE(n, 0) AS longest_run, a AS run_start, b AS run_end, ROUND(most, 9) AS most, worst_columns, first_worst FROM w JOIN x ON x.aln_id = w.aln_id LEFT JOIN l ON l.aln_id = w.aln_id AND k = 1""")
_CMP = f"{_S}, cmp AS (SELECT aln_id, taxon, CAST(SUM(CASE WHEN residue NOT IN ('-','?') THEN 1 ELSE 0 END) AS BIGINT) AS comparable FROM sites GROUP BY 1, 2)"
_add("aln_frameshifts", fr.SITES, rv.frameshifts, f"{_CMP} SELECT *, CAST(comparable % 3 AS INT) AS excess FROM cmp WHERE comparable % 3 <> 0")
_add("aln_coding_behaviour", fr.SITES, rv.coding_behaviour, f"""{_CMP}, st AS ({q.SQL['aln_stop_codons']}), n AS (SELECT aln_id, taxon, COUNT(*) AS stops FROM st WHERE kind = 'internal' GROUP BY 1, 2),
f AS (SELECT cmp.aln_id, cmp.taxon, comparable % 3 = 0 AS framed, COALESCE(stops, 0) AS stops FROM cmp LEFT JOIN n ON n.aln_id = cmp.aln_id AND n.taxon = cmp.taxon)
SELECT *, CASE WHEN framed AND stops = 0 THEN 'coding' WHEN framed OR stops = 0 THEN 'ambiguous' ELSE 'noncoding' END AS behaviour FROM f""")
_LOCI = f"SELECT CAST(FLOOR(aln_id / 4) AS BIGINT) AS matrix, aln_id AS locus, taxon, site, residue FROM ({fr.SITES}) z WHERE NOT (aln_id % 4 = 1 AND taxon = 'AF')"
_L = f"WITH loci AS ({_LOCI}), len AS (SELECT matrix, locus, CAST(MAX(site) AS BIGINT) AS length FROM loci GROUP BY 1, 2), spot AS (SELECT *, COALESCE(SUM(length) OVER (PARTITION BY matrix ORDER BY locus ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM len)"
_add("aln_concatenate", _LOCI, rv.concatenate, f"""{_L}, cell AS (SELECT spot.matrix, spot.locus, taxon, shift, UNNEST(generate_series(1, CAST(length AS INT))) AS site FROM spot JOIN (SELECT DISTINCT matrix, taxon FROM loci) x ON x.matrix = spot.matrix)
SELECT c.matrix, c.taxon, CAST(c.shift + c.site AS BIGINT) AS site, COALESCE(l.residue, '-') AS residue FROM cell c LEFT JOIN loci l ON l.matrix = c.matrix AND l.locus = c.locus AND l.taxon = c.taxon AND l.site = c.site""")
_add("aln_partitions", _LOCI, rv.partition_summary, f"""{_L}, f AS (SELECT matrix, locus, COUNT(DISTINCT taxon) AS taxa, SUM(CASE WHEN residue NOT IN ('-','?') THEN 1 ELSE 0 END) AS filled FROM loci GROUP BY 1, 2)
SELECT spot.matrix, spot.locus, CAST(shift + 1 AS BIGINT) AS start, CAST(shift + length AS BIGINT) AS stop, taxa, ROUND(CAST(filled AS DOUBLE) / (length * taxa), 9) AS completeness FROM spot JOIN f ON f.matrix = spot.matrix AND f.locus = spot.locus""")
_add("aln_partition_slices", fr.SITES, rv.partition_slices, f"{_S} SELECT aln_id, taxon, CAST(FLOOR((site - 1) / 10) AS INT) AS part, STRING_AGG(residue, '' ORDER BY site) AS seq FROM sites GROUP BY 1, 2, 3")
_add("aln_compare_versions", fr.SITES, lambda s: rv.compare_versions(s, s.where("site % 7 <> 0").withColumn("residue", F.when((F.col("residue") == "N") & (F.col("site") % 2 == 0), "-").otherwise(F.col("residue")))), f"""{_S} SELECT aln_id, CAST(SUM(CASE WHEN site % 7 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS shared, CAST(SUM(CASE WHEN site % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS left_only, CAST(0 AS BIGINT) AS right_only,
CAST(SUM(CASE WHEN site % 7 <> 0 AND residue = 'N' AND site % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM sites GROUP BY 1""")
_add("aln_expand_patterns", fr.SITES, rv.expand_patterns, f"{_S}, c AS (SELECT aln_id, site, STRING_AGG(residue, '' ORDER BY taxon) AS pattern FROM sites GROUP BY 1, 2) SELECT *, MIN(site) OVER (PARTITION BY aln_id, pattern) AS first_site FROM c")
_add("aln_remove_missing_columns", fr.SITES, al.remove_all_missing_columns, f"""{_S}, k AS (SELECT aln_id, site, CAST(ROW_NUMBER() OVER (PARTITION BY aln_id ORDER BY site) AS INT) AS new FROM (SELECT aln_id, site FROM sites GROUP BY 1, 2 HAVING NOT BOOL_AND(residue = '?' OR {_AMB})) q)
SELECT s.aln_id, s.taxon, k.new AS site, s.residue FROM sites s JOIN k ON k.aln_id = s.aln_id AND k.site = s.site""")

# Distances

_CD = f"WITH allsites AS ({fr.SITES}), whole AS (SELECT aln_id, site FROM allsites GROUP BY 1, 2 HAVING BOOL_AND(residue IN ('A','C','G','T'))), sites AS (SELECT s.* FROM allsites s JOIN whole w ON w.aln_id = s.aln_id AND w.site = s.site)"
_PD = lambda head: f"""{head}, k AS (SELECT a.aln_id, a.taxon AS "left", b.taxon AS "right", SUM(CASE WHEN {q._OKB} THEN 1 ELSE 0 END) AS n, SUM(CASE WHEN {q._OKB} AND a.residue <> b.residue THEN 1 ELSE 0 END) AS mm FROM sites a JOIN sites b ON a.aln_id = b.aln_id AND a.site = b.site AND a.taxon < b.taxon GROUP BY 1, 2, 3) SELECT aln_id, "left", "right", ROUND(CAST(mm AS DOUBLE) / NULLIF(n, 0), 9) AS distance FROM k"""
_add("dist_gap_policies", fr.SITES, lambda s: rv.compare_gap_policies(di.distances(s), di.distances(rv.complete_deletion(s))), f"""SELECT x.aln_id, x."left", x."right", x.distance AS pairwise, y.distance AS complete, ROUND(y.distance - x.distance, 9) AS delta
FROM ({_PD(_S)}) x LEFT JOIN ({_PD(_CD)}) y ON x.aln_id = y.aln_id AND x."left" = y."left" AND x."right" = y."right\"""")
_add("dist_impute", fr.SITES, lambda s: rv.impute_distances(di.distances(s, "k80")), f"""{q._COUNTS}, d AS (SELECT * FROM ({q._DIST('k80')}) z WHERE "left" < "right"), m AS (SELECT aln_id, ROUND(AVG(distance), 6) AS mean FROM d GROUP BY 1)
SELECT d.aln_id, "left", "right", ROUND(COALESCE(distance, mean), 6) AS distance, distance IS NULL AS imputed FROM d JOIN m ON m.aln_id = d.aln_id""")

# Trees

_CID = f"{_N}, u AS ({q._UP}), cid AS (SELECT tree_id, ancestor AS name, STRING_AGG(tip, '|' ORDER BY tip) AS clade, COUNT(*) AS tips FROM u GROUP BY 1, 2)"
_add("tree_clade_ids", fr.NODES, rv.clade_ids, f"{_CID} SELECT * FROM cid")
_ROOT = "kid AS (SELECT tree_id, parent AS name, COUNT(*) AS c FROM nodes WHERE parent IS NOT NULL GROUP BY 1, 2), rooting AS (SELECT tree_id, BOOL_OR(c > 2) AS polytomy, COALESCE(MAX(CASE WHEN name = 'root' THEN c END) = 2, FALSE) AS rooted FROM kid GROUP BY 1)"
_add("tree_rooting", fr.NODES, rv.rooting, f"{_N}, {_ROOT} SELECT * FROM rooting")
_add("tree_branch_lengths", fr.NODES, rv.branch_length_distribution, f"""{_N}, b AS (SELECT tree_id, branch_length AS b FROM nodes WHERE parent IS NOT NULL), s AS (SELECT tree_id, COUNT(*) AS branches, MEDIAN(b) AS median, ROUND(QUANTILE_CONT(b, 0.95), 6) AS p95, CAST(SUM(CASE WHEN b = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero, CAST(SUM(CASE WHEN b < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative FROM b GROUP BY 1)
SELECT s.*, (SELECT COUNT(*) FROM b WHERE b.tree_id = s.tree_id AND b.b > 2 * s.median) AS far FROM s""")
_add("tree_shape_distribution", fr.NODES, lambda n: rv.shape_distribution(tree.shape(n)), f"WITH s AS ({q.SQL['tree_shape']}) SELECT tips, COUNT(*) AS trees, ROUND(AVG(sackin), 6) AS mean_sackin, MIN(sackin) AS least_sackin, MAX(sackin) AS most_sackin, ROUND(AVG(cherries), 6) AS mean_cherries FROM s GROUP BY 1")
_add("tree_tip_distances", fr.NODES, rv.tip_distances, f"""{_N}, u AS ({q._UP}) SELECT a.tree_id, a.tip AS "left", b.tip AS "right", ROUND(MAX(a.td) + MAX(b.td) - 2 * MAX(a.ad), 6) AS distance FROM u a JOIN u b ON a.tree_id = b.tree_id AND a.ancestor = b.ancestor AND a.tip < b.tip GROUP BY 1, 2, 3""")
_TOPS = "SELECT DISTINCT o_custkey AS tree_id, concat('R', CAST(year(o_orderdate) AS INT)) AS name FROM orders WHERE o_custkey % 3 = 0"
_add("tree_extract", fr.NODES, rv.extract_clades, f"""{_N}, top AS (SELECT n.* FROM nodes n JOIN ({_TOPS}) t ON t.tree_id = n.tree_id AND t.name = n.name)
SELECT n.tree_id, t.name AS clade_root, n.name, CASE WHEN n.pre <> t.pre THEN n.parent END AS parent, ROUND(n.root_dist - t.root_dist, 9) AS depth FROM nodes n JOIN top t ON t.tree_id = n.tree_id AND n.pre BETWEEN t.pre AND t.post""", roots=_TOPS)
_YEARS = "SELECT o_custkey AS tree_id, CAST(year(o_orderdate) AS INT) AS \"group\", concat('C', CAST(o_orderkey AS VARCHAR(19))) AS tip FROM orders"
_add("tree_clades_of_taxa", fr.NODES, rv.clades_of_taxa, f"""{_CID}, w AS (SELECT tree_id, "group", STRING_AGG(tip, '|' ORDER BY tip) AS clade FROM ({_YEARS}) z GROUP BY 1, 2) SELECT cid.tree_id, w."group", name, tips FROM cid JOIN w ON w.tree_id = cid.tree_id AND w.clade = cid.clade""", groups=_YEARS.replace('"group"', "`group`"))
_add("tree_clade_ages", fr.NODES, rv.clade_ages, f"{_CID}, {q._AGE} SELECT cid.tree_id, clade, age FROM cid JOIN age ON age.tree_id = cid.tree_id AND age.name = cid.name")
_add("tree_time_tree", fr.NODES, rv.time_tree, f"""{_N}, {_ROOT}, p AS (SELECT tree_id, BOOL_AND(branch_length > 0) AS positive FROM nodes WHERE parent IS NOT NULL GROUP BY 1), um AS (SELECT tree_id, ROUND(MAX(root_dist) - MIN(root_dist), 6) <= 1e-6 AS ultrametric FROM nodes WHERE is_tip GROUP BY 1)
SELECT rooting.*, positive, ultrametric, rooted AND NOT polytomy AND positive AND ultrametric AS usable FROM rooting JOIN p ON p.tree_id = rooting.tree_id JOIN um ON um.tree_id = rooting.tree_id""")
_add("div_outlier_clades", fr.NODES, rv.diversification_outliers, f"""{_N}, {q._AGE}, {q._SIZE}, r AS (SELECT n.tree_id, n.name, size.tips, age, LN(size.tips) / age AS rate FROM nodes n JOIN age ON age.tree_id = n.tree_id AND age.name = n.name JOIN size ON size.tree_id = n.tree_id AND size.name = n.name WHERE age > 0 AND size.tips >= 2),
m AS (SELECT tree_id, AVG(rate) AS m, STDDEV_POP(rate) AS s FROM r GROUP BY 1), z AS (SELECT r.*, ROUND(CASE WHEN s > 1e-12 THEN (rate - m) / s ELSE 0 END, 6) AS z FROM r JOIN m ON m.tree_id = r.tree_id)
SELECT tree_id, name, tips, age, ROUND(rate, 6) AS rate, z, CASE WHEN z >= 1 THEN 'high' WHEN z <= -1 THEN 'low' ELSE 'baseline' END AS kind FROM z""")

# Tree sets and pairs of trees

_set = q._set
_CL = f"""WITH tips AS ({fr.TIPS}), len AS (SELECT DISTINCT tree_id, clade, size, length FROM (SELECT tree_id, STRING_AGG(tip, '|' ORDER BY tip) AS clade, COUNT(*) AS size, ROUND(AVG(n) / 10, 6) AS length FROM tips GROUP BY tree_id, a
  UNION ALL SELECT tree_id, STRING_AGG(tip, '|' ORDER BY tip), COUNT(*), ROUND(AVG(n) / 10, 6) FROM tips GROUP BY tree_id, a, b) z WHERE size > 1 AND size < 5),
pr AS (SELECT COALESCE(a.tree_id, b.tree_id - 1) AS pair, COALESCE(a.clade, b.clade) AS clade, a.length AS "left", b.length AS "right" FROM len a FULL JOIN len b ON b.tree_id - 1 = a.tree_id AND b.clade = a.clade)"""


def _pairs(f):
    return lambda tips: f(rv.with_next(rv.clade_lengths(tips)))


_add("cmp_clade_changes", fr.TIPS, _pairs(rv.clade_changes), f"""{_CL} SELECT pair, clade, CASE WHEN "right" IS NULL THEN 'lost' ELSE 'gained' END AS status FROM pr WHERE "left" IS NULL OR "right" IS NULL""")
_add("cmp_clade_sets", fr.TIPS, _pairs(rv.clade_sets), f"""{_CL}, n AS (SELECT pair, CAST(SUM(CASE WHEN "left" IS NOT NULL AND "right" IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS shared, CAST(SUM(CASE WHEN "right" IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS left_only, CAST(SUM(CASE WHEN "left" IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS right_only FROM pr GROUP BY 1)
SELECT *, ROUND(CAST(shared AS DOUBLE) / (shared + left_only + right_only), 9) AS jaccard FROM n""")
_add("cmp_branch_lengths", fr.TIPS, _pairs(rv.compare_branch_lengths), f"""{_CL} SELECT pair, clade, "left", "right", ROUND("right" - "left", 6) AS delta, ROUND("right" / NULLIF("left", 0), 6) AS ratio FROM pr WHERE "left" IS NOT NULL AND "right" IS NOT NULL""")
_add("cmp_support", fr.TIPS, _pairs(rv.compare_support), f"""{_CL}, s AS (SELECT pair, clade, COALESCE("left", 0) AS "left", COALESCE("right", 0) AS "right" FROM pr) SELECT *, CASE WHEN "left" >= 0.2 AND "right" >= 0.2 THEN 'agreed' WHEN ("left" >= 0.2 AND "right" <= 0.1) OR ("right" >= 0.2 AND "left" <= 0.1) THEN 'conflict' ELSE 'open' END AS kind FROM s""")
_add("cmp_clade_overlap", fr.TIPS, _set(rv.clade_overlap), f"{_T} SELECT fq.clade, fq.tree_count, MIN(cl.tree_id) AS first_tree, fq.frequency = 1 AS universal FROM fq JOIN cl ON cl.clade = fq.clade GROUP BY 1, 2, 4")
_add("set_reference_support", fr.TIPS, lambda t: rv.reference_support(se.clades_of_levels(t.where("tree_id % 7 = 0")), se.clades_of_levels(t.where("tree_id % 7 <> 0")), t.where("tree_id % 7 <> 0")), f"""{_T}, o AS (SELECT clade, ROUND(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM trees WHERE tree_id % 7 <> 0), 9) AS f FROM cl WHERE tree_id % 7 <> 0 GROUP BY 1)
SELECT cl.tree_id, cl.clade, COALESCE(f, 0) AS support FROM cl LEFT JOIN o ON o.clade = cl.clade WHERE cl.tree_id % 7 = 0""")
_add("set_strict_consensus", fr.TIPS, _set(lambda c, t: se.consensus(c, t, 1.0)), f"{_T} SELECT * FROM fq WHERE frequency >= 1.0")
_EVERY = "(SELECT list_sort(list(DISTINCT tip)) FROM tips)"
_add("set_unrooted_splits", fr.TIPS, _set(rv.unrooted_splits), f"""{_T}, x AS (SELECT tree_id, clade AS o, size AS k, array_to_string(list_filter({_EVERY}, lambda t: NOT list_contains(string_split(clade, '|'), t)), '|') AS r FROM cl)
SELECT DISTINCT tree_id, CASE WHEN k < 5 - k OR (k = 5 - k AND o < r) THEN o ELSE r END AS split FROM x WHERE 5 - k > 1""")
_add("set_length_summary", fr.TIPS, lambda t: rv.length_summary(rv.clade_lengths(t)), f"{_CL} SELECT clade, COUNT(*) AS trees, ROUND(AVG(length), 6) AS mean, ROUND(MEDIAN(length), 6) AS median, MIN(length) AS least, MAX(length) AS most FROM len GROUP BY 1")
_add("set_unstable_clades", fr.TIPS, _set(rv.unstable_clades), f"""{q._COMPAT}, bad AS (SELECT * FROM pr WHERE NOT (k = 0 OR k = l OR k = r)), e AS (SELECT clade, COUNT(*) AS n FROM (SELECT "left" AS clade FROM bad UNION ALL SELECT "right" FROM bad) z GROUP BY 1)
SELECT fq.clade, frequency, COALESCE(n, 0) AS conflicts FROM fq LEFT JOIN e ON e.clade = fq.clade WHERE frequency < 1""")
_add("set_support_classes", fr.TIPS, _set(rv.support_classes), f"""{q._COMPAT}, bad AS (SELECT * FROM pr WHERE NOT (k = 0 OR k = l OR k = r)), e AS (SELECT clade, COUNT(*) AS n FROM (SELECT "left" AS clade FROM bad UNION ALL SELECT "right" FROM bad) z GROUP BY 1)
SELECT fq.clade, frequency, COALESCE(n, 0) AS conflicts, CASE WHEN frequency >= 0.9 AND n IS NULL THEN 'robust' WHEN frequency BETWEEN 0.3 AND 0.7 THEN 'intermediate-support' WHEN n > 0 THEN 'credibility-conflicted' ELSE 'weak-support' END AS support FROM fq LEFT JOIN e ON e.clade = fq.clade""")
_add("set_thresholds", fr.TIPS, _set(rv.consensus_thresholds), f"{_T}, c(threshold) AS (VALUES (CAST(0.05 AS DOUBLE)), (0.1), (0.2), (0.5)) SELECT threshold, CAST(SUM(CASE WHEN frequency >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS clades, ROUND(MAX(frequency), 9) AS most FROM fq, c GROUP BY 1")
_thin = lambda k: f"SELECT {k} AS every, fq.clade, fq.frequency AS all_trees, COALESCE((SELECT ROUND(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM trees WHERE tree_id % {k} = 0), 9) FROM cl WHERE cl.clade = fq.clade AND cl.tree_id % {k} = 0), 0) AS thinned FROM fq"
_add("set_thinning", fr.TIPS, _set(rv.thinning), f"{_T}, z AS ({_thin(2)} UNION ALL {_thin(5)}) SELECT *, ROUND(thinned - all_trees, 9) AS delta FROM z")


def _halves(f):
    def run(tips: DataFrame) -> DataFrame:
        low, high = tips.where("tree_id % 2 = 0"), tips.where("tree_id % 2 = 1")
        return f(se.clades_of_levels(low), low, se.clades_of_levels(high), high)

    return run


_add("set_compare_diversity", fr.TIPS, _halves(rv.compare_diversity), f"""{q._TOPO}, h AS (SELECT CASE WHEN tree_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, signature, COUNT(*) AS c FROM sg GROUP BY 1, 2), n AS (SELECT side, SUM(c) AS n FROM h GROUP BY 1),
t AS (SELECT h.side, CAST(MAX(n) AS BIGINT) AS trees, COUNT(*) AS topologies, ROUND(MAX(CAST(c AS DOUBLE) / n), 9) AS dominant, ROUND(EXP(-SUM(CAST(c AS DOUBLE) / n * LN(CAST(c AS DOUBLE) / n))), 6) AS effective FROM h JOIN n ON n.side = h.side GROUP BY 1),
k AS (SELECT CASE WHEN tree_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, clade, CAST(COUNT(*) AS DOUBLE) AS c FROM cl GROUP BY 1, 2), d AS (SELECT k.side, SUM(c * (n - c)) AS d FROM k JOIN n ON n.side = k.side GROUP BY 1)
SELECT t.*, ROUND(d / (trees * (trees - 1) / 2), 6) AS mean_distance FROM t JOIN d ON d.side = t.side""")
_cut = lambda k: f"SELECT {k} AS cut, fq.clade, ROUND(COALESCE((SELECT ROUND(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM trees WHERE tree_id > {k}), 9) FROM cl WHERE cl.clade = fq.clade AND cl.tree_id > {k}), 0) - fq.frequency, 9) AS shift FROM fq"
_add("set_burnin_shifts", fr.TIPS, _set(lambda c, t: rv.burnin_clade_shifts(c, t, (50, 100))), f"{_T} {_cut(50)} UNION ALL {_cut(100)}")

# Traces

_HALF = f"""{q._TR}, b AS (SELECT *, COUNT(*) OVER (PARTITION BY chain) AS nn FROM tr), k AS (SELECT *, FLOOR(nn * 0.1) AS cut FROM b WHERE iteration > FLOOR(nn * 0.1)),
h AS (SELECT chain, COUNT(*) AS kept, ROUND((AVG(CASE WHEN iteration - cut > FLOOR((nn - cut) / 2) THEN value END) - AVG(CASE WHEN iteration - cut <= FLOOR((nn - cut) / 2) THEN value END)) / NULLIF(STDDEV_SAMP(value), 0), 6) AS shift FROM k GROUP BY 1)"""
_add("mcmc_burnin_diagnosis", fr.TRACE, rv.burnin_diagnosis, f"{_HALF} SELECT *, kept >= 4 AND COALESCE(ABS(shift) <= 0.5, FALSE) AS settled FROM h")
_add("mcmc_convergence", fr.TRACE, lambda t: rv.convergence(tr.effective_sample_size(t), tr.standardised_mean_shift(t)), f"WITH e AS ({q.SQL['mcmc_ess']}), s AS ({q.SQL['mcmc_mean_shift']}) SELECT e.chain, ess, shift, ess >= 20 AND COALESCE(ABS(shift) <= 0.5, FALSE) AS converged FROM e JOIN s ON s.chain = e.chain")
_MODELS = "SELECT user_id AS family, event_type AS model, CAST(ROUND(value * 100) AS BIGINT) AS value FROM events"
_add("mcmc_model_averages", _MODELS, rv.model_averages, f"""WITH n AS (SELECT family, model, COUNT(*) AS n, SUM(value) AS total FROM ({_MODELS}) z GROUP BY 1, 2)
SELECT family, model, n, ROUND(CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY family), 9) AS share, ROUND(CAST(total AS DOUBLE) / n, 6) AS mean, ROUND(CAST(SUM(total) OVER (PARTITION BY family) AS DOUBLE) / SUM(n) OVER (PARTITION BY family), 6) AS average FROM n""")

# Taxa and tables

_LABELS = "SELECT 'people' AS source, c_name AS label FROM customer UNION ALL SELECT 'things' AS source, p_name AS label FROM part UNION ALL SELECT 'places' AS source, n_name AS label FROM nation UNION ALL SELECT 'places' AS source, concat('sub', n_name, '-pop') AS label FROM nation UNION ALL SELECT 'people' AS source, concat('Homo sapiens ', lower(n_name)) AS label FROM nation UNION ALL SELECT 'samples' AS source, concat('Tip_', CAST(n_nationkey + 10 AS VARCHAR(9))) AS label FROM nation UNION ALL SELECT 'places' AS source, concat('XY', CAST(n_nationkey + 10000 AS VARCHAR(9))) AS label FROM nation"
_RANK = r"""CASE WHEN REGEXP_MATCHES(label, '^[A-Z]{1,4}_?\d{4,}(?:\.\d+)?$|^[A-Z]{2}\d{6,}(?:\.\d+)?$') THEN 'accession' WHEN REGEXP_MATCHES(label, '^[A-Z][a-z]+(?:[ _][a-z][a-z-]+){1,2}$') THEN 'species'
WHEN REGEXP_MATCHES(lower(label), 'isolate|strain|clone|cultivar|lineage|sample|specimen|individual|indiv|voucher') OR REGEXP_MATCHES(label, '^[A-Za-z]+[-_]\d{2,}$') THEN 'sample' WHEN REGEXP_MATCHES(label, '^[A-Z][a-z-]+$') THEN 'genus' WHEN REGEXP_MATCHES(lower(label), 'pop|lineage|clade') THEN 'population' ELSE 'unknown' END"""
_add("taxa_ranks", _LABELS, rv.ranks, f"SELECT source, label, {_RANK} AS rank FROM ({_LABELS}) z")
_add("taxa_rank_consistency", _LABELS, rv.rank_consistency, f"WITH n AS (SELECT source, {_RANK} AS rank, COUNT(*) AS n FROM ({_LABELS}) z GROUP BY 1, 2) SELECT *, COUNT(*) FILTER (rank <> 'unknown') OVER (PARTITION BY source) > 1 AS mixed FROM n")
_SAME = f"SELECT label FROM ({_LABELS}) y UNION ALL SELECT upper(p_name) AS label FROM part WHERE p_partkey % 3 = 0"
_add("taxa_identities", _SAME, rv.identities, f"WITH n AS (SELECT DISTINCT label, LOWER(REGEXP_REPLACE(label, '[^0-9A-Za-z]', '', 'g')) AS identity FROM ({_SAME}) z) SELECT identity, COUNT(*) AS labels, MIN(label) AS first_label, MAX(label) AS last_label FROM n GROUP BY 1 HAVING COUNT(*) > 1")
_RES = f"WITH res AS ({q.SQL['taxa_synonyms']})"
_add("taxa_synonym_audit", q._LAB, lambda t, synonyms: rv.synonym_audit(ta.resolve_synonyms(t, synonyms)), f"{_RES} SELECT status, COUNT(*) AS labels, COUNT(DISTINCT accepted) AS names FROM res GROUP BY 1", synonyms=q._SYN)
_add("taxa_accepted_names", q._LAB, lambda t, synonyms: ta.resolve_synonyms(t, synonyms).where("status <> 'ambiguous'").select("label", "accepted"), f"{_RES} SELECT label, accepted FROM res WHERE status <> 'ambiguous'", synonyms=q._SYN)
_add("taxa_mapping_conflicts", q._LAB, lambda t, synonyms: rv.mapping_conflicts(ta.resolve_synonyms(t, synonyms)), f"{_RES} SELECT accepted, COUNT(*) AS labels, MIN(label) AS first_label, CAST(SUM(CASE WHEN status = 'renamed' THEN 1 ELSE 0 END) AS BIGINT) AS renamed FROM res GROUP BY 1 HAVING COUNT(*) > 1", synonyms=q._SYN)
_RUNS = "SELECT CAST(year(o_orderdate) AS INT) AS run, o_custkey AS taxon FROM orders"
_add("taxa_stability", _RUNS, lambda t: rv.stability(t, 7), f"WITH n AS (SELECT taxon, COUNT(DISTINCT run) AS runs FROM ({_RUNS}) z GROUP BY 1) SELECT taxon, runs, ROUND(CAST(runs AS DOUBLE) / 7, 9) AS share, runs = 7 AS stable FROM n")
_ORDER, _TABLE = "SELECT c_nationkey AS grp, c_custkey AS taxon, c_custkey * 31 % 977 AS place FROM customer", "SELECT o_custkey AS taxon, CAST(SUM(o_totalprice) AS DECIMAL(20, 2)) AS spent FROM orders GROUP BY o_custkey"
_add("tbl_align_order", _ORDER, lambda o, table: rv.align_to_order(o, table.select("taxon", F.col("spent").cast("double").alias("spent"))), f"SELECT o.taxon, grp, place, CAST(spent AS DOUBLE) AS spent, CAST(ROW_NUMBER() OVER (PARTITION BY grp ORDER BY place, o.taxon) AS INT) AS rank FROM ({_ORDER}) o JOIN ({_TABLE}) t ON t.taxon = o.taxon", table=_TABLE)
_FIELDS = ["name", "brand", "size", "price", "flag", "note"]
_add("tbl_columns", q._TRAITS, lambda t: rv.column_report(t, _FIELDS), f"""{q._CELLS} SELECT trait AS field, filled, filled + missing AS "rows", distinct_values AS different FROM k""")
_add("tbl_readiness", q._LEFT, lambda a, b, c: rv.readiness(ta.crosswalk(q._surfaces(a, b, c))), f"{q._X} SELECT surfaces, COUNT(*) AS taxa FROM cw GROUP BY 1", b=q._RIGHT, c=q._THIRD)
_TRAIT = "SELECT p_brand AS grp, p_partkey AS taxon, CASE WHEN p_size > 3 THEN p_size END AS value FROM part"
_add("trait_readiness", _TRAIT, rv.trait_readiness, f"""WITH n AS (SELECT grp, COUNT(*) AS taxa, COUNT(value) AS "values", COUNT(DISTINCT value) AS different FROM ({_TRAIT}) z GROUP BY 1),
p AS (SELECT *, CONCAT_WS('|', CASE WHEN "values" < taxa THEN 'missing' END, CASE WHEN "values" < 3 THEN 'few' END, CASE WHEN different < 2 THEN 'constant' END) AS problems FROM n) SELECT *, problems = '' AS ready FROM p""")
_SAMPLED, _ALLTAXA = "SELECT c_nationkey AS grp, c_custkey AS taxon FROM customer JOIN orders ON o_custkey = c_custkey", "SELECT c_nationkey AS grp, c_custkey AS taxon FROM customer"
_DECLARED = "SELECT c_nationkey AS grp, c_custkey AS taxon, CASE c_custkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'many' WHEN 2 THEN '1.5' WHEN 3 THEN ' 0.25 ' ELSE '0.5' END AS fraction FROM customer WHERE c_custkey % 13 > 0"
_add("div_sampling", _ALLTAXA, rv.sampling_fractions, f"""WITH j AS (SELECT t.grp, d.taxon IS NOT NULL AS there, TRIM(fraction) AS raw, TRY_CAST(TRIM(fraction) AS DOUBLE) AS v FROM ({_ALLTAXA}) t LEFT JOIN ({_DECLARED}) d ON d.grp = t.grp AND d.taxon = t.taxon),
n AS (SELECT grp, COUNT(*) FILTER (there) AS matched, COUNT(*) FILTER (NOT there) AS missing_taxa, COUNT(*) FILTER (raw = '') AS missing, COUNT(*) FILTER (raw <> '' AND v IS NULL) AS invalid, COUNT(*) FILTER (v <= 0 OR v > 1) AS out_of_range, ROUND(AVG(v) FILTER (v > 0 AND v <= 1), 9) AS fraction, COUNT(DISTINCT v) FILTER (v > 0 AND v <= 1) > 1 AS heterogeneous FROM j GROUP BY 1)
SELECT *, missing_taxa + missing + invalid + out_of_range = 0 AS complete FROM n""", declared=_DECLARED)

# States along branches

_EDGES = """SELECT * FROM (SELECT o_custkey AS tree_id, LAG(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent_state, o_orderpriority AS child_state,
CAST(o_orderkey % 100 AS DOUBLE) / 100 AS support, CAST(2000 - year(o_orderdate) AS DOUBLE) AS age FROM orders) e WHERE parent_state IS NOT NULL"""
_E = f"WITH e AS ({_EDGES}), mv AS (SELECT * FROM e WHERE parent_state <> child_state)"
_STATES = "SELECT o_orderkey AS taxon, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderpriority END AS state FROM orders"
_LEGAL = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
_add("state_illegal", _STATES, lambda s: rv.illegal_states(s, _LEGAL), f"SELECT state, COUNT(*) AS n, MIN(taxon) AS first_taxon FROM ({_STATES}) z WHERE state IS NULL OR state NOT IN {_LEGAL} GROUP BY 1")
_CODING = "SELECT DISTINCT o_orderpriority AS state, CAST(substr(o_orderpriority, 1, 1) AS INT) AS code FROM orders WHERE o_orderpriority < '4'"
_add("state_coding", _STATES, rv.state_coding, f"WITH n AS (SELECT state, COUNT(*) AS taxa FROM ({_STATES}) z GROUP BY 1) SELECT n.state, code, taxa, code IS NOT NULL AS coded FROM n LEFT JOIN ({_CODING}) c ON c.state = n.state", coding=_CODING)
_add("geo_migration_events", _EDGES, rv.migration_events, f"{_E} SELECT parent_state, child_state, CASE WHEN support >= 0.9 THEN 'strong' WHEN support >= 0.6 THEN 'moderate' ELSE 'weak' END AS sure, COUNT(*) AS events, MIN(age) AS youngest, MAX(age) AS oldest FROM mv GROUP BY 1, 2, 3")
_ALLOWED = "SELECT DISTINCT a.o_orderpriority AS parent_state, b.o_orderpriority AS child_state FROM (SELECT DISTINCT o_orderpriority FROM orders) a JOIN (SELECT DISTINCT o_orderpriority FROM orders) b ON a.o_orderpriority < b.o_orderpriority"
#: Below a support of 0.3 the second host is the parent's, below 0.6 it is another one.
_CHILD_SET = "CASE WHEN support < 0.3 THEN array(child_state, parent_state) WHEN support < 0.6 THEN array(child_state, '9-NONE') ELSE array(child_state) END AS child_set"
_add("host_switches", _EDGES, lambda e, allowed: rv.switches(e.selectExpr("*", _CHILD_SET, "array(parent_state) AS parent_set"), allowed), f"""{_E}, n AS (SELECT parent_state, child_state, CASE WHEN support < 0.6 THEN 'uncertain_switch' ELSE 'certain_switch' END AS certainty, COUNT(*) AS switches, ROUND(AVG(support), 6) AS support FROM mv GROUP BY 1, 2, 3)
SELECT n.*, a.parent_state IS NOT NULL AS allowed FROM n LEFT JOIN ({_ALLOWED}) a ON a.parent_state = n.parent_state AND a.child_state = n.child_state""", allowed=_ALLOWED)
_add("niche_retention", _EDGES, rv.retention, f"{_E} SELECT parent_state AS state, COUNT(*) AS branches, CAST(SUM(CASE WHEN parent_state = child_state THEN 1 ELSE 0 END) AS BIGINT) AS stay, ROUND(CAST(SUM(CASE WHEN parent_state <> child_state THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 9) AS leaving FROM e GROUP BY 1")
_BINS = "SELECT DISTINCT CAST(FLOOR((2000 - year(o_orderdate)) / 2) AS INT) AS bin, CAST(FLOOR((2000 - year(o_orderdate)) / 2) * 2 AS DOUBLE) AS from_age, CAST(FLOOR((2000 - year(o_orderdate)) / 2) * 2 + 2 AS DOUBLE) AS to_age FROM orders"
_add("geo_transitions_by_time", _EDGES, rv.transitions_by_time, f"{_E} SELECT bin, parent_state, child_state, COUNT(*) AS n FROM mv JOIN ({_BINS}) b ON age >= from_age AND age < to_age GROUP BY 1, 2, 3", bins=_BINS)
_add("geo_chronology", _EDGES, rv.chronology, f"{_E} SELECT parent_state, child_state, COUNT(*) AS n, MAX(age) AS first, ROUND(MEDIAN(age), 6) AS median, MIN(age) AS last FROM mv GROUP BY 1, 2")
_REGIONS = "SELECT n_name AS area, c_custkey AS taxon FROM customer JOIN nation ON c_nationkey = n_nationkey"
_add("geo_sampling_weights", _REGIONS, lambda t: rv.sampling_weights(t.withColumnRenamed("area", "region")), f"WITH n AS (SELECT area AS region, COUNT(*) AS tips FROM ({_REGIONS}) z GROUP BY 1) SELECT region, tips, ROUND(CAST(tips AS DOUBLE) / (SELECT SUM(tips) FROM n), 9) AS share, ROUND(CAST((SELECT SUM(tips) FROM n) AS DOUBLE) / ((SELECT COUNT(*) FROM n) * tips), 9) AS weight FROM n")

# Transformations and two-state parsimony

_BITS = "SELECT o_custkey AS tree_id, concat('C', CAST(o_orderkey AS VARCHAR(19))) AS name, CASE WHEN o_orderkey % 3 = 0 THEN '1' ELSE '0' END AS state FROM orders"
_ONES = f"""{_N}, b AS ({_BITS}), o AS (SELECT a.tree_id, a.name, a.parent, a.pre, a.post, a.level, COUNT(*) AS tips, SUM(CASE WHEN b.state = '1' THEN 1 ELSE 0 END) AS ones FROM nodes a JOIN nodes t ON t.tree_id = a.tree_id AND t.is_tip AND t.pre BETWEEN a.pre AND a.post JOIN b ON b.tree_id = t.tree_id AND b.name = t.name GROUP BY ALL),
p AS (SELECT o.*, u.tips AS parent_tips, u.ones AS parent_ones, u.pre AS parent_pre FROM o LEFT JOIN o u ON u.tree_id = o.tree_id AND u.name = o.parent)"""
_add("pars_camin_sokal", fr.NODES, mv.camin_sokal, f"{_ONES} SELECT tree_id, CAST(SUM(CASE WHEN ones = tips AND (parent_tips IS NULL OR parent_ones < parent_tips) THEN 1 ELSE 0 END) AS BIGINT) AS gains FROM p GROUP BY 1", states=_BITS)
_add("pars_dollo", fr.NODES, mv.dollo, f"""{_ONES}, t AS (SELECT tree_id, ones AS total FROM p WHERE parent IS NULL), g AS (SELECT p.tree_id, ARG_MAX(pre, level) AS lo, ARG_MAX(post, level) AS hi FROM p JOIN t ON t.tree_id = p.tree_id WHERE total > 0 AND ones = total GROUP BY 1),
l AS (SELECT p.tree_id, COUNT(*) AS losses FROM p JOIN g ON g.tree_id = p.tree_id WHERE ones = 0 AND parent_ones > 0 AND parent_pre BETWEEN lo AND hi GROUP BY 1)
SELECT t.tree_id, CAST(CASE WHEN total > 0 THEN 1 ELSE 0 END AS BIGINT) AS gains, COALESCE(losses, 0) AS losses FROM t LEFT JOIN l ON l.tree_id = t.tree_id""", states=_BITS)
_add("tree_collapse_short", fr.NODES, lambda n: mv.collapse(n, 2.5), f"""{_N}, k AS (SELECT * FROM nodes WHERE is_tip OR parent IS NULL OR branch_length >= 2.5),
o AS (SELECT k.tree_id, k.name, a.name AS anc, k.root_dist - a.root_dist AS bl, ROW_NUMBER() OVER (PARTITION BY k.tree_id, k.name ORDER BY a.level DESC) AS i FROM k JOIN k a ON a.tree_id = k.tree_id AND NOT a.is_tip AND k.pre > a.pre AND k.pre <= a.post)
SELECT tree_id, name, anc AS new_parent, ROUND(bl, 9) AS new_length FROM o WHERE i = 1""")
_add("tree_ladder_order", fr.NODES, mv.ladderize, f"""{_N}, s AS (SELECT a.tree_id, a.name, a.parent, a.pre, a.post, a.level, COUNT(*) AS tips, MIN(t.name) AS first_tip FROM nodes a JOIN nodes t ON t.tree_id = a.tree_id AND t.is_tip AND t.pre BETWEEN a.pre AND a.post GROUP BY ALL),
r AS (SELECT *, LPAD(CAST(ROW_NUMBER() OVER (PARTITION BY tree_id, parent ORDER BY tips, first_tip, name) AS VARCHAR), 9, '0') AS rk FROM s),
w AS (SELECT n.tree_id, n.name, STRING_AGG(r.rk, '' ORDER BY r.level) AS path FROM nodes n JOIN r ON r.tree_id = n.tree_id AND n.pre BETWEEN r.pre AND r.post GROUP BY 1, 2)
SELECT tree_id, name, CAST(ROW_NUMBER() OVER (PARTITION BY tree_id ORDER BY path) AS INT) AS new_pre FROM w""")
_add("tree_midpoints", fr.NODES, mv.midpoints, f"""WITH dist AS ({q.SQL['tree_tip_distances']}), nodes AS ({fr.NODES}), f AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tree_id ORDER BY distance DESC, "left", "right") AS i FROM dist) z WHERE i = 1),
d AS (SELECT f.tree_id, f."left", f."right", f.distance, CASE WHEN l.root_dist >= r.root_dist THEN l.pre ELSE r.pre END AS tip_pre, GREATEST(l.root_dist, r.root_dist) - f.distance / 2 AS half FROM f JOIN nodes l ON l.tree_id = f.tree_id AND l.name = f."left" JOIN nodes r ON r.tree_id = f.tree_id AND r.name = f."right")
SELECT d.tree_id, "left", "right", distance, n.name AS branch, ROUND(n.root_dist - half, 6) AS "offset" FROM d JOIN nodes n ON n.tree_id = d.tree_id AND n.parent IS NOT NULL AND tip_pre BETWEEN n.pre AND n.post AND n.root_dist - n.branch_length <= half AND half < n.root_dist""")

# Tree files: texts made of the trees of customers, read again

_TAXA = "SELECT o_custkey AS tree_id, CAST(year(o_orderdate) AS INT) AS y, concat('C', CAST(o_orderkey AS VARCHAR(19))) AS taxon, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS token, CAST(1 + o_orderkey % 7 AS DOUBLE) AS len FROM orders"


def _newicks(taxa: DataFrame, label: str) -> DataFrame:
    sub = taxa.groupBy("tree_id", "y").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("token", F.concat_ws(":", F.col(label).cast("string"), F.col("len").cast("string")).alias("s")))), lambda x: x.s), ",").alias("s"))
    return sub.groupBy("tree_id").agg(F.concat(F.lit("("), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "s"))), lambda x: F.concat(F.lit("("), x.s, F.lit("):1"))), ","), F.lit(");")).alias("newick"))


def nexus_files(taxa: DataFrame) -> DataFrame:
    table = taxa.groupBy("tree_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("token", "taxon"))), lambda x: F.concat(F.lit("\t"), x.token.cast("string"), F.lit(" '"), x.taxon, F.lit("'"))), ",\n").alias("table"))
    parts = table.join(_newicks(taxa, "token"), "tree_id")
    return parts.select(F.col("tree_id").alias("file"), F.concat(F.lit("#NEXUS\nBegin trees;\nTranslate\n"), "table", F.lit(";\ntree one = [&R] "), "newick", F.lit("\nEND;\n")).alias("text"))


def phyloxml_files(taxa: DataFrame) -> DataFrame:
    tip = F.concat(F.lit("<clade><name>"), "taxon", F.lit("</name><branch_length>"), F.col("len").cast("string"), F.lit("</branch_length></clade>"))
    return taxa.groupBy("tree_id").agg(F.concat(F.lit('<phyloxml><phylogeny rooted="true"><clade><name>root</name>'), F.array_join(F.sort_array(F.collect_list(tip)), ""), F.lit("</clade></phylogeny></phyloxml>")).alias("text")).withColumnRenamed("tree_id", "file")


_NWK = f"SELECT tree_id, concat('(', STRING_AGG(concat('(', s, '):1'), ',' ORDER BY y), ');') AS newick FROM (SELECT tree_id, y, STRING_AGG(concat(taxon, ':', CAST(len AS VARCHAR)), ',' ORDER BY token) AS s FROM ({_TAXA}) t GROUP BY 1, 2) u GROUP BY 1"
_add("io_nexus_trees", _TAXA, lambda t: tokens.nexus_trees(nexus_files(t)), f"SELECT tree_id AS file, 'one' AS name, TRUE AS rooted, newick FROM ({_NWK}) z")
_add("io_nexus_translate", _TAXA, lambda t: tokens.translations(nexus_files(t)).withColumnRenamed("label", "taxon"), f"SELECT tree_id AS file, CAST(token AS VARCHAR) AS token, taxon FROM ({_TAXA}) t")
_add("io_phyloxml_tips", _TAXA, lambda t: tokens.phyloxml_nodes(phyloxml_files(t)).where("is_tip").select("file", F.col("name").alias("taxon"), "branch_length"), f"SELECT tree_id AS file, taxon, len AS branch_length FROM ({_TAXA}) t")
_add("io_tree_formats", _TAXA, lambda t: nexus_files(t).unionByName(phyloxml_files(t)).unionByName(_newicks(t, "taxon").toDF("file", "text")).groupBy(nexus.tree_format(F.col("text")).alias("format")).agg(F.count("*").alias("n")), f"SELECT format, (SELECT COUNT(DISTINCT tree_id) FROM ({_TAXA}) t) AS n FROM (VALUES ('nexus'), ('phyloxml'), ('newick')) v(format)")

# Further reviews

_W = f"w AS ({q.SQL['aln_windows']}), dg AS ({q.SQL['aln_disagreement']})"
_add("aln_under_aligned", fr.SITES, rv.under_aligned, f"WITH {_W}, m AS (SELECT w.aln_id, start, stop, variable_fraction, ROUND(AVG(disagreement), 6) AS disagreement FROM w JOIN dg ON dg.aln_id = w.aln_id AND dg.site BETWEEN start AND stop GROUP BY 1, 2, 3, 4) SELECT * FROM m WHERE variable_fraction >= 0.7 AND disagreement >= 0.35")
_NUC, _RESIDUES = (", ".join(f"'{c}'" for c in letters) for letters in ("ACGNRYSWKMBDHV", "ABCDEFGHIKLMNPQRSTVWXYZ*"))
#: Some alignments in RNA or protein letters, one with a letter that is neither.
_TYPED = f"SELECT aln_id, taxon, site, CASE WHEN aln_id % 5 = 1 AND residue = 'T' THEN 'U' WHEN aln_id % 5 = 2 AND site = 7 AND residue = 'A' THEN 'L' WHEN aln_id % 5 = 3 AND taxon = 'AF' AND residue = 'T' THEN 'U' WHEN aln_id % 10 = 4 AND site = 3 AND residue = 'G' THEN '@' ELSE residue END AS residue FROM ({fr.SITES}) s"
_add("aln_sequence_types", _TYPED, rv.sequence_types, f"""WITH r AS (SELECT aln_id, taxon, BOOL_AND(residue IN ({_NUC}, 'T')) AS dna, BOOL_AND(residue IN ({_NUC}, 'U')) AS rna, BOOL_AND(residue IN ({_RESIDUES})) AS protein, BOOL_OR(residue NOT IN ({_NUC}, {_RESIDUES}, 'U')) AS odd,
  BOOL_OR(residue = 'T') AS t, BOOL_OR(residue = 'U') AS u, BOOL_OR(residue IN ({_RESIDUES}) AND residue NOT IN ({_NUC}, 'T', 'U')) AS g FROM ({_TYPED}) z WHERE residue NOT IN ('-', '?') GROUP BY 1, 2),
b AS (SELECT *, odd OR NOT (dna OR rna OR protein) AS bad FROM r),
n AS (SELECT aln_id, COUNT(*) FILTER (bad) AS invalid_records, BOOL_AND(dna OR bad) AS d, BOOL_AND(rna OR bad) AS r, BOOL_AND(protein OR bad) AS p, COUNT(*) FILTER (t) AS thymine, COUNT(*) FILTER (u) AS uracil, COUNT(*) FILTER (g) AS signals FROM b GROUP BY 1)
SELECT aln_id, CASE WHEN invalid_records > 0 THEN 'invalid' WHEN NOT (d OR r OR p) THEN 'mixed' WHEN signals > 0 THEN 'protein' WHEN uracil > 0 AND thymine = 0 THEN 'rna' WHEN d THEN 'dna' WHEN r THEN 'rna' ELSE 'protein' END AS kind,
CASE WHEN invalid_records > 0 OR NOT (d OR r OR p) THEN 'blocked' WHEN signals > 0 OR (uracil > 0 AND thymine = 0) THEN 'high' WHEN d AND thymine > 0 THEN 'medium' ELSE 'low' END AS confidence, invalid_records, thymine, uracil, signals FROM n""")
_add("aln_quality_score", fr.SITES, lambda s: rv.quality_score(al.summary(s), al.composition_outliers(s), al.duplicates(s)), f"""WITH s AS ({q.SQL['aln_summary']}), o AS (SELECT aln_id, COUNT(*) AS o FROM ({q.SQL['aln_composition_outliers']}) z WHERE outlier GROUP BY 1), d AS (SELECT aln_id, COUNT(*) AS d FROM ({q.SQL['aln_duplicates']}) z GROUP BY 1),
p AS (SELECT s.aln_id, ROUND(1 - LEAST(CAST(missing + ambiguous AS DOUBLE) / (sites * taxa), 1), 9) AS missingness, ROUND(1 - LEAST(CAST(gaps AS DOUBLE) / (sites * taxa), 1), 9) AS gap_burden, ROUND(1 - LEAST(CAST(COALESCE(o, 0) AS DOUBLE) / taxa, 1), 9) AS composition,
  ROUND(1 - LEAST(CAST(COALESCE(d, 0) AS DOUBLE) / taxa, 1), 9) AS duplicates, ROUND(LEAST(CAST(informative AS DOUBLE) / sites / 0.2, 1), 9) AS density FROM s LEFT JOIN o ON o.aln_id = s.aln_id LEFT JOIN d ON d.aln_id = s.aln_id)
SELECT *, ROUND((missingness + gap_burden + composition + duplicates + density) / 5 * 100, 3) AS score FROM p""")
_SUM2 = q.SQL["aln_summary"].replace(f"WITH sites AS ({fr.SITES})", f"WITH sites AS (SELECT * FROM ({fr.SITES}) y WHERE site % 5 <> 0)")
_add("aln_compare_summaries", fr.SITES, lambda s: rv.compare_summaries(al.summary(s), al.summary(s.where("site % 5 <> 0"))), f"SELECT COALESCE(l.aln_id, r.aln_id) AS aln_id, {', '.join(f'COALESCE(r.{c}, 0) - COALESCE(l.{c}, 0) AS {c}_delta' for c in ('sites', 'taxa', 'gaps', 'informative'))} FROM ({q.SQL['aln_summary']}) l FULL JOIN ({_SUM2}) r ON r.aln_id = l.aln_id")
_TIPSET = "SELECT DISTINCT l_suppkey AS aln_id, concat(l_returnflag, l_linestatus) AS taxon FROM lineitem WHERE l_discount > 0.09"
_add("aln_prune_to_tree", fr.SITES, lambda s, keep: s.join(keep, ["aln_id", "taxon"], "left_semi"), f"{_S} SELECT s.* FROM sites s JOIN ({_TIPSET}) k ON k.aln_id = s.aln_id AND k.taxon = s.taxon", keep=_TIPSET)
_SEQS = "SELECT o_custkey AS tree_id, concat('C', CAST(o_orderkey AS VARCHAR(19))) AS name FROM orders WHERE o_totalprice > 100000"
_add("tree_prune_to_alignment", fr.NODES, tree.prune, q.SQL["tree_prune"].replace(f"keep AS ({q._KEEP})", f"keep AS ({_SEQS})"), keep=_SEQS)
_add("dist_validate", fr.SITES, lambda s: rv.validate_distances(di.distances(s, "k80")), f"""{q._COUNTS}, d AS ({q._DIST('k80')}) SELECT x.aln_id, COUNT(*) AS cells, CAST(SUM(CASE WHEN x.distance < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative, CAST(SUM(CASE WHEN x."left" = x."right" AND x.distance <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS diagonal,
CAST(SUM(CASE WHEN x."left" <> x."right" AND (y.distance IS NULL OR ABS(x.distance - y.distance) > 1e-9) THEN 1 ELSE 0 END) AS BIGINT) AS one_sided FROM d x LEFT JOIN d y ON y.aln_id = x.aln_id AND y."left" = x."right" AND y."right" = x."left" GROUP BY 1""")
_VALUES = "SELECT o_custkey AS tree_id, concat('C', CAST(o_orderkey AS VARCHAR(19))) AS tip, o_totalprice / 1000 AS value FROM orders"
_add("trait_disparity_through_time", fr.NODES, rv.disparity_through_time, f"""{_N}, u AS ({q._UP}), i AS (SELECT u.tree_id, u.ancestor AS name, COALESCE(VAR_SAMP(v.value), 0) AS v FROM u JOIN ({_VALUES}) v ON v.tree_id = u.tree_id AND v.tip = u.tip GROUP BY 1, 2), a AS (SELECT tree_id, v AS all_v FROM i WHERE name = 'root' AND v > 0),
l AS (SELECT n.tree_id, n.root_dist - n.branch_length AS since, n.root_dist AS upto, COALESCE(i.v, 0) / all_v AS relative FROM nodes n JOIN a ON a.tree_id = n.tree_id LEFT JOIN i ON i.tree_id = n.tree_id AND i.name = n.name WHERE n.parent IS NOT NULL), t AS (SELECT DISTINCT tree_id, root_dist AS time FROM nodes WHERE NOT is_tip)
SELECT t.tree_id, t.time, COUNT(*) AS lineages, ROUND(AVG(relative), 6) AS disparity FROM t JOIN l ON l.tree_id = t.tree_id AND since <= t.time AND t.time < upto GROUP BY 1, 2""", traits=_VALUES)
_TREES = "SELECT DISTINCT o_custkey % 40 AS set_id, o_custkey AS tree_id FROM orders"
_add("set_thin", _TREES, lambda t: se.thin(t, 3), f"SELECT set_id, tree_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY set_id ORDER BY tree_id) AS i FROM ({_TREES}) z) y WHERE (i - 1) % 3 = 0")
_add("set_subsample", _TREES, lambda t: rv.subsample(t, 5, 17), f"SELECT * FROM (SELECT set_id, tree_id, CAST(ROW_NUMBER() OVER (PARTITION BY set_id ORDER BY md5(concat('17:', CAST(tree_id AS VARCHAR)))) AS INT) AS drawn FROM ({_TREES}) z) y WHERE drawn <= 5")
_add("tbl_model_matrix", "SELECT p_partkey AS taxon, p_brand AS brand, p_size AS size, CASE WHEN p_size > 2 THEN p_retailprice END AS price FROM part", lambda t: rv.model_matrix(t, "brand", ["size", "price"]), """WITH r AS (SELECT p_partkey AS taxon, p_brand AS brand, p_size AS size, CASE WHEN p_size > 2 THEN p_retailprice END AS price FROM part), f AS (SELECT MIN(brand) AS first FROM r), u AS (SELECT * FROM r WHERE brand IS NOT NULL AND size IS NOT NULL AND price IS NOT NULL)
SELECT taxon, '(Intercept)' AS term, CAST(1 AS DOUBLE) AS x FROM u UNION ALL SELECT taxon, 'size', CAST(size AS DOUBLE) FROM u UNION ALL SELECT taxon, 'price', price FROM u UNION ALL SELECT taxon, concat('brand=', brand), CAST(1 AS DOUBLE) FROM u, f WHERE brand <> first""")
_add("pars_indices", q._FI, lambda t: q.co.indices(q.co.fitch_two_level(t).select(F.col("tree_id").alias("character"), "steps"), q.co.consistency_bounds(t.select(F.col("tree_id").alias("character"), F.col("tip_order").alias("taxon"), "state"))), f"""WITH s AS ({q.SQL['pars_fitch']}), n AS (SELECT tree_id, state, COUNT(*) AS n FROM ({q._FI}) z GROUP BY 1, 2), b AS (SELECT tree_id, COUNT(*) - 1 AS min_steps, CAST(SUM(n) - MAX(n) AS BIGINT) AS max_steps FROM n GROUP BY 1)
SELECT s.tree_id AS "character", steps, min_steps, max_steps, ROUND(CASE WHEN min_steps > 0 THEN CAST(min_steps AS DOUBLE) / steps END, 9) AS ci, ROUND(CASE WHEN max_steps <> min_steps THEN CAST(max_steps - steps AS DOUBLE) / (max_steps - min_steps) END, 9) AS ri FROM s JOIN b ON b.tree_id = s.tree_id""")
