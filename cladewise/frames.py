"""Phylogenetic frames derived from the driver's tables; the text is SQL that Spark and DuckDB both read.

- sites: one alignment per supplier; taxa are return flag and line status, sites the
  quantities 1 to 50, residues a residue code of the part keys, '-' where nothing was sold.
- nodes: one tree per customer, root, years, quarters and orders, with preorder intervals.
- tips: one tree per customer over the five order priorities, in two levels of clades.
- trace: one chain per user over the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CELLS = """
SELECT l_suppkey AS aln_id, concat(l_returnflag, l_linestatus) AS taxon, CAST(l_quantity AS INT) AS site,
       CAST(SUM(l_partkey) % 10 AS INT) AS code
FROM lineitem GROUP BY l_suppkey, concat(l_returnflag, l_linestatus), CAST(l_quantity AS INT)"""

SITES = f"""
SELECT a.aln_id, t.taxon, s.site, COALESCE(substr('AACCGGTTN?', c.code + 1, 1), '-') AS residue
FROM (SELECT DISTINCT l_suppkey AS aln_id FROM lineitem) a
CROSS JOIN (SELECT DISTINCT concat(l_returnflag, l_linestatus) AS taxon FROM lineitem) t
CROSS JOIN (SELECT DISTINCT CAST(l_quantity AS INT) AS site FROM lineitem) s
LEFT JOIN ({CELLS}) c ON c.aln_id = a.aln_id AND c.taxon = t.taxon AND c.site = s.site"""

_PATHS = """
SELECT o_custkey AS tree_id, -1 AS r, -1 AS n, CAST(-1 AS BIGINT) AS c, 'root' AS name, CAST(NULL AS VARCHAR(9)) AS parent,
       CAST(0 AS DOUBLE) AS branch_length, 0 AS level FROM orders GROUP BY o_custkey
UNION ALL
SELECT o_custkey, y, -1, CAST(-1 AS BIGINT), concat('R', CAST(y AS VARCHAR(9))), 'root', CAST(1 + y % 3 AS DOUBLE), 1
FROM (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INT) AS y FROM orders) b
UNION ALL
SELECT o_custkey, y, m, CAST(-1 AS BIGINT), concat('N', CAST(m AS VARCHAR(9))), concat('R', CAST(y AS VARCHAR(9))), CAST(1 + m % 5 AS DOUBLE), 2
FROM (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INT) AS y, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS INT) AS m FROM orders) b
UNION ALL
SELECT o_custkey, CAST(year(o_orderdate) AS INT), CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS INT), o_orderkey, concat('C', CAST(o_orderkey AS VARCHAR(19))),
       concat('N', CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS VARCHAR(9))), CAST(1 + o_orderkey % 7 AS DOUBLE), 3 FROM orders"""

#: pre and post are the first and last preorder rank of a node's subtree.
NODES = f"""
SELECT p.tree_id, p.name, p.parent, p.branch_length, p.level, p.level = 3 AS is_tip, p.pre,
       p.pre - 1 + CASE p.level WHEN 0 THEN COUNT(*) OVER (PARTITION BY p.tree_id)
                        WHEN 1 THEN COUNT(*) OVER (PARTITION BY p.tree_id, p.r)
                        WHEN 2 THEN COUNT(*) OVER (PARTITION BY p.tree_id, p.r, p.n) ELSE 1 END AS post,
       CASE WHEN p.r >= 0 THEN 1 + p.r % 3 ELSE 0 END + CASE WHEN p.n >= 0 THEN 1 + p.n % 5 ELSE 0 END
         + CASE WHEN p.c >= 0 THEN CAST(1 + p.c % 7 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS root_dist
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tree_id ORDER BY r, n, c) AS pre FROM ({_PATHS}) q) p"""

TIPS = """
SELECT g.tree_id, g.tip, COALESCE(k.n, 0) % 2 AS a, CAST(FLOOR(COALESCE(k.n, 0) / 2) AS BIGINT) % 2 AS b, COALESCE(k.n, 0) AS n
FROM (SELECT t.tree_id, p.tip FROM (SELECT DISTINCT o_custkey AS tree_id FROM orders) t
      CROSS JOIN (SELECT DISTINCT o_orderpriority AS tip FROM orders) p) g
LEFT JOIN (SELECT o_custkey AS tree_id, o_orderpriority AS tip, COUNT(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority) k
  ON k.tree_id = g.tree_id AND k.tip = g.tip"""

TRACE = """
SELECT user_id AS chain, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS iteration, value FROM events"""

PARTS = """
SELECT p_partkey AS taxon, p_brand AS brand, p_type AS kind, p_size AS size, p_retailprice AS price FROM part"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The frame of a text above (or any SQL over the driver's tables)."""
    import re

    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", text)}
    body = re.sub(rf"\b({'|'.join(used)})\b", r"{\1}", text) if used else text
    return spark.sql(body.replace("VARCHAR(9)", "STRING").replace("VARCHAR(19)", "STRING"), **used)
