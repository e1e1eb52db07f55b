"""Registered queries on Brownian motion: ancestral values, rates through time, movements over the globe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise import frames as fr
from cladewise import queries as q
from cladewise.operators import brownian

_add = q._add
_N = q._N

#: Where an order was: tips of the customers' trees, some without a place.
_PLACES = """
SELECT o_custkey AS tree_id, concat('C', CAST(o_orderkey AS VARCHAR(19))) AS name, 'latitude' AS trait, CASE WHEN o_orderkey % 11 > 0 THEN pi() * (3 * sqrt(o_orderkey * 37 % 120 + CAST(0.5 AS DOUBLE)) - 16) END AS value FROM orders
UNION ALL SELECT o_custkey, concat('C', CAST(o_orderkey AS VARCHAR(19))), 'longitude', CASE WHEN o_orderkey % 11 > 0 THEN pi() * (5 * sqrt(o_orderkey * 53 % 300 + CAST(0.5 AS DOUBLE)) - 44) END FROM orders"""


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in columns})


def _passes() -> str:
    text = f"""{_N}, t AS (SELECT n.tree_id, n.name, n.parent, v.trait, v.value FROM nodes n JOIN ({_PLACES}) v ON v.tree_id = n.tree_id AND v.name = n.name WHERE value IS NOT NULL),
g AS (SELECT tree_id, trait, MAX(value) - MIN(value) AS range FROM t GROUP BY 1, 2), l3 AS (SELECT t.tree_id, t.name, t.parent, trait, value AS m, branch_length AS w, 0.0::DOUBLE AS q, 1 AS n FROM t JOIN nodes n ON n.tree_id = t.tree_id AND n.name = t.name)"""
    for level in (2, 1, 0):
        text += f""", s{level} AS (SELECT tree_id, parent AS name, trait, SUM(m / w) / SUM(1 / w) AS m, SUM(1 / w) AS u, SUM(w) AS v, SUM(q) + SUM(m * m / w) - SUM(m / w) * SUM(m / w) / SUM(1 / w) AS q, SUM(n) AS n FROM l{level + 1} GROUP BY 1, 2, 3),
l{level} AS (SELECT s.*, z.parent, z.branch_length AS b, z.branch_length + 1 / u AS w FROM s{level} s JOIN nodes z ON z.tree_id = s.tree_id AND z.name = s.name)"""
    text += ", f0 AS (SELECT tree_id, name, trait, m, v, u AS p, m AS al FROM l0)"
    for level in (1, 2):
        text += f""", r{level} AS (SELECT l.*, f.p AS up, f.al AS ua, f.p - 1 / l.w AS rest FROM l{level} l JOIN f{level - 1} f ON f.tree_id = l.tree_id AND f.name = l.parent AND f.trait = l.trait),
k{level} AS (SELECT *, CASE WHEN rest > 1e-12 * up THEN 1 / (1 / rest + b) ELSE 0 END AS g, CASE WHEN rest > 1e-12 * up THEN (up * ua - m / w) / rest ELSE 0 END AS far FROM r{level}),
f{level} AS (SELECT tree_id, name, trait, m, v, u + g AS p, (u * m + g * far) / (u + g) AS al FROM k{level})"""
    return (
        text
        + f""", f AS (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2),
e AS (SELECT tree_id, name, trait, TRUE AS is_tip, value AS estimate, 0.0::DOUBLE AS variance, value AS conditional, 0.0::DOUBLE AS conditional_variance FROM t
UNION ALL SELECT f.tree_id, f.name, f.trait, FALSE, f.m, f.v, f.al, CASE WHEN l0.n > 1 THEN GREATEST(l0.q, 0) / (l0.n - 1) / f.p END FROM f JOIN l0 ON l0.tree_id = f.tree_id AND l0.trait = f.trait),
j AS (SELECT e.*, estimate - {brownian.NORMAL_95} * sqrt(variance) AS lower, estimate + {brownian.NORMAL_95} * sqrt(variance) AS upper, 2 * {brownian.NORMAL_95} * sqrt(variance) / GREATEST(range, 1e-12) AS rel FROM e JOIN g ON g.tree_id = e.tree_id AND g.trait = e.trait)"""
    )


_V = _passes()
_EST = ["estimate", "variance", "conditional", "conditional_variance", "lower", "upper", "confidence"]
_R = lambda *cs: ", ".join(f"ROUND({c}, 6) AS {c}" for c in cs)
_add("anc_brownian", fr.NODES, lambda n, values: _rounded(brownian.ancestral_values(n, values), *_EST), f"{_V} SELECT tree_id, name, trait, is_tip, {_R(*_EST[:-1])}, ROUND(1 - LEAST(rel, 1), 6) AS confidence, rel > 0.6 AS unstable FROM j", values=_PLACES)

_I = f"""{_V}, d AS (SELECT t.tree_id, t.trait, MAX(root_dist) AS depth FROM t JOIN nodes n ON n.tree_id = t.tree_id AND n.name = t.name GROUP BY 1, 2),
ed AS (SELECT n.tree_id, lo.trait, n.branch_length, n.root_dist - n.branch_length AS b, n.root_dist AS z, CASE WHEN ABS(lo.estimate - hi.estimate) > 1e-12 * GREATEST(ABS(lo.estimate), ABS(hi.estimate)) THEN (lo.estimate - hi.estimate) ** 2 ELSE 0 END AS sq FROM nodes n JOIN e lo ON lo.tree_id = n.tree_id AND lo.name = n.name JOIN e hi ON hi.tree_id = n.tree_id AND hi.name = n.parent AND hi.trait = lo.trait),
grid AS (SELECT tree_id, trait, depth, i, i * depth / 5 AS start, CASE WHEN i = 4 THEN depth ELSE (i + 1) * depth / 5 END AS stop FROM d, (VALUES (0), (1), (2), (3), (4)) v(i)),
su AS (SELECT tree_id, trait, i, COUNT(*) AS branches, SUM(o) AS length, SUM(sq * o / branch_length) AS change FROM (SELECT ed.*, i, LEAST(z, stop) - GREATEST(b, start) AS o FROM ed JOIN grid ON grid.tree_id = ed.tree_id AND grid.trait = ed.trait) x WHERE o > 1e-9 GROUP BY 1, 2, 3),
iv AS (SELECT grid.tree_id, grid.trait, CAST(grid.i + 1 AS INT) AS interval, start, stop, COALESCE(branches, 0) AS branches, COALESCE(length, 0) AS length, COALESCE(change, 0) AS change, change / length AS rate,
  CASE WHEN SUM(change) OVER (PARTITION BY grid.tree_id, grid.trait) > 0 THEN COALESCE(change, 0) / SUM(change) OVER (PARTITION BY grid.tree_id, grid.trait) END AS share FROM grid LEFT JOIN su ON su.tree_id = grid.tree_id AND su.trait = grid.trait AND su.i = grid.i)"""


def _intervals(nodes: DataFrame, values: DataFrame) -> DataFrame:
    return brownian.rate_intervals(nodes, brownian.ancestral_values(nodes, values))


_add("trait_rate_intervals", fr.NODES, lambda n, values: _rounded(_intervals(n, values), "start", "stop", "length", "change", "rate", "share"), f"{_I} SELECT tree_id, trait, interval, branches, {_R('start', 'stop', 'length', 'change', 'rate', 'share')} FROM iv", values=_PLACES)
_TREND = ["depth", "earliest", "latest", "ratio", "slope", "normalised_slope"]
_add("trait_rate_trend", fr.NODES, lambda n, values: _rounded(brownian.rate_trend(_intervals(n, values)), *_TREND), f"""{_I}, x AS (SELECT *, (start + stop) / 2 AS x, length AS w FROM iv),
a AS (SELECT tree_id, trait, COUNT(rate) AS nonempty, MAX(stop) AS depth, ARG_MIN(rate, interval) FILTER (rate IS NOT NULL) AS earliest, ARG_MAX(rate, interval) FILTER (rate IS NOT NULL) AS latest, SUM(w) FILTER (rate IS NOT NULL) AS sw, SUM(w * x) FILTER (rate IS NOT NULL) / sw AS mx, SUM(w * rate) / sw AS my FROM x GROUP BY 1, 2),
b AS (SELECT a.tree_id, a.trait, SUM(w * (x - mx) ** 2) FILTER (rate IS NOT NULL) AS den, SUM(w * (x - mx) * (rate - my)) AS num, MIN(interval) FILTER (ROUND(rate, 6) = hi) AS peak, MIN(interval) FILTER (ROUND(rate, 6) = lo) AS trough
  FROM (SELECT x.*, mx, my, MAX(ROUND(rate, 6)) OVER (PARTITION BY x.tree_id, x.trait) AS hi, MIN(ROUND(rate, 6)) OVER (PARTITION BY x.tree_id, x.trait) AS lo FROM x JOIN a ON a.tree_id = x.tree_id AND a.trait = x.trait) a GROUP BY 1, 2),
c AS (SELECT a.tree_id, a.trait, nonempty, depth, earliest, latest, CASE WHEN earliest > 0 THEN latest / earliest END AS ratio, CASE WHEN nonempty > 1 THEN CASE WHEN den <= 1e-12 THEN 0 ELSE num / den END END AS slope, my, peak, trough FROM a JOIN b ON b.tree_id = a.tree_id AND b.trait = a.trait),
n AS (SELECT *, CASE WHEN my > 0 THEN slope * depth / my END AS normalised_slope FROM c)
SELECT tree_id, trait, nonempty, {_R(*_TREND)}, peak, trough, CASE WHEN nonempty < 2 OR normalised_slope IS NULL OR ratio IS NULL OR latest <= 0 THEN 'insufficient_data' WHEN normalised_slope <= -0.2 AND ratio <= 0.85 THEN 'slowdown' WHEN normalised_slope >= 0.2 AND ratio >= 1.15 THEN 'acceleration' ELSE 'stable' END AS trend FROM n""", values=_PLACES)

_W = f"""{_V}, w AS (SELECT tree_id, name, is_tip, MAX(estimate) FILTER (trait = 'latitude') AS latitude, MAX(estimate) FILTER (trait = 'longitude') AS longitude, MAX(variance) FILTER (trait = 'latitude') AS va, MAX(variance) FILTER (trait = 'longitude') AS vo, MIN(1 - LEAST(rel, 1)) AS confidence FROM j GROUP BY 1, 2, 3)"""
_add("geo_coordinates", fr.NODES, lambda n, values: _rounded(brownian.coordinates(brownian.ancestral_values(n, values)), "latitude", "longitude", "confidence", "radial_error_km"), f"{_W} SELECT tree_id, name, is_tip, {_R('latitude', 'longitude', 'confidence')}, ROUND({brownian.DEGREE_KM} * sqrt(va + cos(radians(latitude)) ** 2 * vo), 6) AS radial_error_km FROM w", values=_PLACES)
_add("geo_movements", fr.NODES, lambda n, values: _rounded(brownian.movements(n, brownian.coordinates(brownian.ancestral_values(n, values))), "support"), f"""{_W},
m AS (SELECT n.tree_id, n.name, n.parent, n.branch_length, LEAST(a.confidence, b.confidence) AS support, 2 * {brownian.EARTH_KM} * asin(LEAST(sqrt(sin(radians(a.latitude - b.latitude) / 2) ** 2 + cos(radians(a.latitude)) * cos(radians(b.latitude)) * sin(radians(a.longitude - b.longitude) / 2) ** 2), 1)) AS raw
  FROM nodes n JOIN w a ON a.tree_id = n.tree_id AND a.name = n.name JOIN w b ON b.tree_id = n.tree_id AND b.name = n.parent),
r AS (SELECT *, ROUND(raw, 6) AS km, CASE WHEN branch_length > 0 THEN ROUND(raw / branch_length, 6) END AS km_per_unit FROM m), d AS (SELECT *, MEDIAN(km) OVER (PARTITION BY tree_id) AS mk, MEDIAN(km_per_unit) OVER (PARTITION BY tree_id) AS mr FROM r),
h AS (SELECT tree_id, ANY_VALUE(mk) + 3 * GREATEST(1.4826 * MEDIAN(ABS(km - mk)), 1) AS tk, ANY_VALUE(mr) + 3 * GREATEST(1.4826 * MEDIAN(ABS(km_per_unit - mr)), 1) AS tr FROM d GROUP BY 1)
SELECT r.tree_id, name, parent, branch_length, km, km_per_unit, ROUND(support, 6) AS support, concat_ws(',', CASE WHEN branch_length <= 0 AND km > 1 THEN 'zero_length_jump' END, CASE WHEN km > tk THEN 'distance_outlier' END, CASE WHEN km_per_unit > tr THEN 'rate_outlier' END) AS flags FROM r JOIN h ON h.tree_id = r.tree_id""", values=_PLACES)
