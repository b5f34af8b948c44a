"""Registered queries of zone outlines, adjacency, alternative routes and destinations of unseen origins, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators import lookup as look
from wayfare.operators import space
from wayfare.queries import _questions, model, query, rounded, vertex_view, zone_view
from wayfare.queries_sql import _CHAIN, ORACLES, _select

ROUTES = 3


@query
def zone_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroid and area of every zone's outline, holes left out."""
    return rounded(space.polygon_centroid_area(vertex_view(zone_view(spark, sf_dir))), 3)


@query
def zone_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones whose outlines come within 250 feet of each other, and how near."""
    return rounded(space.zone_adjacency(vertex_view(zone_view(spark, sf_dir))), 3)


@query
def shortest_routes_in_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes, miles, mean confidence and the zones of every least-duration route."""
    rows = model(spark, sf_dir).routes
    return rounded(rows.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">")))


@query
def alternative_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three quickest simple routes between all zones."""
    m = model(spark, sf_dir)
    pairs = space.zone_pairs(m.zones).select("origin", "destination")
    found = space.k_shortest_routes(m.edges, pairs, ROUTES, m.routes)
    return rounded(found.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">")))


#: Origins that the table of estimates is made to lack: one in five has no row at all, one of these has no trip either.
GONE = "origin % 5 = 2"
SILENT = 7


@query
def od_options_of_unseen_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's destinations where some origins have no stored estimates: their largest flows or the first zones stand in."""
    m = model(spark, sf_dir)
    asked = _questions(spark, sf_dir).filter("query_id % 4 = 0").select("query_id", "origin", "minute")
    seen = m.od.filter(f"not ({GONE})")
    pairs = m.pairs.filter(F.col("origin") != SILENT)
    rows = look.od_options_or_default(asked, m, seen, pairs)
    return rounded(rows.select("query_id", "origin", "destination", "probability", "driver_revenue", "duration_min", "distance_miles", "revenue_dev", "confidence", "is_default"), 3)


_OUTLINES = """
WITH zones AS (SELECT CAST(n_nationkey + 1 AS INT) AS zone_id, n_nationkey AS k, (n_nationkey % 5)*9000.0::DOUBLE AS cx, floor(n_nationkey/5)*9000.0::DOUBLE AS cy FROM nation),
corners AS (
  SELECT zone_id, 0 AS ring, s AS seq, cx + (4390 + 5*(k % 4))*[-1, 1, 1, -1][s + 1] AS x, cy + (4390 + 5*(k % 4))*[-1, -1, 1, 1][s + 1] AS y FROM zones, range(4) r(s)
  UNION ALL SELECT zone_id, 1, s, cx + 800 + 100*(k % 5) + (600 + 100*(k % 3))*[-1, -1, 1, 1][s + 1], cy - 500 + (600 + 100*(k % 3))*[-1, 1, 1, -1][s + 1] FROM zones, range(4) r(s) WHERE k % 2 = 1),
segments AS (SELECT a.zone_id, a.ring, a.seq, a.x, a.y, b.x AS nx, b.y AS ny FROM corners a JOIN corners b ON a.zone_id = b.zone_id AND a.ring = b.ring AND b.seq = (a.seq + 1) % 4)"""


def _apart(p: str, q: str, a: str) -> str:
    """Distance of a point (columns p, q) from a segment of table a."""
    t = f"least(greatest((({p}-{a}.x)*({a}.nx-{a}.x) + ({q}-{a}.y)*({a}.ny-{a}.y))/(({a}.nx-{a}.x)**2 + ({a}.ny-{a}.y)**2), 0), 1)"
    return f"sqrt(({p}-{a}.x-{t}*({a}.nx-{a}.x))**2 + ({q}-{a}.y-{t}*({a}.ny-{a}.y))**2)"


_SIMPLE = f"""{_CHAIN}, simple AS (
  SELECT origin, destination, minutes, miles, confidence AS total, [origin, destination] AS path FROM edges
  UNION ALL SELECT s.origin, e.destination, s.minutes + e.minutes, s.miles + e.miles, s.total + e.confidence, list_append(s.path, e.destination) FROM simple s JOIN edges e ON e.origin = s.destination AND NOT list_contains(s.path, e.destination)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY origin, destination ORDER BY round(minutes, 9), len(path), path) AS best, row_number() OVER (PARTITION BY origin, destination ORDER BY round(minutes, 9), path) AS rank FROM simple)
"""

_MIXED = ", ".join(f"sum(w*p*{c})/greatest(sum(w*p), 1e-12) AS {c}" for c in ("revenue", "minutes", "dist", "dev", "confidence"))

ORACLES |= {
    "zone_outlines": f"""{_OUTLINES} SELECT zone_id, round(sum((x + nx)*(x*ny - nx*y))/(3*sum(x*ny - nx*y)) + 1.3e-9, 3) AS centroid_x, round(sum((y + ny)*(x*ny - nx*y))/(3*sum(x*ny - nx*y)) + 1.3e-9, 3) AS centroid_y,
  round(abs(sum(x*ny - nx*y))/2 + 1.3e-9, 3) AS area_sqft FROM segments GROUP BY zone_id""",
    "zone_adjacency": f"""{_OUTLINES} SELECT a.zone_id AS origin, b.zone_id AS destination, round(min(least({_apart('a.x', 'a.y', 'b')}, {_apart('a.nx', 'a.ny', 'b')}, {_apart('b.x', 'b.y', 'a')}, {_apart('b.nx', 'b.ny', 'a')})) + 1.3e-9, 3) AS feet
FROM segments a JOIN segments b ON a.zone_id < b.zone_id GROUP BY ALL HAVING feet <= 250""",
    "shortest_routes_in_full": f"""{_SIMPLE} SELECT origin, destination, round(minutes + 1.3e-9, 5) AS minutes, round(miles + 1.3e-9, 5) AS miles, round(total/(len(path) - 1) + 1.3e-9, 5) AS confidence, array_to_string(path, '>') AS path FROM numbered WHERE best = 1""",
    "alternative_routes": f"""{_SIMPLE} SELECT origin, destination, round(minutes + 1.3e-9, 5) AS minutes, round(miles + 1.3e-9, 5) AS miles, array_to_string(path, '>') AS path, rank::INT AS rank FROM numbered WHERE rank <= {ROUTES}""",
    "od_options_of_unseen_origins": f"""{_CHAIN}, put AS (SELECT * FROM sided WHERE query_id % 4 = 0),
stored AS (
  SELECT query_id, s.origin, o.destination, sum(w*p) AS p, {_MIXED} FROM put s CROSS JOIN (VALUES (0), (1)) v(k) JOIN (SELECT *, time_bin AS tb FROM od WHERE NOT ({GONE})) o ON o.origin = s.origin AND o.tb = CASE WHEN k = 0 THEN low ELSE high END
  CROSS JOIN LATERAL (SELECT CASE WHEN k = 0 THEN 1 - t ELSE t END AS w) GROUP BY ALL),
largest AS (SELECT origin, destination, n, row_number() OVER (PARTITION BY origin ORDER BY n DESC, destination) AS k FROM pairs WHERE origin <> {SILENT}),
chosen AS (
  SELECT origin, destination, n/sum(n) OVER (PARTITION BY origin) AS p FROM largest WHERE k <= 12
  UNION ALL SELECT z.zone_id, f.zone_id, 1/12.0::DOUBLE FROM zones z JOIN (SELECT zone_id, row_number() OVER (ORDER BY zone_id) AS k FROM zones) f ON f.k <= 12 WHERE NOT EXISTS (FROM largest l WHERE l.origin = z.zone_id)),
answered AS (
  SELECT s.query_id, s.origin, c.destination, c.p, (1-t)*a.revenue + t*b.revenue AS revenue, (1-t)*a.minutes + t*b.minutes AS minutes, (1-t)*a.miles + t*b.miles AS dist, (1-t)*a.revenue_std + t*b.revenue_std AS dev, (1-t)*a.confidence + t*b.confidence AS confidence
  FROM put s JOIN chosen c ON c.origin = s.origin JOIN estimate a ON a.time_bin = low AND a.origin = c.origin AND a.destination = c.destination JOIN estimate b ON b.time_bin = high AND b.origin = c.origin AND b.destination = c.destination
  WHERE NOT EXISTS (FROM stored x WHERE x.query_id = s.query_id))
""" + _select("query_id, origin, destination, is_default", "(SELECT query_id, origin, destination, p/sum(p) OVER (PARTITION BY query_id) AS probability, revenue, minutes, dist, dev, confidence, false AS is_default FROM stored UNION ALL SELECT *, true FROM answered)", "probability; revenue driver_revenue; minutes duration_min; dist distance_miles; dev revenue_dev; confidence", 3).removeprefix(_CHAIN),
}
