"""SQL of the registered trip queries: one chain of common table expressions, and what each query selects from it."""

from __future__ import annotations

#: Weights of the circular bins around one, and the same for SQL.
_OFFSETS = "(VALUES " + ", ".join(f"({s * d}, exp(-{d}/1.5))" for d in range(1, 5) for s in (-1, 1)) + ") AS around(step, near)"


def _priors(temporal: str, spatial: str, observed: str, pairs: str) -> str:
    return f"""{temporal} AS (
  SELECT CAST((time_bin + step + 96) % 96 AS INT) AS time_bin, origin, destination, sum(n*near) AS w, sum(n*near*ar)/sum(n*near) AS r, sum(n*near*am)/sum(n*near) AS m, sum(n*near*ad)/sum(n*near) AS d,
    sum(n*near*sr)/sum(n*near) AS sr, sum(n*near*sm)/sum(n*near) AS sm, sum(n*near*sd)/sum(n*near) AS sd
  FROM {observed}, {_OFFSETS} GROUP BY ALL),
{spatial} AS (
  SELECT origin, destination, sum(w) AS w, sum(w*ar)/sum(w) AS r, sum(w*am)/sum(w) AS m, sum(w*ad)/sum(w) AS d, sum(w*sr)/sum(w) AS sr, sum(w*sm)/sum(w) AS sm, sum(w*sd)/sum(w) AS sd FROM (
    SELECT k.zone_id AS origin, p.destination, p.n*exp(-k.miles/2) AS w, ar, am, ad, sr, sm, sd FROM {pairs} p JOIN near k ON k.neighbour = p.origin
    UNION ALL SELECT p.origin, k.zone_id, p.n*exp(-k.miles/2), ar, am, ad, sr, sm, sd FROM {pairs} p JOIN near k ON k.neighbour = p.destination) GROUP BY ALL)"""


def _estimates(name: str, observed: str, pairs: str, temporal: str, spatial: str, direct: bool) -> str:
    """An estimate of every cell by the first source that has one, then the guard."""
    tiers = [
        ("o.n IS NOT NULL", ["s.rel*o.ar + (1-s.rel)*coalesce(g.ar*s.rr, o.ar)", "s.rel*o.am + (1-s.rel)*coalesce(g.am*s.sr_, o.am)", "s.rel*o.ad + (1-s.rel)*coalesce(g.ad, o.ad)", "greatest(0.5, s.rel*o.sr + (1-s.rel)*coalesce(g.sr, o.sr))", "greatest(1, s.rel*o.sm + (1-s.rel)*coalesce(g.sm*s.sr_, o.sm))", "greatest(0.1, s.rel*o.sd + (1-s.rel)*coalesce(g.sd, o.sd))", "s.rel", "o.n", "CASE WHEN o.n >= 20 THEN 'full_observed_dense_eb' ELSE 'full_observed_sparse_eb' END"]),
        ("t.w > 0", ["t.r*s.rr", "t.m*s.sr_", "t.d", "greatest(0.5, t.sr)", "greatest(1, t.sm*s.sr_)", "greatest(0.1, t.sd)", "least(greatest(0.15 + 0.7*t.w/(t.w+30), 0.05), 0.88)", "0", "'temporal_same_od_eb'"]),
        ("g.n IS NOT NULL", ["greatest(0, g.ar*s.rr)", "greatest(1, g.am*s.sr_)", "greatest(0.01, g.ad)", "greatest(0.5, g.sr)", "greatest(1, g.sm*s.sr_)", "greatest(0.1, g.sd)", "least(greatest(0.2 + 0.7*g.n/(g.n+50.0::DOUBLE), 0.05), 0.9)", "0", "'global_od_time_adjusted'"]),
        ("x.w > 0", ["greatest(2.5, 0.55*x.r*s.rr + 0.45*s.gr)", "greatest(1, 0.55*x.m*s.sr_ + 0.45*s.drive)", "greatest(0.01, 0.55*x.d + 0.45*s.way)", "greatest(1, x.sr)", "greatest(2, x.sm*s.sr_)", "greatest(0.25, x.sd)", "least(greatest(0.12 + 0.35*least(x.w, 100)/(least(x.w, 100)+30), 0.05), 0.48)", "0", "'spatial_neighbor_gravity_eb'"]),
    ]
    if direct:
        tiers.insert(0, ("q.n IS NOT NULL", ["q.revenue", "q.minutes", "q.dist", "q.dev", "q.dev_m", "q.dev_d", "q.confidence", "q.n", "q.layer"]))
    names = ("revenue", "minutes", "miles", "revenue_std", "minutes_std", "miles_std", "confidence", "observed_trip_count", "source")
    picked = ", ".join("CASE " + " ".join(f"WHEN {c} THEN {v[k]}" for c, v in tiers) + f" END AS {n}" for k, n in enumerate(names))
    stored = "LEFT JOIN od q ON q.time_bin = s.time_bin AND q.origin = s.origin AND q.destination = s.destination" if direct else ""
    return f"""{name}_base AS (
  SELECT s.time_bin, s.origin, s.destination, s.speed, all_mph/s.speed AS sr_, p.rpm/greatest(0.1, all_rpm) AS rr, way, drive, greatest(2.5, intercept + distance*way + duration*drive) AS gr
  FROM (SELECT c.time_bin, c.origin, c.destination, least(greatest(mph, 5), 35) AS speed, all_mph, all_rpm, greatest(0.01, CASE WHEN c.origin = c.destination THEN 0 ELSE coalesce(w.miles, c.miles) END) AS way,
      greatest(1, CASE WHEN c.origin = c.destination THEN 0 ELSE greatest(0.1, coalesce(w.minutes*all_mph, c.miles*60)/least(greatest(mph, 5), 35)) END) AS drive
    FROM structural c CROSS JOIN (SELECT avg(mph) AS all_mph, avg(rpm) AS all_rpm FROM profiles) LEFT JOIN routes w ON w.origin = c.origin AND w.destination = c.destination) s
    JOIN profiles p ON p.time_bin = s.time_bin CROSS JOIN gravity),
{name}_picked AS (
  SELECT s.time_bin, s.origin, s.destination, s.speed, {picked}
  FROM (SELECT b.*, o.n/(o.n+10.0::DOUBLE) AS rel FROM {name}_base b LEFT JOIN {observed} o ON o.time_bin = b.time_bin AND o.origin = b.origin AND o.destination = b.destination) s {stored}
    LEFT JOIN {observed} o ON o.time_bin = s.time_bin AND o.origin = s.origin AND o.destination = s.destination LEFT JOIN {pairs} g ON g.origin = s.origin AND g.destination = s.destination
    LEFT JOIN {temporal} t ON t.time_bin = s.time_bin AND t.origin = s.origin AND t.destination = s.destination LEFT JOIN {spatial} x ON x.origin = s.origin AND x.destination = s.destination),
{name}_banded AS (
  SELECT k.*, z.borough_pair, z.airport_pair, greatest(0.01, k.miles) AS long,
    CASE WHEN round(k.miles, 9) < 1 THEN 0 WHEN round(k.miles, 9) < 2 THEN 1 WHEN round(k.miles, 9) < 4 THEN 2 WHEN round(k.miles, 9) < 7 THEN 3 WHEN round(k.miles, 9) < 12 THEN 4 WHEN round(k.miles, 9) < 20 THEN 5 ELSE 6 END AS band
  FROM {name}_picked k JOIN miles z ON z.origin = k.origin AND z.destination = k.destination),
{name} AS (
  SELECT b.time_bin, b.origin, b.destination, greatest(0, b.revenue) AS revenue, greatest(1, long/35*60, b.minutes, floor_minutes) AS minutes, b.miles, b.revenue_std, b.minutes_std, b.miles_std,
    least(greatest(b.confidence, 0.05), 0.995) AS confidence, b.observed_trip_count, b.source, floor_minutes
  FROM (SELECT b.*, 0.85*greatest(1, long/greatest(speed, 5)*60)*least(greatest(f.factor*coalesce(c1.factor,1)*coalesce(c2.factor,1)*coalesce(c3.factor,1)*coalesce(c4.factor,1), 0.7), 1.8) AS floor_minutes
    FROM {name}_banded b JOIN calibration f ON f.kind = 'global' LEFT JOIN calibration c1 ON c1.kind = 'distance_band' AND c1.key = b.band::VARCHAR LEFT JOIN calibration c2 ON c2.kind = 'borough_pair' AND c2.key = b.borough_pair
    LEFT JOIN calibration c3 ON c3.kind = 'airport_pair' AND c3.key = b.airport_pair LEFT JOIN calibration c4 ON c4.kind = 'time_bin' AND c4.key = b.time_bin::VARCHAR) b)"""


_CHAIN = f"""
WITH RECURSIVE zones AS (
  SELECT CAST(n_nationkey + 1 AS INT) AS zone_id, r_name AS borough, CASE WHEN n_nationkey IN (0, 12) THEN n_name || ' Airport' ELSE n_name END AS zone_name,
    (n_nationkey % 5) * 9000.0::DOUBLE AS cx, floor(n_nationkey / 5) * 9000.0::DOUBLE AS cy
  FROM nation JOIN region ON n_regionkey = r_regionkey),
raw AS (
  SELECT CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST((l_orderkey*7919 + l_linenumber*131 + l_suppkey*17) % 1440 AS BIGINT)) AS pickup,
    2.0::DOUBLE + l_quantity*1.2::DOUBLE + ((l_partkey*13) % 30) AS minutes,
    CAST(s_nationkey + 1 AS INT) AS origin, CAST(c_nationkey + 1 AS INT) AS destination, l_quantity*0.4::DOUBLE AS miles,
    l_extendedprice/1000.0::DOUBLE AS fare, l_extendedprice/1000.0::DOUBLE*l_discount AS tip, strftime(o_orderdate, '%Y-%m') AS source_month
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
timed AS (SELECT *, pickup + to_microseconds(CAST(round(minutes * 60000000) AS BIGINT)) AS dropoff FROM raw),
clean AS (
  SELECT source_month, CAST(pickup AS DATE) AS pickup_date, CAST(hour(pickup)*4 + minute(pickup)//15 AS INT) AS time_bin, CAST(hour(dropoff)*4 + minute(dropoff)//15 AS INT) AS dropoff_bin,
    origin, destination, fare + greatest(tip, 0) AS revenue, minutes, miles
  FROM timed WHERE fare BETWEEN 2.5 AND 500 AND miles BETWEEN 0.01 AND 100 AND minutes BETWEEN 1 AND 240 AND fare + greatest(tip, 0) > 0
    AND origin IN (SELECT zone_id FROM zones) AND destination IN (SELECT zone_id FROM zones)),
cells AS (
  SELECT time_bin, origin, destination, count(*) AS n, sum(revenue) AS r, sum(revenue*revenue) AS rr, sum(minutes) AS m, sum(minutes*minutes) AS mm, sum(miles) AS d, sum(miles*miles) AS dd
  FROM clean GROUP BY ALL),
observed AS (
  SELECT time_bin, origin, destination, n, r/n AS ar, m/n AS am, d/n AS ad,
    CASE WHEN n <= 1 THEN 0 ELSE sqrt(greatest(0, rr/n - (r/n)*(r/n))) END AS sr, CASE WHEN n <= 1 THEN 0 ELSE sqrt(greatest(0, mm/n - (m/n)*(m/n))) END AS sm,
    CASE WHEN n <= 1 THEN 0 ELSE sqrt(greatest(0, dd/n - (d/n)*(d/n))) END AS sd
  FROM cells),
pairs AS (
  SELECT origin, destination, n, r/n AS ar, m/n AS am, d/n AS ad,
    CASE WHEN n <= 1 THEN 0 ELSE sqrt(greatest(0, rr/n - (r/n)*(r/n))) END AS sr, CASE WHEN n <= 1 THEN 0 ELSE sqrt(greatest(0, mm/n - (m/n)*(m/n))) END AS sm,
    CASE WHEN n <= 1 THEN 0 ELSE sqrt(greatest(0, dd/n - (d/n)*(d/n))) END AS sd
  FROM (SELECT origin, destination, sum(n)::BIGINT AS n, sum(r) AS r, sum(rr) AS rr, sum(m) AS m, sum(mm) AS mm, sum(d) AS d, sum(dd) AS dd FROM cells GROUP BY ALL)),
bins AS (SELECT CAST(range AS INT) AS time_bin FROM range(96)),
own_profile AS (SELECT time_bin, sum(n*60*ad/am)/sum(n) AS mph, sum(n*ar/greatest(ad, 0.1))/sum(n) AS rpm FROM observed WHERE ad > 0 AND am > 0 GROUP BY ALL),
all_profile AS (SELECT sum(n*60*ad/am)/sum(n) AS mph, sum(n*ar/greatest(ad, 0.1))/sum(n) AS rpm FROM observed WHERE ad > 0 AND am > 0),
profiles AS (
  SELECT b.time_bin, least(greatest(coalesce(o.mph, a.mph, 15), 5), 35) AS mph, greatest(coalesce(o.rpm, a.rpm, 4), 0.1) AS rpm
  FROM bins b LEFT JOIN own_profile o USING (time_bin) CROSS JOIN all_profile a),
sums AS (
  SELECT sum(n) AS s, sum(n*ad) AS x, sum(n*am) AS z, sum(n*ar) AS y, sum(n*ad*ad) AS xx, sum(n*ad*am) AS xz, sum(n*am*am) AS zz, sum(n*ad*ar) AS xy, sum(n*am*ar) AS zy,
    sum(sqrt(n)*ar)/sum(sqrt(n)) AS mean_revenue, sum(sqrt(n)*am)/sum(sqrt(n)) AS mean_duration, sum(sqrt(n)*ad)/sum(sqrt(n)) AS mean_distance FROM pairs),
gravity AS (
  SELECT (y*(xx*zz-xz*xz) - x*(xy*zz-xz*zy) + z*(xy*xz-xx*zy)) / det AS intercept, (s*(xy*zz-xz*zy) - y*(x*zz-xz*z) + z*(x*zy-xy*z)) / det AS distance,
    (s*(xx*zy-xy*xz) - x*(x*zy-xy*z) + y*(x*xz-xx*z)) / det AS duration, mean_revenue, mean_duration, mean_distance
  FROM (SELECT *, s*(xx*zz-xz*xz) - x*(x*zz-xz*z) + z*(x*xz-xx*z) AS det FROM sums)),
miles AS (SELECT a.zone_id AS origin, b.zone_id AS destination, sqrt((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy))/5280.0 AS miles, a.borough || '->' || b.borough AS borough_pair,
    CASE WHEN a.zone_name LIKE '%Airport%' OR b.zone_name LIKE '%Airport%' THEN 'airport' ELSE 'non_airport' END AS airport_pair FROM zones a, zones b),
ratios AS (
  SELECT o.time_bin, n, CASE WHEN round(ad, 9) < 1 THEN 0 WHEN round(ad, 9) < 2 THEN 1 WHEN round(ad, 9) < 4 THEN 2 WHEN round(ad, 9) < 7 THEN 3 WHEN round(ad, 9) < 12 THEN 4 WHEN round(ad, 9) < 20 THEN 5 ELSE 6 END AS distance_band, borough_pair, airport_pair,
    least(greatest(am / greatest(1, ad/greatest(mph, 5)*60), 0.35), 3) AS ratio
  FROM observed o JOIN profiles p USING (time_bin) JOIN miles z ON o.origin = z.origin AND o.destination = z.destination WHERE ad > 0 AND am > 0),
overall AS (SELECT sum(n*ratio)/sum(n) AS overall, sum(n)::BIGINT AS trips FROM ratios),
grouped AS (
  SELECT 'distance_band' AS kind, distance_band::VARCHAR AS key, sum(n*ratio)/sum(n) AS raw, sum(n)::BIGINT AS trips FROM ratios GROUP BY ALL
  UNION ALL SELECT 'borough_pair', borough_pair, sum(n*ratio)/sum(n), sum(n)::BIGINT FROM ratios GROUP BY borough_pair
  UNION ALL SELECT 'airport_pair', airport_pair, sum(n*ratio)/sum(n), sum(n)::BIGINT FROM ratios GROUP BY airport_pair
  UNION ALL SELECT 'time_bin', time_bin::VARCHAR, sum(n*ratio)/sum(n), sum(n)::BIGINT FROM ratios GROUP BY time_bin),
calibration AS (
  SELECT kind, key, least(greatest((trips/(trips+150.0::DOUBLE)*raw + (1-trips/(trips+150.0::DOUBLE))*o)/o, 0.75), 1.35) AS factor, trips FROM (SELECT g.*, overall AS o FROM grouped g, overall) WHERE trips >= 50
  UNION ALL SELECT 'global', '', least(greatest(overall, 0.7), 1.8), trips FROM overall),
near_all AS (SELECT origin AS zone_id, destination AS neighbour, miles, row_number() OVER (PARTITION BY origin ORDER BY miles, destination) AS rank FROM miles WHERE origin <> destination),
near AS (SELECT * FROM near_all WHERE rank <= 4),
structural AS (
  SELECT b.time_bin, z.origin, z.destination, z.miles, z.borough_pair, z.airport_pair, p.mph,
    CASE WHEN round(miles, 9) < 1 THEN 0 WHEN round(miles, 9) < 2 THEN 1 WHEN round(miles, 9) < 4 THEN 2 WHEN round(miles, 9) < 7 THEN 3 WHEN round(miles, 9) < 12 THEN 4 WHEN round(miles, 9) < 20 THEN 5 ELSE 6 END AS distance_band
  FROM miles z CROSS JOIN bins b JOIN profiles p USING (time_bin)),
calibrated AS (
  SELECT s.*, mult, greatest(1, greatest(1, miles/greatest(mph, 5)*60)*mult) AS minutes FROM (
    SELECT s.*, least(greatest(g.factor*coalesce(a.factor,1)*coalesce(b.factor,1)*coalesce(c.factor,1)*coalesce(d.factor,1), 0.7), 1.8) AS mult
    FROM structural s JOIN calibration g ON g.kind = 'global'
    LEFT JOIN calibration a ON a.kind = 'distance_band' AND a.key = s.distance_band::VARCHAR LEFT JOIN calibration b ON b.kind = 'borough_pair' AND b.key = s.borough_pair
    LEFT JOIN calibration c ON c.kind = 'airport_pair' AND c.key = s.airport_pair LEFT JOIN calibration d ON d.kind = 'time_bin' AND d.key = s.time_bin::VARCHAR) s),
days AS (SELECT count(*) AS service_days FROM (SELECT DISTINCT source_month, pickup_date FROM clean)),
picks AS (SELECT time_bin, origin AS zone_id, count(*) AS pickup_count FROM clean GROUP BY ALL),
drops AS (SELECT dropoff_bin AS time_bin, destination AS zone_id, count(*) AS dropoff_count FROM clean GROUP BY ALL),
grid AS (
  SELECT b.time_bin, z.zone_id, coalesce(pickup_count, 0) AS pickup_count, coalesce(dropoff_count, 0) AS dropoff_count, service_days,
    coalesce(pickup_count, 0)/greatest(service_days, 1)::DOUBLE AS raw_pickups, coalesce(dropoff_count, 0)/greatest(service_days, 1)::DOUBLE AS raw_dropoffs
  FROM zones z CROSS JOIN bins b CROSS JOIN days LEFT JOIN picks p ON p.time_bin = b.time_bin AND p.zone_id = z.zone_id LEFT JOIN drops d ON d.time_bin = b.time_bin AND d.zone_id = z.zone_id),
around_bins AS (SELECT (time_bin + step + 96) % 96 AS time_bin, zone_id, sum(raw_pickups*near)/sum(near) AS prior FROM grid, {_OFFSETS} GROUP BY ALL),
around_zones AS (SELECT g.time_bin, n.zone_id, sum(raw_pickups*exp(-miles/2))/sum(exp(-miles/2)) AS prior FROM near n JOIN grid g ON g.zone_id = n.neighbour GROUP BY ALL),
zone_rate AS (SELECT zone_id, avg(raw_pickups) AS rate FROM grid GROUP BY ALL),
bin_rate AS (SELECT time_bin, avg(raw_pickups) AS rate FROM grid GROUP BY ALL),
grand AS (SELECT avg(raw_pickups) AS rate FROM grid),
posterior AS (
  SELECT g.time_bin, g.zone_id, pickup_count, dropoff_count, service_days, raw_pickups, raw_dropoffs, t.prior AS temporal_prior, s.prior AS spatial_prior,
    greatest(pickup_count/(pickup_count+12.0::DOUBLE)*raw_pickups + (1-pickup_count/(pickup_count+12.0::DOUBLE))*(4*t.prior + 2*s.prior + 3*z.rate + 2*b.rate + a.rate)/12, 1e-8) AS posterior,
    least(greatest(pickup_count/(pickup_count+12.0::DOUBLE), 0.05), 0.995) AS node_confidence,
    CASE WHEN pickup_count >= 20 THEN 'observed_dense_eb' WHEN pickup_count > 0 THEN 'observed_sparse_eb' WHEN t.prior > 0 THEN 'temporal_spatial_eb' ELSE 'global_prior' END AS node_layer
  FROM grid g JOIN around_bins t ON t.time_bin = g.time_bin AND t.zone_id = g.zone_id JOIN around_zones s ON s.time_bin = g.time_bin AND s.zone_id = g.zone_id
    JOIN zone_rate z ON z.zone_id = g.zone_id JOIN bin_rate b ON b.time_bin = g.time_bin CROSS JOIN grand a),
history AS (
  SELECT zone_id, 0.35 + sum(power(0.72, 95 - time_bin)*(raw_dropoffs + 0.45*posterior)) AS stock FROM posterior WHERE time_bin >= 88 GROUP BY ALL),
cycle AS (
  SELECT 0 AS k, zone_id, stock FROM history
  UNION ALL
  SELECT c.k + 1, c.zone_id, greatest(0.35, 0.72*c.stock + b.raw_dropoffs + 0.45*b.posterior - 0.72*a.posterior)
  FROM cycle c JOIN posterior a ON a.zone_id = c.zone_id AND a.time_bin = c.k % 96 JOIN posterior b ON b.zone_id = c.zone_id AND b.time_bin = (c.k + 95) % 96 WHERE c.k < 480),
stock AS (SELECT CAST(k - 385 AS INT) AS time_bin, zone_id, stock FROM cycle WHERE k > 384),
around_stock AS (SELECT g.time_bin, n.zone_id, sum(stock*exp(-miles/2))/sum(exp(-miles/2)) AS mean FROM near n JOIN stock g ON g.zone_id = n.neighbour GROUP BY ALL),
supply AS (SELECT s.time_bin, s.zone_id, 0.78*stock + 0.22*mean AS supply FROM stock s JOIN around_stock a ON a.time_bin = s.time_bin AND a.zone_id = s.zone_id),
half AS (SELECT greatest(0.05, 0.05*quantile_cont(posterior, 0.5)) AS fl FROM posterior WHERE posterior > 0),
pressure AS (SELECT p.*, supply, (supply + 0.35)/(posterior + fl) AS ratio FROM posterior p JOIN supply s ON s.time_bin = p.time_bin AND s.zone_id = p.zone_id CROSS JOIN half),
middle AS (SELECT quantile_cont(ratio, 0.5) AS middle FROM pressure WHERE ratio > 0),
nodes AS (
  SELECT p.*, zone_name, least(greatest(12/middle*ratio*0.70*q, 1), 75) AS wait_low, least(greatest(12/middle*ratio*1.00*q, 1), 75) AS wait_medium, least(greatest(12/middle*ratio*1.35*q, 1), 75) AS wait_high
  FROM (SELECT p.*, zone_name, CASE WHEN zone_name LIKE '%Airport%' THEN 1.25 ELSE 1 END AS q FROM pressure p JOIN zones z ON z.zone_id = p.zone_id) p CROSS JOIN middle),
flows AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY n DESC, destination) AS rank FROM pairs),
popular AS (SELECT destination, row_number() OVER (ORDER BY n DESC, destination) - 1 AS rank, least(count(*) OVER (), 20) AS of FROM (SELECT destination, sum(n) AS n FROM pairs GROUP BY ALL)),
scored AS (
  SELECT time_bin, origin, destination, sum(score) AS score FROM (
    SELECT time_bin, origin, destination, n::DOUBLE AS score FROM observed
    UNION ALL SELECT time_bin, origin, destination, 0.35::DOUBLE*n FROM flows CROSS JOIN bins WHERE rank <= 20
    UNION ALL SELECT time_bin, zone_id, destination, greatest(0.1, 1 - rank/of::DOUBLE) FROM popular CROSS JOIN bins CROSS JOIN zones WHERE rank < 20
    UNION ALL SELECT time_bin, zone_id, zone_id, 0 FROM bins CROSS JOIN zones) GROUP BY ALL),
support AS (SELECT time_bin, origin, destination, score FROM (SELECT *, row_number() OVER (PARTITION BY time_bin, origin ORDER BY round(score, 9) DESC, destination) AS k FROM scored) WHERE k <= 20),
{_priors('temporal', 'spatial', 'observed', 'pairs')},
mean_mph AS (SELECT avg(mph) AS all_mph FROM profiles),
totals AS (SELECT origin, sum(n) AS n FROM pairs GROUP BY ALL),
joined AS (
  SELECT s.time_bin, s.origin, s.destination, c.miles, c.minutes AS gm, c.mult, coalesce(o.n, 0)::DOUBLE AS n, coalesce(p.n, 0)::DOUBLE AS pn, o.ar AS o_r, o.am AS o_m, o.ad AS o_d, o.sr AS o_sr, p.sr AS p_sr, o.sm AS o_sm, p.sm AS p_sm, o.sd AS o_sd, p.sd AS p_sd, p.n IS NOT NULL AS seen,
    greatest(0, intercept + distance*c.miles + duration*c.minutes) AS gr, coalesce(p.ar, mean_revenue) AS p_r, coalesce(p.am*all_mph/c.mph, c.minutes) AS p_m, coalesce(p.ad, c.miles) AS p_d,
    coalesce(t.w, 0) AS tw, t.r AS t_r, t.m AS t_m, t.d AS t_d, coalesce(x.w, 0) AS xw, x.r AS x_r, x.m AS x_m, x.d AS x_d, coalesce(tt.n, 0) AS total, posterior AS rate
  FROM support s JOIN calibrated c ON c.time_bin = s.time_bin AND c.origin = s.origin AND c.destination = s.destination CROSS JOIN gravity CROSS JOIN mean_mph
    LEFT JOIN observed o ON o.time_bin = s.time_bin AND o.origin = s.origin AND o.destination = s.destination LEFT JOIN pairs p ON p.origin = s.origin AND p.destination = s.destination
    LEFT JOIN temporal t ON t.time_bin = s.time_bin AND t.origin = s.origin AND t.destination = s.destination LEFT JOIN spatial x ON x.origin = s.origin AND x.destination = s.destination
    LEFT JOIN totals tt ON tt.origin = s.origin LEFT JOIN posterior q ON q.time_bin = s.time_bin AND q.zone_id = s.origin),
weighted AS (
  SELECT *, least(tw, 20) AS w2, least(xw, 20) AS w3, least(0.35*pn, 25) AS w4, coalesce(t_r, p_r) AS tr, coalesce(t_m, p_m) AS tm, coalesce(t_d, p_d) AS td, coalesce(x_r, p_r) AS xr, coalesce(x_m, p_m) AS xm, coalesce(x_d, p_d) AS xd,
    n + 0.5*tw + 0.25*least(xw, 20) + 0.2*pn AS eff, 0.8*CASE WHEN total > 0 THEN pn/total ELSE 0 END + 0.2*exp(-miles/8) AS prior FROM joined),
blended AS (
  SELECT *, (coalesce(n*o_r, 0) + w2*tr + w3*xr + w4*p_r + 2*gr)/(n + w2 + w3 + w4 + 2) AS revenue,
    greatest(1, exp((coalesce(n*ln(o_m), 0) + w2*ln(tm) + w3*ln(xm) + w4*ln(p_m) + 2*ln(gm))/(n + w2 + w3 + w4 + 2)), 0.85*gm) AS minutes,
    greatest(0.01, (coalesce(n*o_d, 0) + w2*td + w3*xd + w4*p_d + CASE WHEN true THEN 2*miles END)/(n + w2 + w3 + w4 + 2)) AS dist,
    prior/sum(prior) OVER (PARTITION BY time_bin, origin) AS share FROM weighted),
od AS (SELECT *, (n + 8*share)/sum(n + 8*share) OVER (PARTITION BY time_bin, origin) AS p,
    CASE WHEN n >= 20 THEN 'observed_dense_eb' WHEN n > 0 THEN 'observed_sparse_eb' WHEN tw > 0 THEN 'temporal_eb' WHEN w3 > 0 THEN 'spatial_eb' WHEN pn > 0 THEN 'global_od_eb' ELSE 'gravity_prior' END AS layer,
    least(greatest(eff/(eff+10), 0.05), 0.995) AS confidence, CASE WHEN n >= 2 THEN o_sr WHEN seen THEN p_sr ELSE greatest(1, 0.35*gr) END AS dev,
    CASE WHEN n >= 2 THEN o_sm WHEN seen THEN p_sm ELSE greatest(2, 0.3*gm) END AS dev_m, CASE WHEN n >= 2 THEN o_sd WHEN seen THEN p_sd ELSE greatest(0.25, 0.25*miles) END AS dev_d FROM blended),
expected AS (SELECT time_bin, origin AS zone_id, sum(p*revenue) AS revenue, sum(p*minutes) AS minutes, sum(p*dist) AS dist FROM od GROUP BY ALL),
adjacent AS (SELECT origin, destination FROM miles WHERE origin <> destination AND miles <= 9000.5/5280),
edges AS (
  SELECT a.origin, a.destination, CASE WHEN n IS NOT NULL THEN greatest(am, 0.1) ELSE greatest(miles/15*60, 0.1) END AS minutes, CASE WHEN n IS NOT NULL THEN greatest(ad, 0.01) ELSE greatest(miles, 0.01) END AS miles,
    CASE WHEN n IS NOT NULL THEN least(greatest(n/(n+10.0::DOUBLE), 0.2), 0.99) ELSE 0.2 END AS confidence, CASE WHEN n IS NOT NULL THEN 'historical_od' ELSE 'centroid_fallback' END AS edge_source
  FROM adjacent a JOIN miles z ON z.origin = a.origin AND z.destination = a.destination LEFT JOIN pairs p ON p.origin = a.origin AND p.destination = a.destination),
hops AS (
  SELECT 1 AS k, origin, destination, minutes, miles FROM edges
  UNION ALL
  SELECT k + 1, origin, destination, min(minutes), arg_min(miles, minutes) FROM (
    SELECT h.k, h.origin, e.destination, h.minutes + e.minutes AS minutes, h.miles + e.miles AS miles FROM hops h JOIN edges e ON e.origin = h.destination WHERE h.k < 24 AND e.destination <> h.origin) GROUP BY ALL),
routes AS (SELECT origin, destination, min(minutes) AS minutes, arg_min(miles, minutes) AS miles FROM hops GROUP BY ALL),
part_observed AS (SELECT * FROM observed),
part_pairs AS (SELECT * FROM pairs),
{_priors('part_temporal', 'part_spatial', 'part_observed', 'part_pairs')},
{_estimates('fallback', 'part_observed', 'part_pairs', 'part_temporal', 'part_spatial', direct=False)},
{_estimates('estimate', 'observed', 'pairs', 'temporal', 'spatial', direct=True)},
asked AS (
  SELECT o_orderkey AS query_id, CAST(c_nationkey + 1 AS INT) AS origin, CAST((c_nationkey + o_orderkey) % 25 + 1 AS INT) AS destination, CAST((o_orderkey*37) % 1440 AS DOUBLE) AS minute
  FROM orders JOIN customer ON o_custkey = c_custkey),
full_nodes AS (SELECT n.*, e.revenue, e.minutes, e.dist FROM nodes n JOIN expected e ON e.time_bin = n.time_bin AND e.zone_id = n.zone_id),
sided AS (SELECT *, CAST(floor(minute/15) AS INT) AS low, CAST((floor(minute/15) + 1) % 96 AS INT) AS high, minute/15 - floor(minute/15) AS t FROM asked)
"""


def _select(columns: str, source: str, doubles: str = "", digits: int = 5) -> str:
    """columns as they are; doubles as `expression name` pairs, rounded as in the queries."""
    parts = [columns] if columns else []
    for x in filter(None, (p.strip() for p in doubles.split(";"))):
        expression, _, name = x.rpartition(" ")
        parts.append(f"round({expression or name} + 1.3e-9, {digits}) AS {name}")
    return f"{_CHAIN} SELECT {', '.join(parts)} FROM {source}"


_ESTIMATED = ("revenue", "minutes", "miles", "revenue_std", "minutes_std", "miles_std", "confidence", "observed_trip_count")

_NODES = """(SELECT s.query_id, s.origin AS zone_id, s.minute, {} FROM sided s JOIN full_nodes a ON a.time_bin = low AND a.zone_id = s.origin JOIN full_nodes b ON b.time_bin = high AND b.zone_id = s.origin)"""
_NODE_NAMES = ("posterior", "ratio", "supply", "node_confidence", "revenue", "minutes", "dist", "wait_high")

ORACLES: dict[str, str] = {
    "od_lookup": _select(
        "query_id, origin, destination, source, observed_trip_count > 0 AS is_directly_observed",
        "(SELECT s.query_id, s.origin, s.destination, CASE WHEN t < 0.5 THEN a.source ELSE b.source END AS source, " + ", ".join(f"(1-t)*a.{c} + t*b.{c} AS {c}" for c in _ESTIMATED)
        + " FROM sided s JOIN estimate a ON a.time_bin = low AND a.origin = s.origin AND a.destination = s.destination JOIN estimate b ON b.time_bin = high AND b.origin = s.origin AND b.destination = s.destination)",
        "; ".join(_ESTIMATED), 3,
    ),
    "od_lookup_fallbacks": _select("time_bin, origin, destination, source", "fallback", "; ".join((*_ESTIMATED, "floor_minutes")), 3),
    "node_lookup": _select(
        "query_id, zone_id", _NODES.format(", ".join(f"(1-t)*a.{c} + t*b.{c} AS {c}" for c in _NODE_NAMES)),
        "minute; posterior; ratio competition_ratio; supply; node_confidence; revenue expected_driver_revenue; minutes expected_duration_min; dist expected_distance_miles; wait_high expected_wait; 1-exp(-15/wait_high) pickup_probability",
    ),
    "od_options": _select(
        "query_id, origin, destination",
        "(SELECT query_id, origin, destination, p/sum(p) OVER (PARTITION BY query_id) AS probability, r/p AS revenue, m/p AS minutes, d/p AS dist, c/p AS confidence FROM (SELECT (z.time_bin*1000 + z.zone_id)::BIGINT AS query_id, origin, destination, sum(w*p) AS p, sum(w*p*revenue) AS r, sum(w*p*minutes) AS m, sum(w*p*dist) AS d, sum(w*p*confidence) AS c"
        " FROM grid z CROSS JOIN (VALUES (0, 8/15.0::DOUBLE), (1, 7/15.0::DOUBLE)) AS side(k, w) JOIN od ON od.origin = z.zone_id AND od.time_bin = (z.time_bin + k) % 96 GROUP BY ALL))",
        "probability; revenue driver_revenue; minutes duration_min; dist distance_miles; confidence", 3,
    ),
    "bin_leaders": f"""{_CHAIN} SELECT time_bin, zone_id FROM (SELECT time_bin, zone_id, """
    + ", ".join(f"row_number() OVER (PARTITION BY time_bin ORDER BY round({c} + 1.3e-9, 5) {o}, zone_id) AS k{i}" for i, (c, o) in enumerate((("posterior", "DESC"), ("revenue", "DESC"), ("wait_medium", "ASC"), ("1-exp(-15/wait_medium)", "DESC"), ("ratio", "ASC"))))
    + " FROM full_nodes) WHERE least(k0, k1, k2, k3, k4) <= 12",
    "od_time_profile": _select("time_bin, origin, destination, n AS trip_count", "observed", "ar observed_avg_driver_revenue; am observed_avg_duration_min; ad observed_avg_distance_miles; sr observed_revenue_std; sm observed_duration_std; sd observed_distance_std"),
    "clean_trips_by_month": _select("source_month, count(*) AS trips, count(DISTINCT pickup_date) AS days", "clean GROUP BY source_month", "sum(revenue) revenue; avg(minutes) minutes; max(miles) longest"),
    "pickup_counts": _select("time_bin, zone_id, pickup_count", "picks"),
    "dropoff_counts": _select("time_bin, zone_id, dropoff_count", "drops"),
    "service_days": _select("service_days", "days"),
    "combined_partials": _select("time_bin, origin, destination, n AS trip_count", "cells", "r revenue_sum; m duration_sum; d distance_sum"),
    "global_od": _select("origin, destination, n AS trip_count", "pairs", "ar avg_driver_revenue; am avg_duration_min; ad avg_distance_miles; sr revenue_std; sm duration_std; sd distance_std"),
    "time_profiles": _select("time_bin", "profiles", "mph speed_mph; rpm revenue_per_mile"),
    "gravity_fit": _select("", "gravity", "intercept; distance; duration; mean_revenue; mean_duration; mean_distance"),
    "duration_calibration": _select("kind, key, trips", "calibration", "factor"),
    "calibrated_durations": _select("time_bin, origin, destination, distance_band, borough_pair, airport_pair", "calibrated", "miles; mult calibration_multiplier; minutes calibrated_minutes"),
    "nearest_zones": _select("zone_id, neighbour, CAST(rank AS INT) AS rank", "near", "miles"),
    "reposition_edges": _select("origin, destination, edge_source", "edges", "minutes duration_min; miles distance_miles; confidence"),
    "shortest_routes": _select("origin, destination", "routes", "minutes"),
    "node_posterior": _select("time_bin, zone_id, pickup_count, dropoff_count, service_days, node_layer", "posterior", "raw_pickups; raw_dropoffs; temporal_prior; spatial_prior; posterior; node_confidence"),
    "latent_stock": _select("zone_id, time_bin", "stock", "stock"),
    "node_metrics": _select("time_bin, zone_id", "nodes", "supply; ratio competition_ratio; wait_low expected_wait_low; wait_medium expected_wait_medium; wait_high expected_wait_high; greatest(wait_medium*posterior/15-1, 0) competitors_medium; 1-exp(-15/wait_medium) pickup_probability"),
    "state_features": _select(
        "query_id AS state_id, zone_id", _NODES.format(", ".join(f"(1-t)*a.{c} + t*b.{c} AS {c}" for c in ("posterior", "ratio", "node_confidence", "revenue", "minutes", "dist", "wait_medium")) + ", (1-t)*greatest(a.wait_medium*a.posterior/15-1, 0) + t*greatest(b.wait_medium*b.posterior/15-1, 0) AS rivals")
        + " n CROSS JOIN (SELECT greatest(quantile_cont(posterior, 0.95), 1) AS scale FROM posterior)",
        "sin(2*pi()*minute/1440) sin_clock; cos(2*pi()*minute/1440) cos_clock; (minute%120)/120 remaining_share; n.posterior/scale demand; wait_medium/75 wait; revenue/100 revenue; minutes/90 minutes; dist/30 miles; ratio/(1+ratio) crowding; rivals/(10+rivals) competitors; node_confidence confidence",
    ),
    "pickup_scale": _select("", "posterior", "greatest(quantile_cont(posterior, 0.95), 1) pickup_scale"),
    "od_support": _select("time_bin, origin, destination", "support", "score"),
    "od_temporal_prior": _select("time_bin, origin, destination", "temporal", "w temporal_weight; r temporal_driver_revenue; m temporal_duration_min; d temporal_distance_miles"),
    "od_spatial_prior": _select("origin, destination", "spatial", "w spatial_total; r spatial_driver_revenue; m spatial_duration_min; d spatial_distance_miles"),
    "od_estimates": _select("time_bin, origin, destination, layer AS imputation_layer", "od", "n observed_trip_count; revenue driver_revenue; minutes duration_min; dist distance_miles; dev revenue_dev; confidence; eff effective_sample_size; mult calibration_multiplier; p destination_probability; p*rate trips_per_bin_day", 3),
    "node_trip_expectations": _select("time_bin, zone_id", "expected", "revenue expected_driver_revenue; minutes expected_duration_min; dist expected_distance_miles", 3),
    "build_summary": _select(
        "(SELECT count(*) FROM od) AS od_rows, (SELECT count(*) FROM od WHERE n > 0) AS observed_cells, (SELECT count(*) FROM od WHERE n = 0) AS imputed_cells, count(*) AS node_rows, max(service_days) AS service_days, (SELECT count(*) FROM edges) AS directed_edges",
        "nodes", "(SELECT avg(confidence) FROM od) mean_od_confidence; avg(node_confidence) mean_node_confidence; avg(wait_medium) mean_wait; quantile_cont(wait_medium, 0.5) median_wait",
    ),
    "profile_at_minutes": _select(
        "query_id, printf('%02d:%02d', CAST(floor(minute/60) AS INT), CAST(minute % 60 AS INT)) AS clock",
        "(SELECT s.*, least(greatest((1-t)*a.mph + t*b.mph, 5), 35) AS speed, greatest((1-t)*a.rpm + t*b.rpm, 0.1) AS rate FROM sided s JOIN profiles a ON a.time_bin = low JOIN profiles b ON b.time_bin = high)",
        "minute; speed speed_at; rate rpm_at; least(greatest(speed-5*exp(-5/speed)/(1-exp(-5/speed)),0),5) wait_within_step; 1-exp(-5/speed) pickup_within_step; minute minute_again",
    ),
}

_KIND = "CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 8 WHEN 'view' THEN 16 END"

_EVENTS = f"""
WITH episodes AS (SELECT event_type AS algorithm, user_id AS scenario_id, sum(value) AS x, count(*) AS trips FROM events GROUP BY ALL),
summary AS (
  SELECT algorithm, count(*) AS episodes, avg(x) AS mean, coalesce(stddev_samp(x), 0) AS std, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.1) AS worst, avg(trips) AS trips FROM episodes GROUP BY ALL),
differences AS (SELECT a.algorithm, a.x - b.x AS d FROM episodes a JOIN episodes b USING (scenario_id) WHERE b.algorithm = 'view' AND a.algorithm <> 'view'),
gains AS (
  SELECT algorithm, count(*) AS pairs, avg(d) AS mean_gain, coalesce(stddev_samp(d), 0) AS std_gain, quantile_cont(d, 0.5) AS median_gain, avg((d > 1e-9)::DOUBLE) AS win_rate, avg((abs(d) <= 1e-9)::DOUBLE) AS tie_rate, avg((d < -1e-9)::DOUBLE) AS loss_rate
  FROM differences GROUP BY ALL),
scored AS (
  SELECT e.*, abs(x - avg(x) OVER w)/greatest(1, stddev_samp(x) OVER w) + abs(trips - avg(trips) OVER w)/greatest(1, stddev_samp(trips) OVER w) AS score FROM episodes e WINDOW w AS (PARTITION BY algorithm)),
daily AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS value FROM events GROUP BY ALL),
totals AS (SELECT user_id, {_KIND} AS bit, sum(value) AS total FROM events WHERE {_KIND} IS NOT NULL GROUP BY ALL),
masks AS (SELECT range AS mask FROM range(32)),
worth AS (SELECT mask, sum(best) AS value FROM (SELECT mask, user_id, max(total) AS best FROM totals, masks WHERE (mask & bit) <> 0 GROUP BY ALL) GROUP BY ALL),
coalitions AS (SELECT m.mask, coalesce(value, 0) AS value FROM masks m LEFT JOIN worth w ON w.mask = m.mask),
players AS (SELECT CAST(range + 1 AS INT) AS player, 1::BIGINT << range AS bit FROM range(5)),
marginals AS (SELECT player, a.mask, bit_count(a.mask) AS size, b.value - a.value AS marginal FROM coalitions a JOIN players p ON (a.mask & bit) = 0 JOIN coalitions b ON b.mask = a.mask | bit),
shapley AS (SELECT player, sum(marginal * [24, 6, 4, 6, 24][size + 1] / 120.0::DOUBLE) AS shapley_value FROM marginals GROUP BY ALL),
alone AS (SELECT player, marginal AS gain FROM marginals WHERE mask = 0),
synergy AS (SELECT m.player, q.player AS partner, m.marginal - a.gain AS synergy FROM marginals m JOIN players q ON q.bit = m.mask JOIN alone a ON a.player = m.player),
drawn AS (SELECT r.range AS p, player, bit, md5(concat_ws(':', 7, r.range, player)) AS u FROM players, range(256) r),
walked AS (SELECT player, bit, sum(bit) OVER (PARTITION BY p ORDER BY u, player ROWS UNBOUNDED PRECEDING) AS upto FROM drawn UNION ALL SELECT player, bit, sum(bit) OVER (PARTITION BY p ORDER BY u DESC, player DESC ROWS UNBOUNDED PRECEDING) FROM drawn),
ranked AS (SELECT s.*, bit, row_number() OVER (ORDER BY shapley_value DESC, s.player) AS removed, sum(bit) OVER (ORDER BY shapley_value DESC, s.player ROWS UNBOUNDED PRECEDING) AS gone FROM shapley s JOIN players p ON p.player = s.player),
taken AS (
  SELECT 'top' AS kind, removed, gone FROM ranked
  UNION ALL SELECT 'random', row_number() OVER (PARTITION BY p ORDER BY u, player), sum(bit) OVER (PARTITION BY p ORDER BY u, player ROWS UNBOUNDED PRECEDING) FROM drawn WHERE p < 20)
"""


def _events(columns: str, source: str, doubles: str = "", digits: int = 5) -> str:
    return _EVENTS + _select(columns, source, doubles, digits).removeprefix(_CHAIN)


_HELD = """(SELECT round(o_r, 6) AS r, round(o_m, 6) AS m, round(o_d, 6) AS d, round((w2*tr + w3*xr + w4*p_r + 2*gr)/(w2 + w3 + w4 + 2), 6) AS hr,
  round(greatest(exp((w2*ln(tm) + w3*ln(xm) + w4*ln(p_m) + 2*ln(gm))/(w2 + w3 + w4 + 2)), 0.85*gm), 6) AS hm, round((w2*td + w3*xd + w4*p_d + 2*miles)/(w2 + w3 + w4 + 2), 6) AS hd FROM od WHERE n > 0)"""


def _errors(truth: str, held: str, source: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    comma = f"{by}, " if by else ""
    ranked = f"(SELECT {comma}{truth} AS t, {held} AS e, rank() OVER ({part} ORDER BY {truth}) + (count(*) OVER (PARTITION BY {comma}{truth}) - 1)/2.0 AS rt, rank() OVER ({part} ORDER BY {held}) + (count(*) OVER (PARTITION BY {comma}{held}) - 1)/2.0 AS re FROM {source})"
    return f"(SELECT {comma}count(*) AS n, avg(abs(e - t)) AS mae, sqrt(avg((e - t)*(e - t))) AS rmse, avg(e - t) AS bias, 100*avg(CASE WHEN t <> 0 THEN abs((e - t)/t) END) AS mape, corr(rt, re) AS spearman FROM {ranked}{' GROUP BY ' + by if by else ''})"


#: A uniform draw by the first 52 bits of the keys' MD5.
_UNIFORM = "((('0x' || substr(md5(concat_ws(':', 7, range, '{}')), 1, 13))::BIGINT + 0.5::DOUBLE)/4503599627370496)"

_METRICS = "mae; rmse; bias; mape; spearman"

ORACLES |= {
    "episode_summary": _events("algorithm, episodes, row_number() OVER (ORDER BY mean DESC, algorithm)::INT AS rank", "summary", "mean; std; median; worst worst_10_percent; trips mean_completed_trips; mean-1.96*std/sqrt(episodes) lower; mean+1.96*std/sqrt(episodes) upper"),
    "paired_comparison": _events("algorithm, pairs, 'view' AS baseline", "gains", "mean_gain; std_gain; median_gain; win_rate; tie_rate; loss_rate; mean_gain-1.96*std_gain/sqrt(pairs) lower_gain; mean_gain+1.96*std_gain/sqrt(pairs) upper_gain"),
    "summary_with_pairs": _events("s.algorithm, row_number() OVER (ORDER BY mean DESC, s.algorithm)::INT AS rank", "summary s LEFT JOIN gains g ON g.algorithm = s.algorithm", "mean; mean_gain; win_rate"),
    "representative_episode": _events("algorithm, scenario_id, trips AS completed_trips", "(SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY score, scenario_id) AS k FROM scored) WHERE k = 1", "x net_earnings; score"),
    "event_summary": _events("event_type, hour(ts)::INT AS hour, count(*) AS events", "events GROUP BY event_type, hour(ts)", "sum(value) total_value", 4),
    "trip_count_distribution": _events("algorithm", "episodes GROUP BY algorithm", "quantile_cont(trips,0) low; quantile_cont(trips,0.25) q1; quantile_cont(trips,0.5) median; quantile_cont(trips,0.75) q3; quantile_cont(trips,1) high"),
    "interval_bars": _events("algorithm", "summary", "mean; 1.96*std/sqrt(episodes) below; 1.96*std/sqrt(episodes) above"),
    "smoothed_history": _events("event_type, day", "(SELECT *, avg(value) OVER (PARTITION BY event_type ORDER BY day ROWS 6 PRECEDING) AS smoothed FROM daily)", "value; smoothed", 4),
    "shapley_values": _events("player", "shapley", "shapley_value", 4),
    "pair_synergy": _events("player, partner", "(SELECT *, row_number() OVER (PARTITION BY player ORDER BY synergy DESC, partner) AS k FROM synergy) WHERE k = 1", "synergy", 4),
    "ablation_summary": _events("kind, removed::INT AS removed, count(*) AS n", "(SELECT kind, removed, full_value - value AS gone FROM taken t JOIN coalitions c ON c.mask = 31 - t.gone CROSS JOIN (SELECT value AS full_value FROM coalitions WHERE mask = 31)) GROUP BY kind, removed", "avg(gone) mean_drop; coalesce(stddev_samp(gone),0) std_drop", 3),
    "shapley_sampled": _events("player", "(SELECT player, b.value - a.value AS gain FROM walked w JOIN coalitions b ON b.mask = w.upto JOIN coalitions a ON a.mask = w.upto - w.bit) GROUP BY player", "avg(gain) shapley_value; coalesce(stddev_samp(gain),0)/sqrt(count(*)) standard_error", 3),
    "holdout_sample": f"""{_CHAIN}, enough AS (SELECT CASE WHEN count(*) FILTER (n >= 20) > 0 THEN 20 ELSE quantile_cont(n, 0.75) END AS least FROM od WHERE n > 0),
chosen AS (SELECT od.* FROM od CROSS JOIN enough WHERE n > 0 AND n >= least ORDER BY md5(concat_ws(':', 7, time_bin, origin, destination)), time_bin, origin, destination LIMIT 2000)
""" + _select("time_bin, origin, destination", "chosen", "n observed_trip_count; (w2*tr+w3*xr+w4*p_r+2*gr)/(w2+w3+w4+2) held_revenue; greatest(exp((w2*ln(tm)+w3*ln(xm)+w4*ln(p_m)+2*ln(gm))/(w2+w3+w4+2)),0.85*gm) held_minutes; (w2*td+w3*xd+w4*p_d+2*miles)/(w2+w3+w4+2) held_miles", 3).removeprefix(_CHAIN),
    "coverage_summary": f"""{_CHAIN}, drawn AS (
  SELECT range AS query_id, floor({_UNIFORM.format('o')}*25)::INT + 1 AS origin, floor({_UNIFORM.format('d')}*25)::INT + 1 AS destination, floor({_UNIFORM.format('m')}*1440)::DOUBLE AS minute FROM range(5000)),
answers AS (
  SELECT CASE WHEN t < 0.5 THEN a.source ELSE b.source END AS source, (1-t)*a.confidence + t*b.confidence AS confidence, (1-t)*a.observed_trip_count + t*b.observed_trip_count > 0 AS seen
  FROM (SELECT *, floor(minute/15)::INT AS low, minute/15 - floor(minute/15) AS t FROM drawn) s JOIN estimate a ON a.time_bin = low AND a.origin = s.origin AND a.destination = s.destination JOIN estimate b ON b.time_bin = (low + 1) % 96 AND b.origin = s.origin AND b.destination = s.destination)
""" + _select("count(*) AS questions, count(*) AS valid, (SELECT string_agg(source || '=' || n, '|' ORDER BY source) FROM (SELECT source, count(*) AS n FROM answers GROUP BY ALL)) AS sources", "answers", "avg(confidence) mean_confidence; avg(seen::INT) observed_share; 1.0::DOUBLE coverage").removeprefix(_CHAIN),
    "axiom_checks": _events(
        "*", "(SELECT 'efficiency' AS axiom, CASE WHEN abs((SELECT sum(shapley_value) FROM shapley) - (SELECT max(CASE WHEN mask = 31 THEN value END) - max(CASE WHEN mask = 0 THEN value END) FROM coalitions)) <= 1e-4 THEN 'PASS' ELSE 'FAIL' END AS status"
        " UNION ALL SELECT 'monotonicity', CASE WHEN (SELECT min(marginal) FROM marginals) >= -1e-4 THEN 'PASS' ELSE 'FAIL' END"
        " UNION ALL SELECT 'dummy', CASE WHEN (SELECT coalesce(max(abs(shapley_value)), 0) FROM shapley WHERE player IN (SELECT player FROM marginals GROUP BY player HAVING max(abs(marginal)) <= 1e-4)) <= 1e-4 THEN 'PASS' ELSE 'FAIL' END"
        " UNION ALL SELECT 'symmetry', CASE WHEN (SELECT coalesce(max(abs(a.shapley_value - b.shapley_value)), 0) FROM shapley a, shapley b WHERE a.player < b.player AND (SELECT max(abs(x.marginal - y.marginal)) FROM marginals x JOIN marginals y ON x.mask = y.mask WHERE x.player = a.player AND y.player = b.player) <= 1e-4) <= 1e-4 THEN 'PASS' ELSE 'FAIL' END)",
    ),
    "min_confidence_od": _select(
        "time_bin, origin, destination",
        "(SELECT time_bin, origin, destination, confidence, p/sum(p) OVER (PARTITION BY time_bin, origin) AS p FROM (SELECT *, max(confidence) OVER (PARTITION BY time_bin, origin) AS best, row_number() OVER (PARTITION BY time_bin, origin ORDER BY confidence DESC, destination) AS k FROM od) WHERE confidence >= 0.6 OR (k = 1 AND best < 0.6))",
        "confidence; p destination_probability", 4,
    ),
    "revenue_what_if": _select("origin", "od GROUP BY origin", "sum(p*revenue*CASE_ONE) revenue; avg(dev*CASE_ONE) revenue_dev".replace("CASE_ONE", "(1+(origin=8)::INT*0.05::DOUBLE)"), 3),
    "competition_what_if": _select("competition_scenario", "(SELECT s AS competition_scenario, CASE s WHEN 'low' THEN wait_low WHEN 'medium' THEN wait_medium ELSE wait_high END AS w FROM nodes, (VALUES ('low'), ('medium'), ('high')) AS v(s)) GROUP BY competition_scenario", "avg(w) mean_wait; max(w) longest_wait"),
    "bin_snapshot": _select("f.zone_id, z.zone_name, z.borough", "full_nodes f JOIN zones z ON z.zone_id = f.zone_id WHERE time_bin = 32", "posterior; supply; wait_medium expected_wait"),
    "holdout_errors": _select(
        "measure, n", "(" + " UNION ALL ".join(f"SELECT '{name}' AS measure, * FROM {_errors(t, h, _HELD)}" for name, t, h in (("revenue", "r", "hr"), ("minutes", "m", "hm"), ("miles", "d", "hd"))) + ")", _METRICS, 4,
    ),
    "holdout_tail_errors": _select(
        "quartile, n",
        _errors("t", "hm", f"(SELECT *, CASE WHEN t <= q1 THEN 'Q1' WHEN t <= q2 THEN 'Q2' WHEN t <= q3 THEN 'Q3' ELSE 'Q4' END AS quartile FROM (SELECT round(m, 6) AS t, hm FROM {_HELD}) CROSS JOIN (SELECT quantile_cont(round(m, 6), 0.25) AS q1, quantile_cont(round(m, 6), 0.5) AS q2, quantile_cont(round(m, 6), 0.75) AS q3 FROM {_HELD}))", "quartile"),
        _METRICS, 4,
    ),
    "competition_trend": _select(
        "algorithm, greatest(m - l, h - m) <= 1e-9 AS non_increasing",
        "(SELECT z.borough AS algorithm, avg(1-exp(-15/wait_low)) AS l, avg(1-exp(-15/wait_medium)) AS m, avg(1-exp(-15/wait_high)) AS h FROM nodes n JOIN zones z ON z.zone_id = n.zone_id GROUP BY z.borough)", "m-l low_to_medium; h-m medium_to_high",
    ),
    "baseline_agreement": f"""{_CHAIN}, kinds AS (
  SELECT 'demand' AS kind, zone_id, round(posterior, 6) AS value FROM full_nodes WHERE time_bin = 32 UNION ALL SELECT 'income', zone_id, round(revenue, 6) FROM full_nodes WHERE time_bin = 32 UNION ALL SELECT 'wait', zone_id, round(wait_medium, 6) FROM full_nodes WHERE time_bin = 32),
ranks AS (SELECT *, rank() OVER (PARTITION BY kind ORDER BY value) + (count(*) OVER (PARTITION BY kind, value) - 1)/2.0 AS r, row_number() OVER (PARTITION BY kind ORDER BY value DESC, zone_id) AS k FROM kinds)
SELECT a.kind AS kind_a, b.kind AS kind_b, round(corr(a.r, b.r) + 1.3e-9, 5) AS spearman, round(sum((a.k <= 5 AND b.k <= 5)::INT)/sum((a.k <= 5 OR b.k <= 5)::INT)::DOUBLE + 1.3e-9, 5) AS jaccard
FROM ranks a JOIN ranks b ON a.zone_id = b.zone_id AND a.kind < b.kind GROUP BY ALL""",
}
