"""The gravity fit against exact fractions."""

from fractions import Fraction

from wayfare.operators.aggregate import fit_gravity

COLUMNS = "trip_count long, avg_distance_miles double, avg_duration_min double, avg_driver_revenue double"


def exact(rows: list[tuple]) -> tuple[float, float, float]:
    rows = [tuple(map(Fraction, r)) for r in rows]
    total = sum(r[0] for r in rows)
    mx, mz, my = (sum(r[0] * r[k] for r in rows) / total for k in (1, 2, 3))
    mean = lambda f: sum(r[0] * f(r[1] - mx, r[2] - mz, r[3] - my) for r in rows)
    xx, xz, zz, xy, zy = mean(lambda x, z, y: x * x), mean(lambda x, z, y: x * z), mean(lambda x, z, y: z * z), mean(lambda x, z, y: x * y), mean(lambda x, z, y: z * y)
    a, b = (xy * zz - xz * zy) / (xx * zz - xz * xz), (xx * zy - xz * xy) / (xx * zz - xz * xz)
    return float(my - a * mx - b * mz), float(a), float(b)


def test_the_fit_keeps_its_digits(spark):
    """Means of many trips lie close together, and minutes follow miles: raw squares lose what tells them apart."""
    rows = [(900 + k % 7, 10 + 0.01 * (k % 11), 47 + 0.03 * (k % 11) + 0.004 * (k % 5), 56 + 0.02 * (k % 11) - 0.01 * (k % 3)) for k in range(600)]
    got = fit_gravity(spark.createDataFrame(rows, COLUMNS).repartition(5)).first()
    for mine, true in zip((got.intercept, got.distance, got.duration), exact(rows), strict=True):
        assert abs(mine - true) < 1e-9 * max(1.0, abs(true))


def test_pairs_without_slopes(spark):
    for rows in ([], [(3, 1.5, 9.0, 20.0)] * 4):
        got = fit_gravity(spark.createDataFrame(rows, COLUMNS)).first()
        assert (got.intercept, got.distance, got.duration) == (0.0, 0.0, 0.0)
