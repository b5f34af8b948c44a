"""Column expressions: clock, distance, weighted means, probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfare.plans.params import DEFAULT, Params


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


DAY_MICROS = 86_400_000_000


def day_micros(ts: Column) -> Column:
    """Microseconds since midnight of a clock reading without a zone."""
    return (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def month_text(day: Column) -> Column:
    """yyyy-MM of a date; formatting takes far longer than its numbers, so it is left to years of other than four digits."""
    digits = F.concat(F.year(day).cast("string"), F.lit("-"), F.lpad(F.month(day).cast("string"), 2, "0"))
    return F.when(F.year(day).between(1000, 9999), digits).otherwise(F.date_format(day, "yyyy-MM"))


def micros_bin(micros: Column, params: Params = DEFAULT) -> Column:
    """The time bin of microseconds since some midnight."""
    return F.floor(F.pmod(micros, F.lit(DAY_MICROS)) / F.lit(params.bin_minutes * 60_000_000)).cast("int")


def clock_minutes(value: Column) -> Column:
    """ "HH:MM" or a number of minutes, modulo a day; anything else is an error."""
    text = F.trim(value.cast("string"))
    parts = F.split(text, ":")
    hour, minute = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    valid = (F.size(parts) == 2) & hour.between(0, 23) & minute.between(0, 59)
    by_clock = F.when(valid, (hour * 60 + minute).cast("double"))
    number = F.when(F.size(parts) == 1, text.try_cast("double"))
    found = F.coalesce(by_clock, F.pmod(number, F.lit(1440.0)))
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("not a clock time: "), F.coalesce(text, F.lit("null")))).cast("double"))


def clock_text(minutes: Column) -> Column:
    whole = F.pmod(F.floor(minutes + 0.5).cast("int"), F.lit(1440))
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("int"), (whole % 60).cast("int"))


def low_bin(minutes: Column, params: Params = DEFAULT) -> Column:
    return F.floor(F.pmod(minutes, F.lit(1440.0)) / params.bin_minutes).cast("int")


def next_bin(minutes: Column, params: Params = DEFAULT) -> Column:
    return F.pmod(low_bin(minutes, params) + 1, F.lit(params.bins)).cast("int")


def bin_fraction(minutes: Column, params: Params = DEFAULT) -> Column:
    return F.pmod(minutes, F.lit(1440.0)) / params.bin_minutes - low_bin(minutes, params)


def circular_distance(a: Column, b: Column, params: Params = DEFAULT) -> Column:
    return F.least(F.abs(a - b), params.bins - F.abs(a - b))


def distance_band(miles: Column, params: Params = DEFAULT) -> Column:
    """Number of the band [low, high); what is beyond the last is in the last. Means a hair off an edge are on it."""
    edges, miles = params.distance_bands, F.round(miles, 9)
    band = F.when(miles < edges[1], 0)
    for k in range(1, len(edges) - 2):
        band = band.when(miles < edges[k + 1], k)
    return band.otherwise(len(edges) - 2)


def borough_pair(origin: Column, destination: Column) -> Column:
    return F.concat_ws("->", origin, destination)


def airport_pair(origin_name: Column, destination_name: Column) -> Column:
    has = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains("airport")
    return F.when(has(origin_name) | has(destination_name), "airport").otherwise("non_airport")


def centroid_miles(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) / 5280.0


def conditional_wait(mean: Column, interval: float) -> Column:
    """Mean of an exponential wait, given that it ends within the interval."""
    m = F.greatest(mean, F.lit(1e-6))
    p = 1 - F.exp(-interval / m)
    return F.when(p <= 1e-12, interval / 2).otherwise(clip(m - interval * F.exp(-interval / m) / p, 0.0, interval))


def pickup_probability(wait: Column, interval: float) -> Column:
    return 1 - F.exp(-interval / F.greatest(wait, F.lit(1e-6)))


def pooled_std(total: Column, squares: Column, n: Column) -> Column:
    mean = total / n
    return F.when(n <= 1, 0.0).otherwise(F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0))))


def _usable(value: Column, weight: Column, positive: bool = False) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    ok = finite(value) & finite(weight) & (weight > 0)
    return ok & (value > 0) if positive else ok


def weighted_mean(value: Column, weight: Column, default: Column | float | None = None) -> Column:
    """Aggregate: the mean over usable rows; without any the default."""
    ok = _usable(value, weight)
    mean = F.sum(F.when(ok, value * weight)) / F.sum(F.when(ok, weight))
    return mean if default is None else F.coalesce(mean, default if isinstance(default, Column) else F.lit(default))


def geometric_weighted_mean(value: Column, weight: Column, default: Column | float | None = None) -> Column:
    ok = _usable(value, weight, positive=True)
    mean = F.exp(F.sum(F.when(ok, F.ln(value) * weight)) / F.sum(F.when(ok, weight)))
    return mean if default is None else F.coalesce(mean, default if isinstance(default, Column) else F.lit(default))


def row_mean(pairs: list[tuple[Column, Column]], default: Column, geometric: bool = False) -> Column:
    """The same over columns of one row."""
    top = bottom = F.lit(0.0)
    for value, weight in pairs:
        ok = _usable(value, weight, positive=geometric)
        top = top + F.when(ok, (F.ln(value) if geometric else value) * weight).otherwise(0.0)
        bottom = bottom + F.when(ok, weight).otherwise(0.0)
    mean = F.when(bottom > 0, F.exp(top / bottom) if geometric else top / bottom)
    return F.coalesce(mean, default)
