"""Draws that keep a question one row, against the plain way over one row for each option."""

import math

from conftest import SMALL
from pyspark.sql import functions as F

from wayfare import queries
from wayfare.operators import episodes, lookup


def test_draw_at_equals_options_and_draw(spark):
    od = queries.model(spark, SMALL).od
    asked = spark.range(400).select(F.col("id").alias("query_id"), (F.col("id") % 25 + 1).cast("int").alias("origin"), ((F.col("id") * 37) % 1440 + F.col("id") % 2 / 4.0).alias("minute"), F.when(F.col("id") % 40 == 0, 2.0).otherwise(episodes.keyed_uniform(F.lit(3), F.col("id"))).alias("u"))
    plain = episodes.draw_destination(lookup.od_options(asked.drop("u"), od).join(asked.select("query_id", "u"), "query_id"))
    drawn = episodes.draw_at(asked, episodes.option_cells(od))
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # no row for each option
    left, right = ({r.query_id: r for r in df.select("query_id", "destination", *episodes.OPTION_METRICS).collect()} for df in (drawn, plain))
    assert left.keys() == right.keys() and len(left) == 400
    for k, a in left.items():
        assert a.destination == right[k].destination and all(math.isclose(a[m], right[k][m], rel_tol=1e-9, abs_tol=1e-12) for m in episodes.OPTION_METRICS)
