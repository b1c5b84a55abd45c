"""Order statistics by counting, against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import snapshots as A
from loomspan.operators.ranks import nth_values


def ordered(values):
    return sorted((v for v in values if v is None or not math.isnan(v)), key=lambda v: (v is not None, v or 0.0)) + [v for v in values if v is not None and math.isnan(v)]


def groups():
    rng, inf, nan = random.Random(5), float("inf"), float("nan")
    return {
        "even": [rng.random() for _ in range(3000)],
        "skew": [rng.lognormvariate(0, 40) for _ in range(3000)],
        "ties": [float(rng.randrange(4)) for _ in range(3000)],
        "apart": [1e300] + [5e-324 * rng.randrange(9) for _ in range(500)] + [-1.7e308, 1.7e308],
        "odd": [None, None, nan, nan, inf, -inf, 1.0, 2.0],
        "nulls": [None] * 5,
        "one": [7.0],
        None: [3.0, 1.0, 2.0, 4.0],
    }


@pytest.mark.parametrize("share, bins, few", [(0.75, 64, 3), (0.0, 4096, 1000), (0.5, 4096, 0), (0.9, 64, 10)])
def test_nth(spark, share, bins, few):
    made = groups()
    points = spark.createDataFrame([(g, v) for g, values in made.items() for v in values], "k string, r double")
    got = {r.g: r.nth for r in nth_values(points, "k", "r", lambda n: F.floor((n - 1) * share), bins, few).collect()}
    want = {g: ordered(values)[math.floor((len(values) - 1) * share)] for g, values in made.items()}
    assert repr(sorted(got.items(), key=str)) == repr(sorted(want.items(), key=str))


def test_places_beyond_and_no_rows(spark):
    points = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, r double")
    assert [r.nth for r in nth_values(points, "k", "r", lambda n: n).collect()] == [None]
    assert nth_values(points.limit(0), "k", "r", lambda n: n).collect() == []
    assert A.radius_clamp(points.limit(0), "k", "r").collect() == []


def test_clamp_of_one_large_group(spark):
    """Two hundred thousand points of one group; no window of the plan is keyed by the group over its points."""
    points = spark.range(200_000).select(F.lit("g").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1000.0).alias("r"), F.lit(1).alias("__group"))
    out = A.radius_clamp(points, "k", "r")
    assert "Window" not in out._jdf.queryExecution().toString()
    values = sorted(r.r for r in points.select("r").collect())
    soft = values[math.floor((len(values) - 1) * 0.75)]
    assert out.agg(F.min("soft"), F.max("soft"), F.count_if(F.col("scale") < 1)).first()[:] == (soft, soft, sum(v > soft for v in values))
