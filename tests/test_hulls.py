"""Merged hulls: isotonic knots and Venn-Abers intervals do not depend on how scores are dealt out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrid.operators import calibrate as cal


def pooled(scores, n, pos):
    """Pool adjacent violators, block by block."""
    blocks = []
    for x, w, p in sorted(zip(scores, n, pos)):
        blocks.append([x, x, w, p])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    return [(a, b, p / w, float(w)) for a, b, w, p in blocks]


def sample(seed, size):
    pick = np.random.default_rng(seed)
    scores = np.unique(pick.random(size).round(6))
    n = pick.integers(1, 4, len(scores))
    return scores, n, pick.binomial(n, scores**2)


@pytest.mark.parametrize("size, rows_per_bucket", [(40, 10_000), (3000, 20), (3000, 700), (1, 5)])
def test_knots_equal_pooling(spark, size, rows_per_bucket):
    scores, n, pos = sample(size, size)
    rows = [(float(x), int(w), int(p)) for x, w, p in zip(scores, n, pos)] + [(2.0, 0, 0)]
    df = spark.createDataFrame(rows, "score double, n long, pos long")
    got = sorted(tuple(r) for r in cal.isotonic_knots(df, rows_per_bucket=rows_per_bucket).select("first", "last", "rate", "weight").collect())
    assert got == [pytest.approx(k) for k in pooled(scores, n, pos)]


def test_knots_by_group_and_curve(spark):
    rows, want = [], {}
    for g in (2020, 2021):
        scores, n, pos = sample(g, 400)
        rows += [(g, float(x), int(w), int(p)) for x, w, p in zip(scores, n, pos)]
        want[g] = pooled(scores, n, pos)
    knots = cal.isotonic_knots(spark.createDataFrame(rows, "year int, score double, n long, pos long"), ["year"], rows_per_bucket=30).cache()
    for g in want:
        own = knots.filter(F.col("year") == g)
        assert sorted(tuple(r)[1:] for r in own.collect()) == [pytest.approx(k) for k in want[g]]
        model = cal._isotonic_from_knots(own, "score")
        assert list(model.boundaries) == sorted({x for a, b, _, _ in want[g] for x in (a, b)})
        at = spark.createDataFrame([(float(b),) for _, b, _, _ in want[g]], "score double")
        assert [r.calibrated for r in cal.apply_isotonic(at, model).collect()] == pytest.approx([k[2] for k in want[g]])


def test_intervals_of_a_million_scores(spark):
    """Fifty buckets and merged hulls against one bucket that holds all."""
    df = spark.range(1_000_000).select(
        (F.col("id") / 1e6).alias("score"),
        (F.col("id") % 3 > 0).cast("long").alias("n"),
        ((F.col("id") % 3 > 0) & (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("id"))).cast("long").alias("pos"),
        (F.col("id") % 5 == 0).alias("is_test"),
    )
    one, many = (cal.venn_abers_intervals(df, rows_per_bucket=n) for n in (2_000_000, 20_000))
    both = one.join(many.withColumnsRenamed({"p0": "q0", "p1": "q1"}), "score")
    found = both.agg(F.count(F.lit(1)), F.max(F.abs(F.col("p0") - F.col("q0"))), F.max(F.abs(F.col("p1") - F.col("q1"))), F.sum((F.col("p0") > F.col("p1")).cast("int"))).first()
    assert found[0] == 200_000 and found[1] < 1e-12 and found[2] < 1e-12 and found[3] == 0


def test_a_bucket_takes_one_hull_of_each_level(spark):
    df = spark.range(4096).select((F.col("id") / 4096).alias("score"), F.lit(1).alias("n"), (F.col("id") % 2).alias("pos"))
    _, points, many = cal._cumulated(df.withColumn("_all", F.lit(0)), ["_all"], "score", 1000, 64)
    levels = cal._hull_levels(points.select("_all", "_bucket", "_last", "w", "s"), ["_all"], 2)
    nodes = [level.select("_bucket").distinct().count() for level in levels]
    assert many and nodes[-1] == 1 and all(-(-a // 2) == b for a, b in zip(nodes, nodes[1:])) and nodes[0] >= 64
