"""Digits of the order-preserving form, cells, and ranks found through them."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrid.operators import ranking


def bits(x: float) -> int:
    b = struct.unpack("<q", struct.pack("<d", x + 0.0))[0]
    return b ^ ((1 << 63) - 1) if b < 0 else b


def test_ordered_bits_order_as_doubles(spark):
    values = [0.0, -0.0, 1.0, -1.0, 1e-320, -1e-320, 5e-324, 1e308, -1e308, float("inf"), float("-inf"), 0.1, float(np.nextafter(0.1, 1)), 3.0, -2.5]
    got = {r.v: r.b for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", ranking.ordered_bits(F.col("v"), "double").alias("b")).collect()}
    assert got == {v: bits(v) for v in values}
    assert sorted(got, key=got.get) == sorted(set(values))


@pytest.mark.parametrize("kind, sql", [("double", "(id - 2500) * exp(id % 60 - 30)"), ("float", "cast((id * 7919 % 5000) / 7 - 300 as float)"), ("bigint", "(id - 2500) * 1000000000000"), ("date", "date_add(date'1990-01-01', cast(id * 3 as int))"), ("decimal(20,6)", "cast((id - 2500) / 8 as decimal(20,6))")])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_of_each_kind(spark, kind, sql, descending):
    """Negative, clustered and far-off values, by several levels of digits."""
    df = spark.range(5000).select(F.expr(sql).alias("v")).distinct().select("v", (F.hash("v") % 5 + 5).cast("long").alias("n")).cache()
    assert dict(df.dtypes)["v"] == kind
    got = {r.v: (r.n_before, r.n_all) for r in ranking.running_totals(df, "v", ["n"], descending=descending, values_per_cell=9).collect()}
    rows = sorted(((r.v, r.n) for r in df.collect()), reverse=descending)
    ahead = np.concatenate([[0], np.cumsum([n for _, n in rows])])
    assert got == {v: (ahead[i], ahead[-1]) for i, (v, _) in enumerate(rows)}


def test_running_totals_by_group_with_null(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (F.col("id") / 7).alias("v"), F.lit(2).cast("long").alias("n"), F.col("id").alias("m"))
    got = ranking.running_totals(df, "v", ["n", "m"], ["g"], values_per_cell=50).collect()
    assert len(got) == 6000
    for r in got:
        i = round(r.v * 7)
        earlier = range(i % 3, i, 3)
        assert r.n_before == 2 * len(earlier) and r.m_before == sum(earlier) and r.n_all == 4000
        assert (r.g or 0) == i % 3


def test_only_cells_with_asked_ranks_are_read(spark, monkeypatch):
    """Of 40,000 values one is asked for: each level goes on with its cell alone, and the last hands out a few values."""
    df = spark.range(40_000).select((F.col("id") / 40_000).alias("v"), F.lit(1).cast("long").alias("n"))
    kept = []
    written = ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda d, label: kept.append((label, written(d, label))) or kept[-1][1])
    got = ranking.running_totals(df, "v", ["n"], values_per_cell=20, wanted=lambda before, n, n_all: (before <= 12_345) & (12_345 < before + n)).collect()
    assert [(r.v, r.n_before) for r in got] == [(12_345 / 40_000, 12_345)]
    cells = [d.count() for label, d in kept if label == "value-cells"]
    assert cells and all(n == 1 for n in cells)


def test_quantiles_and_cut_by_digits(spark, monkeypatch):
    monkeypatch.setattr(ranking.running_totals, "__defaults__", ((), False, 10, None, False))
    s = np.random.default_rng(3).beta(0.3, 9, 4000).round(4)
    df = spark.createDataFrame([(i, float(v), int(i % 2)) for i, v in enumerate(s)], "row_key long, score double, g int")
    probs = [0, 0.01, 0.5, 0.77, 0.999, 1]
    for row in ranking.quantiles(df, "score", probs, by=["g"]).collect():
        assert row.q == [pytest.approx(v) for v in np.quantile(s[row.g :: 2], probs)]
    top = set(sorted(range(len(s)), key=lambda i: (-s[i], i))[:400])
    assert {r.row_key for r in ranking.top_k_flag(df).filter("in_top").collect()} == top


def test_nothing_to_rank(spark):
    df = spark.createDataFrame([], "v double, n long")
    assert ranking.running_totals(df, "v", ["n"]).count() == 0
    assert ranking.quantiles(df, "v", [0.5]).first().q == []
