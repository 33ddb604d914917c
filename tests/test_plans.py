"""No table whose rows were multiplied is broadcast: the planner takes it for small."""

import datetime as dt
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def parts_under(df, word: str = "BroadcastExchange") -> list[str]:
    """The part of the physical plan under each node that has the word, a broadcast if none is given."""
    lines = df._jdf.queryExecution().sparkPlan().toString().split("\n")
    lines += df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    found = []
    for i, line in enumerate(lines):
        if word in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            found.append("\n".join(lines[i:end]))
    return found


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["join_7", "win_8", "win_9", "srv_2"])
def test_multiplied_rows_are_not_broadcast(spark, name):
    parts = parts_under(entry.queries()[name](spark, SF))
    assert not [p for p in parts if "Generate explode(sequence" in p]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_what_scored_and_explained_requests_stand_on_broadcasts_no_multiplied_rows(spark, monkeypatch):
    """The scored queries write the answered requests first, so their own plan shows nothing of them."""
    from riskgrid.plans import q_models, serve

    class Answered(Exception):
        pass

    def seen(answered, *_, **__):
        parts = parts_under(answered)
        assert not [p for p in parts if "Generate explode(sequence" in p]
        raise Answered

    monkeypatch.setattr(serve, "score_requests", seen)
    monkeypatch.setattr(serve, "explain_requests", seen)
    for fit in ("small_bundle", "_stump", "_fit_small"):
        monkeypatch.setattr(q_models, fit, lambda *_, **__: None)
    for name in ("srv_2_scores", "srv_3", "srv_3_stump", "srv_4"):
        with pytest.raises(Answered):
            entry.queries()[name](spark, SF)


def test_a_lookback_ends_on_its_day_whatever_other_pairs_look_back_on(spark):
    """The rain of 46 days before belongs to the earlier pair alone."""
    from riskgrid.plans import serve

    last = dt.date(2024, 7, 15)
    days = [last - dt.timedelta(days=n) for n in range(60)]
    wet = last - dt.timedelta(days=46)
    feed = spark.createDataFrame(
        [("1_1", d, 290.0, 40.0, 9.0 if d == wet else 0.0, 0.2, 3.0) for d in days if (last - d).days not in range(5, 25)],
        "cell_id string, date date, t2m double, relative_humidity double, precip_mm double, swvl1 double, wind_speed double",
    )
    asked = spark.createDataFrame([("1_1", last), ("1_1", last - dt.timedelta(days=30))], "cell_id string, date date")
    late, early = [r.asDict() for r in serve.live_feature_rows(asked, feed).orderBy("date", ascending=False).collect()]
    # 26 of the 46 days have a row, and none of them is wet.
    assert late["days_since_rain"] is None and late["precip_30d"] is None and late["precip_7d"] == 0.0
    assert late["weather_status"] == "insufficient_history" and set(late["missing"]) == {"days_since_rain", "precip_30d"}
    assert early["days_since_rain"] == 16 and early["precip_7d"] == 0.0 and early["precip_30d"] == 9.0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_panel_is_not_exchanged_for_labels_rain_neighbours_or_windows(spark):
    from riskgrid.operators import labels as lb
    from riskgrid.plans import demo

    for df in (demo.weather_panel(spark, SF), demo.features(spark, SF).transform(lb.add_forward_label, 3)):
        parts = parts_under(df, "Exchange hashpartitioning")
        assert parts and not [p for p in parts if "Generate explode(sequence" in p]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_model_frame_takes_rolling_values_in_row_order(spark):
    """Neither an exchange of the panel nor a window of 30 rows that is added up anew for each."""
    from riskgrid.plans import demo

    df = demo.features(spark, SF, ahead=3)
    parts = parts_under(df, "Exchange hashpartitioning")
    assert parts and not [p for p in parts if "Generate explode(sequence" in p]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "-29" not in plan


def test_daily_values_come_in_as_by_a_left_join(spark):
    from pyspark.sql import functions as F

    from riskgrid.operators import features as ft

    panel = spark.range(60).select(
        F.concat_ws("_", (F.col("id") % 3).cast("string"), F.lit("0")).alias("cell_id"),
        F.expr("date_add(date'2021-06-01', cast(id / 3 AS int))").alias("date"),
        F.col("id").alias("k"),
    )
    daily = panel.filter("k % 7 = 1").select("cell_id", F.date_add("date", 2).alias("date"), (F.col("k") / 2).alias("a"), F.lit(None).cast("int").alias("b"))
    wanted = sorted(tuple(r) for r in panel.join(daily, ["cell_id", "date"], "left").select("k", "a").collect())
    assert any(a is not None for _, a in wanted)
    assert sorted(tuple(r) for r in ft.add_daily(panel, daily, ("a", "b")).filter("b IS NULL").select("k", "a").collect()) == wanted
    fires = panel.filter("k = 10").select("cell_id", "date")
    beside = ft.add_neighbor_fire_features(panel, ignitions=fires, mark=True, beside=daily, parts=2)
    assert sorted(tuple(r) for r in beside.select("k", "a").collect()) == wanted
    assert beside.filter("ignited = 1").select("k").collect() == [(10,)]
    plain = ft.add_neighbor_fire_features(panel, ignitions=fires)
    counts = ["k", *[c for c in plain.columns if c.startswith("neighbor_fire")]]
    assert sorted(map(str, beside.select(*counts).collect())) == sorted(map(str, plain.select(*counts).collect()))
