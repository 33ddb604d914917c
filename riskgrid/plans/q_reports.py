"""Registered queries: aggregates, ranking, metrics, backtests, calibration, codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgrid.functions import codes as C
from riskgrid.functions import constants as K
from riskgrid.operators import backtest as bt
from riskgrid.operators import calibrate as cal
from riskgrid.operators import codes as fw
from riskgrid.operators import features as ft
from riskgrid.operators import labels as lb
from riskgrid.operators import metrics, profile, ranking, terrain
from riskgrid.operators import weather as wx
from riskgrid.plans import demo
from riskgrid.plans import relations as rel
from riskgrid.plans.catalog import ORACLES, QUERIES, RELATIONS, query, r, rounded
from riskgrid.plans.q_panel import POINT, _FORWARD, _FORWARD_W, _SPLIT

# --- aggregates ---------------------------------------------------------------


@query(
    "agg_1",
    f"SELECT {POINT}, date, {', '.join(r(v, v) for v in K.INSTANT_VARIABLES)} FROM (SELECT latitude, longitude, valid_time::date AS date, {', '.join(f'avg({v}) AS {v}' for v in K.INSTANT_VARIABLES)} FROM readings GROUP BY ALL)",
    ("readings",),
)
def agg_1(spark, sf):
    return rounded(wx.daily_means(demo.readings(spark, sf)))


@query(
    "agg_2",
    f"SELECT {POINT}, valid_time::date - 1 AS date, {r('tp * 1000', 'precip_mm')} FROM readings WHERE hour(valid_time) = 0",
    ("readings",),
)
def agg_2(spark, sf):
    return rounded(wx.daily_precip_from_cumulative(demo.readings(spark, sf)))


@query(
    "agg_3",
    f"""SELECT {POINT}, date, {r('cape', 'cape')}, {r('mm', 'convective_precip_mm')} FROM (SELECT latitude, longitude, valid_time::date AS date, max(cape) AS cape,
       coalesce(sum(cp), 0) * 1000 AS mm FROM readings GROUP BY ALL)""",
    ("readings",),
)
def agg_3(spark, sf):
    return rounded(wx.daily_convective(demo.readings(spark, sf)))


@query("agg_4", "SELECT DISTINCT cell_id, acq_date AS date FROM detections", ("detections",))
def agg_4(spark, sf):
    return lb.distinct_ignitions(demo.detections(spark, sf))


@query("agg_5", f"SELECT DISTINCT {POINT} FROM readings", ("readings",))
def agg_5(spark, sf):
    return rounded(wx.weather_points(demo.readings(spark, sf)))


@query("agg_6", "SELECT cell_id, fuel_type_cd FROM fuel", ("fuel",))
def agg_6(spark, sf):
    return demo.fuel(spark, sf)


@query(
    "agg_7",
    "SELECT f.cell_id, 'fuel_type_' || c.code AS column_name, (f.fuel_type_cd = c.code)::int::double AS value FROM fuel f, (SELECT DISTINCT fuel_type_cd AS code FROM fuel) c",
    ("fuel",),
)
def agg_7(spark, sf):
    """The columns that occur depend on the data, so they are compared in long form."""
    wide = terrain.one_hot_present(demo.fuel(spark, sf))
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("value")) for c in wide.columns[1:]])
    return wide.select("cell_id", F.inline(pairs))


@query(
    "agg_8",
    "SELECT cell_id, " + ", ".join(f"(fuel_type_cd = '{c}')::int::double AS \"fuel_type_{c}\"" for c in ("LARGE", "PROMO", "S-2")) + " FROM fuel",
    ("fuel",),
)
def agg_8(spark, sf):
    names = ("fuel_type_LARGE", "fuel_type_PROMO", "fuel_type_S-2")
    return terrain.one_hot_fixed(demo.fuel(spark, sf), names).drop("fuel_type_cd")


@query(
    "agg_9",
    f"""SELECT year(date)::int AS year, count(*) FILTER (ignited = 0) AS negatives, count(*) FILTER (ignited = 1) AS positives,
       {r('count(*) FILTER (ignited = 0) / greatest(count(*) FILTER (ignited = 1), 1)', 'scale_pos_weight')} FROM panel GROUP BY 1""",
    ("panel",),
)
def agg_9(spark, sf):
    yearly = demo.panel(spark, sf).withColumn("year", F.year("date"))
    return rounded(profile.class_ratio(yearly, by=["year"]))


@query(
    "agg_10",
    f"""SELECT ignited, count(*) AS rows, {r('any_value(weight)', 'weight', 4)} FROM (SELECT ignited, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY ignited)) AS weight FROM panel) GROUP BY ignited""",
    ("panel",),
)
def agg_10(spark, sf):
    weighted = profile.with_class_weights(demo.panel(spark, sf))
    return rounded(weighted.groupBy("ignited").agg(F.count(F.lit(1)).alias("rows"), F.max("weight").alias("weight")), 4)


@query(
    "agg_11",
    f"""SELECT count(*) AS rows, count(DISTINCT cell_id) AS cells, min(date) AS first_date, max(date) AS last_date,
       {r('avg((ignited = 0)::int)', 'share_0')}, {r('avg((ignited = 1)::int)', 'share_1')} FROM panel""",
    ("panel",),
)
def agg_11(spark, sf):
    return rounded(profile.dataset_profile(demo.panel(spark, sf)))


_NULLABLE = ("days_since_rain", "precip_mm", "precip_30d", "t2m", "t2m_trend_7d")


@query(
    "agg_11_nulls",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM timed" for c in _NULLABLE) + ") WHERE nulls > 0",
    ("timed",),
)
def agg_11_nulls(spark, sf):
    return profile.null_counts(demo.features(spark, sf).select(*_NULLABLE))


@query(
    "agg_12",
    f"SELECT {_SPLIT} AS split, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, sum(ignited)::bigint AS positives FROM panel GROUP BY 1",
    ("panel",),
)
def agg_12(spark, sf):
    return profile.split_description(lb.with_split(demo.panel(spark, sf), demo.TRAIN_END, demo.VAL_END))


_PEAK = "sum(label) FILTER (month(date) IN (7, 8)) / sum(label)"


@query(
    "agg_14",
    f"SELECT {r(f'corr(peak, rate)', 'correlation', 5)} FROM (SELECT year, {_PEAK} AS peak, avg(score) AS rate FROM scores GROUP BY year)",
    ("scores",),
)
def agg_14(spark, sf):
    peak = F.sum(F.when(F.month("date").isin(7, 8), F.col("label"))) / F.sum("label")
    yearly = demo.scores(spark, sf).groupBy("year").agg(peak.alias("peak"), F.avg("score").alias("rate"))
    return rounded(profile.pearson(yearly, "peak", "rate"), 5)


rel.relation(
    "flagged",
    """SELECT *, row_number() OVER (PARTITION BY year ORDER BY score DESC, row_key) <= greatest(1, floor(count(*) OVER (PARTITION BY year) * 1e-1)) AS in_top FROM scores""",
    "scores",
)
rel.relation(
    "monthly",
    "SELECT year, month(date)::int AS month, count(*) AS total, count(*) FILTER (in_top) AS caught, count(*) FILTER (in_top) / count(*) AS capture_rate FROM flagged WHERE label = 1 GROUP BY ALL",
    "flagged",
)


@query(
    "agg_15",
    f"SELECT month, sum(total)::bigint AS total, sum(caught)::bigint AS caught, {r('sum(caught) / sum(total)', 'capture_rate')} FROM monthly GROUP BY month",
    ("monthly",),
)
def agg_15(spark, sf):
    return rounded(bt.pooled_months(bt.monthly_capture(demo.scores(spark, sf))))


_SEASONS = "CASE WHEN strftime(o_orderdate, '%m-%d') BETWEEN '05-01' AND '10-15' THEN 'season' WHEN month(o_orderdate) IN (11, 12, 1, 2, 3, 4) THEN 'winter' END"


@query(
    "agg_16",
    f"""SELECT season, o_orderpriority AS cause, n, {r('n / sum(n) OVER (PARTITION BY season)', 'share')} FROM (
       SELECT {_SEASONS} AS season, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) WHERE season IS NOT NULL""",
)
def agg_16(spark, sf):
    from riskgrid.functions.weather_math import season_filter

    date = F.col("o_orderdate")
    season = F.when(season_filter(date), "season").when(F.month(date).isin(11, 12, 1, 2, 3, 4), "winter")
    orders = demo.table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "cause")
    return rounded(profile.category_mix(orders, season, "cause"))


@query(
    "agg_17",
    f"SELECT {r('avg(p)', 'mean')}, {r('median(p)', 'median')}, {r('stddev_samp(p)', 'stddev')}, {r('min(p)', 'min')}, {r('max(p)', 'max')} FROM (SELECT sum(label) AS p FROM scores GROUP BY year)",
    ("scores",),
)
def agg_17(spark, sf):
    yearly = demo.scores(spark, sf).groupBy("year").agg(F.sum("label").cast("double").alias("p"))
    return rounded(profile.fold_summary(yearly, "p"))


@query(
    "agg_18",
    f"""SELECT split, {r('avg(ignited)', 'first_rate')}, {r('avg(n)', 'second_rate')}, {r('avg(n) / avg(ignited)', 'ratio', 4)} FROM (
       SELECT {_SPLIT} AS split, ignited, {_FORWARD} AS n FROM panel {_FORWARD_W}) GROUP BY split""",
    ("panel",),
)
def agg_18(spark, sf):
    both = lb.with_split(lb.add_forward_label(demo.panel(spark, sf), 3), demo.TRAIN_END, demo.VAL_END)
    out = profile.rates_by_split(both, "ignited", "ignited_next_3d")
    return rounded(out.select("split", F.round("first_rate", 6).alias("first_rate"), F.round("second_rate", 6).alias("second_rate"), F.round("ratio", 4).alias("ratio")))


# --- events on one day, relative risk ------------------------------------------


@query(
    "win_13",
    f"""SELECT year, bucket, sum(fires)::bigint AS fires, sum(caught)::bigint AS caught, {r('sum(caught) / sum(fires)', 'capture_rate')} FROM (
       SELECT year, date, count(*) AS fires, count(*) FILTER (in_top) AS caught,
         CASE WHEN count(*) = 1 THEN '1' WHEN count(*) <= 5 THEN '2-5' WHEN count(*) <= 20 THEN '6-20' WHEN count(*) <= 50 THEN '21-50' WHEN count(*) <= 100 THEN '51-100' ELSE '100+' END AS bucket
       FROM flagged WHERE label = 1 GROUP BY year, date) GROUP BY year, bucket""",
    ("flagged",),
)
def win_13(spark, sf):
    return rounded(bt.same_day_buckets(demo.scores(spark, sf)))


@query(
    "win_13_count",
    "SELECT cell_id, acq_date AS date, count(*) OVER (PARTITION BY acq_date) AS same_day FROM (SELECT DISTINCT cell_id, acq_date FROM detections)",
    ("detections",),
)
def win_13_count(spark, sf):
    return bt.same_day_count(lb.distinct_ignitions(demo.detections(spark, sf))).select("cell_id", "date", "same_day")


@query("win_14", f"SELECT row_key, {r('score / max(score) OVER (PARTITION BY date)', 'relative_risk')} FROM scores", ("scores",))
def win_14(spark, sf):
    return rounded(bt.relative_risk(demo.scores(spark, sf)).select("row_key", "relative_risk"))


# --- daily codes ------------------------------------------------------------------

_LE = f"""CASE WHEN lat > 30 THEN {list(K.DMC_DAY_LENGTH_ABOVE_30N)}[m] WHEN lat > 10 THEN {list(K.DMC_DAY_LENGTH_10N_30N)}[m] WHEN lat > -10 THEN 9.0
  WHEN lat > -30 THEN {list(K.DMC_DAY_LENGTH_30S_10S)}[m] ELSE {list(K.DMC_DAY_LENGTH_BELOW_30S)}[m] END::double"""
_LF = f"CASE WHEN lat > 20 THEN {list(K.DC_FACTOR_ABOVE_20N)}[m] WHEN lat <= -20 THEN {list(K.DC_FACTOR_BELOW_20S)}[m] ELSE 1.4 END::double"


def _nested(table: str, steps: list[tuple[str, str]], final: str, keep: str) -> str:
    """SELECT layers, one per intermediate, over `table`."""
    sql = table
    for name, expression in steps:
        sql = f"(SELECT *, {expression} AS {name} FROM {sql})"
    return f"SELECT {keep}, {final} FROM {sql}"


_A = "147.27722772277228::double"
_FFMC_STEPS = [
    ("wo", f"{_A} * (101 - p) / (59.5 + p)"),
    ("ra", "CASE WHEN rain > 0.5 THEN rain - 0.5 ELSE 1 END"),
    (
        "wr",
        """CASE WHEN rain > 0.5 THEN wo + 42.5 * ra * exp(-100 / (251 - wo)) * (1 - exp(-6.93 / ra))
           + CASE WHEN wo > 150 THEN 0.0015 * (wo - 150) * (wo - 150) * sqrt(ra) ELSE 0 END ELSE wo END""",
    ),
    ("w", "CASE WHEN wr > 250 THEN 250 ELSE wr END"),
    ("ed", "0.942 * pow(rh, 0.679) + 11 * exp((rh - 100) / 10) + 0.18 * (21.1 - t) * (1 - exp(-0.115 * rh))"),
    ("ew", "0.618 * pow(rh, 0.753) + 10 * exp((rh - 100) / 10) + 0.18 * (21.1 - t) * (1 - exp(-0.115 * rh))"),
    ("q", "CASE WHEN w > ed THEN rh / 100 WHEN w < ed AND w < ew THEN CASE WHEN rh <= 100 THEN (100 - rh) / 100 END ELSE rh / 100 END"),
    ("kk", "pow(10, -(0.424 * (1 - pow(q, 1.7)) + 0.0694 * sqrt(wind) * (1 - pow(q, 8))) * 0.581 * exp(0.0365 * t))"),
    ("wm", "CASE WHEN w > ed THEN ed + (w - ed) * kk WHEN w < ed AND w < ew THEN ew - (ew - w) * kk ELSE w END"),
    ("f", f"59.5 * (250 - wm) / ({_A} + wm)"),
]
_FFMC = "CASE WHEN f < 0 THEN 0 WHEN f > 101 THEN 101 ELSE f END"
# One column for each equation of the published system, by its number.
_DMC_STEPS = [
    ("e11", "0.92 * rain - 1.27"),
    ("e12", "20 + 280 * exp(-0.023 * p)"),
    ("e13", "CASE WHEN p > 65 THEN 6.2 * ln(p) - 17.2 WHEN p > 33 THEN 14 - 1.3 * ln(p) ELSE 1 / (0.005 + 0.003 * p) END"),
    ("e14", "CASE WHEN rain > 1.5 THEN e12 + 1000 * e11 / (48.77 + e13 * e11) END"),
    ("e15", "43.43 * 5.6348 - 43.43 * ln(e14 - 20)"),
    ("e16", f"1.894e-6 * CASE WHEN t > -1.1 THEN t + 1.1 ELSE t - t END * (100 - rh) * {_LE}"),
    ("kept", "CASE WHEN rain > 1.5 THEN e15 WHEN rain <= 1.5 THEN p END"),
    ("e17", "CASE WHEN kept > 0 THEN kept ELSE 0 * kept END + 100 * e16"),
]
_DMC = "CASE WHEN e17 > 0 THEN e17 ELSE 0 * e17 END"
_DC_STEPS = [
    ("e18", "0.83 * rain - 1.27"),
    ("e19", "800 * exp(-p / 400)"),
    ("e20", "CASE WHEN rain > 2.8 THEN e19 + 3.937 * e18 END"),
    ("e21", "-400 * ln(e20 / 800)"),
    ("e22", f"0.36 * CASE WHEN t > -2.8 THEN t + 2.8 ELSE t - t END + {_LF}"),
    ("kept", "CASE WHEN rain > 2.8 THEN e21 WHEN rain <= 2.8 THEN p END"),
    ("e23", "CASE WHEN rain > 2.8 AND kept < 0 THEN 0 ELSE kept END + 0.5 * CASE WHEN e22 > 0 THEN e22 ELSE 0 * e22 END"),
]
_DC = "CASE WHEN e23 > 0 THEN e23 ELSE 0 * e23 END"

# Latitudes in every band of the day-length tables; humidity above 100 occurs.
_LAT = "-45 + (k % 10) * 11"
rel.relation(
    "code_input",
    f"""SELECT k, cell_id, date, month(date)::int AS m, ({_LAT})::double AS lat, t2m - 27315e-2 AS t, relative_humidity AS rh, wind_speed * 36e-1 AS wind, precip_mm AS rain FROM humid""",
    "humid",
)


def code_frame(spark, sf):
    frame = demo.weather_panel(spark, sf).transform(ft.add_relative_humidity).transform(ft.add_wind_features)
    return frame.withColumn("latitude", (F.lit(-45) + F.col("k") % 10 * 11).cast("double"))


def _one_step(spark, sf):
    return code_frame(spark, sf).select(
        "k",
        "cell_id",
        "date",
        "latitude",
        F.month("date").alias("m"),
        (F.col("t2m") - K.KELVIN_OFFSET).alias("t"),
        F.col("relative_humidity").alias("rh"),
        (F.col("wind_speed") * 3.6).alias("wind"),
        F.col("precip_mm").alias("rain"),
    )


def _previous(scale: str):
    return f"(SELECT *, {scale} AS p FROM code_input)"


@query(
    "fwi_1",
    _nested(_previous("(k * 7 % 101)::double"), _FFMC_STEPS, r(_FFMC, "ffmc", 5), "cell_id, date"),
    ("code_input",),
)
def fwi_1(spark, sf):
    f = _one_step(spark, sf)
    step = C.ffmc_step(C.ColumnMath, (F.col("k") * 7 % 101).cast("double"), F.col("t"), F.col("rh"), F.col("wind"), F.col("rain"))
    return rounded(f.select("cell_id", "date", step.alias("ffmc")), 5)


@query("fwi_2", _nested(_previous("(k * 3 % 120)::double"), _DMC_STEPS, r(_DMC, "dmc", 5), "cell_id, date"), ("code_input",))
def fwi_2(spark, sf):
    f = _one_step(spark, sf)
    step = C.dmc_step(
        C.ColumnMath, (F.col("k") * 3 % 120).cast("double"), F.col("t"), F.col("rh"), F.col("rain"), F.col("latitude"), F.col("m")
    )
    return rounded(f.select("cell_id", "date", step.alias("dmc")), 5)


@query("fwi_3", _nested(_previous("(k * 11 % 700)::double"), _DC_STEPS, r(_DC, "dc", 5), "cell_id, date"), ("code_input",))
def fwi_3(spark, sf):
    f = _one_step(spark, sf)
    step = C.dc_step(C.ColumnMath, (F.col("k") * 11 % 700).cast("double"), F.col("t"), F.col("rain"), F.col("latitude"), F.col("m"))
    return rounded(f.select("cell_id", "date", step.alias("dc")), 5)


_ISI_M = f"({_A} * (101 - ffmc) / (59.5 + ffmc))"
_ISI = f"0.208 * exp(0.05039 * wind) * 91.9 * exp(-0.1386 * {_ISI_M}) * (1 + pow({_ISI_M}, 5.31) / 49300000)"
_BUI_STEPS = [
    ("joint", "nullif(dmc + 0.4 * dc, 0)"),
    ("e27a", "0.8 * dmc * dc / joint"),
    ("e27b", "dmc - (1 - 0.8 * dc / joint) * (0.92 + pow(0.0114 * dmc, 1.7))"),
    ("bui", "CASE WHEN dmc = 0 AND dc = 0 THEN 0 WHEN dmc <= 0.4 * dc THEN e27a WHEN e27b > 0 THEN e27b ELSE 0 * e27b END"),
]
_FWI_STEPS = [
    ("e28", "CASE WHEN bui <= 80 THEN 2 + 0.626 * pow(bui, 0.809) ELSE 1000 / (25 + 108.64 * exp(-0.023 * bui)) END"),
    ("e29", "isi * e28 / 10"),
    ("e30", "CASE WHEN e29 > 1 THEN 2.72 * pow(0.434 * ln(e29), 0.647) END"),
    ("fwi", "CASE WHEN e29 > 1 THEN exp(e30) ELSE e29 END"),
]


@query("fwi_4", f"SELECT cell_id, date, {r(_ISI, 'isi', 5)} FROM (SELECT *, 50 + (k % 50)::double AS ffmc FROM code_input)", ("code_input",))
def fwi_4(spark, sf):
    isi = C.initial_spread_index(C.ColumnMath, F.lit(50.0) + F.col("k") % 50, F.col("wind"))
    return rounded(_one_step(spark, sf).select("cell_id", "date", isi.alias("isi")), 5)


@query(
    "fwi_5",
    _nested("(SELECT *, (k % 7 * 10)::double AS dmc, (dayofyear(date) % 40 * 10)::double AS dc FROM code_input)", _BUI_STEPS, r("bui", "bui", 5), "cell_id, date"),
    ("code_input",),
)
def fwi_5(spark, sf):
    dmc, dc = (F.col("k") % 7 * 10).cast("double"), (F.dayofyear("date") % 40 * 10).cast("double")
    return rounded(_one_step(spark, sf).select("cell_id", "date", C.buildup_index(C.ColumnMath, dmc, dc).alias("bui")), 5)


@query(
    "fwi_6",
    _nested("(SELECT *, (k % 30) / 4.0::double AS isi, (dayofyear(date) % 200)::double AS bui FROM code_input)", _FWI_STEPS, r("fwi", "fwi", 5), "cell_id, date"),
    ("code_input",),
)
def fwi_6(spark, sf):
    isi, bui = F.col("k") % 30 / 4.0, (F.dayofyear("date") % 200).cast("double")
    return rounded(_one_step(spark, sf).select("cell_id", "date", C.fire_weather_index(C.ColumnMath, isi, bui).alias("fwi")), 5)


def _fold_sql() -> str:
    """Season by season from 1 March, one day per round of the recursion."""

    def chain(prev: str, steps: list[tuple[str, str]], final: str, out: str, source: str) -> str:
        sql = f"(SELECT *, {prev} AS p FROM {source})"
        for name, expression in steps:
            sql = f"(SELECT *, {expression} AS {name} FROM {sql})"
        used = ", ".join(n for n, _ in steps)
        return f"(SELECT * EXCLUDE (p, {used}), {final} AS {out} FROM {sql})"

    def day(source: str) -> str:
        sql = chain("pf", _FFMC_STEPS, _FFMC, "ffmc", source)
        sql = chain("pd", _DMC_STEPS, _DMC, "dmc", sql)
        return chain("pc", _DC_STEPS, _DC, "dc", sql)

    first = "(SELECT *, 85::double AS pf, 6::double AS pd, 15::double AS pc FROM seasons WHERE n = 0)"
    later = "(SELECT s.*, f.ffmc AS pf, f.dmc AS pd, f.dc AS pc FROM folded f JOIN seasons s ON s.k = f.k AND s.season = f.season AND s.n = f.n + 1)"
    keep = "k, cell_id, date, season, n, wind, ffmc::double AS ffmc, dmc::double AS dmc, dc::double AS dc"
    return f"folded AS (SELECT {keep} FROM {day(first)} UNION ALL SELECT {keep} FROM {day(later)})"


rel.relation(
    "seasons",
    "SELECT *, date - make_date(season, 3, 1) AS n FROM (SELECT *, year(date) - (month(date) < 3)::int AS season FROM code_input)",
    "code_input",
)


def _codes_body() -> str:
    sql = f"(SELECT *, {_ISI} AS isi FROM folded)"
    for name, expression in _BUI_STEPS + _FWI_STEPS:
        sql = f"(SELECT *, {expression} AS {name} FROM {sql})"
    names = ", ".join(r(f"c.{n}", n, 4) for n in K.CODE_COLUMNS)
    return f"SELECT i.cell_id, i.date, {names} FROM code_input i LEFT JOIN {sql} c ON c.k = i.k AND c.date = i.date"


@query("win_11", _codes_body(), ("seasons", "code_input"), recursive=_fold_sql())
def win_11(spark, sf):
    return rounded(fw.compute_codes(code_frame(spark, sf)).select("cell_id", "date", *K.CODE_COLUMNS), 4)


# --- ranking, metrics, backtest -------------------------------------------------


@query("top_1", "SELECT row_key, in_top FROM flagged", ("flagged",))
def top_1(spark, sf):
    return ranking.top_k_flag(demo.scores(spark, sf), by=["year"]).select("row_key", "in_top")


@query(
    "top_3",
    f"""SELECT * FROM (SELECT 'highest_scored_actual_fire' AS example, row_key, {r('score', 'score')} FROM scores WHERE label = 1 ORDER BY scores.score DESC, row_key LIMIT 1)
       UNION ALL SELECT * FROM (SELECT 'highest_scored_non_fire', row_key, {r('score', 'score')} FROM scores WHERE label = 0 ORDER BY scores.score DESC, row_key LIMIT 1)
       UNION ALL SELECT * FROM (SELECT 'highest_scored_missed_fire', row_key, {r('score', 'score')} FROM scores WHERE label = 1 AND scores.score < (SELECT quantile_cont(s.score, 0.9) FROM scores s) ORDER BY scores.score DESC, row_key LIMIT 1)""",
    ("scores",),
)
def top_3(spark, sf):
    s = demo.scores(spark, sf)
    return rounded(bt.extreme_examples(s, s))


@query("top_5", f"SELECT row_key, label, score FROM scores ORDER BY md5('0:' || row_key), row_key LIMIT {K.BACKGROUND_ROWS}", ("scores",))
def top_5(spark, sf):
    return ranking.seeded_sample(demo.scores(spark, sf).select("row_key", "label", "score"), K.BACKGROUND_ROWS, "row_key")


@query(
    "set_1",
    "SELECT kind, cell_id, count(*) AS rows FROM (SELECT 'fire' AS kind, cell_id FROM detections UNION ALL SELECT 'point', cell_id FROM points_in_cells) GROUP BY ALL",
    ("detections", "points_in_cells"),
)
def set_1(spark, sf):
    from riskgrid.operators import grid

    fires = demo.detections(spark, sf).select(F.lit("fire").alias("kind"), "cell_id")
    located = grid.assign_cell_ids(demo.points(spark, sf)).select("cell_id", F.lit("point").alias("kind"))
    return fires.unionByName(located).groupBy("kind", "cell_id").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "set_2",
    f"SELECT y AS left_out, count(*) AS rows, sum(label)::bigint AS positives FROM scores, (SELECT unnest([{', '.join(map(str, demo.YEARS))}]) AS y) WHERE year <> y GROUP BY y",
    ("scores",),
)
def set_2(spark, sf):
    from functools import reduce

    s = demo.scores(spark, sf)
    parts = [
        bt.all_but_year(s, y).groupBy(F.lit(y).alias("left_out")).agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives"))
        for y in demo.YEARS
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


rel.relation("ladder", "SELECT year, score, count(*) AS n, sum(label) AS pos FROM scores GROUP BY ALL", "scores")
rel.relation(
    "climb",
    """SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(pos) OVER (PARTITION BY year) AS np, sum(n) OVER (PARTITION BY year) AS nn
       FROM ladder WINDOW w AS (PARTITION BY year ORDER BY score DESC)""",
    "ladder",
)
_AP = "sum(pos * cp / cn) / max(np)"
_AUC = "sum(pos * ((nn - np) - (cn - cp) + (n - pos) / 2.0)) / max(np * (nn - np))"


@query("ev_1", f"SELECT year, {r(_AP, 'pr_auc')} FROM climb GROUP BY year", ("climb",))
def ev_1(spark, sf):
    return rounded(metrics.average_precision(demo.scores(spark, sf), by=["year"]))


@query("ev_2", f"SELECT year, {r(_AUC, 'roc_auc')} FROM climb GROUP BY year", ("climb",))
def ev_2(spark, sf):
    return rounded(metrics.roc_auc(demo.scores(spark, sf), by=["year"]))


_CAPTURE = "sum(label) FILTER (in_top) / sum(label)"


@query("ev_3", f"SELECT year, {r(_CAPTURE, 'capture')} FROM flagged GROUP BY year", ("flagged",))
def ev_3(spark, sf):
    return rounded(metrics.top_k_capture(demo.scores(spark, sf), by=["year"]))


_BRIER = "avg((score - label) * (score - label))"
_FLOOR = "avg(label) * (1 - avg(label))"


@query("ev_4", f"SELECT year, {r(_BRIER, 'brier')}, {r(_FLOOR, 'brier_floor')}, {r(f'{_BRIER} / ({_FLOOR})', 'brier_ratio')} FROM scores GROUP BY year", ("scores",))
def ev_4(spark, sf):
    return rounded(metrics.brier(demo.scores(spark, sf), by=["year"]))


@query(
    "ev_5",
    f"""SELECT a.pr_auc, a.roc_auc, b.top_10pct_capture FROM (SELECT {r(_AP, 'pr_auc')}, {r(_AUC, 'roc_auc')} FROM (
         SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(pos) OVER () AS np, sum(n) OVER () AS nn FROM (SELECT score, sum(n) AS n, sum(pos) AS pos FROM ladder GROUP BY score) WINDOW w AS (ORDER BY score DESC))) a,
       (SELECT {r(_CAPTURE, 'top_10pct_capture')} FROM (SELECT *, row_number() OVER (ORDER BY score DESC, row_key) <= floor(count(*) OVER () * 1e-1) AS in_top FROM scores)) b""",
    ("ladder", "scores"),
)
def ev_5(spark, sf):
    return rounded(metrics.score_card(demo.scores(spark, sf)))


_YEAR_LIST = ", ".join(map(str, demo.YEARS))


@query(
    "bt_1",
    f"""SELECT y::int AS year, count(*) FILTER (year(date) < y) AS train_rows, count(*) FILTER (year(date) = y) AS holdout_rows,
       coalesce(sum(ignited) FILTER (year(date) = y), 0)::bigint AS holdout_positives FROM panel, (SELECT unnest([{_YEAR_LIST}]) AS y) GROUP BY y""",
    ("panel",),
)
def bt_1(spark, sf):
    return bt.fold_sizes(demo.panel(spark, sf), demo.YEARS)


@query("bt_3", f"SELECT year, month, total, caught, {r('capture_rate', 'capture_rate')} FROM monthly", ("monthly",))
def bt_3(spark, sf):
    return rounded(bt.monthly_capture(demo.scores(spark, sf)))


rel.relation(
    "edges",
    "SELECT year, list_sort(list_distinct([" + ", ".join(f"quantile_cont(score, {i / 10})" for i in range(11)) + "])) AS q FROM scores GROUP BY year",
    "scores",
)
rel.relation(
    "reliability",
    """SELECT year, bin, count(*) AS count, avg(score) AS mean_predicted, avg(label) AS observed_rate FROM (
       SELECT s.year, s.score, s.label, greatest(len(list_filter(q, lambda e: e < s.score)), 1)::int AS bin FROM scores s JOIN edges USING (year)) GROUP BY ALL""",
    "scores",
    "edges",
)


@query(
    "bt_4",
    f"""SELECT a.*, t.top_bin_mean_predicted, t.top_bin_observed_rate, t.top_bin_ratio, c.top_10pct_capture, l.pr_auc, l.roc_auc FROM (
         SELECT year, sum(label)::bigint AS positives, {r(_BRIER, 'brier')}, {r(_FLOOR, 'brier_floor')}, {r(f'{_BRIER} / ({_FLOOR})', 'brier_ratio')},
           {r('coalesce(sum(label) FILTER (month(date) IN (7, 8)), 0) / sum(label)', 'jul_aug_fire_share')} FROM scores GROUP BY year) a
       JOIN (SELECT year, {r('mean_predicted', 'top_bin_mean_predicted')}, {r('observed_rate', 'top_bin_observed_rate')}, {r('mean_predicted / observed_rate', 'top_bin_ratio')}
         FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY bin DESC) AS rn FROM reliability) WHERE rn = 1) t USING (year)
       JOIN (SELECT year, {r(_CAPTURE, 'top_10pct_capture')} FROM flagged GROUP BY year) c USING (year)
       JOIN (SELECT year, {r(_AP, 'pr_auc')}, {r(_AUC, 'roc_auc')} FROM climb GROUP BY year) l USING (year)""",
    ("scores", "reliability", "flagged", "climb"),
)
def bt_4(spark, sf):
    return rounded(bt.yearly_summary(demo.scores(spark, sf)))


@query(
    "bt_5",
    f"SELECT in_top AS caught, count(*) AS fires, {r('avg(score)', 'mean_score')}, {r('avg(k)', 'mean_k')} FROM flagged WHERE label = 1 GROUP BY in_top",
    ("flagged",),
)
def bt_5(spark, sf):
    per_year = bt.caught_vs_missed(demo.scores(spark, sf), ["score", "k"], by=["year"])
    weighted = [(F.sum(F.col(f"mean_{f}") * F.col("fires")) / F.sum("fires")).alias(f"mean_{f}") for f in ("score", "k")]
    return rounded(per_year.groupBy("caught").agg(F.sum("fires").alias("fires"), *weighted))


# --- calibration ------------------------------------------------------------------


@query("cal_1", f"SELECT year, bin, count, {r('mean_predicted', 'mean_predicted')}, {r('observed_rate', 'observed_rate')} FROM reliability", ("reliability",))
def cal_1(spark, sf):
    return rounded(cal.reliability_table(demo.scores(spark, sf), by=["year"]))


rel.relation("pooled", "SELECT score, sum(n) AS n, sum(pos) AS pos, row_number() OVER (ORDER BY score) AS i FROM ladder WHERE year < 2000 GROUP BY score", "ladder")
rel.relation("sums", "SELECT *, sum(n) OVER (ORDER BY i) AS cn, sum(pos) OVER (ORDER BY i) AS cp FROM pooled", "pooled")
rel.relation(
    "isotonic",
    """SELECT i, score, max(lowest) AS g FROM (
         SELECT k.i, k.score, a.i AS ai, min((b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n)) AS lowest
         FROM sums k JOIN sums a ON a.i <= k.i JOIN sums b ON b.i >= k.i GROUP BY k.i, k.score, a.i) GROUP BY i, score""",
    "sums",
)


@query(
    "cal_2",
    f"""SELECT t.score, {r('''CASE WHEN t.score <= (SELECT min(score) FROM isotonic) THEN (SELECT arg_min(g, score) FROM isotonic)
         WHEN t.score >= (SELECT max(score) FROM isotonic) THEN (SELECT arg_max(g, score) FROM isotonic)
         ELSE lo.g + (hi.g - lo.g) * coalesce((t.score - lo.score) / nullif(hi.score - lo.score, 0), 0) END''', 'calibrated')}
       FROM (SELECT DISTINCT score FROM ladder WHERE year >= 2000) t
       ASOF LEFT JOIN isotonic lo ON t.score >= lo.score ASOF LEFT JOIN isotonic hi ON t.score <= hi.score""",
    ("ladder", "isotonic"),
)
def cal_2(spark, sf):
    """Curve of the years before 2000, read off at every later score."""
    s = demo.scores(spark, sf)
    model = cal.fit_isotonic(s.filter("year < 2000"))
    asked = s.filter("year >= 2000").select("score").distinct()
    return cal.apply_isotonic(asked, model).select("score", F.round("calibrated", 6).alias("calibrated"))


# Newton steps on the two parameters of the curve; the slope has a unit penalty.
_NEWTON = """newton AS (SELECT 0 AS i, 0::double AS a, 0::double AS b UNION ALL
  SELECT i + 1, a - (ga * hbb - gb * hab) / (haa * hbb - hab * hab), b - (gb * haa - ga * hab) / (haa * hbb - hab * hab) FROM (
    SELECT i, a, b, sum((n * p - pos) * score) + a AS ga, sum(n * p - pos) AS gb, sum(n * p * (1 - p) * score * score) + 1 AS haa, sum(n * p * (1 - p) * score) AS hab, sum(n * p * (1 - p)) AS hbb
    FROM (SELECT i, a, b, score, n, pos, 1 / (1 + exp(-a * score - b)) AS p FROM newton, (SELECT score, n, pos FROM pooled) WHERE i < 25) GROUP BY i, a, b))"""


@query(
    "cal_3",
    f"SELECT score, {r('1 / (1 + exp(-a * score - b))', 'calibrated', 5)} FROM (SELECT DISTINCT score FROM ladder WHERE year >= 2000), newton WHERE i = 25",
    ("ladder", "pooled"),
    recursive=_NEWTON,
)
def cal_3(spark, sf):
    s = demo.scores(spark, sf)
    asked = s.filter("year >= 2000").select("score").distinct()
    found = cal.apply_sigmoid(asked, cal.fit_sigmoid(s.filter("year < 2000")))
    return found.select("score", (F.round("calibrated", 5) + F.lit(0.0)).alias("calibrated"))


def _added(gain: int) -> str:
    """Isotonic value at each asked score with one more row of outcome `gain`."""
    return f"""SELECT score, max(lowest) AS p FROM (
      SELECT t.score, a.w, min((b.w2s - a.s + {gain}) / (b.w2 - a.w + 1)) AS lowest
      FROM asked t JOIN starts a ON a.upto < t.score JOIN stops b ON b.since >= t.score GROUP BY t.score, a.w, a.s) GROUP BY score"""


rel.relation("asked", "SELECT DISTINCT score FROM ladder WHERE year >= 2000", "ladder")
# Cumulative points: where a pooled block may start (strictly below the score)
# and where it may end (at it or above, or just before the next one).
rel.relation("starts", "SELECT -1::double AS upto, 0 AS w, 0 AS s UNION ALL SELECT score, cn, cp FROM sums", "sums")
rel.relation(
    "stops",
    """SELECT score AS since, cn AS w2, cp AS w2s FROM sums UNION ALL
       SELECT coalesce(lead(score) OVER (ORDER BY score), 9) - 1e-9 AS since, cn, cp FROM sums UNION ALL SELECT (SELECT min(score) FROM sums) - 1e-9, 0, 0""",
    "sums",
)


@query(
    "cal_4",
    f"""SELECT z.score, {r('z.p', 'p0')}, {r('o.p', 'p1')}, {r('o.p / (1 - z.p + o.p)', 'point')}, {r('o.p - z.p', 'width')}
       FROM ({_added(0)}) z JOIN ({_added(1)}) o USING (score)""",
    ("asked", "starts", "stops"),
)
def cal_4(spark, sf):
    s = demo.scores(spark, sf)
    asked = s.filter("year >= 2000").select("score").distinct()
    return rounded(cal.venn_abers(s.filter("year < 2000"), asked))


def _year_report(spark, sf):
    return cal.leave_one_year_out(demo.scores(spark, sf), demo.YEARS)


# Each year against all others: cumulative points of the other years, then the
# interval at every score of the year itself.
rel.relation(
    "other_sums",
    f"""SELECT y, score, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, row_number() OVER w AS i FROM (
         SELECT y, score, sum(n) AS n, sum(pos) AS pos FROM ladder, (SELECT unnest([{_YEAR_LIST}]) AS y) WHERE year <> y GROUP BY y, score)
       WINDOW w AS (PARTITION BY y ORDER BY score)""",
    "ladder",
)
rel.relation("other_starts", "SELECT DISTINCT y, -1::double AS upto, 0 AS w, 0 AS s FROM other_sums UNION ALL SELECT y, score, cn, cp FROM other_sums", "other_sums")
rel.relation(
    "other_stops",
    """SELECT y, score AS since, cn AS w2, cp AS w2s FROM other_sums UNION ALL
       SELECT y, coalesce(lead(score) OVER (PARTITION BY y ORDER BY score), 9) - 1e-9, cn, cp FROM other_sums UNION ALL SELECT y, min(score) - 1e-9, 0, 0 FROM other_sums GROUP BY y""",
    "other_sums",
)


def _year_added(gain: int) -> str:
    return f"""SELECT year, score, max(lowest) AS p FROM (
      SELECT t.year, t.score, a.w, min((b.w2s - a.s + {gain}) / (b.w2 - a.w + 1)) AS lowest
      FROM ladder t JOIN other_starts a ON a.y = t.year AND a.upto < t.score JOIN other_stops b ON b.y = t.year AND b.since >= t.score
      GROUP BY t.year, t.score, a.w, a.s) GROUP BY year, score"""


@query(
    "cal_6",
    f"""SELECT {r('avg(width) FILTER (year IN (1998, 2000))', 'sparse_mean_width')}, {r('avg(width) FILTER (year NOT IN (1998, 2000))', 'other_mean_width')},
       {r('corr(width, 1 / positives)', 'width_vs_inverse_positives', 4)} FROM (
       SELECT year, sum((o.p - z.p) * n) / sum(n) AS width, sum(pos) AS positives FROM ladder JOIN ({_year_added(0)}) z USING (year, score) JOIN ({_year_added(1)}) o USING (year, score) GROUP BY year)""",
    ("ladder", "other_starts", "other_stops"),
)
def cal_6(spark, sf):
    out = cal.interval_check(_year_report(spark, sf), (1998, 2000))
    return rounded(out.withColumn("width_vs_inverse_positives", F.round("width_vs_inverse_positives", 4)))


# The three curves of each year, fitted to all others, at the year's own scores.
rel.relation(
    "other_pooled",
    f"""SELECT y, score, sum(n) AS n, sum(pos) AS pos, row_number() OVER (PARTITION BY y ORDER BY score) AS i
       FROM ladder, (SELECT unnest([{_YEAR_LIST}]) AS y) WHERE year <> y GROUP BY y, score""",
    "ladder",
)
rel.relation(
    "year_isotonic",
    """SELECT y, score, max(lowest) AS g FROM (
         SELECT k.y, k.score, a.i AS ai, min((b.cp - a.cp + p.pos) / (b.cn - a.cn + p.n)) AS lowest
         FROM other_sums k JOIN other_sums a ON a.y = k.y AND a.i <= k.i JOIN other_pooled p ON p.y = a.y AND p.i = a.i JOIN other_sums b ON b.y = k.y AND b.i >= k.i
         GROUP BY k.y, k.score, a.i) GROUP BY y, score""",
    "other_sums",
    "other_pooled",
)
rel.relation(
    "year_ends",
    "SELECT y, min(score) AS least, max(score) AS most, arg_min(g, score) AS g_least, arg_max(g, score) AS g_most FROM year_isotonic GROUP BY y",
    "year_isotonic",
)
_YEAR_NEWTON = """newton_y AS (SELECT 0 AS i, y, 0::double AS a, 0::double AS b FROM (SELECT DISTINCT y FROM other_pooled) UNION ALL
  SELECT i + 1, y, a - (ga * hbb - gb * hab) / (haa * hbb - hab * hab), b - (gb * haa - ga * hab) / (haa * hbb - hab * hab) FROM (
    SELECT i, y, a, b, sum((n * p - pos) * score) + a AS ga, sum(n * p - pos) AS gb, sum(n * p * (1 - p) * score * score) + 1 AS haa, sum(n * p * (1 - p) * score) AS hab, sum(n * p * (1 - p)) AS hbb
    FROM (SELECT m.i, m.y, a, b, score, n, pos, 1 / (1 + exp(-a * score - b)) AS p FROM newton_y m JOIN (SELECT y AS oy, score, n, pos FROM other_pooled) o ON o.oy = m.y WHERE m.i < 25) GROUP BY i, y, a, b))"""


def _cal_5_sql() -> str:
    isotonic = """CASE WHEN t.score <= e.least THEN e.g_least WHEN t.score >= e.most THEN e.g_most
         ELSE lo.g + (hi.g - lo.g) * coalesce((t.score - lo.score) / nullif(hi.score - lo.score, 0), 0) END"""
    values = f"""SELECT t.year, t.score, t.n, t.pos, t.score AS raw, least(greatest({isotonic}, 0), 1) AS isotonic, 1 / (1 + exp(-m.a * t.score - m.b)) AS sigmoid,
         o.p / (1 - z.p + o.p) AS venn_abers, o.p - z.p AS width
       FROM ladder t JOIN year_ends e ON e.y = t.year JOIN newton_y m ON m.y = t.year AND m.i = 25
       JOIN ({_year_added(0)}) z ON z.year = t.year AND z.score = t.score JOIN ({_year_added(1)}) o ON o.year = t.year AND o.score = t.score
       ASOF LEFT JOIN year_isotonic lo ON lo.y = t.year AND t.score >= lo.score ASOF LEFT JOIN year_isotonic hi ON hi.y = t.year AND t.score <= hi.score"""
    long = " UNION ALL ".join(f"SELECT year, n, pos, '{m}' AS method, round({m}, 12) AS v FROM vals" for m in cal.METHODS)
    edges = ", ".join(f"quantile_cont(v, {i / 10})" for i in range(11))
    of = lambda m, what, name: r(f"max({what}) FILTER (method = '{m}')", f"{m}_{name}", 5)
    wide = ", ".join(f"{of(m, 'brier', 'brier')}, {of(m, 'ratio', 'top_bin_ratio')}" for m in cal.METHODS)
    return f"""SELECT year, any_value(positives)::bigint AS positives, {r('any_value(width)', 'venn_abers_mean_interval_width', 5)},
         ((SELECT sum(pos) FROM ladder) - any_value(positives))::bigint AS pooled_train_positives, {wide}
       FROM (SELECT year, sum(pos) AS positives, sum(width * n) / sum(n) AS width FROM ({values}) GROUP BY year) JOIN (
         WITH vals AS ({values}), long AS ({long}),
         q AS (SELECT year, method, list_sort(list_distinct([{edges}])) AS q FROM (SELECT year, method, v, unnest(range(n::bigint)) FROM long) GROUP BY year, method),
         bins AS (SELECT year, method, bin, sum(v * n) / sum(n) AS predicted, sum(pos) / sum(n) AS observed FROM (
           SELECT l.*, greatest(len(list_filter(q, lambda e: e < v)), 1) AS bin FROM long l JOIN q USING (year, method)) GROUP BY year, method, bin),
         tops AS (SELECT year, method, arg_max(CASE WHEN observed > 0 THEN predicted / observed ELSE -1 END, bin) AS ratio FROM bins GROUP BY year, method)
         SELECT year, method, sum(pos * (1 - v) * (1 - v) + (n - pos) * v * v) / sum(n) AS brier, any_value(nullif(ratio, -1)) AS ratio
         FROM long JOIN tops USING (year, method) GROUP BY year, method) USING (year) GROUP BY year"""


@query("cal_5", _cal_5_sql(), ("ladder", "other_pooled", "other_starts", "other_stops", "year_isotonic", "year_ends"), recursive=_YEAR_NEWTON)
def cal_5(spark, sf):
    return rounded(_year_report(spark, sf), 5)


rel.relation("all_pooled", "SELECT score, sum(n) AS n, sum(pos) AS pos, row_number() OVER (ORDER BY score) AS i FROM ladder GROUP BY score", "ladder")
rel.relation("all_sums", "SELECT *, sum(n) OVER (ORDER BY i) AS cn, sum(pos) OVER (ORDER BY i) AS cp FROM all_pooled", "all_pooled")
rel.relation(
    "all_isotonic",
    """SELECT score, n, pos, max(lowest) AS g FROM (
         SELECT k.score, k.n, k.pos, a.i AS ai, min((b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n)) AS lowest
         FROM all_sums k JOIN all_sums a ON a.i <= k.i JOIN all_sums b ON b.i >= k.i GROUP BY k.score, k.n, k.pos, a.i) GROUP BY score, n, pos""",
    "all_sums",
)


@query(
    "cal_7",
    f"""SELECT bin, sum(n)::bigint AS count, {r('sum(g * n) / sum(n)', 'mean_predicted')}, {r('sum(pos) / sum(n)', 'observed_rate')} FROM (
       SELECT i.*, greatest(len(list_filter(q, lambda e: e < i.g)), 1)::int AS bin FROM all_isotonic i, (
         SELECT list_sort(list_distinct([{', '.join(f'quantile_cont(round(g, 12), {i / 10})' for i in range(11))}])) AS q FROM (SELECT g, unnest(range(n::bigint)) FROM all_isotonic))) GROUP BY bin""".replace(
        "e < i.g", "e < round(i.g, 12)"
    ),
    ("all_isotonic",),
)
def cal_7(spark, sf):
    return rounded(cal.pooled_reliability(demo.scores(spark, sf)))


rel.relation("split_scores", f"SELECT *, {_SPLIT} AS split FROM scores", "scores")
rel.relation(
    "split_edges",
    "SELECT split, list_sort(list_distinct([" + ", ".join(f"quantile_cont(score, {i / 10})" for i in range(11)) + "])) AS q FROM split_scores GROUP BY split",
    "split_scores",
)


@query(
    "cal_8",
    f"""SELECT split, bin, count(*) AS count, {r('avg(score)', 'mean_predicted')}, {r('avg(label)', 'observed_rate')}, {r('any_value(b)', 'brier')}, {r('any_value(f)', 'brier_floor')}, {r('any_value(p)', 'positive_rate')} FROM (
       SELECT s.split, s.score, s.label, greatest(len(list_filter(q, lambda e: e < s.score)), 1)::int AS bin, b, f, p FROM split_scores s JOIN split_edges USING (split)
       JOIN (SELECT split, {_BRIER} AS b, {_FLOOR} AS f, avg(label) AS p FROM split_scores GROUP BY split) USING (split)) GROUP BY split, bin""",
    ("split_scores", "split_edges"),
)
def cal_8(spark, sf):
    return rounded(cal.split_report(lb.with_split(demo.scores(spark, sf), demo.TRAIN_END, demo.VAL_END)))


# --- the same reports on scores that hardly repeat: many buckets instead of one ----------


def _on_fine_scores(name: str) -> None:
    coarse = RELATIONS["scores"][1]
    fine = f"SELECT * REPLACE (score + (row_key % 9973) / 1e7 AS score) FROM ({coarse})"

    def run(spark, sf):
        token = demo.FINE.set(True)
        try:
            return QUERIES[name](spark, sf)
        finally:
            demo.FINE.reset(token)

    QUERIES[f"{name}_fine"] = run
    ORACLES[f"{name}_fine"] = ORACLES[name].replace(f"({coarse})", f"({fine})")


for _name in ("ev_1", "ev_2", "ev_3", "ev_5", "top_1", "cal_1", "bt_4"):
    _on_fine_scores(_name)
