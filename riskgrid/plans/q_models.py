"""Registered queries: sources, datasets, learning, serving, streams."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.functions import constants as K
from riskgrid.functions.weather_math import season_filter
from riskgrid.learn import export, importance, models, search
from riskgrid.learn.bundle import Bundle, load_bundle, save_bundle
from riskgrid.operators import backtest as bt
from riskgrid.operators import explain as xai
from riskgrid.operators import features as ft
from riskgrid.operators import labels as lb
from riskgrid.operators import profile
from riskgrid.operators.calibrate import fit_isotonic
from riskgrid.plans import demo, serve
from riskgrid.plans import relations as rel
from riskgrid.plans.catalog import RELATIONS, query, r, rounded
from riskgrid.plans.dataset import build_dataset
from riskgrid.plans.q_panel import POINT
from riskgrid.plans.q_reports import _codes_body, _fold_sql
from riskgrid.operators.terrain import attach_static, one_hot_fixed
from riskgrid.session import materialize, scratch_path
from riskgrid.sources import detections as src
from riskgrid.sources import readings as rd

# --- sources ----------------------------------------------------------------------


def landed_points(spark, sf, file_format="parquet") -> str:
    path = scratch_path(spark, "landed")
    frame = demo.points(spark, sf).select("latitude", "longitude", "acq_date", "type")
    frame.write.option("header", True).format(file_format).save(path)
    return path


@query(
    "src_1",
    f"""SELECT {POINT}, acq_date, type FROM points WHERE longitude BETWEEN -121 AND -120 AND latitude BETWEEN 50 AND 51 AND acq_date BETWEEN date '2024-01-05' AND date '2024-01-20'""",
    ("points",),
)
def src_1(spark, sf):
    path = landed_points(spark, sf, "csv")
    return rounded(src.read_detections(spark, path, "2024-01-05", "2024-01-20", "-121,50,-120,51", "csv"))


@query("src_2", "SELECT acq_date, count(*) AS rows FROM points WHERE acq_date BETWEEN date '2024-01-03' AND date '2024-01-25' GROUP BY 1", ("points",))
def src_2(spark, sf):
    """Three runs over a growing source; the second resumes, the third finds nothing."""
    source, target = demo.points(spark, sf), scratch_path(spark, "archive")
    src.append_new(spark, source.filter("acq_date <= '2024-01-12'"), target, "2024-01-03", "2024-01-25")
    src.append_new(spark, source, target, "2024-01-03", "2024-01-25")
    table = src.append_new(spark, source, target, "2024-01-03", "2024-01-25")
    return table.groupBy("acq_date").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "src_4",
    """SELECT year(m)::int AS year, month(m)::int AS month FROM (SELECT unnest(generate_series(timestamp '1994-06-01', timestamp '2002-05-01', INTERVAL 1 MONTH)) AS m)
       WHERE (year(m), month(m)) NOT IN (SELECT (year(o_orderdate), month(o_orderdate)) FROM orders WHERE o_orderstatus = 'F')""",
)
def src_4(spark, sf):
    orders = demo.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.to_date("o_orderdate").alias("date"))
    return src.missing_months(orders, "1994-06-15", "2002-05-31")


def _reading_files(spark, sf) -> tuple[str, str]:
    """Readings in two sets of files, one without `swvl1`."""
    early, late = scratch_path(spark, "readings"), scratch_path(spark, "readings")
    frame = demo.readings(spark, sf)
    frame.filter("valid_time < '1998-01-01'").drop("swvl1").write.parquet(early)
    frame.filter("valid_time >= '1998-01-01'").write.parquet(late)
    return early, late


@query(
    "src_5",
    f"SELECT year(valid_time)::int AS year, count(*) AS rows, count(swvl1) FILTER (valid_time >= timestamp '1998-01-01') AS with_soil, {r('avg(t2m)', 't2m')} FROM readings GROUP BY 1",
    ("readings",),
)
def src_5(spark, sf):
    table = rd.read_readings(spark, _reading_files(spark, sf))
    return rounded(
        table.groupBy(F.year("valid_time").alias("year")).agg(
            F.count(F.lit(1)).alias("rows"), F.count("swvl1").alias("with_soil"), F.avg("t2m").alias("t2m")
        )
    )


_KEYED = "SELECT valid_time, latitude, longitude, {cols} FROM readings WHERE {where} GROUP BY ALL"
rel.relation("first_set", _KEYED.format(cols="max(t2m) AS t2m, max(cape) AS cape", where="l_ok"), "flagged_readings")
rel.relation("second_set", _KEYED.format(cols="min(cape) AS cape, max(cp) AS cp", where="NOT l_ok OR t2m > 285"), "flagged_readings")
RELATIONS["flagged_readings"] = (("readings",), "SELECT *, t2m > 270 AS l_ok FROM readings")
for _name in ("first_set", "second_set"):
    RELATIONS[_name] = (RELATIONS[_name][0], RELATIONS[_name][1].replace("FROM readings", "FROM flagged_readings"))


@query(
    "src_6",
    f"""SELECT strftime(valid_time, '%Y-%m-%d %H:%M') AS valid_time, {POINT}, {r('a.t2m', 't2m')}, {r('coalesce(a.cape, b.cape)', 'cape')}, {r('b.cp', 'cp')}
       FROM first_set a FULL JOIN second_set b USING (valid_time, latitude, longitude)""",
    ("first_set", "second_set"),
)
def src_6(spark, sf):
    frame = demo.readings(spark, sf)
    first = frame.filter("t2m > 270").groupBy(*rd.READING_KEY).agg(F.max("t2m").alias("t2m"), F.max("cape").alias("cape"))
    second = frame.filter("t2m <= 270 OR t2m > 285").groupBy(*rd.READING_KEY).agg(F.min("cape").alias("cape"), F.max("cp").alias("cp"))
    merged = rd.merge_readings(first, second)
    return rounded(merged.withColumn("valid_time", F.date_format("valid_time", "yyyy-MM-dd HH:mm")))


@query("src_7", "SELECT cell_id, date, ignited, year(date)::int AS year FROM panel WHERE ignited = 1", ("panel",))
def src_7(spark, sf):
    path = f"{scratch_path(spark, 'sink')}/nested/panel"
    rd.write_table(demo.panel(spark, sf).withColumn("year", F.year("date")), path, ["year"])
    return spark.read.parquet(path).filter("ignited = 1").select("cell_id", "date", "ignited", "year")


@query("src_8", "SELECT cell_id, fuel_type_cd FROM fuel", ("fuel",))
def src_8(spark, sf):
    path = scratch_path(spark, "fuel")
    rd.load_or_build(spark, path, lambda: demo.fuel(spark, sf))
    return rd.load_or_build(spark, path, lambda: demo.fuel(spark, sf).limit(0))  # already there


@query("src_9", f"SELECT cell_id, date, {r('t2m', 't2m')} FROM weather WHERE ignited = 1", ("weather",))
def src_9(spark, sf):
    stored = materialize(demo.weather_panel(spark, sf), "weather-table")
    path = stored.inputFiles()[0].rsplit("/", 1)[0]
    return rounded(rd.read_columns(spark, path, ["cell_id", "date", "ignited", "t2m"]).filter("ignited = 1").drop("ignited"))


def raw_feed(spark, sf) -> DataFrame:
    """The weather panel as a daily feed in Celsius, with some days missing."""
    frame = ft.add_wind_features(ft.add_relative_humidity(demo.weather_panel(spark, sf)))
    return frame.filter("(k * 13 + d) % 211 <> 0").select(
        "cell_id",
        F.date_format("date", "yyyy-MM-dd").alias("time"),
        (F.col("t2m") - K.KELVIN_OFFSET).alias("temperature_2m_mean"),
        F.col("relative_humidity").alias("relative_humidity_2m_mean"),
        F.col("precip_mm").alias("precipitation_sum"),
        F.col("swvl1").alias("soil_moisture_0_to_7cm_mean"),
        F.col("wind_speed").alias("wind_speed_10m_mean"),
    )


rel.relation("feed", "SELECT * FROM humid WHERE (k * 13 + d) % 211 <> 0", "humid")


@query(
    "src_10",
    f"SELECT cell_id, date, {r('t2m', 't2m')}, {r('relative_humidity', 'relative_humidity')}, {r('precip_mm', 'precip_mm')}, {r('swvl1', 'swvl1')}, {r('wind_speed', 'wind_speed')} FROM feed WHERE date BETWEEN date '1998-07-15' - 45 AND date '1998-07-15'",
    ("feed",),
)
def src_10(spark, sf):
    return rounded(rd.recent_weather(raw_feed(spark, sf), "1998-07-15"))


# --- datasets -----------------------------------------------------------------------

_FEATURES = ("relative_humidity", "wind_speed", "wind_dir_sin", "wind_dir_cos", "precip_7d", "precip_30d", "t2m_mean_7d", "t2m_trend_7d", "rh_mean_7d")
_COUNTS = ("neighbor_fire_count_1d", "neighbor_fire_count_3d", "neighbor_fire_count_7d")


@query(
    "pipe_1",
    f"SELECT cell_id, date, days_since_rain::int AS days_since_rain, {', '.join(r(c, c, 4) for c in _FEATURES)}, {', '.join(_COUNTS)} FROM features",
    ("features",),
)
def pipe_1(spark, sf):
    return rounded(demo.features(spark, sf).select("cell_id", "date", "days_since_rain", *_FEATURES, *_COUNTS), 4)


def land_daily(spark, sf) -> DataFrame:
    """Daily weather at one point per nation; rain from its suppliers' items."""
    n = F.col("s_nationkey")
    points = demo.table(spark, sf, "supplier").select("s_nationkey").distinct()
    shipped = (
        demo.table(spark, sf, "lineitem")
        .join(demo.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", F.to_date("l_shipdate").alias("date"))
        .agg((F.sum("l_quantity") / 20.0).alias("shipped"))
    )
    days = points.join(F.broadcast(demo.calendar(spark, sf))).select("s_nationkey", F.explode(F.sequence("lo", "hi")).alias("date"))
    d, doy = demo.day_number(), F.dayofyear("date")
    return days.join(shipped, ["s_nationkey", "date"], "left").select(
        (F.lit(50.0) + F.floor(n / 5) * 0.1).alias("latitude"),
        (F.lit(-121.0) + n % 5 * 0.15).alias("longitude"),
        "date",
        (F.lit(263.15) + (n * 7 + doy * 3) % 350 / 10.0).alias("t2m"),
        (F.lit(262.1) + (n * 7 + doy * 3) % 350 / 10.0 - (n * 5 + d) % 200 / 10.0).alias("d2m"),
        ((n + d * 3) % 21 / 2.0 - 5).alias("u10"),
        ((n * 3 + d) % 17 / 2.0 - 4).alias("v10"),
        ((n * 13 + d) % 100 / 250.0).alias("swvl1"),
        F.coalesce("shipped", F.lit(0.0)).alias("precip_mm"),
    )


def convective_daily(spark, sf) -> DataFrame:
    """The coarser source: one point per five nations."""
    land = land_daily(spark, sf)
    return land.groupBy("latitude", F.lit(-120.7).alias("longitude"), "date").agg(
        F.max(F.round(F.col("t2m") * 4)).alias("cape"), F.sum("precip_mm").alias("convective_precip_mm")
    )


rel.relation(
    "land_daily",
    """SELECT 5e1 + (n // 5) * 1e-1 AS latitude, -121e0 + (n % 5) * 15e-2 AS longitude, date, 26315e-2 + ((n * 7 + dayofyear(date) * 3) % 350) / 1e1 AS t2m,
       2621e-1 + ((n * 7 + dayofyear(date) * 3) % 350) / 1e1 - ((n * 5 + d) % 200) / 1e1 AS d2m, ((n + d * 3) % 21) / 2e0 - 5 AS u10, ((n * 3 + d) % 17) / 2e0 - 4 AS v10,
       ((n * 13 + d) % 100) / 25e1 AS swvl1, coalesce(shipped, 0e0) AS precip_mm
       FROM (SELECT n, date, date - date '1995-01-01' AS d FROM (SELECT n, unnest(generate_series(lo::timestamp, hi::timestamp, INTERVAL 1 DAY))::date AS date
         FROM (SELECT DISTINCT s_nationkey AS n FROM supplier), calendar)) x
       LEFT JOIN (SELECT s_nationkey AS n, l_shipdate::date AS date, sum(l_quantity) / 2e1 AS shipped FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) s USING (n, date)""",
    "calendar",
)
rel.relation(
    "conv_daily",
    "SELECT latitude, date, max(round(t2m * 4)) AS cape, sum(precip_mm) AS convective_precip_mm FROM land_daily GROUP BY ALL",
    "land_daily",
)


def _nearest_of(points: str) -> str:
    return f"""SELECT cell_id, lat, lon FROM (SELECT c.cell_id, p.latitude AS lat, p.longitude AS lon, row_number() OVER (PARTITION BY c.cell_id
      ORDER BY (c.latitude - p.latitude) * (c.latitude - p.latitude) + (c.longitude - p.longitude) * (c.longitude - p.longitude), p.latitude DESC, p.longitude) AS rn
      FROM cells c, (SELECT DISTINCT latitude, longitude FROM {points}) p) WHERE rn = 1"""


rel.relation("land_near", _nearest_of("land_daily"), "cells", "land_daily")
rel.relation("conv_near", _nearest_of("(SELECT latitude, -1207e-1 AS longitude FROM conv_daily)"), "cells", "conv_daily")
rel.relation(
    "weather_2",
    """SELECT p.*, l.t2m, l.d2m, l.u10, l.v10, l.swvl1, l.precip_mm, c.cape, c.convective_precip_mm FROM panel p
       JOIN land_near n USING (cell_id) JOIN land_daily l ON l.latitude = n.lat AND l.longitude = n.lon AND l.date = p.date
       JOIN conv_near m USING (cell_id) JOIN conv_daily c ON c.latitude = m.lat AND c.date = p.date""",
    "panel",
    "land_near",
    "conv_near",
)


def _second(name: str, *renames: tuple[str, str]) -> None:
    """A relation over the joined weather instead of the panel's own."""
    reads, sql = RELATIONS[name]
    for old, new in renames:
        sql = sql.replace(f"FROM {old}", f"FROM {new}")
        reads = tuple(new if x == old else x for x in reads)
    RELATIONS[f"{name}_2"] = (reads, sql)


_second("humid", ("weather", "weather_2"))
_second("timed", ("humid", "humid_2"))
_second("code_input", ("humid", "humid_2"))
RELATIONS["code_input_2"] = (RELATIONS["code_input_2"][0], RELATIONS["code_input_2"][1].replace("(-45 + (k % 10) * 11)::double AS lat", "latitude AS lat"))
_second("seasons", ("code_input", "code_input_2"))
_CODES_2 = _codes_body().replace("FROM code_input", "FROM code_input_2")
_PIPE_WEATHER = ("t2m", "swvl1", "precip_mm", "cape", "convective_precip_mm")

query_reads = ("timed_2", "neighbors", "seasons_2", "code_input_2", "elevations", "fuel")


def _pipe_2_sql() -> str:
    from riskgrid.plans.q_panel import _FORWARD, _FORWARD_W

    columns = ", ".join(r(f"t.{c}", c, 4) for c in (*_PIPE_WEATHER, *_FEATURES))
    needed = ["t.days_since_rain", "t.precip_30d", "t.t2m_trend_7d", "n.neighbor_fire_count_7d", *[f"c.{x}" for x in K.CODE_COLUMNS]]
    return f"""SELECT t.cell_id, t.date, t.ignited, f.ignited_next_3d, t.days_since_rain::int AS days_since_rain, {columns}, n.neighbor_fire_count_1d, n.neighbor_fire_count_3d, n.neighbor_fire_count_7d,
      {', '.join('c.' + x for x in K.CODE_COLUMNS)}, e.elevation_m, u.fuel_type_cd AS fuel
      FROM timed_2 t JOIN neighbors n USING (cell_id, date) JOIN ({_CODES_2}) c USING (cell_id, date)
      JOIN (SELECT cell_id, date, {_FORWARD} AS ignited_next_3d FROM panel {_FORWARD_W}) f USING (cell_id, date)
      JOIN elevations e USING (cell_id) JOIN fuel u USING (cell_id) WHERE {' AND '.join(f'{x} IS NOT NULL' for x in needed)}"""


def full_dataset(spark, sf, complete_only: bool = True) -> DataFrame:
    first, last = demo.calendar(spark, sf).first()
    return build_dataset(
        demo.detections(spark, sf),
        demo.cells(spark, sf).select("cell_id", "latitude", "longitude"),
        land_daily(spark, sf),
        convective_daily(spark, sf),
        demo.elevations(spark, sf),
        demo.fuel(spark, sf),
        str(first),
        str(last),
        complete_only=complete_only,
    )


@query("pipe_2", _pipe_2_sql(), query_reads, recursive=_fold_sql().replace("seasons", "seasons_2"))
def pipe_2(spark, sf):
    out = full_dataset(spark, sf)
    hot = [c for c in out.columns if c.startswith("fuel_type_")]
    name = F.coalesce(*[F.when(F.col(f"`{c}`") == 1.0, F.lit(c.removeprefix("fuel_type_"))) for c in hot])
    return rounded(
        out.select(
            "cell_id", "date", "ignited", "ignited_next_3d", "days_since_rain", *_PIPE_WEATHER, *_FEATURES, *_COUNTS, *K.CODE_COLUMNS, "elevation_m", name.alias("fuel")
        ),
        4,
    )


# --- learning -----------------------------------------------------------------------

INPUTS = [*K.WEATHER_FEATURES, *K.NEIGHBOR_FEATURES]
SMALL_FOREST = {"n_estimators": 12, "max_depth": 5, "max_features": 0.6063110478838847, "min_samples_leaf": 7}


def model_frame(spark, sf) -> DataFrame:
    """Complete rows of the season and its lookback with labels and inputs, written once per session.

    Every fit, score and explanation is of season rows, and a history begins in
    the lookback before them, so no other rows are written.  A file has one
    year: by its first and last date it is skipped by those who ask for others.
    """

    def build():
        return (
            demo.features(spark, sf, ahead=3)
            .transform(lb.season_rows, start=K.LOOKBACK_SEASON_START)
            .withColumns({"row_key": F.col("k") * 100000 + F.col("d"), "_year": F.year("date")})
            .select("row_key", "cell_id", "date", "ignited", "ignited_next_3d", *INPUTS, "_year")
            .na.drop(subset=INPUTS)
        )

    return demo.stored(spark, sf, "model-frame", build, by=("_year",)).drop("_year")


def split_frames(spark, sf):
    return lb.temporal_split(lb.season_rows(model_frame(spark, sf)), demo.TRAIN_END, demo.VAL_END)


def _fit_small(train, features=INPUTS, label="ignited", **params):
    return models.fit_forest(train, features, label, **{**SMALL_FOREST, **params})


@lru_cache(maxsize=8)
def _small_bundle(application: str, sf: str) -> str:
    """A calibrated forest, stored once per session."""
    spark = SparkSession.active()
    train, val, _ = split_frames(spark, sf)
    model = _fit_small(train)
    curve = fit_isotonic(models.predict(model, val), "ignited", "score")
    path = scratch_path(spark, "bundle")
    save_bundle(Bundle(model, INPUTS, {"estimator": "forest", "settings": SMALL_FOREST}, curve), path)
    return path


def small_bundle(spark, sf) -> Bundle:
    return load_bundle(spark, _small_bundle(spark.sparkContext.applicationId, sf))


def _card(spark, name, model, df, label="ignited"):
    found = models.evaluate(model, df, label)
    rows = [(name, found["pr_auc"], found["roc_auc"], found["top_10pct_capture"])]
    return spark.createDataFrame(rows, "model string, pr_auc double, roc_auc double, top_10pct_capture double")


rel.relation(
    "model_rows",
    f"""SELECT k * 100000 + d AS row_key, cell_id, date, year(date)::int AS year, ignited, neighbor_fire_count_7d AS near FROM features
        WHERE {' AND '.join(f'{c} IS NOT NULL' for c in INPUTS)} AND strftime(date, '%m-%d') BETWEEN '{K.SEASON_START}' AND '{K.SEASON_END}'""",
    "features",
)
_TRAIN, _VAL, _TEST = (
    f"date < date '{demo.TRAIN_END}'",
    f"date >= date '{demo.TRAIN_END}' AND date < date '{demo.VAL_END}'",
    f"date >= date '{demo.VAL_END}'",
)


@query(
    "ml_1",
    f"""SELECT row_key, ignited, (('0x' || substr(md5('0:' || row_key), 1, 8))::BIGINT / 4294967296 < (SELECT avg(ignited) FROM model_rows WHERE {_TRAIN}))::int::double AS score
        FROM model_rows WHERE {_VAL}""",
    ("model_rows",),
)
def ml_1(spark, sf):
    train, val, _ = split_frames(spark, sf)
    return models.fit_dummy(train).predict(val).select("row_key", "ignited", "score")


@query("ml_2")
def ml_2(spark, sf):
    train, val, _ = split_frames(spark, sf)
    return _card(spark, "logistic", models.fit_logistic(train, INPUTS, max_iter=100), val)


@query("ml_3")
def ml_3(spark, sf):
    train, val, _ = split_frames(spark, sf)
    return _card(spark, "forest", _fit_small(train), val)


# One split on one count: SQL can search all of them. Classes weigh alike, so the best split is the one with the least
# weighted impurity 2 p (1 - p); of equals the lowest cut, which lies halfway between two counts.
STUMP = {"n_estimators": 1, "max_depth": 1, "max_features": 1.0, "min_samples_leaf": 1, "bootstrap": False}
NEAR = "neighbor_fire_count_7d"


def _stump_sql(fold: str, where: str, reads: str) -> str:
    """(fold, cut, low, high): the stump of each fold of `reads`, trained where `where` holds."""
    return f"""SELECT fold, arg_min(cut, (round(impurity, 12), cut)) AS cut, arg_min(low, (round(impurity, 12), cut)) AS low, arg_min(high, (round(impurity, 12), cut)) AS high FROM (
       SELECT *, lw * 2 * low * (1 - low) + (2 - lw) * 2 * high * (1 - high) AS impurity FROM (
         SELECT fold, cut, pl / p + nl / n AS lw, pl / p / (pl / p + nl / n) AS low, (1 - pl / p) / (2 - pl / p - nl / n) AS high FROM (
           SELECT fold, (near + after) / 2 AS cut, sum(pos) OVER up AS pl, sum(neg) OVER up AS nl, sum(pos) OVER (PARTITION BY fold) AS p, sum(neg) OVER (PARTITION BY fold) AS n FROM (
             SELECT *, lead(near) OVER (PARTITION BY fold ORDER BY near) AS after FROM (
               SELECT {fold} AS fold, near, sum(ignited)::double AS pos, sum(1 - ignited)::double AS neg FROM {reads} WHERE {where} GROUP BY ALL))
           WINDOW up AS (PARTITION BY fold ORDER BY near)) WHERE cut IS NOT NULL)) GROUP BY fold"""


rel.relation("stump", _stump_sql("0", _TRAIN, "model_rows"), "model_rows")
rel.relation("year_stumps", _stump_sql("y", "year < y", f"model_rows, (SELECT unnest({list(demo.YEARS)}) AS y)"), "model_rows")
_STUMP_SCORE = "CASE WHEN near <= cut THEN low ELSE high END"


def _stump(spark, sf) -> DataFrame:
    train, _, _ = split_frames(spark, sf)
    return models.fit_forest(train, [NEAR], "ignited", **STUMP)


@query("ml_3_stump", f"SELECT row_key, {r(_STUMP_SCORE, 'score')} FROM model_rows, stump WHERE {_VAL}", ("model_rows", "stump"))
def ml_3_stump(spark, sf):
    _, val, _ = split_frames(spark, sf)
    return rounded(models.predict(_stump(spark, sf), val).select("row_key", "score"))


@query(
    "bt_2_stump",
    f"""SELECT year, count(*) AS rows, sum(ignited)::bigint AS positives, {r(f'avg({_STUMP_SCORE})', 'mean_score')} FROM model_rows JOIN year_stumps ON fold = year GROUP BY year""",
    ("model_rows", "year_stumps"),
)
def bt_2_stump(spark, sf):
    folds = export.run_backtest(lb.season_rows(model_frame(spark, sf)), demo.YEARS, models.fit_forest, STUMP, [NEAR])
    return rounded(folds.groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives"), F.avg("score").alias("mean_score")))


# The curve of a score with two values: the two rates, or one where they fall.
rel.relation("val_rates", f"SELECT {_STUMP_SCORE} AS score, avg(ignited) AS rate FROM model_rows, stump WHERE {_VAL} GROUP BY 1", "model_rows", "stump")


@query(
    "ml_8_stump",
    f"""SELECT row_key, {r('t.score', 'score')}, {r(f"CASE WHEN (SELECT arg_max(rate, score) >= arg_min(rate, score) FROM val_rates) THEN v.rate ELSE (SELECT avg(ignited) FROM model_rows WHERE {_VAL}) END", 'calibrated')}
        FROM (SELECT row_key, {_STUMP_SCORE} AS score FROM model_rows, stump WHERE {_TEST}) t JOIN val_rates v ON v.score = t.score""",
    ("model_rows", "stump", "val_rates"),
)
def ml_8_stump(spark, sf):
    _, val, test = split_frames(spark, sf)
    model = _stump(spark, sf)
    bundle = Bundle(model, [NEAR], {}, fit_isotonic(models.predict(model, val), "ignited", "score"))
    return rounded(bundle.score(test).select("row_key", "score", "calibrated"))


@query("ml_12_stump", f"SELECT '{NEAR}' AS feature, 1e0 AS importance", ())
def ml_12_stump(spark, sf):
    return importance.impurity_importance(_stump(spark, sf))


# With one input, a row's part is its score less the mean score of the background.
@query(
    "xai_1_stump",
    f"""SELECT row_key, '{NEAR}' AS feature, near::double AS value, {r('s - base', 'contribution')}, {r('base', 'base')}
        FROM (SELECT row_key, near, {_STUMP_SCORE} AS s FROM model_rows, stump WHERE {_TEST}),
             (SELECT avg({_STUMP_SCORE}) AS base FROM model_rows, stump WHERE {_TRAIN})""",
    ("model_rows", "stump"),
)
def xai_1_stump(spark, sf):
    """Every row of the test years, against all training rows as background."""
    train, _, test = split_frames(spark, sf)
    return rounded(xai.attributions(_stump(spark, sf), test, train))


@query(
    "xai_2_stump",
    f"""SELECT '{NEAR}' AS feature, {r('avg(abs(s - base))', 'mean_abs')}
        FROM (SELECT {_STUMP_SCORE} AS s FROM model_rows, stump WHERE {_TEST}), (SELECT avg({_STUMP_SCORE}) AS base FROM model_rows, stump WHERE {_TRAIN})""",
    ("model_rows", "stump"),
)
def xai_2_stump(spark, sf):
    train, _, test = split_frames(spark, sf)
    return rounded(xai.mean_abs(xai.attributions(_stump(spark, sf), test, train)))


def served_frame(spark, sf) -> DataFrame:
    """The model rows with all served inputs: each cell has one of the listed fuels, or none of them, by its id."""
    codes = [n.removeprefix("fuel_type_") for n in K.FUEL_FEATURES]
    at = F.col("k") % (len(codes) + 1)
    fuel = demo.cells(spark, sf).select("cell_id", F.get(F.array(*[F.lit(c) for c in codes]), at.cast("int")).alias("fuel_type_cd"))
    return attach_static(model_frame(spark, sf), one_hot_fixed(fuel).drop("fuel_type_cd"))


@query("ml_3_served")
def ml_3_served(spark, sf):
    """A forest on all 32 served inputs under their own names, scored on the validation year."""
    train, val, _ = lb.temporal_split(lb.season_rows(served_frame(spark, sf)), demo.TRAIN_END, demo.VAL_END)
    return _card(spark, "forest", models.fit_forest(train, K.SERVED_FEATURES, **SMALL_FOREST), val)


@query("ml_4")
def ml_4(spark, sf):
    train, val, _ = split_frames(spark, sf)
    return _card(spark, "boosted", models.fit_boosted(train, INPUTS, n_estimators=5, max_depth=4, subsample=0.8, colsample_bytree=0.8), val)


@query("ml_5")
def ml_5(spark, sf):
    train, val, _ = split_frames(spark, sf)
    _, best, results = search.grid_search(_fit_small, {"n_estimators": [4, 8], "max_depth": [3, 5]}, train, val)
    rows = [(str(f["params"]), f["params"] == best, f["pr_auc"], f["roc_auc"], f["top_10pct_capture"]) for f in results]
    return spark.createDataFrame(rows, "params string, chosen boolean, pr_auc double, roc_auc double, top_10pct_capture double")


@query("ml_6")
def ml_6(spark, sf):
    train, val, _ = split_frames(spark, sf)
    space = {"n_estimators": ("int", 3, 8), "max_depth": ("int", 3, 6), "learning_rate": ("loguniform", 0.05, 0.3)}

    def fit(train, label="ignited", **params):
        return models.fit_boosted(train, INPUTS, label, **params)

    _, best, results = search.random_search(fit, space, train, val)
    rows = [(str(f["params"]), f["params"] == best, f["pr_auc"]) for f in results]
    return spark.createDataFrame(rows, "params string, chosen boolean, pr_auc double")


@query("ml_7")
def ml_7(spark, sf):
    train, val, test = split_frames(spark, sf)
    candidates = search.expand_grid({"n_estimators": [4], "max_depth": [3, 5]})
    return search.tune_and_report(spark, _fit_small, candidates, train, val, test)


@query("ml_8")
def ml_8(spark, sf):
    _, _, test = split_frames(spark, sf)
    return small_bundle(spark, sf).score(test).select("row_key", "score", "calibrated")


@query("ml_9", f"SELECT count(*) AS rows, 0e0 AS largest_difference FROM model_rows WHERE {_TEST}", ("model_rows",))
def ml_9(spark, sf):
    """Scores of a bundle before saving and after loading."""
    _, _, test = split_frames(spark, sf)
    first = small_bundle(spark, sf)
    path = scratch_path(spark, "bundle")
    save_bundle(first, path)
    again = load_bundle(spark, path)
    both = first.score(test).select("row_key", F.col("score").alias("a")).join(again.score(test).select("row_key", F.col("score").alias("b")), "row_key")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("a") - F.col("b"))).alias("largest_difference"))


def _metadata_row(spark, bundle: Bundle):
    m = bundle.metadata
    row = (m["estimator"], str(m["settings"]), m["scores"]["val"]["pr_auc"], m["scores"]["test"]["pr_auc"], bundle.calibrator is not None)
    return spark.createDataFrame([row], "estimator string, settings string, val_pr_auc double, test_pr_auc double, calibrated boolean")


@query("ml_10")
def ml_10(spark, sf):
    bundle = export.export_served_model(
        model_frame(spark, sf), scratch_path(spark, "served"), INPUTS, demo.YEARS, demo.TRAIN_END, demo.VAL_END, {**SMALL_FOREST, "n_estimators": 4}
    )
    return _metadata_row(spark, bundle)


@query("ml_11")
def ml_11(spark, sf):
    bundle = export.export_multi_day_model(
        model_frame(spark, sf), scratch_path(spark, "served"), "ignited_next_3d", INPUTS, demo.TRAIN_END, demo.VAL_END, {**SMALL_FOREST, "n_estimators": 4}
    )
    return _metadata_row(spark, bundle)


@query("ml_12")
def ml_12(spark, sf):
    return importance.impurity_importance(small_bundle(spark, sf).model)


@query("ml_13")
def ml_13(spark, sf):
    _, val, _ = split_frames(spark, sf)
    return importance.permutation_importance(small_bundle(spark, sf).model, val, INPUTS, repeats=2)


@query("ml_14")
def ml_14(spark, sf):
    train, _, test = split_frames(spark, sf)
    groups = {"rain": ["precip_7d", "precip_30d"], "neighbors": list(K.NEIGHBOR_FEATURES)}
    return search.ablation(spark, _fit_small, ["t2m", "relative_humidity"], groups, train, test, {"n_estimators": 4})


@query("ml_14_sweep")
def ml_14_sweep(spark, sf):
    train, val, test = split_frames(spark, sf)
    return search.parameter_sweep(spark, _fit_small, "max_features", [0.3, 0.9], train, val, test, n_estimators=4)


@query("ml_15")
def ml_15(spark, sf):
    """Raw histories against the forest on the same rows."""
    channels = ("t2m", "relative_humidity", "wind_speed", "precip_mm", "swvl1")
    margin = lb.season_rows(model_frame(spark, sf), start=K.LOOKBACK_SEASON_START)
    runs = ft.build_runs(margin, channels, 30)
    train, val, _ = lb.temporal_split(lb.season_rows(ft.cut_histories(runs, margin.columns, 30)), demo.TRAIN_END, demo.VAL_END)
    # The forest reads its rows several times: cut out of the runs once.
    train = materialize(train.select("ignited", *INPUTS), "rows-with-history")

    def learned(day):
        return season_filter(day, K.SEASON_START, K.SEASON_END) & (day < F.lit(demo.TRAIN_END).cast("date"))

    network = models.fit_runs(runs, learned, 30)
    # The scores are written first: the metrics read them several times, and the network should run once.
    on_histories = materialize(models.predict(network, models.flatten_sequences(val)).select("row_key", "ignited", "score"), "scored")
    from riskgrid.operators.metrics import score_card

    a = score_card(on_histories, "ignited").select(F.lit("sequences").alias("model"), "*")
    b = score_card(models.predict(_fit_small(train), val), "ignited").select(F.lit("forest").alias("model"), "*")
    return a.unionByName(b)


@query("bt_2")
def bt_2(spark, sf):
    folds = export.run_backtest(
        lb.season_rows(model_frame(spark, sf)), demo.YEARS, models.fit_forest, {**SMALL_FOREST, "n_estimators": 4}, INPUTS
    )
    return folds.groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives"), F.avg("score").alias("mean_score"))


def _explained(spark, sf) -> DataFrame:
    """Attributions of every row of the test years."""
    _, _, test = split_frames(spark, sf)
    bundle = small_bundle(spark, sf)
    background = xai.training_background(model_frame(spark, sf), demo.TRAIN_END)
    return xai.attributions(bundle.model, test, background)


@query("xai_1")
def xai_1(spark, sf):
    return _explained(spark, sf)


@query("xai_2")
def xai_2(spark, sf):
    return xai.mean_abs(_explained(spark, sf))


@query("xai_3")
def xai_3(spark, sf):
    return xai.conditional_mean_abs(_explained(spark, sf), "neighbor_fire_count_7d")


@query("top_2")
def top_2(spark, sf):
    return xai.top_contributions(_explained(spark, sf), 5)


_PARTS = "(SELECT row_key, f AS feature, ((row_key // 7 + i * 13) % 5)::double AS value, ((row_key * (i + 3) + i * 17) % 41 - 20) / 8e0 AS contribution FROM scores, (VALUES ('a', 0), ('b', 1), ('c', 2), ('d', 3)) t(f, i))"


def formula_parts(spark, sf) -> DataFrame:
    """A contribution by formula for each score row and four features."""
    features = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("i")) for i, f in enumerate("abcd")]))
    k, i = F.col("row_key"), F.col("i")
    rows = demo.scores(spark, sf).select("row_key", features)
    return rows.select("row_key", "feature", ((F.floor(k / 7) + i * 13) % 5).cast("double").alias("value"), ((k * (i + 3) + i * 17) % 41 - 20).cast("double").alias("c")).select(
        "row_key", "feature", "value", (F.col("c") / 8).alias("contribution")
    )


@query("xai_2_formula", f"SELECT feature, {r('avg(abs(contribution))', 'mean_abs')} FROM {_PARTS} GROUP BY feature", ("scores",))
def xai_2_formula(spark, sf):
    return rounded(xai.mean_abs(formula_parts(spark, sf)))


@query(
    "xai_3_formula",
    f"SELECT value > 0 AS nonzero, count(*) AS rows, {r('avg(abs(contribution))', 'mean_abs')} FROM {_PARTS} WHERE feature = 'b' GROUP BY ALL",
    ("scores",),
)
def xai_3_formula(spark, sf):
    return rounded(xai.conditional_mean_abs(formula_parts(spark, sf), "b"))


@query(
    "top_2_formula",
    f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY abs(contribution) DESC, feature)::int AS rank FROM {_PARTS}) WHERE rank <= 2",
    ("scores",),
)
def top_2_formula(spark, sf):
    return xai.top_contributions(formula_parts(spark, sf), 2)


@query("xai_4")
def xai_4(spark, sf):
    """The three example rows among all of the test years, with their contributions against all training rows."""
    train, _, test = split_frames(spark, sf)
    bundle = small_bundle(spark, sf)
    # Scores are written first: the cut-off and the examples read them several times, and the model should run once.
    scored = materialize(models.predict(bundle.model, test).select("row_key", "ignited", "score"), "scored")
    chosen = materialize(bt.extreme_examples(scored, xai.example_pool(scored), "ignited").na.drop(), "examples")
    parts = xai.attributions(bundle.model, test.join(F.broadcast(chosen.select("row_key").distinct()), "row_key", "left_semi"), train)
    return chosen.join(xai.top_contributions(parts, 6), "row_key")


# --- serving --------------------------------------------------------------------------

TODAY = "2001-01-15"


def asked_pairs(spark, sf) -> DataFrame:
    """Cell of each point, on the day after it."""
    from riskgrid.operators import grid

    located = grid.assign_cell_ids(demo.points(spark, sf))
    return located.select("cell_id", F.date_add("acq_date", 1).alias("date")).distinct()


@query(
    "win_8",
    "SELECT a.cell_id, a.date, "
    + ", ".join(f"count(DISTINCT (p.cell_id, p.acq_date)) FILTER (a.date - p.acq_date BETWEEN 1 AND {n})::double AS neighbor_fire_count_{n}d" for n in (1, 3, 7))
    + """ FROM (SELECT DISTINCT cell_id, acq_date + 1 AS date, split_part(cell_id, '_', 1)::int AS r, split_part(cell_id, '_', 2)::int AS c FROM points_in_cells) a
       LEFT JOIN (SELECT DISTINCT cell_id, acq_date, split_part(cell_id, '_', 1)::int AS r, split_part(cell_id, '_', 2)::int AS c FROM points_in_cells) p
         ON abs(a.r - p.r) <= 1 AND abs(a.c - p.c) <= 1 AND a.cell_id <> p.cell_id AND a.date - p.acq_date BETWEEN 1 AND 7 GROUP BY ALL""",
    ("points_in_cells",),
)
def win_8(spark, sf):
    return serve.live_neighbor_counts(asked_pairs(spark, sf), demo.points(spark, sf))


def live_requests(spark, sf) -> DataFrame:
    """Orders as requests; half as many cells again as there are suppliers."""
    k = F.floor(F.col("o_custkey") / 10)
    return demo.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.concat_ws("_", F.floor(k / 10).cast("int"), (k % 10).cast("int")).alias("cell_id"),
        F.when(F.col("o_orderkey") % 1000 != 7, F.to_date("o_orderdate")).alias("date"),
    )


def live_feed(spark, sf) -> DataFrame:
    return rd.rename_feed(raw_feed(spark, sf))


rel.relation(
    "requests",
    f"""SELECT o_orderkey AS request_id, (o_custkey // 100) || '_' || ((o_custkey // 10) % 10) AS cell_id,
       CASE WHEN o_orderkey % 1000 <> 7 THEN o_orderdate::date ELSE date '{TODAY}' END AS date FROM orders""",
)
_LIVE_W = "WINDOW w AS (PARTITION BY cell_id, target ORDER BY date)"


def _frame_sql(column: str, n: int, how: str) -> str:
    w = f"(PARTITION BY cell_id, target ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) OVER {w} = {n} THEN {how}({column}) OVER {w} END"


rel.relation(
    "live_rows",
    f"""SELECT * EXCLUDE (date), target AS date FROM (
       SELECT *, pos - last_value(CASE WHEN precip_mm >= 1 THEN pos END IGNORE NULLS) OVER (PARTITION BY cell_id, target ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS days_since_rain FROM (
       SELECT a.cell_id, a.date AS target, f.date, f.t2m, f.relative_humidity, f.precip_mm, f.swvl1, f.wind_speed, row_number() OVER (PARTITION BY a.cell_id, a.date ORDER BY f.date) AS pos
       FROM (SELECT DISTINCT cell_id, date FROM requests) a JOIN feed f ON f.cell_id = a.cell_id AND f.date BETWEEN a.date - 45 AND a.date))
       WHERE true""",
    "requests",
    "feed",
)
rel.relation(
    "live_derived",
    f"""SELECT * FROM (SELECT cell_id, target, date, t2m, days_since_rain, {_frame_sql('precip_mm', 7, 'sum')} AS precip_7d, {_frame_sql('precip_mm', 30, 'sum')} AS precip_30d,
       {_frame_sql('t2m', 7, 'avg')} AS t2m_mean_7d, t2m - lag(t2m, 7) OVER (PARTITION BY cell_id, target ORDER BY date) AS t2m_trend_7d, {_frame_sql('relative_humidity', 7, 'avg')} AS rh_mean_7d, precip_mm
       FROM live_history) WHERE date = target""",
    "live_history",
)
RELATIONS["live_history"] = (
    RELATIONS["live_rows"][0],
    RELATIONS["live_rows"][1].replace("SELECT * EXCLUDE (date), target AS date FROM (", "", 1).rsplit(")\n       WHERE true", 1)[0],
)
del RELATIONS["live_rows"]
_MISSING = "list_filter([" + ", ".join(f"CASE WHEN w.{c} IS NULL THEN '{c}' END" for c in ("precip_mm", "days_since_rain", "precip_7d", "precip_30d", "t2m_mean_7d", "t2m_trend_7d", "rh_mean_7d")) + "], lambda x: x IS NOT NULL)"


@query(
    "win_9",
    f"""SELECT a.cell_id, a.date, CASE WHEN w.cell_id IS NULL THEN 'no_row' WHEN len({_MISSING}) > 0 THEN 'insufficient_history' ELSE 'ok' END AS weather_status,
       CASE WHEN w.cell_id IS NOT NULL THEN array_to_string({_MISSING}, ',') END AS missing, w.days_since_rain::int AS days_since_rain,
       {r('w.precip_30d', 'precip_30d', 4)}, {r('w.t2m_trend_7d', 't2m_trend_7d', 4)}, {r('w.rh_mean_7d', 'rh_mean_7d', 4)}
       FROM (SELECT DISTINCT cell_id, date FROM requests) a LEFT JOIN live_derived w ON w.cell_id = a.cell_id AND w.date = a.date""",
    ("requests", "live_derived"),
)
def win_9(spark, sf):
    asked = live_requests(spark, sf).withColumn("date", F.coalesce("date", F.lit(TODAY).cast("date"))).select("cell_id", "date").distinct()
    out = serve.live_feature_rows(asked, live_feed(spark, sf))
    return rounded(
        out.select("cell_id", "date", "weather_status", F.array_join("missing", ",").alias("missing"), "days_since_rain", "precip_30d", "t2m_trend_7d", "rh_mean_7d"), 4
    )


def answered_requests(spark, sf) -> DataFrame:
    return serve.request_features(
        live_requests(spark, sf), TODAY, demo.cells(spark, sf), live_feed(spark, sf), demo.detections(spark, sf), demo.fuel(spark, sf), ("fuel_type_LARGE", "fuel_type_S-2")
    )


_ANSWERED = (
    f"""SELECT q.request_id, q.cell_id, q.date, status, {r('CASE WHEN early IS NULL THEN w.precip_30d END', 'precip_30d', 4)},
       CASE WHEN early IS NULL THEN (SELECT count(*) FROM (SELECT DISTINCT cell_id, acq_date FROM detections) d JOIN cells dc ON dc.cell_id = d.cell_id
         WHERE abs(dc.row - q.row) <= 1 AND abs(dc.col - q.col) <= 1 AND dc.cell_id <> q.cell_id AND q.date - d.acq_date BETWEEN 1 AND 7) END::double AS neighbor_fire_count_7d,
       CASE WHEN early IS NULL THEN (f.fuel_type_cd = 'LARGE')::int END::double AS fuel_large
       FROM (SELECT r.*, c.row, c.col, CASE WHEN c.cell_id IS NULL THEN 'unknown_cell' WHEN r.date > date '{TODAY}' THEN 'future_date'
          WHEN strftime(r.date, '%m-%d') NOT BETWEEN '05-01' AND '10-15' THEN 'off_season' END AS early FROM requests r LEFT JOIN cells c USING (cell_id)) q
       LEFT JOIN (SELECT w.*, CASE WHEN len({_MISSING}) > 0 THEN 'insufficient_history' ELSE 'ok' END AS ws FROM live_derived w) w ON w.cell_id = q.cell_id AND w.date = q.date
       LEFT JOIN fuel f ON f.cell_id = q.cell_id, LATERAL (SELECT coalesce(early, w.ws, 'no_row') AS status)"""
)
rel.relation("answered", _ANSWERED, "requests", "live_derived", "cells", "detections", "fuel")


@query("srv_2", "SELECT * FROM answered", ("answered",))
def srv_2(spark, sf):
    out = answered_requests(spark, sf)
    return rounded(
        out.select("request_id", "cell_id", "date", "status", "precip_30d", "neighbor_fire_count_7d", F.col("`fuel_type_LARGE`").alias("fuel_large")), 4
    )


@query("srv_2_scores")
def srv_2_scores(spark, sf):
    return serve.score_requests(answered_requests(spark, sf), small_bundle(spark, sf))


@query("srv_3")
def srv_3(spark, sf):
    train, _, _ = split_frames(spark, sf)
    several = Bundle(_fit_small(lb.drop_unlabelled(train, "ignited_next_3d"), label="ignited_next_3d", n_estimators=4), INPUTS)
    return serve.score_requests(answered_requests(spark, sf), several, window_days=K.MULTI_DAY_WINDOW)


@query(
    "srv_3_stump",
    f"""SELECT request_id, a.cell_id, date, {r('latitude', 'latitude')}, {r('longitude', 'longitude')}, status, {r(f"CASE WHEN status = 'ok' THEN CASE WHEN neighbor_fire_count_7d <= cut THEN low ELSE high END END", 'ignition_probability')}, 3 AS window_days
        FROM answered a LEFT JOIN cells c ON c.cell_id = a.cell_id, stump""",
    ("answered", "cells", "stump"),
)
def srv_3_stump(spark, sf):
    return rounded(serve.score_requests(answered_requests(spark, sf), Bundle(_stump(spark, sf), [NEAR], {}), window_days=3))


@query(
    "srv_4_stump",
    f"""SELECT request_id, '{NEAR}' AS feature, near AS value, {r('s - base', 'contribution')}, {r('base', 'base')}, 1 AS rank
        FROM (SELECT request_id, neighbor_fire_count_7d AS near, CASE WHEN neighbor_fire_count_7d <= cut THEN low ELSE high END AS s FROM answered, stump WHERE status = 'ok'),
             (SELECT avg({_STUMP_SCORE}) AS base FROM model_rows, stump WHERE {_TRAIN})""",
    ("answered", "model_rows", "stump"),
)
def srv_4_stump(spark, sf):
    train, _, _ = split_frames(spark, sf)
    return rounded(serve.explain_requests(answered_requests(spark, sf), Bundle(_stump(spark, sf), [NEAR], {}), train, 1))


@query("srv_4")
def srv_4(spark, sf):
    background = xai.training_background(model_frame(spark, sf), demo.TRAIN_END)
    return serve.explain_requests(answered_requests(spark, sf), small_bundle(spark, sf), background, 6)


@query("srv_1")
def srv_1(spark, sf):
    """Risk of every cell on the dates of the urgent orders."""
    dates = demo.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.date_add(F.to_date("o_orderdate"), 200).alias("date"))
    return serve.risk_map(dates, model_frame(spark, sf), demo.cells(spark, sf), small_bundle(spark, sf))


rel.relation(
    "asked_dates",
    f"""SELECT DISTINCT (o_orderdate::date + 200) AS date, strftime(o_orderdate::date + 200, '%m-%d') BETWEEN '{K.SEASON_START}' AND '{K.SEASON_END}' AS season
        FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
rel.relation("shown_rows", f"SELECT date, cell_id, {_STUMP_SCORE} AS score, ignited FROM model_rows JOIN asked_dates USING (date), stump", "model_rows", "asked_dates", "stump")


@query(
    "srv_1_stump",
    f"""SELECT date, cell_id, {r('score', 'risk_probability')}, NULL::double AS calibrated_risk_probability, ignited::int AS actual_ignited, {r('latitude', 'latitude')}, {r('longitude', 'longitude')}, 'ok' AS status
        FROM shown_rows JOIN cells USING (cell_id)
        UNION ALL SELECT date, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN season THEN 'no_data' ELSE 'off_season' END FROM asked_dates WHERE date NOT IN (SELECT date FROM shown_rows)""",
    ("shown_rows", "cells"),
)
def srv_1_stump(spark, sf):
    dates = demo.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.date_add(F.to_date("o_orderdate"), 200).alias("date"))
    return rounded(serve.risk_map(dates, model_frame(spark, sf), demo.cells(spark, sf), Bundle(_stump(spark, sf), [NEAR], {})))


# --- streams ----------------------------------------------------------------------------

_EVENTS = "event_id bigint, ts timestamp_ntz, event_type string"
LANDED = 4  # files that a batch lands as


def point_stream(spark, path: str, glob: str = "events.parquet", files: int = 1) -> DataFrame:
    """The events file as a stream of detections."""
    e = spark.readStream.schema(_EVENTS).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(path)
    return e.select(
        "event_id",
        (F.lit(49.8) + F.col("event_id") % 1700 / 1000.0).alias("latitude"),
        (F.lit(-121.5) + F.col("event_id") % 2500 / 1000.0).alias("longitude"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def _run(stream: DataFrame, mode: str = "append") -> DataFrame:
    from riskgrid.streaming.detections import run_available

    spark = stream.sparkSession
    return run_available(stream, scratch_path(spark, "stream"), scratch_path(spark, "stream-state"), mode)


@query("str_1", "SELECT DISTINCT cell_id, acq_date AS day FROM points_in_cells", ("points_in_cells",))
def str_1(spark, sf):
    from riskgrid.streaming.detections import ignition_days

    return _run(ignition_days(point_stream(spark, sf))).select("cell_id", "day")


@query(
    "str_2",
    f"""SELECT (r + dr) || '_' || (c + dc) AS cell_id, acq_date + lag::int AS date, {', '.join(f'count(*) FILTER (lag <= {n})::double AS neighbor_fire_count_{n}d' for n in (1, 3, 7))}
       FROM (SELECT DISTINCT acq_date, split_part(cell_id, '_', 1)::int AS r, split_part(cell_id, '_', 2)::int AS c FROM points_in_cells),
         (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc), (SELECT unnest(range(1, 8)) AS lag) WHERE dr <> 0 OR dc <> 0
       GROUP BY 1, 2 HAVING max(acq_date + lag::int)::timestamp <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""",
    ("points_in_cells",),
)
def str_2(spark, sf):
    """Windows that the watermark has passed by the end of the stream."""
    from riskgrid.streaming.detections import sliding_neighbor_counts

    return _run(sliding_neighbor_counts(point_stream(spark, sf)))


@query(
    "str_3",
    f"""SELECT {POINT}, date, {r('t2m', 't2m')}, {r('cape', 'cape')}, {r('mm', 'convective_precip_mm')}, n AS readings FROM (
       SELECT latitude, longitude, valid_time::date AS date, avg(t2m) AS t2m, max(cape) AS cape, coalesce(sum(cp), 0) * 1000 AS mm, count(*) AS n FROM readings GROUP BY ALL)
       WHERE (date + 1)::timestamp <= (SELECT max(valid_time) FROM readings) - INTERVAL 1 DAY""",
    ("readings",),
)
def str_3(spark, sf):
    from riskgrid.streaming.detections import daily_weather

    schema = demo.table(spark, sf, "lineitem").schema
    items = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    return rounded(_run(daily_weather(demo.readings_of(items, demo.table(spark, sf, "supplier")))))


@query(
    "str_4",
    """SELECT cell_id, acq_date AS date, count(*) AS detections FROM points_in_cells JOIN events USING (event_id)
       WHERE ts >= timestamp '2024-01-20' OR event_id % 10 < 8
          OR (acq_date + 1)::timestamp > (SELECT max(ts) FROM events WHERE ts < timestamp '2024-01-20' AND event_id % 10 < 8 AND event_id % 2 = 0) - INTERVAL 2 DAY GROUP BY ALL""",
    ("points_in_cells",),
)
def str_4(spark, sf):
    """A fifth of the early events arrives late: those of the last days are
    still counted, older ones are dropped.

    A batch is held against the watermark that the batch before the last one
    set, which is why the events on time come in two batches.
    """
    from riskgrid.streaming.detections import daily_counts

    landing = scratch_path(spark, "landing")
    events = demo.table(spark, sf, "events").select("event_id", "ts", "event_type")
    early = F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")
    on_time = F.col("event_id") % 10 < 8
    even = F.col("event_id") % 2 == 0
    for part in (early & on_time & even, early & on_time & ~even, early & ~on_time, ~early):
        events.filter(part).repartition(LANDED).write.mode("append").parquet(landing)
    versions = _run(daily_counts(point_stream(spark, landing, "*.parquet", LANDED)), "update")
    last = versions.groupBy("cell_id", "date").agg(F.max_by("detections", "batch").alias("detections"))
    return last


_CODES_3 = ", ".join(r(f"f.{n}", n, 4) for n in ("ffmc", "dmc", "dc"))


@query(
    "str_5",
    f"SELECT i.cell_id, i.date, {_CODES_3} FROM code_input i LEFT JOIN folded f ON f.k = i.k AND f.date = i.date",
    ("seasons", "code_input"),
    recursive=_fold_sql(),
)
def str_5(spark, sf):
    """The daily codes with state per cell, fed in two halves."""
    from riskgrid.plans.q_reports import code_frame
    from riskgrid.streaming.codes import INPUT, stateful_codes

    landing = scratch_path(spark, "landing")
    frame = code_frame(spark, sf).select(
        "cell_id",
        "date",
        "latitude",
        (F.col("t2m") - K.KELVIN_OFFSET).alias("temp_c"),
        F.col("relative_humidity").alias("rh"),
        (F.col("wind_speed") * 3.6).alias("wind_kmh"),
        F.col("precip_mm").alias("rain"),
    )
    half, files = F.col("date") < "1998-06-01", [0]
    for part in (half, ~half):
        # As the cells are dealt out: a cell's half lies in one file, and nothing is exchanged for landing.
        frame.filter(part).select(*INPUT).write.mode("append").parquet(landing)
        files.append(len(spark.read.parquet(landing).inputFiles()))
    at_once = max(files[1], files[2] - files[1])
    stream = spark.readStream.schema(frame.select(*INPUT).schema).option("maxFilesPerTrigger", at_once).parquet(landing)
    return rounded(_run(stateful_codes(stream)), 4)
