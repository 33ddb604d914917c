"""Per-cell time features and neighbour counts.

All windows are partitioned by cell and ordered by date.  A panel holds one
row per cell and date, so a window group is never longer than the record has
days, whatever the number of detections.  The chain shares one partitioning
and one ordering, so it shuffles and sorts once.

A sliding window of N rows is added up anew for every row.  Where rows lie by
cell and date already (`arranged`), rain gaps and rolling values are taken from
them in that order instead, some thousand rows at a time; only their inputs go to Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.functions import constants as K
from riskgrid.functions import weather_math as wm
from riskgrid.functions.geo import moore_neighbor_ids
from riskgrid.operators.grid import explode_neighbors
from riskgrid.session import materialize


def _per_cell(cell_col: str, date_col: str):
    return Window.partitionBy(cell_col).orderBy(date_col)


def add_relative_humidity(df: DataFrame, t2m_col: str = "t2m", d2m_col: str = "d2m", out_col: str = "relative_humidity") -> DataFrame:
    return df.withColumn(out_col, wm.relative_humidity(F.col(t2m_col), F.col(d2m_col)))


def add_wind_features(df: DataFrame, u_col: str = "u10", v_col: str = "v10") -> DataFrame:
    """Speed, and direction as the two parts of a unit vector."""
    speed = F.col("wind_speed")
    return df.withColumn("wind_speed", wm.wind_speed(F.col(u_col), F.col(v_col))).withColumns(
        {
            "wind_dir_cos": wm.direction_part(F.col(u_col), speed),
            "wind_dir_sin": wm.direction_part(F.col(v_col), speed),
        }
    )


def add_row_position(df: DataFrame, out_col: str = "position", cell_col: str = "cell_id", date_col: str = "date") -> DataFrame:
    return df.withColumn(out_col, F.row_number().over(_per_cell(cell_col, date_col)) - 1)


def add_days_since_rain(
    df: DataFrame,
    precip_col: str = "precip_mm",
    threshold: float = K.RAIN_THRESHOLD_MM,
    out_col: str = "days_since_rain",
    cell_col: str = "cell_id",
    date_col: str = "date",
    arranged: bool = False,
) -> DataFrame:
    """Rows since the last wet row: 0 on it, NULL before the first.

    `arranged` says that rows lie in partitions by cell, sorted by cell and date."""
    if arranged:
        # A value depends on rows before it: nothing may be filtered below this step.
        since = F.arrow_udf(_since_in_order, "int").asNondeterministic()
        return df.withColumn(out_col, since(F.col(cell_col).cast("string"), F.coalesce(F.col(precip_col) >= threshold, F.lit(False))))
    w = _per_cell(cell_col, date_col)
    last_wet = F.last(F.when(F.col(precip_col) >= threshold, F.col("_pos")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)
    )
    return add_row_position(df, "_pos", cell_col, date_col).withColumn(out_col, F.col("_pos") - last_wet).drop("_pos")


def rolling(column: str, rows: int, how: str, cell_col: str = "cell_id", date_col: str = "date"):
    """Sum or mean over the last `rows` rows; NULL unless all have a value."""
    w = _per_cell(cell_col, date_col).rowsBetween(1 - rows, 0)
    aggregate = {"sum": F.sum, "mean": F.avg, "max": F.max}[how]
    return F.when(F.count(column).over(w) == rows, aggregate(column).over(w))


def _cell_starts(cell: pa.Array) -> np.ndarray:
    """Whether a row is the first of its cell; rows without an id are one cell."""
    new = np.ones(len(cell), dtype=bool)
    here, ahead = cell.slice(1), cell.slice(0, max(len(cell) - 1, 0))
    other = pc.coalesce(pc.not_equal(here, ahead), pc.xor(here.is_null(), ahead.is_null()))
    new[1:] = other.to_numpy(zero_copy_only=False)
    return new


def _since_in_order(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Rows since the last wet one of the cell, in the order in which the rows come."""
    held: tuple[pa.Array, int | None] | None = None  # the last row's cell, and its value
    for cell, wet in batches:
        if not len(cell):
            yield pa.array([], pa.int32())
            continue
        if held is not None:
            cell = pa.concat_arrays([held[0], cell])
        at = np.arange(len(cell))
        rain = np.zeros(len(cell), dtype=bool)
        rain[len(cell) - len(wet) :] = wet.to_numpy(zero_copy_only=False)
        last = np.where(rain, at, -len(cell) - 1)
        known = rain.copy()
        if held is not None and held[1] is not None:
            last[0], known[0] = -held[1], True
        first = np.maximum.accumulate(np.where(_cell_starts(cell), at, 0))
        # Of each row the nearest known one ahead, if it is of the same cell.
        near = np.maximum.accumulate(np.where(known, at, -1))
        found = near >= first
        since = np.where(found, at - last[np.maximum(near, 0)], 0)
        out = pa.array(since.astype(np.int32), mask=~found)
        held = (cell.slice(len(cell) - 1), out[-1].as_py())
        yield out.slice(len(cell) - len(wet))


def _roller(sums: dict[str, int]) -> Callable[[Iterator[tuple[pa.Array, ...]]], Iterator[pa.Array]]:
    """Rolling values in the order in which the rows come; of the rows before a batch, as many as a window reaches are held."""
    reach = max(7, *sums.values())

    def roll(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        held: tuple[pa.Array, ...] | None = None
        for batch in batches:
            arrays = batch if held is None else tuple(pa.concat_arrays(pair) for pair in zip(held, batch, strict=True))
            rows, own = len(arrays[0]), len(batch[0])
            held = tuple(a.slice(max(rows - reach, 0)) for a in arrays)
            column = np.cumsum(_cell_starts(arrays[0]))
            values = {name: pc.fill_null(a, 0.0).to_numpy(zero_copy_only=False) for name, a in zip(("precip", "t2m", "rh"), arrays[1:], strict=True)}
            nulls = {name: np.cumsum(np.concatenate([[0], a.is_null().to_numpy(zero_copy_only=False)])) for name, a in zip(values, arrays[1:], strict=True)}

            def total(name: str, n: int) -> tuple[np.ndarray, np.ndarray]:
                """Sum of the last n rows, oldest first, and where it is missing."""
                out, missing = np.zeros(rows), np.ones(rows, dtype=bool)
                if rows >= n:
                    for i in range(n):
                        out[n - 1 :] += values[name][i : rows - n + 1 + i]
                    missing[n - 1 :] = (column[n - 1 :] != column[: rows - n + 1]) | (nulls[name][n:] != nulls[name][: rows - n + 1])
                return out, missing

            found = [total("precip", n) for n in sums.values()]
            found += [(s / 7, missing) for s, missing in (total("t2m", 7), total("rh", 7))]
            trend, missing = np.zeros(rows), np.ones(rows, dtype=bool)
            if rows > 7:
                trend[7:] = values["t2m"][7:] - values["t2m"][:-7]
                gone = np.diff(nulls["t2m"]).astype(bool)
                missing[7:] = (column[7:] != column[:-7]) | gone[7:] | gone[:-7]
            found.append((trend, missing))
            names = [*sums, "t2m_mean_7d", "rh_mean_7d", "t2m_trend_7d"]
            yield pa.StructArray.from_arrays([pa.array(x[rows - own :], mask=m[rows - own :]) for x, m in found], names)

    return roll


def add_rolling_features(
    df: DataFrame,
    precip_col: str = "precip_mm",
    t2m_col: str = "t2m",
    rh_col: str = "relative_humidity",
    windows: tuple[int, ...] = K.ROLLING_WINDOWS,
    cell_col: str = "cell_id",
    date_col: str = "date",
    arranged: bool = False,
) -> DataFrame:
    """Rain sums over `windows`, 7-row means, and the change over 7 rows.

    `arranged` says that rows lie in partitions by cell, sorted by cell and date;
    the three inputs are taken as doubles then."""
    keys = (cell_col, date_col)
    if arranged:
        sums = {f"{precip_col.removesuffix('_mm')}_{n}d": n for n in windows}
        names = [*sums, "t2m_mean_7d", "rh_mean_7d", "t2m_trend_7d"]
        # A value depends on rows before it: nothing may be filtered below this step.
        roll = F.arrow_udf(_roller(sums), ", ".join(f"`{n}` double" for n in names)).asNondeterministic()
        rolled = roll(F.col(cell_col).cast("string"), *[F.col(c).cast("double") for c in (precip_col, t2m_col, rh_col)])
        kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
        return df.withColumn("_rolled", rolled).select(*kept, *[F.col("_rolled")[n].alias(n) for n in names])
    new = {f"{precip_col.removesuffix('_mm')}_{n}d": rolling(precip_col, n, "sum", *keys) for n in windows}
    new["t2m_mean_7d"] = rolling(t2m_col, 7, "mean", *keys)
    new["rh_mean_7d"] = rolling(rh_col, 7, "mean", *keys)
    new["t2m_trend_7d"] = F.col(t2m_col) - F.lag(t2m_col, 7).over(_per_cell(*keys))
    return df.withColumns(new)


def neighbor_counts(
    ignitions: DataFrame,
    windows: tuple[int, ...] = K.NEIGHBOR_WINDOWS,
    cell_col: str = "cell_id",
    date_col: str = "date",
) -> DataFrame:
    """Prior-day fire days among the eight neighbours, for cells that have any.

    Grown outward from the ignitions: each reaches eight cells on each of the
    following days, so the work follows the fires and not the panel.  A key
    receives at most 8 x max(windows) rows, however busy its neighbours are.
    """
    reach = (
        explode_neighbors(ignitions.select(cell_col, date_col).distinct(), cell_col, "_near")
        .withColumn("_lag", F.explode(F.sequence(F.lit(1), F.lit(max(windows)))))
        .select(
            F.col("_near").alias(cell_col), F.expr(f"date_add(`{date_col}`, _lag)").alias(date_col), "_lag"
        )
    )
    # Merge join: the planner does not see that the rows were multiplied, and
    # might broadcast a table it takes for small.
    return (
        reach.groupBy(cell_col, date_col)
        .agg(*[F.count(F.when(F.col("_lag") <= n, 1)).cast("double").alias(f"neighbor_fire_count_{n}d") for n in windows])
        .hint("merge")
    )


def add_neighbor_fire_features(
    df: DataFrame,
    windows: tuple[int, ...] = K.NEIGHBOR_WINDOWS,
    label_col: str = "ignited",
    cell_col: str = "cell_id",
    date_col: str = "date",
    ignitions: DataFrame | None = None,
    mark: bool = False,
    parts: int | None = None,
    beside: DataFrame | None = None,
) -> DataFrame:
    """Trailing neighbour counts on a dense panel; NULL on the first N dates.

    The ignitions are handed to their neighbours, counted per (cell, day), and
    put beside the panel rows of the same cell; a range window over the days
    before then adds them up.  That takes the exchange and the sort that the
    other per-cell windows need anyway, and no join.  `ignitions` (the panel's
    own positives) saves a pass over the panel where the caller has them; with
    `mark` they also set the panel's label, in the same way.  `beside` has one
    row per cell and day, whose other columns come in likewise, as by a left
    join.  Counts of N days are differences of totals from the cell's first row
    on, which take one step a row, however many days N is.  A panel that is dealt out by cell already, into `parts`, stays where
    it is if `beside` is dealt out like it.
    """
    fires = df.filter(F.col(label_col) == 1) if ignitions is None else ignitions
    fires = fires.select(cell_col, date_col).distinct()
    to = F.transform(moore_neighbor_ids(F.col(cell_col)), lambda c: F.struct(c.alias("_to"), F.lit(1).alias("_near"), F.lit(0).alias("_own")))
    if mark:
        to = F.concat(to, F.array(F.struct(F.col(cell_col).alias("_to"), F.lit(0).alias("_near"), F.lit(1).alias("_own"))))
    near = fires.select(date_col, F.inline(to)).withColumnRenamed("_to", cell_col)
    near = near if parts is None else near.repartition(parts, cell_col)
    near = near.groupBy(cell_col, date_col).agg(F.sum("_near").alias("_near"), F.max("_own").alias("_own")).withColumn("_panel", F.lit(False))
    panel = df.withColumns({"_near": F.lit(0).cast("long"), "_own": F.lit(0), "_panel": F.lit(True)})
    both = panel.unionByName(near, allowMissingColumns=True)
    values = [] if beside is None else [c for c in beside.columns if c not in (cell_col, date_col)]
    if values:
        both = both.unionByName(beside.withColumn("_panel", F.lit(False)), allowMissingColumns=True)
    w = _per_cell(cell_col, date_col)

    def days(what: str, first: str, last: str) -> str:
        return f"{what} OVER (PARTITION BY `{cell_col}` ORDER BY `{date_col}` RANGE BETWEEN {first} AND {last})"

    def until(n: int) -> str:
        return f"coalesce({days('sum(_near)', 'UNBOUNDED PRECEDING', f'{n} PRECEDING')}, 0)"

    first = F.min(F.when(F.col("_panel"), F.col(date_col))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    counted = both.withColumns(
        {
            "_first": first,
            **{f"_near_{n}": F.expr(f"cast({until(1)} - {until(n + 1)} AS double)") for n in windows},
            **({label_col: F.expr(days("max(_own)", "CURRENT ROW", "CURRENT ROW"))} if mark else {}),
            **{c: F.expr(days(f"max(`{c}`)", "CURRENT ROW", "CURRENT ROW")) for c in values},
        }
    ).filter("_panel")
    day = F.datediff(date_col, "_first")
    return counted.withColumns(
        {f"neighbor_fire_count_{n}d": F.when(day >= n, F.col(f"_near_{n}")) for n in windows}
    ).drop("_near", "_own", "_panel", "_first", *[f"_near_{n}" for n in windows])


def add_daily(
    df: DataFrame, daily: DataFrame, columns: tuple[str, ...], cell_col: str = "cell_id", date_col: str = "date"
) -> DataFrame:
    """Columns of `daily`, which has one row per cell and day, on the rows of that cell and day; else NULL.

    The same as a left join.  The values are put beside the rows of their cell
    and read by a window, so where both are dealt out by cell into like parts,
    nothing is exchanged.
    """
    values = daily.select(cell_col, date_col, *columns, F.lit(False).alias("_row"))
    both = df.withColumn("_row", F.lit(True)).unionByName(values, allowMissingColumns=True)
    day = f"OVER (PARTITION BY `{cell_col}` ORDER BY `{date_col}` RANGE BETWEEN CURRENT ROW AND CURRENT ROW)"
    return both.withColumns({c: F.expr(f"max(`{c}`) {day}") for c in columns}).filter("_row").drop("_row")


def add_date_index(df: DataFrame, out_col: str = "day_index", date_col: str = "date") -> DataFrame:
    """Days since the first date of the panel (a one-row broadcast)."""
    start = df.agg(F.min(date_col).alias("_first"))
    return df.join(F.broadcast(start)).withColumn(out_col, F.datediff(date_col, "_first")).drop("_first")


def engineer_features(df: DataFrame, **neighbor_options) -> DataFrame:
    """The whole chain: one exchange by cell and one sort for all windows."""
    return (
        df.transform(add_relative_humidity)
        .transform(add_wind_features)
        .transform(add_history_features, **neighbor_options)
    )


def add_history_features(df: DataFrame, **neighbor_options) -> DataFrame:
    """The windowed part, for panels that have humidity and wind already."""
    return (
        df.transform(add_neighbor_fire_features, **neighbor_options)
        .transform(add_days_since_rain)
        .transform(add_rolling_features)
    )


def drop_incomplete_history(df: DataFrame, columns: list[str] | tuple[str, ...] = K.COMPLETE_COLUMNS) -> DataFrame:
    return df.na.drop(subset=[f"`{c}`" if "." in c else c for c in columns])


def build_sequences(
    df: DataFrame,
    channels: tuple[str, ...] = K.SEQUENCE_CHANNELS,
    length: int = K.SEQUENCE_LENGTH,
    cell_col: str = "cell_id",
    date_col: str = "date",
    by_run: bool = False,
) -> DataFrame:
    """Add `sequence`, the last `length` rows of the cell as float arrays, and
    keep the rows whose history is complete and without a gap.

    With `by_run`, the rows of a cell are written once, a run of consecutive
    days in a row, and a history is cut out of its run where it is read: a day
    is stored once, not in each of the `length` histories that it is part of.
    """
    if by_run:
        return cut_histories(build_runs(df, channels, length, cell_col, date_col), df.columns, length, cell_col, date_col)
    w = _per_cell(cell_col, date_col)
    step = _step(channels)
    return (
        df.withColumns(
            {
                "sequence": F.collect_list(step).over(w.rowsBetween(1 - length, 0)),
                "_start": F.lag(date_col, length - 1).over(w),
            }
        )
        .filter(F.datediff(date_col, "_start") == length - 1)
        .drop("_start")
    )


def _step(channels: tuple[str, ...]) -> Column:
    return F.array(*[F.col(c).cast("float") for c in channels])


def build_runs(
    df: DataFrame, channels: tuple[str, ...] = K.SEQUENCE_CHANNELS, length: int = K.SEQUENCE_LENGTH, cell_col: str = "cell_id", date_col: str = "date"
) -> DataFrame:
    """The rows of a cell, a run of consecutive days in a row, written once: an array for each column, in order of the
    days, and the channels in `_step`.  Runs shorter than `length` have no history and are left out."""
    names = [date_col, *[c for c in df.columns if c not in (cell_col, date_col)]]
    day = F.struct(*[F.col(f"`{c}`") for c in names], _step(channels).alias("_step"))
    runs = (
        df.withColumn("_run", F.date_sub(date_col, F.row_number().over(_per_cell(cell_col, date_col))))
        .groupBy(cell_col, "_run")
        .agg(F.array_sort(F.collect_list(day)).alias("_days"))
        .filter(F.size("_days") >= length)
        .select(cell_col, *[F.col("_days")[c].alias(c) for c in (*names, "_step")])
    )
    return materialize(runs, "runs")


def cut_histories(runs: DataFrame, columns: Sequence[str], length: int = K.SEQUENCE_LENGTH, cell_col: str = "cell_id", date_col: str = "date") -> DataFrame:
    """A row for each day of `build_runs` that ends a history of `length` days, with `sequence`."""
    ends = runs.withColumn("_end", F.explode(F.sequence(F.lit(length), F.size(date_col))))
    cut = F.slice("_step", F.col("_end") - (length - 1), F.lit(length)).alias("sequence")
    return ends.select(*[F.col(c) if c == cell_col else F.element_at(F.col(f"`{c}`"), F.col("_end")).alias(c) for c in columns], cut)
