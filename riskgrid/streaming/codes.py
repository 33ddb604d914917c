"""Daily codes as a stream: a small state per cell, held by tile."""

from __future__ import annotations

import datetime as dt
import zlib
from collections.abc import Iterator
from itertools import pairwise
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskgrid.functions import codes as C
from riskgrid.functions import constants as K

STATE = "cells array<string>, last array<string>, ffmc array<double>, dmc array<double>, dc array<double>"
INPUT = ["cell_id", "date", "latitude", "temp_c", "rh", "wind_kmh", "rain"]
VALUES = INPUT[2:]
OUTPUT = "cell_id string, date date, ffmc double, dmc double, dc double"
PACKED = "tile string, cells array<string>, packed binary"
ROW_BYTES = 8 + 8 * len(VALUES)
EPOCH = dt.date(1970, 1, 1)
TILE_CELLS = 16  # on a side


def pack(days: np.ndarray, cells: np.ndarray, values: np.ndarray) -> bytes:
    """Days, cells (numbers of both) and the five inputs of some rows, a column after the other, its bytes by place: they
    hardly differ from row to row, so what is exchanged and kept on disk is small."""
    columns = [np.ascontiguousarray(c) for c in (days.astype(np.int32), cells.astype(np.int32), *values.astype(np.float64))]
    return zlib.compress(b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(packed), np.uint8)
    n, at, found = len(raw) // ROW_BYTES, 0, []
    for kind in (np.int32, np.int32, *[np.float64] * len(VALUES)):
        size = np.dtype(kind).itemsize
        found.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return found[0], found[1], np.stack(found[2:])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tile of a batch, with all rows of the tile; without a date there is no day to step."""
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column("date")))
        tile, cell = (batch.column(c).dictionary_encode("encode") for c in ("tile", "cell_id"))
        tiles, cells, names = tile.indices.to_numpy(), cell.indices.to_numpy(), cell.dictionary
        days = batch.column("date").cast(pa.int32()).to_numpy()
        values = np.stack([batch.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy() for c in VALUES]) if len(days) else np.empty((len(VALUES), 0))
        order = np.argsort(tiles, kind="stable")
        rows = []
        for at in np.split(order, np.flatnonzero(np.diff(tiles[order])) + 1) if len(order) else []:
            own, number = np.unique(cells[at], return_inverse=True)
            rows.append((tile.dictionary[int(tiles[at[0]])], names.take(pa.array(own)), pack(days[at], number, values[:, at])))
        columns = [[r[0].as_py() for r in rows], [r[1].to_pylist() for r in rows], [r[2] for r in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.list_(pa.string()), pa.binary()))], ["tile", "cells", "packed"])


def _advance(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Step a tile's cells day by day, all cells of a day at once; a day that is
    not after the last one its cell has seen comes too late and is left out."""
    cells, last, *codes = state.get if state.exists else ([], [], [], [], [])
    place = {c: k for k, c in enumerate(cells)}
    parts = []
    for batch in batches:
        for names, packed in zip(batch["cells"], batch["packed"]):
            days, number, values = unpack(packed)
            at = np.array([place.setdefault(c, len(place)) for c in names])
            parts.append((days, at[number], values))
    days, at, values = (np.concatenate([p[k] for p in parts], axis=-1) for k in range(3))
    names = np.array(list(place), object)
    order = np.argsort(days, kind="stable")
    days, at, values = days[order], at[order], values[:, order]
    new = len(place) - len(cells)
    last = np.array([*last, *[""] * new], object)
    ffmc, dmc, dc = (np.array([*c, *[np.nan] * new], float) for c in codes)
    m, out = C.ArrayMath, []
    with np.errstate(all="ignore"):
        for start, stop in pairwise([*np.flatnonzero(np.diff(days, prepend=days[0] - 1)), len(days)]):
            date = EPOCH + dt.timedelta(days=int(days[start]))
            day = date.isoformat()
            own, first = np.unique(at[start:stop], return_index=True)  # the first record of a cell
            fresh = last[own] < day
            own, (latitude, temp, rh, wind, rain) = own[fresh], values[:, start + first[fresh]]
            if not len(own):
                continue
            last[own] = day
            if day.endswith(K.RESET_MONTH_DAY):
                ffmc[own], dmc[own], dc[own] = K.STARTUP_FFMC, K.STARTUP_DMC, K.STARTUP_DC
            month = np.full(len(own), date.month)
            ffmc[own], dmc[own], dc[own] = (
                C.ffmc_step(m, ffmc[own], temp, rh, wind, rain),
                C.dmc_step(m, dmc[own], temp, rh, rain, latitude, month),
                C.dc_step(m, dc[own], temp, rain, latitude, month),
            )
            out.append(pd.DataFrame({"cell_id": names[own], "date": date, "ffmc": ffmc[own], "dmc": dmc[own], "dc": dc[own]}))
    state.update((list(place), last.tolist(), ffmc.tolist(), dmc.tolist(), dc.tolist()))
    if out:
        yield pd.concat(out)


def stateful_codes(stream: DataFrame) -> DataFrame:
    """ffmc, dmc and dc per cell and day; NULL before the first 1 March seen.

    `stream` has the columns of INPUT.  State is three numbers and a date per
    cell, held by tile, so a step of a day is one for all cells of the tile, and
    rows are exchanged packed, some thousand of a tile in one.  Of two records of a cell and day the first is taken.
    """
    part = F.split("cell_id", "_", 2)
    row, column = (F.floor(F.try_element_at(part, F.lit(k)).try_cast("int") / TILE_CELLS) for k in (1, 2))
    # An id that is not "row_col" makes a tile of its own.
    tile = F.when(row.isNull() | column.isNull(), F.col("cell_id")).otherwise(F.concat_ws("_", row, column))
    return (
        stream.select(*INPUT, tile.alias("tile"))
        .mapInArrow(_packed, PACKED)
        .groupBy("tile")
        .applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
    )
