"""Global order without a global sort: prefix sums, quantiles, top-k.

A score table can hold billions of rows and one score may hold a third of
them.  Everything here first counts per distinct value (combined before the
shuffle) and writes that table.  If it is small, one window does the rest.  Else
the values are told apart by the digits, twelve bits each, of a 64-bit form that
has the same order: a group-by on the first digits gives cells, their totals are
added up among at most 4,096 cells at a time, and cells that still hold too
many values are cut by the next digit.  Where only some ranks are asked for,
only the cells that hold them go on.  No task sees more than one cell or 4,096
totals, no sketch is made, and only single numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.session import materialize

DIGIT_BITS = 12
VALUES_PER_CELL = 50_000
BUCKETS = 10_000
ROWS_PER_BUCKET = 10_000

# Of the total before a value or a cell, its own, and the group's: may it hold a rank that is asked for?
Wanted = Callable[[Column, Column, Column], Column]


def _attach(df: DataFrame, per_group: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Put the one row of each group on all its rows; a NULL group is a group.

    Rows of a group without that row keep NULLs, unless `how` is "inner".
    Without groups there is one row at most, which is broadcast; with groups
    the size measured at run time decides.
    """
    if not by:
        return df.join(F.broadcast(per_group), F.lit(True), how)
    renamed = per_group.withColumnsRenamed({b: f"_group_{b}" for b in by})
    same = [F.col(f"`{b}`").eqNullSafe(F.col(f"`_group_{b}`")) for b in by]
    return df.join(renamed, same, how).drop(*[f"_group_{b}" for b in by])


def value_counts(
    df: DataFrame, value: str, sums: dict[str, object] | None = None, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Rows per distinct value as `n`, and any further sums.  With `weight`,
    a row stands for that many."""
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    extra = [F.sum(c).alias(name) for name, c in (sums or {}).items()]
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(rows.alias("n"), *extra)


def ordered_bits(value: Column, kind: str) -> Column:
    """A long that orders as the value does, for numbers and dates.

    Of a double, its bits, the lower ones turned over where it is negative.
    Decimals go by their double, which may tie but never turns an order round.
    """
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return value.cast("long")
    if kind == "date":
        return F.unix_date(value).cast("long")
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def _totals_ahead(sums: Sequence[str], group: Sequence[str], order: Sequence[str], descending: bool) -> dict[str, Column]:
    direction = F.desc if descending else F.asc
    ahead = Window.partitionBy(*group).orderBy(*[direction(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    return {s: F.coalesce(F.sum(s).over(ahead), F.lit(0)) for s in sums}


def _with_cells(
    counts: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str],
    descending: bool,
    values_per_cell: int,
    wanted: Wanted | None,
    written: bool = False,
) -> tuple[DataFrame, list[str], DataFrame]:
    """`counts`, written, with digit columns; their names; the cells.

    A cell has the digits, `_values`, how many distinct values it holds,
    `<s>_before`, the totals of the cells ahead of it, and `<s>_all`, those of
    the group.  Without digits each group is one cell.
    """
    counts = counts if written else materialize(counts, "value-counts")
    none = [F.lit(0).cast("long").alias(f"{s}_before") for s in sums]
    totals = [F.sum(s).alias(s) for s in sums]
    cells = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_values"), *totals)
    cells = cells.select(*by, "_values", *sums, *none, *[F.col(s).alias(f"{s}_all") for s in sums])
    if counts.count() <= values_per_cell or (by and cells.agg(F.max("_values")).first()[0] <= values_per_cell):
        return counts, [], cells
    counts = materialize(counts.withColumn("_order", ordered_bits(F.col(f"`{order}`"), dict(counts.dtypes)[order])), "value-orders")
    ends = counts.agg(F.min("_order"), F.max("_order")).first()
    width = (ends[0] + (1 << 63) ^ ends[1] + (1 << 63)).bit_length()  # bits in which values differ at all
    unsigned, digits = F.col("_order").bitwiseXOR(F.lit(-(1 << 63))), []
    while width > 0:
        taken = min(DIGIT_BITS, width)
        width -= taken
        digit = F.shiftrightunsigned(unsigned, width).bitwiseAND(F.lit((1 << taken) - 1)).cast("int")
        counts = counts.withColumn(f"_digit{len(digits)}", digit)
        parents, outer = cells, [*by, *digits]
        digits.append(f"_digit{len(digits)}")
        rows = counts if wanted is None else _beside(counts, parents.select(*outer), by, digits[:-1], "left_semi")
        cells = rows.groupBy(*by, *digits).agg(F.count(F.lit(1)).alias("_values"), *totals)
        inside = _totals_ahead(sums, outer, digits[-1:], descending)
        cells = cells.withColumns({f"_{s}_ahead": c for s, c in inside.items()})
        cells = _beside(cells, parents.select(*outer, *[f"{s}_{x}" for s in sums for x in ("before", "all")]), by, digits[:-1])
        cells = cells.withColumns({f"{s}_before": F.col(f"{s}_before") + F.col(f"_{s}_ahead") for s in sums}).drop(*[f"_{s}_ahead" for s in sums])
        if wanted is not None:
            cells = cells.filter(wanted(F.col("n_before"), F.col("n"), F.col("n_all")))
        cells = materialize(cells, "value-cells")
        if (cells.agg(F.max("_values")).first()[0] or 0) <= values_per_cell:
            break
    return counts, digits, cells


def _beside(rows: DataFrame, cells: DataFrame, by: Sequence[str], digits: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows with what their cell has; a NULL group is a group."""
    if not by and not digits:
        return rows if how == "left_semi" else rows.join(F.broadcast(cells))  # one row
    renamed = cells.withColumnsRenamed({c: f"_cell_{c}" for c in (*by, *digits)})
    same = [F.col(f"`{d}`") == F.col(f"`_cell_{d}`") for d in digits]
    same += [F.col(f"`{b}`").eqNullSafe(F.col(f"`_cell_{b}`")) for b in by]
    return rows.join(renamed, same, how).drop(*[f"_cell_{c}" for c in (*by, *digits)])


def running_totals(
    counts: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    values_per_cell: int = VALUES_PER_CELL,
    wanted: Wanted | None = None,
    written: bool = False,
) -> DataFrame:
    """Add `<s>_before`, the total over the values ahead in the order, and
    `<s>_all`, the total of the group, for each of `sums`.

    `order` must be a number or a date, never NULL, and distinct within a group.
    With `wanted`, which goes by the sum `n`, only the values that meet it come
    back, and only cells that may hold one are looked into.  Counts that are
    `written` are not written once more.
    """
    counts, digits, cells = _with_cells(counts, order, sums, by, descending, values_per_cell, wanted, written)
    if not digits:
        everything = Window.partitionBy(*by)
        ranked = counts.withColumns({f"{s}_before": c for s, c in _totals_ahead(sums, by, [order], descending).items()})
        ranked = ranked.withColumns({f"{s}_all": F.sum(s).over(everything) for s in sums})
    else:
        offsets = cells.select(*by, *digits, *[F.col(f"{s}_{x}") for s in sums for x in ("before", "all")])
        ranked = _beside(counts, offsets, by, digits)
        inside = _totals_ahead(sums, [*by, *digits], [order], descending)
        ranked = ranked.withColumns({f"{s}_before": F.col(f"{s}_before") + c for s, c in inside.items()})
    if wanted is not None:
        ranked = ranked.filter(wanted(F.col("n_before"), F.col("n"), F.col("n_all")))
    return ranked.drop("_order", *digits)


def place_in_buckets(
    counts: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    buckets: int = BUCKETS,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add `_bucket` (like shares of the distinct values of a group, in value
    order), `_last`, the group's highest bucket, and the totals `<s>_all`.

    A group has as many buckets as its distinct values call for, up to
    `buckets`.  Neighbouring cells of digits share a bucket until it is full.
    """
    return dealt_in_buckets(counts, order, sums, by, buckets, rows_per_bucket)[0]


def dealt_in_buckets(
    counts: DataFrame, order: str, sums: Sequence[str], by: Sequence[str], buckets: int, rows_per_bucket: int
) -> tuple[DataFrame, bool]:
    """The same, and whether any group may have more than one bucket."""
    counts = counts.withColumn("_one", F.lit(1).cast("long"))
    counts, digits, cells = _with_cells(counts, order, [*sums, "_one"], by, False, max(1, rows_per_bucket // 2), None)
    size = F.greatest(F.lit(rows_per_bucket), F.ceil(F.col("_one_all") / F.lit(buckets)))
    cells = cells.select(
        *by,
        *digits,
        F.floor(F.col("_one_before") / size).cast("int").alias("_bucket"),
        F.floor((F.col("_one_all") - 1) / size).cast("int").alias("_last"),
        *[f"{s}_all" for s in sums],
    )
    return _beside(counts, cells, by, digits).drop("_order", "_one", *digits), bool(digits)


def add_running_totals(
    placed: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """Add `<s>_before` to values placed in buckets: the total of the buckets
    ahead plus the total ahead inside the own bucket."""
    offsets = placed.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    offsets = offsets.withColumns(_totals_ahead([f"_{s}" for s in sums], by, ["_bucket"], descending))
    inside = _totals_ahead(sums, [*by, "_bucket"], [order], descending)
    return (
        _attach(placed, offsets, [*by, "_bucket"])
        .withColumns({f"{s}_before": F.col(f"_{s}") + c for s, c in inside.items()})
        .drop(*[f"_{s}" for s in sums])
    )


def quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per group with `q`,
    an array in the order of `probs`."""
    return quantiles_of_counts(materialize(value_counts(df, value, by=by, weight=weight), "value-counts"), value, probs, by)


def quantiles_of_counts(counts: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The same from written counts `n` per distinct value."""

    def targets(before: Column, n: Column, n_all: Column) -> Column:
        """The asked ranks that lie among these n rows."""
        all_ranks = F.flatten(
            F.array(
                *[
                    F.array(
                        F.struct(F.lit(i).alias("i"), F.lit(0).alias("side"), F.floor((n_all - 1) * F.lit(p)).alias("rank")),
                        F.struct(F.lit(i).alias("i"), F.lit(1).alias("side"), F.ceil((n_all - 1) * F.lit(p)).alias("rank")),
                    )
                    for i, p in enumerate(probs)
                ]
            )
        )
        return F.filter(all_ranks, lambda t: (t["rank"] >= before) & (t["rank"] < before + n))

    asked = lambda before, n, n_all: F.size(targets(before, n, n_all)) > 0
    ranked = running_totals(counts, value, ["n"], by, wanted=asked, written=True)
    met = targets(F.col("n_before"), F.col("n"), F.col("n_all"))
    hits = ranked.select(*by, "n_all", F.col(value).alias("v"), F.explode(met).alias("t"))
    sides = hits.groupBy(*by, F.col("t.i").alias("i")).agg(
        F.max(F.when(F.col("t.side") == 0, F.col("v"))).alias("lo"),
        F.max(F.when(F.col("t.side") == 1, F.col("v"))).alias("hi"),
        F.max("n_all").alias("n_all"),
    )
    p = F.element_at(F.array(*[F.lit(float(x)) for x in probs]), F.col("i") + 1)
    at = (F.col("n_all") - 1) * p
    value_at = F.col("lo") + (F.col("hi") - F.col("lo")) * (at - F.floor(at))
    return sides.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", value_at.alias("v")))), lambda s: s["v"]).alias("q")
    )


def _smallest(ties: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """Per group, the key that closes its first `need` rows in key order."""
    counts = ties.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
    ranked = running_totals(counts, key, ["n"], by)  # the few rows of one score
    return ranked.filter((F.col("n_before") < F.col("need")) & (F.col("need") <= F.col("n_before") + F.col("n"))).select(
        *by, F.col(key).alias("cut_key")
    )


def cut_of_ladder(ladder: DataFrame, score: str, fraction: float, by: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Per group, the score at which the top share ends and how many rows of
    that score are still `need`ed.  The share is max(1, floor(n * fraction))."""
    return ladder.filter(_holds_cut(fraction)(F.col("n_before"), F.col("n"), F.col("n_all"))).select(
        *by, F.col(score).alias("cut_score"), (_share(F.col("n_all"), fraction) - F.col("n_before")).alias("need"), *keep
    )


def _share(n_all: Column, fraction: float) -> Column:
    return F.greatest(F.lit(1), F.floor(n_all * F.lit(fraction)))


def _holds_cut(fraction: float) -> Wanted:
    """Whether the last row of the top share is among these."""
    return lambda before, n, n_all: (before < _share(n_all, fraction)) & (_share(n_all, fraction) <= before + n)


def tied_rows(df: DataFrame, cut: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    return _attach(df, cut, by, "inner").filter(F.col(score) == F.col("cut_score"))


def top_k_cutoff(df: DataFrame, score: str, key: str, fraction: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """Per group, the score and key of the last row inside the top share.

    Rows tied at the cut-off score are taken in ascending order of `key`, a
    unique numeric column; only those rows are ranked further.
    """
    ladder = running_totals(value_counts(df, score, by=by), score, ["n"], by, descending=True, wanted=_holds_cut(fraction))
    cut = cut_of_ladder(ladder, score, fraction, by)
    keys = _smallest(tied_rows(df.select(*by, score, key), cut, score, by), key, by)
    return _attach(cut, keys, by, "inner").drop("need")


def top_k_flag(
    df: DataFrame, score: str = "score", key: str = "row_key", fraction: float = 0.1, by: Sequence[str] = (), out: str = "in_top"
) -> DataFrame:
    """Add a boolean: is the row among its group's highest-scored share?

    Every row comes back: one without a score, or of a group without any, is
    not in the share.
    """
    cut = top_k_cutoff(df, score, key, fraction, by)
    inside = (F.col(score) > F.col("cut_score")) | (
        (F.col(score) == F.col("cut_score")) & (F.col(key) <= F.col("cut_key"))
    )
    return _attach(df, cut, by).withColumn(out, F.coalesce(inside, F.lit(False))).drop("cut_score", "cut_key")


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """`n` rows (all, if there are fewer), the same on every run: the lowest
    by a hash of key and seed.  Spark keeps only n rows per task."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), key)), key).limit(n)
