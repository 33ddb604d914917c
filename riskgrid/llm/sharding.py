"""Shards of near equal bytes by sampled splitters. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.session import materialize

RANGES_PER_SHARD = 16
SAMPLES_PER_RANGE = 32
ROWS_PER_RANGE = 50_000
GROUPS_PER_SHARD = 16
FIRST_ID = -(1 << 63)


def _rank(splitters: Column, key: Column, steps: int) -> Column:
    """How many of the sorted `splitters` are not above `key`: binary search by halving steps."""
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    return F.aggregate(
        halves, F.lit(0), lambda at, step: F.when(F.get(splitters, at + step - 1) <= key, at + step).otherwise(at)
    )


def rank_among(cuts: list[int], key: Column) -> Column:
    """How many of the sorted `cuts` are not above `key`."""
    return _rank(F.array(*[F.lit(c).cast("long") for c in cuts]), key, len(cuts).bit_length()) if cuts else F.lit(0)


def _quantiles(samples: Column, n: Column) -> Column:
    """n - 1 distinct keys that cut the sorted samples into n like parts."""
    picks = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(samples, F.floor(i * F.size(samples) / n).cast("int")))
    return F.array_sort(F.array_distinct(F.filter(picks, lambda x: x.isNotNull())))


def place(
    docs: DataFrame,
    shards: int = 24,
    ranges_per_shard: int = RANGES_PER_SHARD,
    rows_per_range: int = ROWS_PER_RANGE,
    seed: int = 7,
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of (doc_id, text).

    Law: bytes. Size is the UTF-8 bytes of the text (null: none) plus 8; each shard gets its share of the sum of
    sizes to within a few documents. Slots run from 0 without gap in each shard.

    Records are in order of (hash of text, doc_id). A size-weighted sample of keys gives splitters, their quantiles
    cut the keys into ranges, and a range with more rows or bytes than it should hold is subdivided by splitters
    drawn from itself. Sizes before a row are then known exactly (sum of earlier ranges, running sum inside the
    range), and a shard is an equal slice of that scale. The sample decides only how the work is cut: the result is
    the same for any sample.

    Equal texts go to one shard, unless they alone hold over 1/16 of a shard by bytes or rows: such a group is cut by
    doc_id like the rest. At most 16 groups a shard by bytes and 16 by rows can be so large, which bounds the table that is broadcast.

    Null doc_id comes first, rows that repeat are rows of their own, an empty table gives no rows; other columns are
    ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ),
        "shard-sizes",
    )
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    total = total or 1
    share = shards * GROUPS_PER_SHARD
    big = rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    big = big.where((F.col("rows") > 1) & ((F.col("bytes") > total / share) | (F.col("rows") > n / share))).select("h", F.lit(True).alias("big"))
    keyed = rows.join(F.broadcast(big), "h", "left").withColumn("id", F.coalesce("doc_id", F.lit(FIRST_ID)))
    keyed = keyed.withColumn("big", F.coalesce("big", F.lit(False))).withColumn(
        "key", F.struct("h", F.when(F.col("big"), F.col("id")).otherwise(F.lit(FIRST_ID)).alias("id"))
    )
    chance = F.pmod(F.xxhash64("h", "id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)

    # Splitters of the first level: their number is a parameter, so they travel as a constant.
    ranges = shards * ranges_per_shard
    sample = keyed.where(chance < F.col("size") * (ranges * SAMPLES_PER_RANGE / total)).agg(F.array_sort(F.collect_list("key")).alias("keys"))
    picked = sample.select(_quantiles(F.col("keys"), F.lit(ranges)).alias("cuts")).first()["cuts"] or []
    cuts = F.array(*[F.struct(F.lit(c["h"]).alias("h"), F.lit(c["id"]).alias("id")) for c in picked])
    keyed = keyed.withColumn("range", _rank(cuts, F.col("key"), max(1, len(picked).bit_length())) if picked else F.lit(0))

    # Overfull ranges get splitters of their own.
    fair = total / ranges
    load = keyed.groupBy("range").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    parts = F.greatest(F.ceil(F.col("rows") / rows_per_range), F.when(F.col("bytes") > 3 * fair, F.ceil(F.col("bytes") / fair)).otherwise(1)).cast("int")
    load = materialize(load.select("range", "rows", parts.alias("parts")).where("parts > 1"), "shard-overfull")
    again = keyed.join(load, "range").where(
        F.pmod(F.xxhash64("h", "id", F.lit(seed + 1)), F.lit(1 << 40)) / float(1 << 40) < F.col("parts") * F.lit(SAMPLES_PER_RANGE) / F.col("rows")
    )
    finer = again.groupBy("range").agg(F.array_sort(F.collect_list("key")).alias("keys"), F.first("parts").alias("parts"))
    finer = finer.select("range", _quantiles(F.col("keys"), F.col("parts")).alias("finer"))
    most = load.agg(F.max("parts")).first()[0] or 1
    ranged = keyed.join(finer, "range", "left").withColumn(
        "sub", F.when(F.col("finer").isNull(), F.lit(0)).otherwise(_rank(F.col("finer"), F.col("key"), int(most).bit_length()))
    )
    ranged = materialize(ranged.select("doc_id", "id", "size", "text_crc32", "h", "big", "range", "sub"), "shard-ranges")

    ahead = Window.orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("range", "sub").agg(F.sum("size").alias("bytes"))
    offsets = offsets.select("range", "sub", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("offset"))
    order = ["h", "id", "size", "text_crc32"]
    inside = Window.partitionBy("range", "sub").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("range", "sub", "h")
    placed = ranged.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.withColumn("start", F.when(F.col("big"), F.col("before")).otherwise(F.min("before").over(group)))
    placed = placed.withColumn("unit", F.when(F.col("big"), F.col("size")).otherwise(F.sum("size").over(group)))
    placed = placed.join(offsets, ["range", "sub"])
    middle = F.expr(f"((2 * (offset + start) + unit) * {shards}L) div {2 * total}L")
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), middle).cast("int"))
    placed = materialize(placed.drop("before", "start", "unit", "offset", "big"), "shard-placed")

    earlier = Window.partitionBy("shard").orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("shard", "range", "sub").agg(F.count("*").alias("n"))
    first = first.select("shard", "range", "sub", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "range", "sub").orderBy(*order)
    slotted = placed.withColumn("nth", F.row_number().over(within)).join(first, ["shard", "range", "sub"])
    return slotted.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"))
