"""Mixing of sources to target weights by weighted fair queueing.

Every source sends its documents, shuffled, up to `max_epochs` times. A copy's virtual finish time is the number of
words its source has sent up to and with it, divided by the source's target. One order by finish time over all
sources then serves each at its target rate, and the order is cut where the budget is used up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.llm.common import n_words
from riskgrid.session import materialize

ROWS_PER_RANGE = 4_000


def source_targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """source, source_size, target for a table of (source, size).

    Weights are dealt to the sources by code point, null last, again and again. The sources share the sum of all
    sizes; a source's target stops at `max_epochs` times its size, and what it leaves goes to the others by weight.

    Filling is a sort by size over weight: the sources that are full are the first ones of that order, so one pass of
    running sums finds the level. There is one row for each source here. All sizes zero: targets are zero.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * max_epochs
    rank = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        totals.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        # The level if this source and all after it were open; the first source that is not full has the true one.
        .withColumn("level", F.col("left") / F.col("open"))
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    )
    over_all = Window.partitionBy()
    turn = F.col("cap") / F.col("weight")
    ranked = ranked.withColumn("first", F.min(F.when(~F.col("full"), turn)).over(over_all))
    ranked = ranked.withColumn("level", F.max(F.when(turn == F.col("first"), F.col("level"))).over(over_all))
    return ranked.select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"),
    )


def mix(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", size: Column | None = None
) -> DataFrame:
    """doc_id, size, source_size, target, epochs, taken for each row of (doc_id, text, source).

    `epochs` is how often the mix takes the document, `taken` the words that makes. Documents are taken whole, so a
    source ends within one document of its target; the whole mix never exceeds the budget. Null text has size 0;
    rows of size 0 cost nothing and are never taken. Null source is a source of its own. Rows that repeat are rows
    of their own; ties go by doc_id, then size. An empty table gives an empty mix. Other columns are ignored.

    The shuffle is by the md5 of seed and doc_id, so reruns agree. Running sums have two levels: ranges of the shuffle
    key inside a source (their number follows the source's rows), then inside a range. So a source with a third of
    all rows is dealt to many tasks. The cut is exact: finish times fall into ranges, whole ranges before the cut are
    taken, and only the range with the cut is put in order.
    """
    rows = materialize(
        docs.select("doc_id", "source", (n_words(F.col("text")) if size is None else size).alias("size")), "mix-sizes"
    )
    return mix_sizes(rows, weights, max_epochs, seed)


def mix_sizes(rows: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """As `mix`, for a written table of (doc_id, source, size)."""
    targets = materialize(source_targets(rows.select("source", "size"), weights, max_epochs), "mix-targets")
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    per_source = counts.join(targets, counts.source.eqNullSafe(targets.source), "inner").select(
        counts.source, "source_size", "target", F.ceil(F.col("n") / ROWS_PER_RANGE).cast("long").alias("parts")
    )
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    spread = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    keyed = (
        rows.alias("r")
        .join(per_source.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")), "left")
        .select("doc_id", "r.source", "size", "source_size", "target", key.alias("key"), F.floor(spread * F.col("parts") / F.lit(1 << 32)).alias("part"))
    )
    parts = keyed.groupBy("source", "part").agg(F.sum("size").alias("sum"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        keyed.alias("k")
        .join(parts.alias("p"), F.col("k.source").eqNullSafe(F.col("p.source")) & (F.col("k.part") == F.col("p.part")))
        .select("doc_id", "k.source", "size", "source_size", "target", "key", "k.part", "ahead")
        .withColumn("sent", F.col("ahead") + F.sum("size").over(inside))
        .withColumn("nth", F.row_number().over(inside))
    )
    queued = materialize(queued.drop("ahead"), "mix-queue")
    copies = queued.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    copies = copies.withColumn("finish", (F.col("sent") + F.col("epoch") * F.col("source_size")).cast("double") / F.col("target"))
    # Finish times spread evenly over (0, 1], a little beyond, by construction, so equal slices of them are ranges of like size.
    n, budget = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    slices = max(1, -(-n // ROWS_PER_RANGE)) * 4
    copies = copies.withColumn("slice", F.floor(F.col("finish") * slices))
    sums = copies.groupBy("slice").agg(F.sum("size").alias("sum"))
    upto = sums.withColumn("upto", F.sum("sum").over(Window.orderBy("slice")))
    cut = upto.where(F.col("upto") > budget).agg(F.min("slice").alias("cut")).first()["cut"]
    cut = cut if cut is not None else 1 << 62
    start = upto.where(F.col("slice") < cut).agg(F.max("upto")).first()[0] or 0
    order = Window.orderBy("finish", F.col("source").isNull(), "source", "key", "doc_id", "size", "nth", "epoch")
    last = (
        copies.where(F.col("slice") == cut)
        .withColumn("sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("sum") <= budget - start)
    )
    same = ["source", "part", "nth"]
    edge = last.groupBy(*same).agg(F.count("*").alias("edge"))
    whole = F.aggregate(
        F.sequence(F.lit(0), F.lit(max_epochs - 1)),
        F.lit(0),
        lambda n, e: n
        + F.when(F.floor((F.col("sent") + e * F.col("source_size")).cast("double") / F.col("target") * slices) < cut, 1).otherwise(0),
    )
    on = F.col("q.source").eqNullSafe(F.col("e.source")) & (F.col("q.part") == F.col("e.part")) & (F.col("q.nth") == F.col("e.nth"))
    taken = queued.alias("q").join(edge.alias("e"), on, "left")
    epochs = F.when(F.col("size") > 0, whole + F.coalesce("edge", F.lit(0))).otherwise(F.lit(0)).cast("int")
    return taken.select(
        "doc_id", "q.source", "size", "source_size", "target", epochs.alias("epochs"), (epochs * F.col("size")).cast("long").alias("taken")
    )


def draw(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of `docs` as often as `mix` takes it, all columns kept; rows not taken are left out.

    Rows that agree in doc_id, source and size are told apart by their text, equal ones by any order.
    """
    sized = docs.withColumn("_size", n_words(F.col("text")))
    rows = materialize(sized.select("doc_id", "source", F.col("_size").alias("size")), "draw-sizes")
    taken = mix_sizes(rows, weights, max_epochs, seed).groupBy("doc_id", "source", "size")
    taken = materialize(taken.agg(F.sort_array(F.collect_list("epochs"), asc=False).alias("_epochs")).where("_epochs[0] > 0"), "draw-taken")
    nth = F.lit(0)
    if taken.where(F.size("_epochs") > 1).limit(1).count():
        nth = F.row_number().over(Window.partitionBy("doc_id", "source", "_size").orderBy("text")) - 1
    numbered = sized.withColumn("_nth", nth).alias("d")
    same = [F.col(f"d.{a}").eqNullSafe(F.col(f"t.{b}")) for a, b in (("doc_id", "doc_id"), ("source", "source"), ("_size", "size"))]
    found = numbered.join(taken.alias("t"), same).withColumn("_times", F.get("_epochs", F.col("_nth"))).where("_times > 0")
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return found.select(*[F.col(f"d.`{c}`") for c in docs.columns])
