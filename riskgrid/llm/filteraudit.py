"""What each order of a set of filters removes, for all orders at once, by difference arrays over Lehmer ranks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgrid.session import materialize

SIGNS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
WEIGHTS = ("docs", "good", "toxic")
# An id with more than one in so many of all rows finds its labels by broadcast: there are fewer such ids than that.
HOT_IDS = 1_000


def failures(text: bytes) -> int:
    """One bit for each of A to D that a UTF-8 text fails.

    A: under 100 words. B: under 80 distinct words in 100. C: over 10 ASCII capitals in 100 code points. D: a sign.
    """
    words = text.split()  # of bytes: at ASCII white space, which is the words' rule
    capitals = len(text) - len(text.translate(None, CAPITALS))
    fails = (
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * capitals > 10 * len(text.decode(errors="replace")),
        len(text) != len(text.translate(None, SIGNS)),
    )
    return sum(1 << k for k, f in enumerate(fails) if f)


def with_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest and mask of each row of (doc_id, text, lang): part is lang, the digest the text's SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, masks = [], []
            for value in batch.column(2):
                text = value.as_py()
                digests.append(hashlib.sha256(text).digest())
                masks.append(failures(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], ["doc_id", "part", "digest", "mask"]
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), part, text).mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """`rows` with good and toxic, 0 or 1, by doc_id: 1 where any of the id's labels says so, 0 without one.

    A null id has no label and isn't joined. An id that holds over 1/1,000 of all rows is joined by broadcast, so that
    its rows stay where they are; there are fewer than 1,000 of those, whatever the size.
    """
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    n = rows.count()
    hot = rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where(F.col("count") > max(HOT_IDS, n / HOT_IDS)).select("doc_id")
    hot = materialize(hot.join(said, "doc_id", "left").withColumn("hot", F.lit(True)), "audit-hot-ids")
    marked = rows.join(F.broadcast(hot), "doc_id", "left")
    known = marked.where("hot OR doc_id IS NULL").drop("hot")
    others = marked.where("hot IS NULL AND doc_id IS NOT NULL").drop("hot", "good", "toxic").join(said, "doc_id", "left")
    return known.unionByName(others).na.fill(0, ["good", "toxic"])


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """part, mask and the sums of WEIGHTS of `rows`, where `bit` of the mask says: a smaller doc_id has the same digest.

    Rows are summed for each text, part and id, then for each text and part with the smallest id kept apart, so a text
    that holds a third of all rows is one row for each task before the last shuffle. A null id is neither smaller nor
    larger than any; rows of one id and text don't make each other copies.
    """
    sums = [F.sum(w).alias(w) for w in WEIGHTS]
    by_id = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("docs"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *WEIGHTS))).alias("least")
    free = [F.sum(F.when(F.col("doc_id").isNull(), F.col(w)).otherwise(F.lit(0))).alias(f"{w}_free") for w in WEIGHTS]
    by_text = by_id.groupBy("digest", "part", "mask").agg(least, *free, *sums)
    first = F.col("least.doc_id") == F.min("least.doc_id").over(Window.partitionBy("digest"))
    by_text = by_text.withColumn("first", F.coalesce(first, F.lit(False)))
    kept = {w: F.col(f"{w}_free") + F.when(F.col("first"), F.col(f"least.{w}")).otherwise(F.lit(0)) for w in WEIGHTS}
    sides = F.array(
        F.struct(F.col("mask").alias("mask"), *[c.alias(w) for w, c in kept.items()]),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << bit)).alias("mask"), *[(F.col(w) - c).alias(w) for w, c in kept.items()]),
    )
    return by_text.select("part", F.inline(sides)).groupBy("part", "mask").agg(*sums)


def intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, rank, sign): where the difference array of a step goes up or down for those who fail the filters of mask.

    Orders of n filters are ranked by their Lehmer code, that is lexicographically. All orders that begin alike are one
    interval of ranks, so a mask is removed at a step on the intervals whose beginning has one of its filters last, and none before.
    """
    found = []

    def visit(begin: tuple[int, ...], rank: int) -> None:
        left = [k for k in range(n) if k not in begin]
        size = math.factorial(len(left) - 1) if left else 0
        for nth, k in enumerate(left):
            start, free = rank + nth * size, [j for j in left if j != k]
            for some in range(1 << len(free)):
                mask = 1 << k | sum(1 << j for i, j in enumerate(free) if some >> i & 1)
                found.extend([(mask, len(begin) + 1, start, 1), (mask, len(begin) + 1, start + size, -1)])
            visit((*begin, k), start)

    visit((), 0)
    return found


def audit(counts: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """What each filter does at each step of each order: one row for each part, order and step, zeros included.

    `counts` has part, mask (bit k: fails the k-th filter) and docs, good, toxic; a part's rows are summed. Returns part,
    filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, all counts of documents.
    For n filters a part has n! orders and at most 2^n masks, so what follows the counting doesn't depend on the documents.
    """
    spark: SparkSession = counts.sparkSession
    n = len(filters)
    ranks = math.factorial(n)
    counts = materialize(counts.groupBy("part", "mask").agg(*[F.sum(w).alias(w) for w in WEIGHTS]), "audit-masks")

    # Counts go in at the ends of intervals; the sum up to a rank is what that order's step removes.
    ends = spark.createDataFrame(intervals(n), "mask int, step int, rank int, sign int")
    steps = counts.join(F.broadcast(ends), "mask").select("part", "step", "rank", *[(F.col("sign") * F.col(w)).alias(w) for w in WEIGHTS])
    parts = counts.groupBy("part").agg(
        F.sum("docs").alias("total"),
        F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, F.col("docs")).otherwise(F.lit(0))) for k in range(n)]).alias("fails"),
        F.array(*[F.sum(F.when(F.col("mask") == 1 << k, F.col("docs")).otherwise(F.lit(0))) for k in range(n)]).alias("unique"),
    )
    grid = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank"))
    grid = grid.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"), "rank", *[F.lit(0).cast("long").alias(w) for w in WEIGHTS])
    change = steps.unionByName(grid).groupBy("part", "step", "rank").agg(*[F.sum(w).alias(w) for w in WEIGHTS])
    upto = Window.partitionBy("part", "step").orderBy("rank")
    gone = change.select("part", "step", "rank", *[F.sum(w).over(upto).alias(w) for w in WEIGHTS]).where(F.col("rank") < ranks)

    orders = F.split(F.lit(",".join("".join(p) for p in permutations(filters))), ",")
    gone = gone.withColumn("filter_order", F.get(orders, F.col("rank")))
    gone = gone.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    so_far = F.sum("docs").over(Window.partitionBy("part", "rank").orderBy("step"))
    shapley = F.sum("docs").over(Window.partitionBy("part", "filter"))
    own = lambda name: F.get(name, F.instr(F.lit(filters), F.col("filter")) - 1)
    gone = gone.select("part", "filter_order", "step", "filter", *WEIGHTS, so_far.alias("so_far"), shapley.alias("shapley")).join(parts, "part")
    return gone.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        (F.col("total") - F.col("so_far")).alias("kept"),
        F.col("docs").alias("removed"),
        (own("fails") - F.col("docs")).alias("redundant"),
        own("unique").alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        "shapley",
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over (doc_id, text, lang), with (doc_id, quality, toxic) for what is lost.

    A to D: see `failures`. E: the text is that of a smaller doc_id anywhere in the table; texts are told apart by their
    SHA-256. A null text is empty, a null lang is the part of the empty string, a null doc_id has no labels and never
    fails E. Repeated rows and rows of one id count as often as they are there, and aren't copies of each other. Repeated labels of an id
    are one; a null in them is no 1. An empty table has no parts, so no rows. Other columns are ignored.
    """
    rows = materialize(with_failures(docs), "audit-failures")
    return audit(with_copies(with_labels(rows, labels), bit=4))
