"""What the corpus operators share: narrow inputs, prefix sums over ranges, components of a link table."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.session import materialize

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def give_back() -> None:
    """Hands memory that a Python worker no longer uses to the system: the next stage may run in the same worker, or in
    another beside it. Does nothing where the C library has no such call."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def components(nodes: DataFrame, links: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node: columns node, root.

    `nodes` has a long column node (distinct), `links` long columns a, b. Alternates large-star and small-star
    steps; the link table shrinks to a forest of depth one in a logarithmic number of rounds in practice. Each
    round is written to the shared folder, so a lost executor costs one round at most. No link leaves the cluster.
    Raises when `max_rounds` are not enough: no half-finished result is returned.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-edges"
    )
    if not edges.take(1):
        return nodes.select("node", F.col("node").alias("root"))
    before = None
    for k in range(max_rounds):
        # Large star: each node tells its larger neighbours of the smallest node it knows.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: each node ties its smaller neighbours and itself to the smallest of them.
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, f"{label}-round")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == state:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )
