"""A Merkle manifest of a dataset, rolled up by grouping rank digits away, with a proof for each row."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 2
LEVELS_PER_BLOCK = 5
ROWS_PER_RANGE = 50_000
RANGES_PER_GROUP = 1_000


def _said(field: str | Column) -> Column:
    """A field as the leaf takes it in: byte count, colon, value; a dash for null."""
    value = (F.col(field) if isinstance(field, str) else field).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(fields: Sequence[str | Column] = FIELDS) -> Column:
    return F.sha2(F.concat(*[_said(f) for f in fields]).cast("binary"), 256)


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """`rows`, a written table, with `rank` from 0 and `size` within each group of `by`, in the order of `order`.

    Rows are dealt into ranges of the whole order, numbered within their range and group, and moved on by what the
    earlier ranges of the group hold: sums of 1,000 ranges first, then of ranges among those. Ranges cut through
    groups, so one that holds nearly all rows is no larger piece of work than others. `by` and `order` must tell rows
    apart, unless rows are equal in both.
    """
    n = rows.count()
    ranges = max(1, math.ceil(n / rows_per_range))
    keys = [*by, *order]
    dealt = materialize(rows.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()), "merkle-ranges")
    held = dealt.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_far", F.floor(F.col("_range") / RANGES_PER_GROUP))
    ahead = lambda *group: Window.partitionBy(*by, *group)
    far = held.groupBy(*by, "_far").agg(F.sum("_n").alias("_all"))
    far = far.select(
        *[F.col(c).alias(f"_{c}") for c in by],
        F.col("_far").alias("_of"),
        F.coalesce(F.sum("_all").over(ahead().orderBy("_far").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_all").over(ahead()).alias("size"),
    )
    near = F.coalesce(F.sum("_n").over(ahead("_far").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("_near", near).join(far, [F.col("_far") == F.col("_of"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]])
    held = held.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_of"), (F.col("_before") + F.col("_near")).alias("_first"), "size")
    placed = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order)) - 1)
    placed = placed.join(held, [F.col("_range") == F.col("_of"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]])
    return placed.select(*rows.columns, (F.col("_first") + F.col("_nth")).alias("rank"), "size")


def _rolled(nodes: DataFrame, run: int, levels: int) -> DataFrame:
    """tree, size, block, top: `levels` levels over each block of run^levels neighbouring nodes of (tree, size, rank, node).

    The rank's digits are grouped away from the last to the first, each level's structs nested in the next one's. Groups
    of fewer digits lie in one partition with those of more, so all levels share one exchange. A level counts only
    while more than one node remains in the whole tree; else its one node is handed up as it is.
    """
    digits = [f"digit{k}" for k in range(levels)]
    at = nodes.select(
        "tree",
        "size",
        F.floor(F.col("rank") / run**levels).alias("block"),
        *[F.pmod(F.floor(F.col("rank") / run**k), F.lit(run)).cast("int").alias(d) for k, d in enumerate(digits)],
        "node",
    ).repartition("tree", "block")
    for k, digit in enumerate(digits):
        kids = F.transform(F.array_sort(F.collect_list(F.struct(F.col(digit).alias("digit"), F.col("node").alias("node")))), lambda kid: kid["node"])
        at = at.groupBy("tree", "size", "block", *digits[k + 1 :]).agg(kids.alias("kids"))
        digest = F.when(F.col("size") > run**k, F.sha2(F.array_join(F.transform("kids", lambda kid: kid["h"]), "").cast("binary"), 256))
        at = at.select("tree", "size", "block", *digits[k + 1 :], F.struct(F.coalesce(digest, F.get("kids", F.lit(0))["h"]).alias("h"), "kids").alias("node"))
    return at.withColumnRenamed("node", "top")


def _paths(node: Column, path: Column, size: Column, levels: int, run: int) -> Column:
    """Every node at the bottom of a nested block with its path: the digests left and right of it in its run, level by level upwards."""
    if not levels:
        return F.array(F.struct(node.alias("node"), path.alias("path")))
    counts = size > run ** (levels - 1)

    def below(kid: Column, nth: Column) -> Column:
        digests = F.transform(node["kids"], lambda k: k["h"])
        beside = F.struct(F.array_join(F.slice(digests, 1, nth), "").alias("left"), F.array_join(F.slice(digests, nth + 2, F.lit(run)), "").alias("right"))
        return _paths(kid, F.when(counts, F.concat(F.array(beside), path)).otherwise(path), size, levels - 1, run)

    return F.flatten(F.transform(node["kids"], below))


def roll_up(nodes: DataFrame, run: int = RUN, levels: int = LEVELS_PER_BLOCK) -> list[DataFrame]:
    """Written tiers of (tree, size, block, top) over (tree, size, rank, node): the last has one block for each tree.

    `node` is a struct of a digest h and whatever goes with the row; `rank` runs from 0 to size - 1 in a tree. A tier's
    nodes are rolled up in blocks of run^levels; the blocks' digests are the nodes of the next tier. No task
    and no row ever holds more than one block nested.
    """
    tiers: list[DataFrame] = []
    while True:
        tiers.append(materialize(_rolled(nodes, run, levels), f"merkle-tier{len(tiers)}"))
        if not tiers[-1].where(F.col("size") > run**levels).take(1):
            return tiers
        up = F.ceil(F.col("size") / run**levels).cast("long").alias("size")
        nodes = tiers[-1].select("tree", up, F.col("block").alias("rank"), F.struct(F.col("top.h").alias("h"), "block").alias("node"))


def hand_down(tiers: list[DataFrame], crowns: DataFrame | None = None, run: int = RUN, levels: int = LEVELS_PER_BLOCK) -> DataFrame:
    """tree, node, path, crown of each node at the bottom of `tiers`.

    Coming down, a block meets the path of its own top by grouping, not by a join, and one explode hands out the paths
    below. `crowns` has tree and crown, a struct of a path to append to that of the tree's top and whatever else to
    hand down; without it the crown has the tree's digest as root.
    """
    if crowns is None:
        none = F.array().cast("array<struct<left:string,right:string>>")
        held = tiers[-1].withColumn("crown", F.struct(none.alias("path"), F.col("top.h").alias("root")))
    else:
        held = _met(tiers[-1], crowns.select("tree", F.lit(0).cast("long").alias("block"), "crown"))
    for tier in reversed(range(len(tiers))):
        paths = _paths(F.col("top"), F.col("crown.path"), F.col("size"), levels, run)
        found = held.select("tree", "crown", F.explode(paths).alias("found"))
        if tier:
            crown = F.col("crown").withField("path", F.col("found.path")).alias("crown")
            held = _met(tiers[tier - 1], found.select("tree", F.col("found.node.block").alias("block"), crown))
    return found.select("tree", F.col("found.node").alias("node"), F.col("found.path").alias("path"), "crown")


def _met(blocks: DataFrame, crowns: DataFrame) -> DataFrame:
    """Each block (tree, size, block, top) with the crown of the same (tree, block): two rows a group."""
    both = blocks.unionByName(crowns, allowMissingColumns=True).groupBy("tree", "block")
    one = lambda c: F.get(F.array_compact(F.collect_list(c)), F.lit(0)).alias(c)
    return both.agg(one("size"), one("top"), one("crown"))


def _fold(leaf: Column, path: Column) -> Column:
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]).cast("binary"), 256))


def manifest(docs: DataFrame, run: int = RUN, levels: int = LEVELS_PER_BLOCK, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (array of left and right, upwards), proof_sha256, folded_root, verified for each row.

    Rows are (doc_id, source, lang, n_chars, text); the leaf is the SHA-256 of all five, a dash for a null one. Each lang
    is a tree whose leaves ascend by doc_id, null first; the langs' roots, null first and then bytewise, are the leaves of
    one more. In each tree neighbours in runs of `run` become the digest of their digests while more than one node is left.

    A row whose crc32(doc_id) 7 divides is tampered with before it is verified: its n_chars is one more, unless null.
    `folded_root` is its root by that leaf and the true path; a null doc_id is not tampered with.

    Rows of one lang and doc_id follow each other by their leaf; rows equal in all are leaves of their own. A lang
    of one row has its leaf as its root; a table of one lang has that lang's root. An empty table gives no rows. Other columns are
    ignored.
    """
    divides = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0, F.lit(False))
    tampered = leaf_digest([F.col(c) + F.when(divides, F.lit(1)).otherwise(F.lit(0)) if c == "n_chars" else c for c in FIELDS])
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        leaf_digest().alias("leaf"),
        F.when(divides & F.col("n_chars").isNotNull(), tampered).alias("tampered"),
        F.monotonically_increasing_id().alias("nth"),
    )
    leaves = materialize(leaves, "merkle-leaves")
    langs = materialize(leaves.select("lang").distinct().withColumn("all", F.lit(0)), "merkle-langs")
    trees = materialize(ranked(langs, ["all"], ["lang"], rows_per_range).select(F.col("lang").alias("_lang"), F.col("rank").alias("tree")), "merkle-trees")
    placed = ranked(leaves, ["lang"], ["doc_id", "leaf", "nth"], rows_per_range).join(trees, F.col("lang").eqNullSafe(F.col("_lang")))
    own = F.struct(F.col("leaf").alias("h"), "doc_id", "tampered").alias("node")
    tiers = roll_up(placed.select("tree", "size", "rank", own), run, levels)

    subroots = tiers[-1].select(
        F.lit(0).cast("long").alias("tree"), F.lit(trees.count()).cast("long").alias("size"), F.col("tree").alias("rank"), F.struct(F.col("top.h").alias("h"), F.col("tree").alias("of")).alias("node")
    )
    crowned = hand_down(roll_up(subroots, run, levels), None, run, levels)
    crown = F.struct("path", F.col("node.h").alias("subroot"), F.col("crown.root").alias("root")).alias("crown")
    rows = hand_down(tiers, crowned.select(F.col("node.of").alias("tree"), crown), run, levels)

    out = rows.select("node.doc_id", F.col("node.h").alias("leaf"), "crown.subroot", "crown.root", F.col("path").alias("proof"), "node.tampered")
    siblings = F.flatten(F.transform("proof", lambda step: F.array(step["left"], step["right"])))
    out = out.withColumn("folded_root", _fold(F.coalesce("tampered", "leaf"), F.col("proof"))).drop("tampered")
    return out.withColumns(
        {"proof_sha256": F.sha2(F.array_join(siblings, "").cast("binary"), 256), "verified": F.col("folded_root") == F.col("root")}
    )
