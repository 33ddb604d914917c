"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits. Of two fingerprints with three or fewer differing
bits, at least two segments differ in one bit at most (else there were four). The perfect binary Golay code maps every
23-bit word to the one codeword within three bits of it; the 12-bit index of that codeword is the segment's own key.
A segment that may be wrong in one bit has the indices of all words one bit away: one or six different ones. So a
fingerprint is stored under the own keys of each pair of segments (three rows), asks with all combinations of nearby
keys of each pair (3 to 108 rows), and meets every fingerprint in reach. Each meeting is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.llm.common import components, give_back
from riskgrid.session import materialize

MAX_BITS = 3
SHINGLE = 3
SEED = 42
WIDTHS = (22, 21, 21)
GENERATOR = 0b101011100011  # of the [23, 12, 7] Golay code, a fixed value
SLICE = 1 << 16  # shingles whose bits are unpacked at once

# The near-dedup stage: sets of five-word shingles, Jaccard similarity of 0.8 or more.
STAGE_SHINGLE, STAGE_LEAST = 5, 0.8
BANDS, ROWS = 24, 5
MIX = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
STAGE_SLICE = 500  # documents whose sets are held at once
COMMON = 32  # open sets that have a shingle, beyond which it no longer makes sets meet by itself
SLACK = 1e-6
SCALE = (1 + STAGE_LEAST) / STAGE_LEAST  # sets link if their sizes add up to this many times what they share, or less


# ------------------------------------------------------------------ fingerprints


def shingle_hashes(text: str | None, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of k words, A-Z lower-cased; of all words if there are fewer; empty without words."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - k].tolist()]
    stops = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(stops))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; zero without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        octets = hashes[at : at + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row of (doc_id, text); null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t.as_py(), k, seed)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


# ------------------------------------------------------------------ Golay keys


def _syndrome(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def error_table() -> np.ndarray:
    """Error of weight three or less for each of the 2048 syndromes; the code is perfect, so each has one."""
    errors = [0] + [sum(1 << b for b in bits) for n in (1, 2, 3) for bits in combinations(range(23), n)]
    table = np.zeros(2048, np.int64)
    table[_syndrome(np.array(errors))] = errors
    return table


ERRORS = error_table()


def codeword(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword next to each 23-bit word."""
    return (words ^ ERRORS[_syndrome(words)]) >> 11


def segments(fps: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> list[np.ndarray]:
    rest, found = fps.astype(np.uint64), []
    for width in widths:
        found.append((rest & np.uint64((1 << width) - 1)).astype(np.int64))
        rest = rest >> np.uint64(width)
    return found


def _pair(which: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (which << 24) | (a << 12) | b


def own_keys(fps: np.ndarray) -> np.ndarray:
    """One key for each pair of segments, shape (n, 3)."""
    own = [codeword(s) for s in segments(fps)]
    return np.stack([_pair(n, own[i], own[j]) for n, (i, j) in enumerate(combinations(range(3), 2))], 1)


def near_keys(fps: np.ndarray) -> list[np.ndarray]:
    """The keys that each fingerprint asks with: own and one-bit-off codewords of both segments of each pair."""
    near = []
    for segment, width in zip(segments(fps), WIDTHS):
        flips = np.array([0] + [1 << b for b in range(width)], np.int64)
        near.append(np.sort(codeword((segment[:, None] ^ flips).ravel()).reshape(len(fps), -1), 1))
    found = []
    for row in range(len(fps)):
        sets = [np.unique(n[row]) for n in near]
        found.append(
            np.concatenate([_pair(n, sets[i][:, None], sets[j][None, :]).ravel() for n, (i, j) in enumerate(combinations(range(3), 2))])
        )
    return found


def _keyed(fps: DataFrame, ask: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000).column(0).to_numpy(zero_copy_only=False)
                keys = near_keys(part.view(np.uint64)) if ask else list(own_keys(part.view(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).astype(np.int32)), pa.array(np.repeat(part, [len(x) for x in keys]))], ["key", "fp"]
                )

    return fps.select("fp").mapInArrow(run, "key int, fp long")


def links(fps: DataFrame) -> DataFrame:
    """All pairs a < b of distinct fingerprints with 1 to 3 differing bits; `fps` has one row for each, column fp."""
    stored, asked = _keyed(fps, False).alias("s"), _keyed(fps, True).alias("q")
    near = (F.col("q.fp") < F.col("s.fp")) & (F.bit_count(F.col("q.fp").bitwiseXOR(F.col("s.fp"))) <= MAX_BITS)
    met = asked.join(stored.hint("merge"), (F.col("q.key") == F.col("s.key")) & near)
    return met.select(F.col("q.fp").alias("a"), F.col("s.fp").alias("b")).distinct()


# ------------------------------------------------------------------ groups


def near_duplicates(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp, component_id for each row of (doc_id, text).

    Fingerprints link at three or fewer differing bits; component_id is the smallest doc_id that links reach. Rows
    with one fingerprint are one node from the start, so a group of copies, however large, is pre-aggregated to a
    single row before anything is joined, and meets the others once. A text without words has fingerprint zero and
    links like any other. Null doc_id never is a component_id; a component of nulls alone has a null one. Rows that
    repeat are given back as often as they come; an empty table gives no rows; other columns are ignored.
    """
    rows = materialize(fingerprints(docs, k, seed), "simhash-rows")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = components(nodes.select(F.col("fp").alias("node")), links(nodes), "simhash")
    classes = nodes.join(roots, nodes.fp == roots.node).select("fp", "first", "root")
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


# ------------------------------------------------------------------ the near-dedup stage


def signature(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """A name for the set of `hashes`, and one key for each band of its least values under as many mixings as needed."""
    held = np.unique(hashes)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(held), 2000):
        mixed = held[None, at : at + 2000] * MIX[:, None]
        mixed ^= mixed >> np.uint64(29)
        mixed *= FACTOR
        np.minimum(least, mixed.min(1), out=least)
    octets = least.tobytes()
    keys = [xxhash.xxh64_intdigest(octets[8 * ROWS * n : 8 * ROWS * (n + 1)], n) for n in range(BANDS)]
    return xxhash.xxh64_intdigest(held.tobytes(), SEED), np.array(keys, np.uint64)


def _row_hash(docs: DataFrame) -> Column:
    """Hash of the whole row; a null is told from a value."""
    return F.xxhash64(*[c for name in docs.columns for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))])


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, row, node (names a set of shingles), fp and keys (of its bands) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STAGE_SLICE):
                part = batch.slice(at, STAGE_SLICE)
                nodes, prints, keys = [], [], []
                for t in part.column(2):
                    hashes = shingle_hashes(t.as_py(), STAGE_SHINGLE)
                    node, bands = signature(hashes)
                    nodes.append(node)
                    prints.append(fingerprint(hashes))
                    keys.append(bands.view(np.int64))
                nodes, prints = (pa.array(np.array(v, np.uint64).view(np.int64)) for v in (nodes, prints))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), nodes, prints, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "row", "node", "fp", "keys"]
                )
        give_back()  # other stages run in the same workers

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_hash(docs).alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, node long, fp long, keys array<long>")


def _sets(docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """node and held (its sorted shingle hashes) of each node of `pairs`, made from one document that has it."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    first = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("r"))
    first = first.select(F.col("r.doc_id").alias("doc_id"), F.col("r.row").alias("row"), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), _row_hash(docs).alias("_row"), F.col("text").cast("string").alias("_text"))
    texts = texts.join(first, (F.col("_row") == F.col("row")) & F.col("_id").eqNullSafe(F.col("doc_id"))).select("node", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STAGE_SLICE):
                part = batch.slice(at, STAGE_SLICE)
                held = [np.unique(shingle_hashes(t.as_py(), STAGE_SHINGLE)).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held, pa.list_(pa.int64()))], ["node", "held"])
        give_back()

    # A row that comes several times gives its set several times.
    return texts.mapInArrow(run, "node long, held array<long>").dropDuplicates(["node"])


def similar(sets: DataFrame, pairs: DataFrame, least: float = STAGE_LEAST) -> DataFrame:
    """The pairs (a, b) of nodes whose sets (node, held) have a Jaccard similarity of `least` or more, exactly."""
    one = sets.select(F.col("node").alias("a"), F.col("held").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("held").alias("y"))
    m, n, shared = F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))
    near = (F.least(m, n) >= F.lit(least) * F.greatest(m, n)) & (shared >= F.lit(least) * (m + n - shared))
    return pairs.join(one, "a").join(two, "b").where(near).select("a", "b")


def _met(nodes: DataFrame) -> DataFrame:
    """key, node and n (nodes of the key) for each band key that several nodes have."""
    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    return keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def _with_hub(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node and the hub of each of its keys: the node whose keys are shared most.

    Edits take band keys away from a copy, so the text that copies come from is the hub of most of them.
    """
    busy = met.groupBy("node").agg(F.sum("n").alias("met"))
    hubs = met.select("key", "node").join(busy, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("hub"))
    pairs = met.select("key", "node").join(hubs.select("key", F.col("hub.node").alias("hub")), "key").where("node <> hub")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _open(met: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, root of the band keys whose nodes are not in one component."""
    rooted = met.select("key", "node").join(roots, "node")
    keys = rooted.groupBy("key").agg(F.min("root").alias("_l"), F.max("root").alias("_h")).where("_l < _h").select("key")
    return rooted.join(keys, "key")


def _ordered(sets: DataFrame, common: int) -> DataFrame:
    """node, s (size of its set), first (of its rarest shingles, those in `common` sets or fewer, with their places) and
    shared (its shingles in more sets), both in one order for all: rarest shingle first."""
    each = sets.select("node", F.size("held").alias("s"), F.explode("held").alias("h"))
    # A shingle of one set alone is shared with none: only its place at the front of the order counts.
    counted = each.join(each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "h")
    lists = counted.groupBy("node", "s").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("seq"))
    alone = F.col("s") - F.size("seq")
    reach = (F.col("s") - F.ceil(F.lit(STAGE_LEAST) * F.col("s") - SLACK) + 1 - alone).cast("int")
    placed = F.transform(
        F.slice("seq", F.lit(1), F.greatest(reach, F.lit(0))),
        lambda e, i: F.struct(e["df"].alias("df"), e["h"].alias("h"), (i + alone).alias("at")),
    )
    return lists.select(
        "node",
        "s",
        F.filter(placed, lambda e: e["df"] <= common).alias("first"),
        F.transform(F.filter("seq", lambda e: e["df"] > common), lambda e: e["h"]).alias("shared"),
    )


def _by_rare(ordered: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) not in one component that share a rare shingle early enough to be 0.8 alike."""
    entries = ordered.join(roots, "node").select("node", "root", "s", F.explode("first").alias("e")).select("node", "root", "s", "e.h", "e.at")
    left, right = (entries.select("h", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "s", "at")]) for side in "ab")
    most = F.least(F.col("s_a") - F.col("at_a"), F.col("s_b") - F.col("at_b"))  # shingles that can still be shared
    near = (
        (F.col("node_a") < F.col("node_b"))
        & (F.col("root_a") != F.col("root_b"))
        & (F.least("s_a", "s_b") >= F.lit(STAGE_LEAST) * F.greatest("s_a", "s_b"))
        & (most * (1 + STAGE_LEAST) >= F.lit(STAGE_LEAST) * (F.col("s_a") + F.col("s_b")) - SLACK)
    )
    met = left.join(right.hint("merge"), "h").where(near)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _compared(pairs: DataFrame, tops: DataFrame) -> DataFrame:
    """The pairs (class_a, class_b) with s and rep of both classes and n, the common shingles that both have."""
    one, two = (tops.select(*[F.col(c).alias(f"{c}_{side}") for c in ("class", "s", "rep", "shared")]) for side in "ab")
    met = pairs.join(one, "class_a").join(two, "class_b")
    return met.withColumn("n", F.size(F.array_intersect("shared_a", "shared_b"))).drop("shared_a", "shared_b")


def _beside_hubs(keyed: DataFrame, tops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of each class and the hub of each of its keys, as `_compared`; and `keyed` with inside, outside and settled.

    The hub of a key is the class that leaves most room for the size of another, if it shares with that what classes on
    average have of its shingles. `inside` counts the common shingles that a class shares with the hub, `outside` those
    it does not; `settled` is set where every set of the class is in one component with the hub already or links to the
    hub's smallest set. Which class is the hub decides how many pairs are left, not which are found.
    """
    each = tops.select("class", "s", F.explode("shared").alias("h"))
    each = each.join(each.groupBy("h").agg(F.count("*").alias("df")), "h")
    room = each.groupBy("class").agg((SCALE * F.sum("df") / F.max("df") - F.max("s")).alias("room"))
    best = F.max(F.struct("room", "class", "s", "low", "high")).alias("h")
    hubs = keyed.join(room, "class").groupBy("key").agg(best, F.count("*").alias("n"))
    hubs = hubs.where("n > 1").select("key", F.col("h.class").alias("hub"), *[F.col(f"h.{c}").alias(f"hub_{c}") for c in ("s", "low", "high")])
    rows = keyed.join(hubs, "key")
    to_hub = rows.where("class <> hub").select(F.col("class").alias("class_a"), F.col("hub").alias("class_b")).distinct()
    to_hub = materialize(_compared(to_hub, tops), "simhash-hubs")
    rows = rows.join(to_hub.select(F.col("class_a").alias("class"), F.col("class_b").alias("hub"), "n"), ["class", "hub"], "left")
    rows = rows.withColumn("inside", F.coalesce("n", "sh")).withColumn("outside", F.col("sh") - F.col("inside"))
    joined = (F.col("low") == F.col("hub_high")) & (F.col("high") == F.col("hub_low"))  # then all four are the same
    linked = SCALE * F.col("inside") >= F.col("most") + F.col("hub_s") - SLACK
    return to_hub, rows.withColumn("settled", joined | linked).drop("n", "hub", "hub_s", "hub_low", "hub_high")


def _class_pairs(keyed: DataFrame) -> DataFrame:
    """Pairs (class_a, class_b) of one key that may link, are not in one component and not both settled with its hub.

    Two classes share no more than the lesser of their `inside` and the lesser of their `outside`.
    """
    kept = ("class", "low", "high", "s", "inside", "outside", "settled")
    left, right = (keyed.select("key", *[F.col(c).alias(f"{c}_{side}") for c in kept]) for side in "ab")
    apart = (F.col("class_a") < F.col("class_b")) & (F.least("low_a", "low_b") < F.greatest("high_a", "high_b"))
    alike = F.least("s_a", "s_b") >= F.lit(STAGE_LEAST) * F.greatest("s_a", "s_b")
    enough = SCALE * (F.least("inside_a", "inside_b") + F.least("outside_a", "outside_b")) >= F.col("s_a") + F.col("s_b") - SLACK
    met = left.join(right.hint("merge"), "key").where(apart & alike & enough & ~(F.col("settled_a") & F.col("settled_b")))
    return met.select("class_a", "class_b").distinct()


def _by_common(ordered: DataFrame, open_: DataFrame) -> DataFrame:
    """Pairs (a, b) that join what common shingles alone make 0.8 alike.

    Sets that share no rare shingle link where their common shingles, s of them in both, reach 0.8 of their sizes: the
    sum of the sizes is at most 2.25 s. Sets with the same common shingles are a class. If two of a class link, both
    link to its smallest set; if sets of two classes link, so do the smallest sets of the classes, and each of the two
    sets links to the smallest set of that class which allows the largest sizes. So a set meets two others at most,
    and only classes of one band key meet each other: all of them the key's hub, and each other where the hub neither
    joins both nor shows that they share too little.
    """
    mostly = ordered.where(F.size("shared") >= F.lit(STAGE_LEAST) * F.col("s") - SLACK).withColumn("class", F.xxhash64("shared"))
    mostly = materialize(mostly.select("node", "s", "class", "shared"), "simhash-mostly")
    members = mostly.select("node", "s", "class")
    least = mostly.groupBy("class").agg(F.min(F.struct("s", "node")).alias("r"), F.max("s").alias("most"), F.max(F.size("shared")).alias("sh"))
    least = least.select("class", F.col("r.s").alias("s"), F.col("r.node").alias("rep"), "most", "sh")
    own = members.join(least.drop("s"), "class").select("node", "rep")
    tops = least.join(mostly.select(F.col("node").alias("rep"), "shared"), "rep")
    keyed = open_.join(members.select("node", "class"), "node")
    states = keyed.groupBy("class").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    keyed = keyed.select("key", "class").distinct().join(states, "class").join(least.drop("rep"), "class")
    to_hub, keyed = _beside_hubs(materialize(keyed, "simhash-keyed"), tops)
    met = to_hub.unionByName(_compared(_class_pairs(materialize(keyed, "simhash-beside")), tops)).withColumn("both", SCALE * F.col("n"))
    met = materialize(met.where(F.col("both") >= F.col("s_a") + F.col("s_b") - SLACK), "simhash-classes")
    ways = [
        met.select(F.col(f"class_{x}").alias("class"), F.struct((F.col("both") - F.col(f"s_{y}")).alias("room"), F.col(f"rep_{y}").alias("rep")).alias("way"))
        for x, y in ("ab", "ba")
    ]
    best = ways[0].unionByName(ways[1]).groupBy("class").agg(F.max("way").alias("way"))
    other = members.join(best, "class").where(F.col("s") <= F.col("way.room") + SLACK).select("node", F.col("way.rep").alias("rep"))
    found = own.unionByName(other).unionByName(met.select(F.col("rep_a").alias("node"), F.col("rep_b").alias("rep"))).where("node <> rep")
    return found.select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct()


def _by_prints(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) not in one component whose fingerprints differ in three bits at most."""
    # Every fingerprint stands for its smallest node, which the other nodes with that fingerprint meet too.
    prints = materialize(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "simhash-prints")
    same = nodes.join(prints, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    near = links(prints).join(prints.select(F.col("fp").alias("a"), F.col("rep").alias("_a")), "a")
    near = near.join(prints.select(F.col("fp").alias("b"), F.col("rep").alias("_b")), "b")
    near = near.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).unionByName(same)
    root_a, root_b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b"))
    return near.join(root_a, "a").join(root_b, "b").where("root_a <> root_b").select("a", "b")


def near_copies(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """doc_id, row (hash of the row) and root (names the group) of each row of (doc_id, text, ...).

    Two documents link where their sets of five-word shingles have a Jaccard similarity of 0.8 or more; groups are what
    links reach. Every link is checked on the sets themselves. To be checked, two sets must meet: by one of 24 bands of
    five least hashes (at 0.8 all bands miss 7 pairs in 100,000, fewer above) or by fingerprints of three or fewer
    differing bits. Equal sets are one node. All nodes of a band key meet its hub. Where that leaves a key with nodes of
    several components, sets meet by their rarest shingles (the first fifth in order of rarity, in at most `common`
    sets), and what they share beyond is settled class by class (`_by_common`): no link between nodes of one key is
    lost, however many have it, and `common` only shifts work between the two ways. What can still grow with the square
    of a crowd is the number of its different sets of common shingles that their key's hub neither joins nor rules out.

    Null and empty texts have the empty set and are copies of each other; null and repeated ids keep their rows; a long
    text is one set; rows that repeat come as often; an empty table gives no rows; other columns count in `row` alone.
    """
    rows = materialize(_signed(docs), "simhash-rows")
    nodes = materialize(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("keys").alias("keys")), "simhash-nodes")
    met = materialize(_met(nodes), "simhash-met")
    tried = materialize(_with_hub(met), "simhash-tried")
    sets = materialize(_sets(docs, rows, tried), "simhash-sets")
    linked = materialize(similar(sets, tried), "simhash-linked")
    roots = materialize(components(nodes.select("node"), linked, "simhash"), "simhash-roots")
    open_ = materialize(_open(met, roots), "simhash-open")
    left = sets.join(open_.select("node").distinct(), "node", "left_semi")
    ordered = materialize(_ordered(left, common), "simhash-ordered")
    more = _by_rare(ordered, roots).unionByName(_by_common(ordered, open_)).distinct().join(tried, ["a", "b"], "left_anti")
    linked = linked.unionByName(similar(sets, more))
    prints = materialize(_by_prints(nodes, roots).join(tried, ["a", "b"], "left_anti"), "simhash-near")
    if prints.take(1):
        linked = linked.unionByName(similar(_sets(docs, rows, prints), prints))
    roots = components(nodes.select("node"), linked, "simhash")
    return rows.select("doc_id", "row", "node").join(roots, "node").select("doc_id", "row", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near-duplicates: one row of each group of `near_copies`, all columns kept.

    Of a group it is the row with the smallest doc_id (null last), then the smallest hash of all columns, whatever
    other groups have that doc_id. A row that comes several times in all columns is one row then.
    """
    found = materialize(near_copies(docs), "simhash-found")
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("r"))
    first = least.select(F.col("r.doc_id").alias("_kept"), F.col("r.row").alias("_kept_row"))
    named = docs.withColumn("_row", _row_hash(docs))
    kept = named.join(first, (F.col("_row") == F.col("_kept_row")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_kept")), "left_semi")
    repeated = found.groupBy("doc_id", "row").count().where("count > 1").limit(1).count()
    kept = kept.dropDuplicates(["doc_id", "_row"]) if repeated else kept
    return kept.select(*[F.col(f"`{name}`") for name in docs.columns])
