"""Fingerprints under which likeness by edit distance shows as agreement, place by place.

A walk reads a text from the left. At each step it puts out the character it stands on, and a bit that depends on the
step and the character alone, shared by all texts, says whether it moves on. Two texts that agree up to some place
walk alike; after an insertion or a deletion their walks meet again after few steps, so a small edit distance becomes
a small Hamming distance of what they put out. A fingerprint samples that output at fixed random steps of two scales:
the smallest power of two that holds the whole walk, and the next, so that texts of like length share one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.llm.common import components
from riskgrid.llm.sharding import rank_among
from riskgrid.session import materialize

SEED = 20_24
PERIOD = 4096  # steps after which the shared bits repeat
CLASSES = 64  # characters are hashed into so many
SAMPLES = 128  # steps sampled at each scale
LEAST_SCALE = 5
FEW = 24  # so many walks or fewer are followed one by one
BATCH = 2_000_000  # characters whose walks are held at once
RANGE_BYTES, MOST_RANGES = 16 << 20, 10_000
FIRST_ID = -(1 << 63)
DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


@lru_cache(maxsize=1)
def dwell() -> np.ndarray:
    """For each class and step, after how many steps the walk moves on. Every class moves at some step."""
    bits = np.random.default_rng(SEED).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8).astype(bool)
    bits[:, 0] = True
    steps, found = np.arange(2 * PERIOD), np.empty((CLASSES, PERIOD), np.int32)
    for c in range(CLASSES):
        moves = np.flatnonzero(np.tile(bits[c], 2))
        found[c] = moves[np.searchsorted(moves, steps[:PERIOD])] - steps[:PERIOD] + 1
    return found


@lru_cache(maxsize=64)
def sampled_steps(scale: int) -> np.ndarray:
    """The steps below 2 ** scale that all fingerprints of that scale look at, in rising order."""
    return np.sort(np.random.default_rng([SEED, scale]).integers(0, 1 << scale, SAMPLES))


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((codes * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.uint8)


def walk(texts: list[np.ndarray], starts: list[int]) -> list[np.ndarray]:
    """For each text, the step at which the walk comes to each character, and the step after the last; a text's walk
    begins at its start. All texts walk side by side, long ones first; the last few are followed one by one."""
    table = dwell()
    flat, rows, mask = table.ravel(), table.tolist(), PERIOD - 1
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    found = [np.empty(len(t) + 1, np.int32) for t in texts]
    # The walks of all but the few longest end together at most where the longest of them does.
    together = int(lengths[order[FEW]]) if len(texts) > FEW else 0
    at = np.array(starts, np.int32)[order]
    if together:
        active = np.searchsorted(-lengths[order], -np.arange(together), side="left")  # longer than i
        offset = np.concatenate([[0], np.cumsum(active)])
        laid = np.empty(offset[-1], np.int32)
        for rank, k in enumerate(order):
            own = min(len(texts[k]), together)
            laid[offset[:own] + rank] = texts[k][:own]
        laid *= PERIOD
        steps = np.empty(offset[-1], np.int32)
        for i in range(together):
            n, a = active[i], offset[i]
            now = at[:n]
            steps[a : a + n] = now
            now += flat[laid[a : a + n] + (now & mask)]
        for rank, k in enumerate(order):
            own = min(len(texts[k]), together)
            found[k][:own] = steps[offset[:own] + rank]
    for rank, k in enumerate(order):
        step, first = int(at[rank]), min(len(texts[k]), together)
        rest = []
        for c in texts[k][first:].tolist():
            rest.append(step)
            step += rows[c][step & mask]
        found[k][first:-1] = rest
        found[k][-1] = step
    return found


def fingerprint(codes: np.ndarray, steps: np.ndarray) -> str:
    """Scale (two hex digits) and a sign for each sampled step of that scale and the next: a digit of the character
    the walk puts out there, or - beyond its end. An empty text has the least scale and no digit."""
    end = int(steps[-1])
    scale = max(LEAST_SCALE, (end - 1).bit_length() if end else 0)
    signs = []
    for s in (scale, scale + 1):
        at = sampled_steps(s)
        place = np.searchsorted(steps, at, side="right") - 1
        inside = at < end
        row = np.full(SAMPLES, ord("-"), np.uint8)
        if len(codes):
            row[inside] = DIGITS[(codes[place[inside]] ^ (codes[place[inside]] >> 4)) & 15]
        signs.append(row.tobytes().decode())
    return f"{scale:02x}{signs[0]}{signs[1]}"


def likeness(a: str, b: str) -> float:
    """Share of the sampled steps, of those that either text reaches, at which both put out the same. 0 where the
    scales are two or more apart: one text is over twice as long. Two empty texts are alike."""
    low, high = (a, b) if a[:2] <= b[:2] else (b, a)
    apart = int(high[:2], 16) - int(low[:2], 16)
    if apart > 1:
        return 0.0
    x = np.frombuffer(low[2 + apart * SAMPLES : 2 + (apart + 1) * SAMPLES].encode(), np.uint8)
    y = np.frombuffer(high[2 : 2 + SAMPLES].encode(), np.uint8)
    reached = (x != 45) | (y != 45)
    return float(((x == y) & reached).sum() / reached.sum()) if reached.any() else 1.0


def _prints(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[str]]:
    codes = [classes(t) for t in texts]
    steps = walk(codes, [0] * len(codes))
    return codes, steps, [fingerprint(c, s) for c, s in zip(codes, steps)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of each row of (doc_id, text); null is an empty text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            at = 0
            for i, text in enumerate(batch.column(1)):
                held.append(text.as_py() or "")
                n += len(held[-1])
                if n >= BATCH or i + 1 == batch.num_rows:
                    sizes = pa.array([len(t) for t in held], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), sizes, pa.array(_prints(held)[2])], ["doc_id", "n_chars", "fingerprint"])
                    at, held, n = i + 1, [], 0

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


# ------------------------------------------------------------------ neighbours in id order

OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edit_rows(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for all texts but the last, each edited with the one after it."""
    codes, steps, prints = _prints(texts)
    tails, kept, edits = [], [], []
    for k in range(len(ids) - 1):
        n = len(texts[k])
        put = texts[k + 1][: n // 3]
        kept.append(n - n // 3)
        tails.append(classes(put))
        edits.append(texts[k][: kept[-1]] + put)
    # The edited text walks like the text up to the cut, and goes on from there.
    rest = walk(tails, [int(steps[k][kept[k]]) for k in range(len(tails))])
    edited = [
        fingerprint(np.concatenate([codes[k][: kept[k]], tails[k]]), np.concatenate([steps[k][: kept[k]], rest[k]])) for k in range(len(tails))
    ]
    columns = [
        pa.array(ids[:-1], pa.int64()),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(e.encode("utf-8", "replace")).hexdigest() for e in edits], pa.string()),
        pa.array(prints[:-1], pa.string()),
        pa.array(edited, pa.string()),
        pa.array([likeness(a, b) for a, b in zip(prints, edited)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(prints, prints[1:])], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT.split(", ")])


def edit_study(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and the likeness to that and to the next row's.

    Edited: the last third (rounded down) of the characters is replaced by as many of the first of the next document,
    or all it has. Next: in descending doc_id, then by text, null last; after the last comes the first, so a lone row
    is its own next. Null texts are empty; rows that repeat are rows of their own; an empty table gives no rows; other
    columns are ignored.

    Texts are shuffled once: rows go by ranges of doc_id, and the first row of each range is sent to the range before
    it too, so every row finds its next in its own range. A range is read as a sorted stream; no more than some
    characters of it are held at a time.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("key"))
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    ranges = int(min(MOST_RANGES, max(1, total // range_bytes)))
    shares = [k / ranges for k in range(1, ranges)]
    cuts = sorted(set(rows.select(F.percentile_approx("key", shares, 20 * MOST_RANGES)).first()[0] or [])) if shares else []
    ranged = rows.withColumn("range", rank_among(cuts, F.col("key")))
    # First of a range in descending order: its largest id. Its row also ends the range above, the first of all the lowest.
    firsts = {r["range"]: r["first"] for r in ranged.groupBy("range").agg(F.max("key").alias("first")).collect()}
    full = sorted(firsts)
    above = {r: full[(k + 1) % len(full)] for k, r in enumerate(full)}
    size = (max(full) if full else 0) + 1
    first_of = F.array(*[F.lit(firsts.get(r, FIRST_ID)).cast("long") for r in range(size)])
    sent_to = F.array(*[F.lit(above.get(r, 0)) for r in range(size)])
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("ahead"))
    also = F.struct(F.get(sent_to, F.col("range")).alias("range"), F.lit(1).alias("ahead"))
    is_first = F.col("key") == F.get(first_of, F.col("range"))
    dealt = ranged.withColumn("to", F.explode(F.when(is_first, F.array(own, also)).otherwise(F.array(own))))
    dealt = dealt.select("to.range", "to.ahead", "key", "doc_id", "text").repartition("range")
    dealt = dealt.sortWithinPartitions("range", "ahead", F.desc("key"), "text").select("range", "ahead", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, texts, n, ended = None, [], [], 0, False
        for batch in batches:
            for r, ahead, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if r != at:
                    if len(ids) > 1:
                        yield _edit_rows(ids, texts)
                    at, ids, texts, n, ended = r, [], [], 0, False
                if ended:
                    continue  # further rows of the doc_id that begins the next range
                ids.append(doc)
                texts.append(text.as_py())
                n += len(texts[-1])
                ended = ahead == 1
                if n >= BATCH and len(ids) > 1:
                    yield _edit_rows(ids, texts)
                    ids, texts, n = ids[-1:], texts[-1:], len(texts[-1])
        if len(ids) > 1:
            yield _edit_rows(ids, texts)

    return dealt.mapInArrow(run, OUT)


# ------------------------------------------------------------------ near-duplicates


@lru_cache(maxsize=4)
def orders(bands: int) -> np.ndarray:
    """For each band an order of the sampled steps."""
    return np.argsort(np.random.default_rng([SEED, 1]).random((bands, SAMPLES)), axis=1)


def band_keys(print_: str, bands: int, width: int) -> list[int]:
    """A hash of `width` signs for each band and each of the two scales, equal for texts that agree there. A band takes
    the first steps of its order that lie inside the text, so what is beyond the end never makes texts meet."""
    scale, found, order = int(print_[:2], 16), [], orders(bands)
    for k in range(2):
        signs = np.frombuffer(print_[2 + k * SAMPLES : 2 + (k + 1) * SAMPLES].encode(), np.uint8)[order]
        first = np.argsort(signs == 45, axis=1, kind="stable")[:, :width]
        at, taken = np.take_along_axis(order, first, 1), np.take_along_axis(signs, first, 1)
        for band in range(bands):
            name = bytes([scale + k, band % 256, band // 256])
            digest = hashlib.blake2b(name + at[band].astype(np.uint8).tobytes() + taken[band].tobytes(), digest_size=8).digest()
            found.append(int.from_bytes(digest, "little", signed=True))
    return found


def near_groups(prints: DataFrame, least: float = 0.8, bands: int = 24, width: int = 8) -> DataFrame:
    """doc_id and class_id (smallest doc_id of its group) of each row of (doc_id, fingerprint).

    Equal fingerprints are one node from the start. Nodes that share a band are candidates, and every candidate is
    verified: likeness of `least` or more links it. At 0.8 a band of eight signs agrees with probability 0.17, so
    one of 24 does with 0.99.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keys = [band_keys(p, bands, width) for p in part.column(1).to_pylist()]
                nodes_ = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array(k, np.int64) for k in keys])), pa.array(nodes_)], ["band", "node"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [likeness(a, b) >= least for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.filter(pa.array(good, pa.bool_())).select([0, 1])

    rows = materialize(prints.select("doc_id", "fingerprint"), "edit-prints")
    nodes = materialize(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.xxhash64("fingerprint").alias("node")), "edit-nodes")
    banded = nodes.select("node", "fingerprint").mapInArrow(keyed, "band long, node long").distinct()
    a, b = banded.alias("a"), banded.alias("b")
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.node") < F.col("b.node")))
    met = met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    prints_of = lambda side: nodes.select(F.col("node").alias(side), F.col("fingerprint").alias(f"print_{side}"))
    pairs = met.join(prints_of("a"), "a").join(prints_of("b"), "b").select("a", "b", "print_a", "print_b")
    links = pairs.mapInArrow(verify, "a long, b long")
    classes_ = nodes.join(components(nodes.select("node"), links, "edit"), "node")
    least_id = classes_.groupBy("root").agg(F.min("first").alias("class_id"))
    return rows.join(classes_.join(least_id, "root").select("fingerprint", "class_id"), "fingerprint").select("doc_id", "class_id")
