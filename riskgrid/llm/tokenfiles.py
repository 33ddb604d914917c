"""Token ids in byte-aligned files.

Ids are replaced by their rank by frequency over the whole corpus, so that the commonest take one byte. A rank is
written in 1 to 4 bytes, little end first. The lengths stand apart: a control byte has those of four ranks, two bits
each, the first rank in the low bits. So lengths are read from a table of 256 rows, and all ranks of a block at once.

On disk a token store is a folder with two Parquet tables. `ranks` has (rank, id). `blocks` has one row for each block:
part and block (the order), at (ids of the part before it), n_ids, docs (doc_id of each document), counts (ids of each), control and data (bytes).
Blocks follow each other in ascending doc_id order. Spark reads and writes them, wherever the folder is.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgrid.llm import bpe
from riskgrid.llm.sharding import rank_among
from riskgrid.session import scratch_path

BLOCK_IDS, FIRST_ID = 1 << 16, -(1 << 63)
PART_IDS, MOST_PARTS = 1 << 22, 10_000

LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    extra = (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    padded = np.concatenate([extra, np.zeros(-len(extra) % 4, np.uint8)]).reshape(-1, 4)
    control = padded[:, 0] | padded[:, 1] << 2 | padded[:, 2] << 4 | padded[:, 3] << 6
    octets = values.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), octets[np.arange(4) <= extra[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values that `pack` was given."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    octets = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    return (octets[at] | octets[at + 1] << 8 | octets[at + 2] << 16 | octets[at + 3] << 24) & MASKS[lengths]


# ------------------------------------------------------------------ ids


STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "BPE")


class Encoder(bpe.Tokenizer):
    """The tokenizers library. Where its file describes word-level BPE, texts are cut into words as in `bpe`, and the
    library's model is asked once for each word that a worker has not at hand; else it gets whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.no_padding()
        self.tool.no_truncation()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = lambda part, many: [x["type"] for x in (spec.get(part) or {}).get(many, [])]
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        self.by_word = plain and (kinds("normalizer", "normalizers"), kinds("pre_tokenizer", "pretokenizers"), spec["model"]["type"]) == STEPS
        if self.by_word:
            super().__init__(path)
        self.library = self.tool.model
        self.dtype = "<u2" if self.tool.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"

    def tokens(self, letters: str) -> list[int]:
        return [t.id for t in self.library.tokenize(letters)]

    def encode_texts(self, texts: list[str], tail: bytes) -> list[bytes]:
        if self.by_word:
            return [self.encode_bytes(t) + tail for t in texts]
        found = self.tool.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() + tail for e in found]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _slices(batch: pa.RecordBatch, most: int = 500, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of few rows and, unless one row has more, few bytes."""
    at = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
        if i > at and (i - at >= most or total + n > most_bytes):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


def encode(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id and ids (bytes, 2 or 4 for each id as the vocabulary needs) of each row, `end_id` last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer_path)
        tail = np.array([end_id], tool.dtype).tobytes()
        for batch in batches:
            for part in _slices(batch):
                coded = tool.encode_texts([t or "" for t in part.column(1).to_pylist()], tail)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(coded, pa.binary())], ["doc_id", "ids"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids binary")


def vocabulary(tokenizer_path: str) -> tuple[int, str]:
    """Number of ids, and the kind of integer that holds them."""
    tool = encoder(tokenizer_path)
    return tool.tool.get_vocab_size(with_added_tokens=True), tool.dtype


# ------------------------------------------------------------------ store


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, block_ids: int = BLOCK_IDS, part_ids: int = PART_IDS) -> None:
    """Encodes each whole text of (doc_id, text), appends `end_id` and writes a token store at `path`.

    Documents are in ascending doc_id order, null first; rows of one doc_id are in the order of their ids. Null and
    empty texts have the end id alone; an empty table makes a store without blocks. The text is encoded once, the
    ids are dealt out by ranges of doc_id, and only the rank table (one row for each id of the vocabulary) is sent
    to the workers.
    """
    spark = docs.sparkSession
    size, dtype = vocabulary(tokenizer_path)
    interim = scratch_path(spark, "token-ids")
    encode(docs, tokenizer_path, end_id).write.parquet(interim)
    coded = spark.read.schema("doc_id long, ids binary").parquet(interim)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                joined = b"".join(batch.column(0).to_pylist())
                seen += np.bincount(np.frombuffer(joined, dtype), minlength=size)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(seen[used])], ["id", "n"])

    counts = coded.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    order = Window.orderBy(F.desc("n"), "id")
    ranks = counts.select((F.row_number().over(order) - 1).alias("rank"), "id", "n")
    ranks.write.parquet(f"{path}/ranks")
    known = spark.read.schema("rank int, id int, n long").parquet(f"{path}/ranks").collect()
    rank_of = np.zeros(size, np.uint32)
    rank_of[[r["id"] for r in known]] = [r["rank"] for r in known]
    parts = min(MOST_PARTS, max(1, sum(r["n"] for r in known) // part_ids))
    order = F.coalesce("doc_id", F.lit(FIRST_ID))
    shares = [k / parts for k in range(1, parts)]
    cuts = coded.select(F.percentile_approx(order, shares, 20 * MOST_PARTS)).first()[0] if shares else []
    cuts = sorted(set(cuts or []))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, docs_, held, n, at = TaskContext.get().partitionId(), 0, [], [], 0, 0

        def out() -> pa.RecordBatch:
            control, data = pack(rank_of[np.concatenate(held)])
            row = [[part], [block], [at], [n], [docs_], [[len(h) for h in held]], [control], [data]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, BLOCK_TYPES)], BLOCK_NAMES)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(ids.as_py(), dtype)
                if n and n + len(ids) > block_ids:
                    yield out()
                    block, docs_, held, at, n = block + 1, [], [], at + n, 0
                docs_.append(doc)
                held.append(ids)
                n += len(ids)
        if held:
            yield out()

    spread = coded.repartitionById(len(cuts) + 1, rank_among(cuts, order)).sortWithinPartitions("doc_id", F.xxhash64("ids"), "ids")
    spread.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")


BLOCK_SCHEMA = "part int, block int, at long, n_ids long, docs array<long>, counts array<int>, control binary, data binary"
BLOCK_NAMES = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (bytes: little-endian unsigned 32-bit) of each document of a token store.

    `start` counts the ids of all documents before it: those of earlier parts, of earlier blocks of the part (kept with
    each block) and of earlier documents of the block. Only the sums by part are joined to the blocks; there are at
    most 10,000 parts, which bounds what is broadcast. No shuffle.
    """
    known = spark.read.schema("rank int, id int").parquet(f"{path}/ranks").collect()
    id_of = np.zeros(max([1, *(r["rank"] + 1 for r in known)]), np.uint32)
    id_of[[r["rank"] for r in known]] = [r["id"] for r in known]
    stored = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    by_part = stored.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", F.coalesce(before, F.lit(0)).alias("ahead"))
    placed = stored.join(F.broadcast(by_part), "part").select((F.col("ahead") + F.col("at")).alias("first"), "n_ids", "docs", "counts", "control", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                first, n, docs, counts, control, data = (batch.column(i)[row].as_py() for i in range(6))
                ids = id_of[unpack(control, data, n)].astype("<u4")
                ends = np.cumsum(counts)
                starts = ends - counts
                cut = [ids[a:b].tobytes() for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts + first), pa.array(cut, pa.binary())], ["doc_id", "start", "ids"])

    return placed.mapInArrow(run, "doc_id long, start long, ids binary")
