"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every training text, by language, in a fixed number of buckets; the counts are summed
by Spark and become one log-probability row for each language. That matrix is broadcast (languages x buckets x 4
bytes, and the number of languages is checked), and texts are scored in numpy, a batch of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 15
SIZES = (1, 2, 3)
SMOOTH = 0.5
MOST_LANGUAGES = 512  # 64 MB of log-probabilities
PIECE = 1 << 18  # letters that are hashed at once
TRUSTED = 30  # n-grams of a text overlap; its score is that of so many independent ones
UNKNOWN = "und"

# Odd multipliers of the n-gram hash, one for each place and one for the length.
FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def buckets(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, piece by piece. Case is dropped, and each run of non-letters is one space; the text
    stands between spaces. Nothing without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return
    before = np.concatenate([[False], is_letter[:-1]])
    codes = np.where(is_letter, codes, np.uint32(32))[is_letter | before]
    tail = [] if codes[-1] == 32 else [32]
    codes = np.concatenate([[32], codes, tail]).astype(np.uint32)
    most = max(SIZES)
    for at in range(0, len(codes), PIECE):
        part = codes[at : at + PIECE + most - 1]
        own = min(PIECE, len(codes) - at)
        found = []
        for n in SIZES:
            stop = min(own, len(part) - n + 1)
            if stop <= 0:
                continue
            h = np.full(stop, FACTORS[3] * np.uint32(n), np.uint32)
            for k in range(n):
                h += part[k : k + stop] * FACTORS[k]
                h ^= h >> np.uint32(15)
                h *= FACTORS[3]
            found.append(h >> np.uint32(32 - BITS))
        yield np.concatenate(found).astype(np.intp)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prob: np.ndarray  # (buckets, languages), float32
    prior: np.ndarray


def train(labelled: DataFrame) -> Model:
    """Model of all rows of (lang, text) with a language; null texts count for the prior only.

    Counting covers every training text. Each task sends at most one row for each language and bucket. Raises when
    there are more languages than the broadcast is sized for. Without any row the model knows no language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = seen.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
                own[-1] += 1  # the last place counts texts
                for part in buckets(text.as_py() or ""):
                    own[:-1] += np.bincount(part, minlength=1 << BITS)
        for lang, own in seen.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(own[used])], ["lang", "bucket", "n"]
            )

    rows = labelled.where("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    found = rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the log-probability matrix is not sized for them")
    languages = sorted(r["lang"] for r in found)
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((len(languages), (1 << BITS) + 1))
    place = {lang: k for k, lang in enumerate(languages)}
    # One language's row at a time keeps the driver to the size of the matrix.
    packed = counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("c"))
    packed = packed.select("lang", F.col("c.bucket").alias("b"), F.col("c.n").alias("n"))
    for row in packed.toLocalIterator():
        table[place[row["lang"]], row["b"]] = row["n"]
    grams, texts = table[:, :-1], table[:, -1]
    log_prob = np.log(grams + SMOOTH) - np.log(grams.sum(1, keepdims=True) + SMOOTH * (1 << BITS))
    prior = np.log(texts + SMOOTH) - np.log(texts.sum() + SMOOTH * max(1, len(languages)))
    return Model(languages, np.ascontiguousarray(log_prob.T, np.float32), prior)


def classify(text: str | None, model: Model) -> tuple[str, float]:
    """Language and probability; `und` with 0 without a letter or without a model. Ties go to the first language."""
    total, n = np.zeros(len(model.languages)), 0
    if text and model.languages:
        for part in buckets(text):
            # Sparse: a text's distinct buckets times how often it has them, then their rows of the matrix.
            counts = np.bincount(part)
            used = np.flatnonzero(counts)
            total += counts[used].astype(np.float32) @ model.log_prob[used]
            n += len(part)
    if not n:
        return UNKNOWN, 0.0
    scaled = model.prior + total * min(1.0, TRUSTED / n)
    odds = np.exp(scaled - scaled.max())
    best = int(np.argmax(total + model.prior))
    return model.languages[best], float(odds[best] / odds.sum())


RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predictor(spark, model: Model):
    """A column function text -> struct(lang_pred, score); the model is broadcast once."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([classify(t, held.value) for t in texts], columns=["lang_pred", "score"])

    return lambda text: predict(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training: a third of all, by the crc32 of its id. Null ids are learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of (doc_id, text, lang).

    Learns from text and non-null lang of the rows that are not held out, and predicts from the text alone. A text
    that is null, empty or without letters is `und` with score 0, and so is every text where nothing could be
    learned. Very long texts are hashed in pieces, whole. Rows that repeat count as often as they come; an empty table
    gives no rows; other columns are ignored.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    predict = predictor(docs.sparkSession, model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text")).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_known(docs: DataFrame, sure: float = 0.99) -> DataFrame:
    """The rows of `docs` whose language is known: not `und`, and not surely (`sure`) another than their own `lang`.

    All columns are kept. Rows without lang go by the text alone.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    predict = predictor(docs.sparkSession, model)
    names = docs.columns
    judged = docs.select("*", predict(F.col("text")).alias("_judged"))
    other = F.coalesce(F.col("_judged.lang_pred") != F.col("lang"), F.lit(False)) & (F.col("_judged.score") >= sure)
    return judged.where((F.col("_judged.lang_pred") != UNKNOWN) & ~other).select(*[F.col(f"`{n}`") for n in names])
