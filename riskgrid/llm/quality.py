"""Quality of documents by co-training.

Two views of a document, each with a classifier of its own: what the text says (hashed character n-grams, how words
repeat) and what the page around it tells (source, language, stated length, layout). Both learn from labelled
documents; then, in rounds, each labels the unlabelled documents it is surest of for the other to learn from. At the
end each view is calibrated on labelled documents that neither has learned from, and the two are averaged.

Only the labelled sample is bounded. The views of all documents are written once; a round is one pass over those of all
unlabelled documents that counts them by score, from which the thresholds of the surest follow, and a few Newton
steps, each a pass that sums gradient and curvature. What a document has been told is not stored: it follows from the
models and thresholds of the rounds before, so a pass needs the stored views only and may be repeated anywhere.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrid.llm.common import give_back
from riskgrid.session import materialize

BUCKETS_BITS = 9
SIZES = (1, 2, 3)
FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)
PIECE = 1 << 18
NAMES = 16  # buckets for sources, and as many for languages

MOST_LABELLED = 2_000  # labelled documents of each class that the classifiers are fitted on
ROUNDS, SHARE, SURE = 5, 0.05, 0.95
PENALTY, LEAST_CURVE = 3e-3, 0.05
FIRST_STEPS, STEPS = 15, 2  # Newton steps on the labelled rows alone, and in each round
BINS, BOUND = 8_192, 30.0  # of raw scores, which thresholds are cut from
TASKS, FAN = 4_096, 64  # most tasks of a pass; partial sums that are added at once
PIECE_ROWS = 65  # of a curvature matrix
SALTS = 16


# ------------------------------------------------------------------ views


def text_view(text: str) -> np.ndarray:
    """Square roots of the shares of hashed character n-grams (case and signs kept), and how words repeat."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts, most = np.zeros(1 << BUCKETS_BITS, np.int64), max(SIZES)
    for at in range(0, len(codes), PIECE):
        part = codes[at : at + PIECE + most - 1]
        for n in SIZES:
            stop = min(PIECE, len(codes) - at, len(part) - n + 1)
            if stop <= 0:
                continue
            h = np.full(stop, FACTORS[3] * np.uint32(n), np.uint32)
            for k in range(n):
                h += part[k : k + stop] * FACTORS[k]
                h ^= h >> np.uint32(15)
                h *= FACTORS[3]
            counts += np.bincount(h >> np.uint32(32 - BUCKETS_BITS), minlength=1 << BUCKETS_BITS)
    words = text.split()
    often = Counter(words)
    n = max(1, len(words))
    pairs = len(set(zip(words, words[1:])))
    same = sum(map(eq, words, words[1:])) / n
    repeats = [len(often) / n, max(often.values(), default=0) / n, same, np.sqrt(same), same > 0.2, pairs / n, len(often) / np.sqrt(n)]
    return np.concatenate([np.sqrt(counts / max(1, counts.sum())), repeats]).astype(np.float32)


def page_view(text: str, lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """Source and language (hashed names, null apart), length, and the layout of the page: lines, capitals, digits, signs,
    and how far it compresses."""
    found = np.zeros(2 * (NAMES + 1) + 11, np.float32)
    for k, name in enumerate((source, lang)):
        found[k * (NAMES + 1) + (NAMES if name is None else zlib.crc32(name.encode("utf-8", "replace")) % NAMES)] = 1
    raw = text.encode("utf-8", "replace")
    octets = np.frombuffer(raw, np.uint8)
    packed = len(zlib.compress(raw, 1))
    n, kinds = max(1, len(octets)), np.bincount(octets, minlength=256)
    lines = kinds[10] + 1
    signs = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()
    stated = float(n_chars) if n_chars is not None and n_chars == n_chars and n_chars >= 0 else 0.0
    found[-11:] = [
        np.log1p(len(octets)),
        np.log1p(stated),
        np.log1p(lines),
        np.log1p(n / lines),
        kinds[65:91].sum() / n,
        kinds[48:58].sum() / n,
        signs / n,
        (kinds[9:14].sum() + kinds[32]) / n,
        kinds[128:].sum() / n,
        packed / n,
        np.log(packed / (n + 8)),
    ]
    return found


# ------------------------------------------------------------------ classifiers


@dataclass
class Logistic:
    """Logistic regression on standardised inputs, classes weighted alike."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the bias
    slope: float = 1.0  # of the calibration
    shift: float = 0.0

    @classmethod
    def blank(cls, mean: np.ndarray, scale: np.ndarray) -> "Logistic":
        return cls(mean, scale, np.zeros(len(mean) + 1))

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.ones((len(x), len(self.mean) + 1))
        z[:, :-1] = np.clip((x - self.mean) / self.scale, -5, 5)
        return z

    def slopes(self, x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the loss of rows that weigh share[0] or share[1], by class. Curvature has a floor, so a
        step falls short of the optimum rather than beyond it."""
        z, w = self.inputs(x), np.where(y > 0.5, share[1], share[0])
        p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
        return z.T @ (w * (p - y)), z.T @ ((w * np.maximum(p * (1 - p), LEAST_CURVE))[:, None] * z)

    def step(self, gradient: np.ndarray, curve: np.ndarray) -> None:
        penalty = np.full(len(self.weights), PENALTY)
        penalty[-1] = 1e-9
        self.weights = self.weights - np.linalg.solve(curve + np.diag(penalty), gradient + penalty * self.weights)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weights

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Slope and shift that fit the labels best, by Newton steps; targets are drawn in a little, so both stay finite."""
        r = self.raw(x)
        good, bad = weight[y > 0.5].sum(), weight[y <= 0.5].sum()
        target = np.where(y > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))
        theta, design = np.array([1.0, 0.0]), np.stack([r, np.ones(len(r))], 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
            gradient = design.T @ (weight * (p - target)) + 1e-3 * (theta - [1.0, 0.0])
            curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            step = np.linalg.solve(curve, gradient)
            theta = theta - np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.shift = max(1e-3, float(theta[0])), float(theta[1])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.shift, -30, 30)


@dataclass(frozen=True)
class Model:
    text: Logistic
    page: Logistic


def bins(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw + BOUND) * (BINS / (2 * BOUND)), 0, BINS - 1).astype(np.int64)


@dataclass(frozen=True)
class Teacher:
    """A view's model of one round: it tells the other view `good` from bin `high` on, `bad` up to bin `low`."""

    model: Logistic
    high: int
    low: int


Views = tuple[np.ndarray, np.ndarray]
Taught = tuple[list[Teacher], list[Teacher]]


def told(x: np.ndarray, teachers: list[Teacher]) -> np.ndarray:
    """1, 0 or NaN: what the rounds so far have told about rows with this view; the first round that did so holds."""
    found = np.full(len(x), np.nan)
    for t in reversed(teachers):
        at = bins(t.model.raw(x))
        found = np.where(at >= t.high, 1.0, np.where(at <= t.low, 0.0, found))
    return found


def count_bins(views: Views, models: list[Logistic], taught: Taught) -> list[np.ndarray]:
    """For each view, rows by score among those it has told nothing about."""
    return [np.bincount(bins(m.raw(x))[np.isnan(told(x, t))], minlength=BINS).astype(float) for x, m, t in zip(views, models, taught)]


def sum_slopes(views: Views, models: list[Logistic], taught: Taught, shares: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view, gradient and curvature over the rows that the other has told it about."""
    found = []
    for own, other in ((0, 1), (1, 0)):
        y = told(views[other], taught[other])
        rows = ~np.isnan(y)
        found.append(models[own].slopes(views[own][rows], y[rows], shares[own]))
    return found


class HeldPool:
    """Unlabelled rows in memory: the plain form of the passes, for small tables and as the test of those on Spark."""

    def __init__(self, views: Views):
        self.views, self.n = views, len(views[0])

    def count_bins(self, *given) -> list[np.ndarray]:
        return count_bins(self.views, *given)

    def sum_slopes(self, *given) -> list[tuple[np.ndarray, np.ndarray]]:
        return sum_slopes(self.views, *given)


def thresholds(counts: np.ndarray, quota: int, sure: float) -> tuple[int, int]:
    """First bin that is told good and last one told bad: whole bins from either end, as many as hold `quota` rows (the first
    with any rows always), none less sure than `sure`. Rows of one score are told together."""

    def reach(ordered: np.ndarray) -> int:
        sums = np.cumsum(ordered)
        first = int(np.searchsorted(sums, 1))
        return max(first + 1, int(np.searchsorted(sums, quota, "right")))

    edge = np.log(sure / (1 - sure))
    high = max(BINS - reach(counts[::-1]), int(bins(np.array([edge]))[0]) + 1)
    return high, min(reach(counts) - 1, int(bins(np.array([-edge]))[0]) - 1)


def co_train(views: Views, y: np.ndarray, prior: float, pool, moments: list[tuple[np.ndarray, np.ndarray]] | None = None, rounds: int = ROUNDS, share: float = SHARE, sure: float = SURE) -> Model | None:
    """Fits both views on labelled rows (`y` is 1 or 0) and on what they tell each other about the rows of `pool`.

    `prior` is the share of good ones among all labelled documents; `moments` has mean and scale of the inputs of each view
    (of the labelled rows if not given). A quarter of the labelled rows, every fourth of each class, is kept for
    calibration. In each round each view hands the other its surest rows, about `share` of the pool for each class,
    with a probability of `sure` or more. None where a class has fewer than eight rows.
    """
    if min((y == 0).sum(), (y == 1).sum()) < 8:
        return None
    held = np.concatenate([np.flatnonzero(y == c)[::4] for c in (0, 1)])
    seeds = np.setdiff1d(np.arange(len(y)), held)
    moments = moments or [(x.mean(0), x.std(0) + 1e-6) for x in views]
    models = [Logistic.blank(*m) for m in moments]
    own = np.array([(y[seeds] == c).sum() for c in (0, 1)], float)
    for x, model in zip(views, models):
        for _ in range(FIRST_STEPS):
            model.step(*model.slopes(x[seeds], y[seeds], 0.5 / own))
    taught: Taught = ([], [])
    given = [np.zeros(2), np.zeros(2)]  # rows each view has been told about, by class
    quota = max(1, int(share * pool.n))
    for _ in range(rounds if pool.n else 0):
        for k, counts in enumerate(pool.count_bins(models, taught)):
            high, low = thresholds(counts, quota, sure)
            given[1 - k] += [counts[: max(0, low + 1)].sum(), counts[high:].sum()]
            taught[k].append(Teacher(replace(models[k]), high, low))
        shares = [0.5 / (own + g) for g in given]
        for _ in range(STEPS):
            for x, model, weight, (gradient, curve) in zip(views, models, shares, pool.sum_slopes(models, taught, shares)):
                more, bent = model.slopes(x[seeds], y[seeds], weight)
                model.step(gradient + more, curve + bent)
    # Classes were sampled apart; weights bring their shares back.
    truth = y[held]
    weight = np.where(truth > 0.5, prior / max(1, (truth > 0.5).sum()), (1 - prior) / max(1, (truth <= 0.5).sum())) * len(held)
    for x, one in zip(views, models):
        one.calibrate(x[held], truth, weight)
    return Model(*models)


# ------------------------------------------------------------------ Spark side


def _columns(docs: DataFrame) -> list[Column]:
    """text, lang, source and n_chars, null where the table has no such column."""
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "double"}
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]


def both_views(text: str | None, lang: str | None, source: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """The views as they are stored: two bytes a number."""
    return text_view(text or "").astype(np.float16), page_view(text or "", lang, source, n_chars).astype(np.float16)


VIEWS = "id long, a binary, b binary"


def view_table(docs: DataFrame) -> DataFrame:
    """(id, a, b): both views of each row of `docs`, written once; a little over a kilobyte a row, whatever the text's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [both_views(*(c.as_py() for c in row)) for row in zip(*(part.column(k) for k in range(1, 5)))]
                cols = [pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["id", "a", "b"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), *_columns(docs))
    return materialize(rows.mapInArrow(run, VIEWS), "quality-views")


def _stacked(column: pa.Array | list) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_py() if isinstance(v, pa.Scalar) else v, np.float16) for v in column]).astype(np.float64)


def summed(table: DataFrame, work: Callable[[Views], list[np.ndarray]]) -> list[np.ndarray]:
    """The sum of the arrays that `work` makes of the views of a table, slice by slice.

    A task adds up its own slices and gives out one row for each `PIECE_ROWS` rows of an array; rows are added `FAN`
    by `FAN`, so no task holds more than that many, and only the sums come to the driver. Their size is that of the
    models, whatever the table's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = work((_stacked(part.column(0)), _stacked(part.column(1))))
                total = found if total is None else [t + f for t, f in zip(total, found)]
        rows = [(k, j, row) for k, t in enumerate(total or []) for j, row in enumerate(_pieces(t))]
        part = TaskContext.get().partitionId()
        columns = [[r[0] for r in rows], [r[1] for r in rows], [part] * len(rows), [r[2].tobytes() for r in rows], [str(r[2].shape[1:]) for r in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SUM_TYPES)], SUM_NAMES)

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = np.sum([np.frombuffer(v.as_py(), np.float64) for v in table.column("v")], axis=0)
        return table.slice(0, 1).set_column(3, "v", pa.array([total.tobytes()], pa.binary()))

    rows = table.select("a", "b").coalesce(TASKS).mapInArrow(run, SUM_SCHEMA)
    rows = rows.groupBy("k", "j", F.expr(f"part div {FAN}")).applyInArrow(add, SUM_SCHEMA).groupBy("k", "j").applyInArrow(add, SUM_SCHEMA)
    found: dict[int, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["k"], r["j"])):
        tail = tuple(int(n) for n in r["shape"].strip("(),").split(",") if n.strip())
        found.setdefault(r["k"], []).append(np.frombuffer(r["v"], np.float64).reshape(-1, *tail))
    return [np.concatenate(found[k]) for k in sorted(found)]


def _pieces(total: np.ndarray) -> list[np.ndarray]:
    return [total[at : at + PIECE_ROWS] for at in range(0, len(total), PIECE_ROWS)] if total.ndim > 1 else [total]


SUM_SCHEMA = "k int, j int, part int, v binary, shape string"
SUM_NAMES = [c.split()[0] for c in SUM_SCHEMA.split(", ")]
SUM_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]


class SparkPool:
    """Unlabelled rows of a table of views."""

    def __init__(self, table: DataFrame):
        self.table, self.n = table, table.count()

    def count_bins(self, *given) -> list[np.ndarray]:
        return summed(self.table, lambda views: count_bins(views, *given))

    def sum_slopes(self, *given) -> list[tuple[np.ndarray, np.ndarray]]:
        a, b, c, d = summed(self.table, lambda views: [x for pair in sum_slopes(views, *given) for x in pair])
        return [(a, b), (c, d)]


def moments(table: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and scale of each input of both views, over all rows."""
    n, *sums = summed(table, lambda views: [np.array([float(len(views[0]))]), *(x for v in views for x in (v.sum(0), (v * v).sum(0)))])
    found = []
    for once, twice in (sums[:2], sums[2:]):
        mean = once / n
        found.append((mean, np.sqrt(np.maximum(twice / n - mean * mean, 0)) + 1e-6))
    return found


def majority(labels: DataFrame) -> DataFrame:
    """(id, y): 1 or 0 of each labelled id; the majority of several labels, good on a tie."""
    votes = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
    return votes.agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("double").alias("y"))


def sample(table: DataFrame, votes: DataFrame, most: int = MOST_LABELLED) -> tuple[DataFrame, float | None]:
    """(y, a, b) of a bounded sample of labelled rows, and the share of good ones among all labelled ids of the table.

    Of each class the `most` ids that come first by a hash; only ids are joined before, which bounds what is broadcast.
    Rows that repeat an id do not enlarge the sample.
    """
    known = votes.join(table.select("id").hint("merge"), "id", "left_semi")  # ids of all rows: never to the driver
    order = [F.xxhash64("id"), "id"]
    chosen = known.where("y = 1").orderBy(*order).limit(most).unionByName(known.where("y = 0").orderBy(*order).limit(most))
    rows = table.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id", "a", "b").limit(2 * most)
    return rows.select("y", "a", "b"), known.agg(F.avg("y")).first()[0]


def unlabelled(table: DataFrame, votes: DataFrame) -> DataFrame:
    """Rows of a table of views whose id has no label, null ids among them; written once. Rows of one id go to several
    tasks, so an id that a third of all rows have is no hot key.

    Labelled ids are multiplied for that, which the planner does not see: without the hint it would broadcast them."""
    spread = votes.select("id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = table.where("id IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)).cast("int"))
    free = rows.join(spread.hint("merge"), ["id", "salt"], "left_anti").select("id", "a", "b")
    return materialize(free.unionByName(table.where("id IS NULL")), "quality-unlabelled")


def train(table: DataFrame, labels: DataFrame) -> Model | None:
    """Co-trained model of a table of views and of (doc_id, quality); None without enough labels."""
    votes = majority(labels)
    rows, prior = sample(table, votes)
    got = rows.collect()
    if not got or prior is None:
        return None
    # Rows come back in any order; the fit must not depend on it.
    got = sorted(got, key=lambda r: (zlib.crc32(r["a"]), bytes(r["a"]), bytes(r["b"]), r["y"]))
    y = np.array([r["y"] for r in got])
    if min((y == 0).sum(), (y == 1).sum()) < 8:
        return None
    views = tuple(_stacked([r[c] for r in got]) for c in ("a", "b"))
    return co_train(views, y, prior, SparkPool(unlabelled(table, votes)), moments(table))


RESULT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("text_score", "page_score", "score")])


def score_views(model: Model, views: Views) -> np.ndarray:
    """Text score, page score and their mean in log-odds, a row each."""
    a, b = model.text.logit(views[0]), model.page.logit(views[1])
    return 1 / (1 + np.exp(-np.stack([a, b, (a + b) / 2], 1)))


def assess(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, text_score, page_score, score and keep of each row of (doc_id, text, lang, source, n_chars).

    Scores are probabilities of good quality by the text view, by the page view, and by both (mean of log-odds);
    `keep` is score >= `least`. Null and empty texts are scored like any other, by what is left of them. Without
    labels of both classes nothing can be learned: scores are null and everything is kept. Rows that repeat are
    scored alike; an empty table gives no rows; other columns are ignored.
    """
    table = view_table(docs)
    model = train(table, labels)
    if model is None:
        empty = [F.lit(None).cast("double").alias(c) for c in RESULT.names]
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *empty, F.lit(True).alias("keep"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = score_views(held.value, (_stacked(part.column(1)), _stacked(part.column(2))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in found.T)], ["doc_id", *RESULT.names])

    schema = "doc_id long, " + ", ".join(f"{n} double" for n in RESULT.names)
    return table.mapInArrow(run, schema).withColumn("keep", F.col("score") >= least)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs` with a score of `least` or more, all columns kept, whatever their names.

    Null and empty texts are judged like any other; rows that repeat are judged alike, null ids too. Without labels of
    both classes, and on an empty table, nothing is dropped.
    """
    model = train(view_table(docs), labels)
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.Series:
        found = np.empty(len(text), bool)
        for at in range(0, len(text), 256):
            part = [both_views(*row) for row in zip(*(c.iloc[at : at + 256] for c in (text, lang, source, n_chars)))]
            views = tuple(np.stack([p[k] for p in part]).astype(np.float64) for k in (0, 1))
            found[at : at + len(part)] = score_views(held.value, views)[:, 2] >= least
        return pd.Series(found)

    return docs.where(good(*_columns(docs)))
