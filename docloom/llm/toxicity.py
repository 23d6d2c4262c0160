"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are positives; all texts of the training fold are unlabelled. A linear model
over hashed words is trained in numpy on the risk
``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))`` with the logistic loss;
where the corrected part turns negative, the step goes against it, as in non-negative PU learning.
The class prior is the share of toxic rows among the labelled ones of the training fold, or, if that is
smaller, the share of unlabelled texts with one of the strongest words by that of positives.

Labels are read only from the training fold: rows whose crc32 of doc_id as text isn't divisible by
``FOLDS``. Inputs of a score are the words of the text alone. Texts are cut into words once, as sets of
hashed words in a stored table. Word counts, the choice of words and the share of texts with a strong
word cover all texts of the fold. Bounded are the positives (``MAX_POSITIVE``, those with the smallest
hashes of doc_id), the unlabelled texts of the gradient steps (about ``MAX_UNLABELLED``, by the same
hash in full width) and the words (``FEATURES``, those with the largest z value of being in more
positives than unlabelled texts); so the model and what reaches the driver have a fixed size. All
documents are scored.

Defined results: null, empty and word-less texts get the score of the bias alone; texts of any length
are read whole; without labelled positives every score is 0; words of equal z are taken by their
hashes; an id with several labels counts as toxic if one says so; repeated rows come out once each, with
equal scores; an empty table gives no rows; other columns aren't read. doc_id must be a number.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, slices, stored, text_of

FOLDS = 5
BUCKETS = 1 << 20
FEATURES = 256
MAX_POSITIVE, MAX_UNLABELLED = 20_000, 40_000
#: A word must be in so many positives, and a word's z value must reach so much.
MIN_POSITIVE, MIN_Z = 8, 6.0
STEPS, RATE, DECAY = 800, 0.1, 4e-5
SEED = 17
#: The words with the largest z values that bound the class prior.
STRONG = 10

#: Non-letters and non-digits of ASCII to spaces, A-Z to lower case.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word, SEED) % BUCKETS
        if len(self) < 500_000:
            self[word] = h
        return h


@lru_cache(maxsize=1)
def _buckets() -> _Buckets:
    return _Buckets()


def bucket_set(text: str) -> np.ndarray:
    """The hashed words of a text, each once, in order."""
    words = set(text.encode("utf-8", "surrogatepass").translate(_WORDS).split())
    return np.unique(np.fromiter(map(_buckets().__getitem__, words), np.int32, len(words)))


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def scores(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of texts whose bucket sets are flat up to each of ends."""
        if not np.isfinite(self.bias):
            return np.zeros(len(ends))
        by_bucket = np.zeros(BUCKETS)
        by_bucket[self.buckets] = self.weights
        row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        z = self.bias + np.bincount(row, by_bucket[flat], len(ends))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    def score(self, text: str) -> float:
        own = bucket_set(text)
        return float(self.scores(own, np.array([len(own)]))[0])


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, n_positive: np.ndarray, n_unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias from distinct 0/1 rows and how often each occurs, by Adam on the non-negative risk."""
    n = positive.shape[1]
    theta = np.zeros(n + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    p, u = (np.hstack([x, np.ones((len(x), 1))]).astype(np.float64) for x in (positive, unlabelled))
    wp, wu = n_positive / n_positive.sum(), n_unlabelled / n_unlabelled.sum()

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    for t in range(1, steps + 1):
        zp, zu = p @ theta, u @ theta
        # Logistic loss: of a positive log(1 + e^-z), of a negative log(1 + e^z).
        negative = wu @ np.logaddexp(0, zu) - prior * (wp @ np.logaddexp(0, zp))
        g_negative = (wu * sigmoid(zu)) @ u - prior * ((wp * sigmoid(zp)) @ p)
        g = g_negative - prior * ((wp * sigmoid(-zp)) @ p) if negative >= 0 else -g_negative
        g[:-1] += DECAY * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta[:-1], float(theta[-1])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def word_sets(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, buckets (the distinct hashed words in order) of every row of docs(doc_id, text), as a stored table."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("buckets", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([bucket_set(t) for t in part.column(2).to_pylist()], schema.field(2).type)], schema=schema)

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of())
    return stored(rows.mapInArrow(run, "doc_id long, held_out boolean, buckets array<int>"), "toxicity-words")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each list ends among them."""
    ends = column.offsets.to_numpy()
    return column.values.to_numpy()[ends[0] : ends[-1]], ends[1:] - ends[0]


def _training(sets: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """doc_id, buckets, positive of all rows of the training fold, and the share of toxic labels."""
    known = labels.filter("toxic is not null and doc_id is not null").select("doc_id", "toxic").filter(~held_out())
    counts = known.agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p")).first()
    prior = min(0.5, max(1e-4, (counts.p or 0) / max(1, counts.n)))
    toxic = known.filter("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_POSITIVE)
    # At most MAX_POSITIVE ids: broadcast, so that no word set is shuffled.
    marked = F.broadcast(toxic.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_toxic")))
    rows = sets.filter(~F.col("held_out")).join(marked, F.col("doc_id") == F.col("_id"), "left")
    return rows.select("doc_id", "buckets", F.coalesce("_toxic", F.lit(False)).alias("positive")), prior


def _share(of: int, n: int) -> Column:
    """Whether a row is among about of of n, by the whole hash of its doc_id."""
    limit = (of << 64) // max(n, of, 1)
    return F.xxhash64("doc_id") < F.lit(limit - (1 << 63)).cast("long") if limit < 1 << 64 else F.lit(True)


def fit_sets(sets: DataFrame, labels: DataFrame, features: int = FEATURES, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    rows, prior = _training(bounded_batches(sets), labels)

    def count(batches):
        own, n = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            positive = batch.column(1).to_numpy(zero_copy_only=False)
            for k, part in enumerate((batch.column(0), batch.column(0).filter(batch.column(1)))):
                own[k] += np.bincount(_flat(part)[0], minlength=BUCKETS)
            n += (len(positive), positive.sum())
        used = np.flatnonzero(own[0])
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used], pa.int64()), *[pa.array([n[k], *own[k, used]], pa.int64()) for k in (0, 1)]], names=["bucket", "u", "p"])

    found = stored(rows.select("buckets", "positive").mapInArrow(count, "bucket long, u long, p long").groupBy("bucket").agg(F.sum("u").alias("u"), F.sum("p").alias("p")), "toxicity-counts")
    total = found.filter("bucket = -1").first()
    if total is None or not total.p:
        return Model(np.zeros(0, np.int64), np.zeros(0), float("-inf"))
    both = (F.col("p") + F.col("u")) / F.lit(float(total.p + total.u))
    z = (F.col("p") / F.lit(float(total.p)) - F.col("u") / F.lit(float(total.u))) / F.sqrt(both * (1 - both) * F.lit(1 / total.p + 1 / total.u))
    best = [r.bucket for r in found.filter(f"bucket >= 0 and p >= {MIN_POSITIVE}").withColumn("z", z).filter(f"z >= {MIN_Z}").orderBy(F.desc("z"), "bucket").limit(features).collect()]
    discard(found)
    buckets = np.array(sorted(best), np.int64)
    place = np.full(BUCKETS, -1)
    place[buckets] = np.arange(len(buckets))
    strong = np.zeros(BUCKETS, bool)
    strong[best[:STRONG]] = True
    schema = pa.schema([("positive", pa.bool_()), ("bits", pa.binary()), ("n", pa.int64()), ("strong", pa.int64())])

    def reduce_(batches):
        for batch in batches:
            flat, ends = _flat(batch.column(0))
            row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            held = np.bincount(row, strong[flat], len(ends)) > 0
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.bool_()), pa.array([None], pa.binary()), pa.array([len(ends)], pa.int64()), pa.array([held.sum()], pa.int64())], schema=schema)
            bits = np.zeros((len(ends), max(1, len(buckets))), np.uint8)
            at = place[flat]
            bits[row[at >= 0], at[at >= 0]] = 1
            positive, near = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            packed = [x.tobytes() for x in np.packbits(bits, axis=1)]
            for side, chosen in ((True, positive), (False, near)):
                own = np.flatnonzero(chosen)
                yield pa.RecordBatch.from_arrays([pa.array([side] * len(own), pa.bool_()), pa.array([packed[i] for i in own], pa.binary()), pa.array([1] * len(own), pa.int64()), pa.array(held[own].astype(int), pa.int64())], schema=schema)

    # Equal rows are one with a weight, so far fewer than the bound reach the driver.
    taken = rows.select("buckets", "positive", _share(max_unlabelled, total.u).alias("near"))
    packed = taken.mapInArrow(reduce_, "positive boolean, bits binary, n long, strong long").groupBy("positive", "bits").agg(F.sum("n").alias("n"), F.sum("strong").alias("strong")).orderBy("positive", "bits").collect()
    sides, often, held = {}, {}, {}
    for side in (True, False):
        own = [r for r in packed if r.positive is side]
        sides[side] = np.array([np.unpackbits(np.frombuffer(r.bits, np.uint8))[: len(buckets)] for r in own], np.float64).reshape(len(own), len(buckets))
        often[side] = np.array([r.n for r in own], np.float64)
        counted = own if side else [r for r in packed if r.positive is None]
        held[side] = sum(r.strong for r in counted) / max(1, sum(r.n for r in counted))
    if not len(sides[False]):  # a fold so small that the hash takes none
        sides[False], often[False] = sides[True], often[True]
    # Unlabelled texts hold at least the prior's share of what positives hold, so the labels' share is
    # corrected downwards where toxic rows are labelled more often than others.
    if held[True] > 0:
        prior = min(prior, max(1e-4, held[False] / held[True]))
    weights, bias = nnpu(sides[True], sides[False], often[True], often[False], prior)
    return Model(buckets, weights, bias)


def fit(docs: DataFrame, labels: DataFrame, features: int = FEATURES) -> Model:
    return fit_sets(word_sets(docs), labels, features)


def score_sets(sets: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of word_sets()."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.scores(*_flat(batch.column(2))), pa.float64())], schema=schema)

    rows = bounded_batches(sets).select("doc_id", "held_out", "buckets")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text)."""
    return score_sets(word_sets(docs), model)
