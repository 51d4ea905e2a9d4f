"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear over hashed words and word beginnings, written in numpy.  It sees
confirmed toxic texts and unlabelled texts; the loss of the unlabelled ones taken as clean is
corrected by the class prior and kept from going below zero, so that rare positives among
them do no harm.  It is fitted on a bounded sample and scores every text.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds of the sample that the classifier is fitted on.
POSITIVE_ROWS, UNLABELLED_ROWS = 4000, 12000
FEATURE_BITS = 22
#: Features with the clearest difference between confirmed and unlabelled texts.
SELECTED = 4096
MIN_POSITIVE_TEXTS = 5
PREFIXES = (4, 5)
#: Chosen on fold 3, fitted on folds 0 and 1.
STEPS, RATE, DECAY = 400, 0.05, 0.2
CACHE_WORDS = 200_000
#: Fixed values of the contract.
FOLDS, HELD_OUT_FOLD, THRESHOLD = 4, 2, 0.3

WORDS = re.compile(r"\w+")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings."""
    mask = (1 << FEATURE_BITS) - 1
    keys = ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]
    return tuple(zlib.crc32(k.encode("utf-8", "surrogatepass")) & mask for k in keys)


def text_features(text: str | None) -> np.ndarray:
    found: set[int] = set()
    for w in set(WORDS.findall((text or "").lower())):
        found.update(word_features(w))
    return np.sort(np.fromiter(found, dtype=np.int32, count=len(found)))


class Sample:
    """Feature sets of many texts in two flat arrays."""

    def __init__(self, sets: list[np.ndarray]):
        self.lengths = np.array([len(x) for x in sets], dtype=np.int64)
        self.flat = np.concatenate([*sets, np.zeros(0, np.int32)]).astype(np.int32)

    def __len__(self) -> int:
        return len(self.lengths)

    def counted(self, chosen: np.ndarray) -> np.ndarray:
        """In how many texts each of the sorted features ``chosen`` is."""
        at, among = _places(self.flat, chosen)
        return np.bincount(at[among], minlength=len(chosen)).astype(float)


def _places(values: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(chosen, values).astype(np.int32)
    at[at == len(chosen)] = 0
    return at, chosen[at] == values if len(chosen) else np.zeros(len(values), dtype=bool)


def select(positive: Sample, unlabelled: Sample) -> np.ndarray:
    """Features by the difference of their document frequencies, in standard errors; ties by number."""
    found, p = np.unique(positive.flat, return_counts=True)  # only what confirmed texts have can be chosen
    found, p = found[p >= MIN_POSITIVE_TEXTS], p[p >= MIN_POSITIVE_TEXTS].astype(float)
    rate_p, rate_u = p / max(1, len(positive)), (unlabelled.counted(found) + 0.5) / (len(unlabelled) + 1)
    z = np.abs(rate_p - rate_u) / np.sqrt(rate_u * (1 - rate_u) / max(1, len(positive)))
    best = np.argsort(-z, kind="stable")[:SELECTED]
    return np.sort(found[best[z[best] > 3]])


def select_features(sampled: DataFrame) -> np.ndarray:
    """The same over a table of positive (int), unlabelled (boolean) and features (packed), counted where the rows lie."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in batch.column(2)]
        flat = np.concatenate([*sets, np.zeros(0, np.int32)])
        weights = [np.repeat(np.array(c.to_pylist(), dtype=np.int64), [len(x) for x in sets]) for c in batch.columns[:2]]
        found, place = np.unique(flat, return_inverse=True)
        arrays = [pa.array(np.bincount(place, weights=w, minlength=len(found)).astype(np.int64)) for w in weights]
        return pa.RecordBatch.from_arrays([pa.array(found), *arrays], names=["feature", "p", "u"])

    n_p, n_u = sampled.agg(F.coalesce(F.sum("positive"), F.lit(0)), F.count_if("unlabelled")).first()
    flags = sampled.select("positive", F.col("unlabelled").cast("int").alias("unlabelled"), "features")
    counts = common.map_batches(flags, count, "feature int, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    rate_p, rate_u = F.col("p") / max(1, n_p), (F.col("u") + 0.5) / (n_u + 1)
    z = F.abs(rate_p - rate_u) / F.sqrt(rate_u * (1 - rate_u) / max(1, n_p))
    best = counts.filter(F.col("p") >= MIN_POSITIVE_TEXTS).withColumn("z", z).filter("z > 3").orderBy(F.desc("z"), "feature").limit(SELECTED)
    return np.sort(np.array([r["feature"] for r in best.select("feature").collect()], dtype=np.int32))


def fit(positive: Sample, unlabelled: Sample, prior: float, chosen: np.ndarray | None = None) -> tuple[dict[int, float], float, int]:
    """Weights by feature, the bias, and the number of steps in which the negative risk was below zero.

    Gradient steps on the non-negative risk; ``chosen`` features (sorted), by ``select`` if not given.
    """
    if chosen is None:
        chosen = select(positive, unlabelled)
    n_p, n_u = len(positive), len(unlabelled)
    rows, columns = [], []
    for part, before in ((positive, 0), (unlabelled, n_p)):
        at, among = _places(part.flat, chosen)
        columns.append(at[among])
        rows.append((np.repeat(np.arange(len(part), dtype=np.int32), part.lengths) + before)[among])
    row, column = np.concatenate(rows), np.concatenate(columns)
    weights, bias, corrected = np.zeros(len(chosen)), float(np.log(prior / (1 - prior))), 0
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, STEPS + 1):
        f = np.bincount(row, weights=weights[column], minlength=n_p + n_u) + bias
        s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        # Logistic losses: l(+) has slope s - 1, l(-) has slope s.
        loss_minus = np.logaddexp(0, f)
        negative_risk = loss_minus[n_p:].mean() - prior * loss_minus[:n_p].mean()
        slope = np.zeros(n_p + n_u)
        if negative_risk >= 0:
            slope[:n_p] = prior * (s[:n_p] - 1) / n_p - prior * s[:n_p] / n_p
            slope[n_p:] = s[n_p:] / n_u
        else:  # step back from the negative part alone
            corrected += 1
            slope[:n_p] = prior * s[:n_p] / n_p
            slope[n_p:] = -s[n_p:] / n_u
        gradient = np.append(np.bincount(column, weights=slope[row], minlength=len(chosen)) + DECAY * weights / max(1, n_u) * 10, slope.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return {int(c): float(w) for c, w in zip(chosen, weights, strict=True) if abs(w) > 1e-4}, float(bias), corrected


def train(docs: DataFrame, labels: DataFrame, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> tuple[dict[int, float], float] | None:
    """Fit on the rows outside the held-out fold; None where no toxic text is confirmed.

    Confirmed texts and unlabelled texts are the first by a hash of doc_id, at most
    ``positive_rows`` and ``unlabelled_rows``.  The prior is the toxic share of all labels
    outside the held-out fold.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic:
        return None
    prior = min(0.9, max(1e-4, toxic / n))
    order = F.xxhash64("doc_id")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null")
    positive = ids.join(known.filter("toxic = 1"), "doc_id", "left_semi").distinct().orderBy(order, "doc_id").limit(positive_rows)
    unlabelled = ids.filter(~held_out(F.col("doc_id"))).distinct().orderBy(order, "doc_id").limit(unlabelled_rows)
    picked = positive.withColumn("positive", F.lit(1)).unionByName(unlabelled.withColumn("positive", F.lit(0)))
    picked = picked.groupBy("doc_id").agg(F.max("positive").alias("positive"), (F.min("positive") == 0).alias("unlabelled"))
    picked = F.broadcast(common.cut(picked.coalesce(1), "toxic-sample"))  # bounded by the two row counts

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [text_features(t).tobytes() for t in batch.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, type=pa.binary())], names=["doc_id", "positive", "unlabelled", "features"])

    sampled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id").select("doc_id", "positive", "unlabelled", "text")
    sampled = common.cut(common.map_batches(sampled, features, "doc_id long, positive int, unlabelled boolean, features binary"), "toxic-features")
    chosen = select_features(sampled)

    def narrow(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = []
        for x in batch.column(3):
            own = np.frombuffer(x.as_buffer(), dtype=np.int32)
            kept.append(own[_places(own, chosen)[1]].tobytes())
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kept, type=pa.binary())], names=batch.schema.names)

    # The driver gets the chosen features of the sampled texts alone, one of the two parts at a time.
    narrowed = common.map_batches(sampled, narrow, "doc_id long, positive int, unlabelled boolean, features binary")
    samples = []
    for kind in ("positive = 1", "unlabelled"):
        part = narrowed.filter(kind).select("doc_id", "features").toArrow().sort_by("doc_id")
        samples.append(Sample([np.frombuffer(x.as_buffer(), dtype=np.int32) for x in part.column("features")]))
        del part
    common.discard(sampled)
    if not len(samples[0]) or not len(samples[1]):
        return None
    return fit(*samples, prior, chosen)[:2]


class Scorer:
    """Scores texts; a worker keeps which words carry a weighted feature."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def score(self, text: str | None) -> float:
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known, found = self.known, set()
        for w in set(WORDS.findall((text or "").lower())):
            carried = known.get(w)
            if carried is None:
                carried = known[w] = tuple(f for f in word_features(w) if f in self.weights)
            if carried:
                found.update(carried)
        f = self.bias + sum([self.weights[x] for x in sorted(found)])
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, f)))))


_scorers: dict[tuple, Scorer] = {}


def _scorer(weights: dict[int, float], bias: float) -> Scorer:
    common.hold_cache("toxicity", _scorers.clear)
    key = (hash(tuple(sorted(weights.items()))), bias)
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(weights, bias)
    return _scorers[key]


def _scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` as it is with one more column, __qw_score."""
    model = train(docs, labels)
    if model is None:
        return docs.withColumn("__qw_score", F.lit(0.0))
    at, names = docs.columns.index("text"), [*docs.columns, "__qw_score"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = _scorer(*model)
        values = [scorer.score(t) for t in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, type=pa.float64())], names=names)

    from pyspark.sql.types import DoubleType, StructType

    return common.map_batches(docs, run, StructType(list(docs.schema.fields)).add("__qw_score", DoubleType()))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 if score >= ``threshold``).

    Null and empty texts get the score of a text without features.  Without a confirmed toxic
    text every score is 0.  Repeated rows score alike; extra columns stay, and columns named
    like a new one are replaced; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    scored = _scored(docs.select(*kept), labels).withColumnRenamed("__qw_score", "score")
    return scored.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows predicted toxic; columns, whatever their names, and other rows stay as they are."""
    return _scored(docs, labels).filter(F.col("__qw_score") < threshold).drop("__qw_score")
