"""Quality classifier by importance resampling.

Hashed n-gram generative models of target and raw text give each document a log importance weight; Gumbel
noise is added and the k largest are kept, which samples without replacement in proportion to the weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import free, written
from .words import MARKS, mix, slices, words

UNIGRAMS, LEADS = 1 << 18, 1 << 17
LABELLED = 50_000
PRIOR = 5.0
ZONE = 1.4
SEED = 17


def features(column: pa.Array, unigrams: int, leads: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all rows' n-grams, each one's row): words, words' first 4 and first 5 bytes, and one
    n-gram for any word said three times running."""
    w = words(column, lower=True, cut=MARKS)
    row = np.repeat(np.arange(len(column)), np.diff(w.doc))
    out, rows = [(w.hash % np.uint64(unigrams)).astype(np.int64)], [row]
    for n in (4, 5):
        long = np.flatnonzero(w.last - w.first >= n)
        start = np.zeros(len(long), np.uint64)
        for i in range(n):
            start = (start << np.uint64(8)) | w.data[w.first[long] + i]
        out.append((np.uint64(1) + mix(start + np.uint64(n << 48)) % np.uint64(leads - 1)).astype(np.int64) + unigrams)
        rows.append(row[long])
    thrice = np.flatnonzero((w.hash[2:] == w.hash[:-2]) & (w.hash[2:] == w.hash[1:-1]) & (row[2:] == row[:-2]))
    return np.concatenate([*out, np.full(len(thrice), unigrams)]), np.concatenate([*rows, row[thrice]])


def _count(unigrams: int, leads: int, flag: str):
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        raw, target = np.zeros(unigrams + leads, np.int64), np.zeros(unigrams + leads, np.int64)
        for batch in batches:
            for part in slices(batch):
                bucket, row = features(part.column("text"), unigrams, leads)
                good = part.column(flag).fill_null(0).to_numpy() == 1
                raw += np.bincount(bucket, minlength=len(raw))
                target += np.bincount(bucket[good[row]], minlength=len(raw))
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], schema=schema)

    return run


def _weights(model, part: pa.RecordBatch) -> np.ndarray:
    """Log importance weight of each row. A document's own counts are left out of both models, so that
    n-grams of its own weigh nothing; a ratio within `zone` of the usual one (`centre`) is no evidence."""
    raw, target, unigrams, leads, prior, centre, zone, flag = model.value
    bucket, row = features(part.column("text"), unigrams, leads)
    good = part.column(flag).fill_null(0).to_numpy() == 1
    size = len(raw)
    pair, times = np.unique(row * size + bucket, return_counts=True)
    row, bucket = pair // size, pair % size
    known = good[row]
    base, aim = (raw[bucket] - times).astype(float), (target[bucket] - times * known).astype(float)
    length = np.bincount(row, weights=times, minlength=part.num_rows)
    both = (np.maximum(raw.sum() - length, 1), np.maximum(target.sum() - length * good, 0))
    expected = base * (both[1] / both[0])[row]
    ratio = np.log((aim + prior) / (expected + prior)) - centre
    ratio = np.sign(ratio) * np.maximum(np.abs(ratio) - zone, 0)
    return np.bincount(row, weights=times * ratio, minlength=part.num_rows)


def usual(raw: np.ndarray, target: np.ndarray, prior: float) -> float:
    """Median of the log ratio over the target text; raw text unlike the target shifts all ratios by that."""
    expected = raw * (target.sum() / max(raw.sum(), 1))
    ratio = np.log((target + prior) / (expected + prior))
    order = np.argsort(ratio, kind="stable")
    mass = np.cumsum(target[order])
    return float(ratio[order][np.searchsorted(mass, mass[-1] / 2)]) if len(mass) and mass[-1] else 0.0


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    u = ((mix(mix(ids.view(np.uint64)) ^ np.uint64(seed)) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
    return -np.log(-np.log(u))


def _score(model, seed: int):
    schema = pa.schema([("doc_id", pa.int64()), ("good", pa.int32()), ("log_weight", pa.float64()), ("key", pa.float64())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                weight = _weights(model, part)
                key = weight + gumbel(part.column("doc_id").fill_null(-1).to_numpy().astype(np.int64), seed)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column(model.value[-1]), pa.array(weight), pa.array(key)], schema=schema)

    return run


def _keep(model, seed: int, cut: tuple[float, float], columns: list[str]):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id").fill_null(-1).to_numpy().astype(np.int64)
                key = _weights(model, part) + gumbel(ids, seed)
                yield part.select(columns).filter(pa.array((key > cut[0]) | ((key == cut[0]) & (ids <= cut[1]))))

    return run


def kth(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a numeric column, by counting in ever finer bins; only counts reach the driver."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    x = F.col(column)
    while low < high:
        step = (high - low) / bins
        edges = sorted({low, *(low + step * i for i in range(1, bins)), high})
        at = F.least(F.floor((x - low) / step), F.lit(bins - 1)) if step > 0 else F.lit(0)
        got = df.filter(x.between(low, high)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect()
        if len(edges) <= 2 or len(got) == 0:
            break
        for r in sorted(got, key=lambda r: -r.b):
            if k <= r.n:
                low, high = r.lo, r.hi
                break
            k -= r.n
    return high


def cutoff(good: np.ndarray, weight: np.ndarray, times: np.ndarray | None = None) -> float:
    """The weight that best parts good from bad labelled documents (largest sum of both shares that are right).
    times: how many documents each value stands for."""
    if not len(good) or good.all() or not good.any():
        return -math.inf
    order = np.argsort(weight, kind="stable")
    good, weight = good[order] == 1, weight[order]
    times = np.ones(len(good), np.int64) if times is None else times[order]
    n_good, n_bad = np.r_[0, np.cumsum(times * good)], np.r_[0, np.cumsum(times * ~good)]
    right = n_bad / n_bad[-1] + 1 - n_good / n_good[-1]
    edge = np.r_[True, weight[1:] > weight[:-1], True]
    best = int(np.flatnonzero(edge)[np.argmax(right[edge])])
    return -math.inf if best == 0 else math.inf if best == len(weight) else (weight[best - 1] + weight[best]) / 2


class Resampling:
    """Importance weights of docs, fitted to the labelled good documents, and the Gumbel top-k among them.

    target: documents of quality 1 that are not toxic, at most `labelled` labelled documents, those of smallest
    hash; raw: all documents. k is the number of documents whose weight is above the one that best parts the
    labelled good from the labelled bad. Without labels of both kinds all documents are kept.
    A null or empty text weighs 0; rows that repeat a doc_id have the same noise; a null doc_id counts as -1. Of equal keys the
    smaller doc_ids stay, and rows that repeat one stay together. Texts of any length are taken whole; an empty table gives no
    rows; other columns are passed on, whatever their names.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unigrams: int = UNIGRAMS, leads: int = LEADS, prior: float = PRIOR, zone: float = ZONE, seed: int = SEED):
        spark, self.flag, self.known_id = docs.sparkSession, free("labelled_good", docs.columns), free("known_id", docs.columns)
        self.docs, self.seed = docs, seed
        known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias(self.known_id))
        known = known.agg(((F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).cast("int").alias(self.flag))
        self.known = F.broadcast(known.orderBy(F.xxhash64(self.known_id), self.known_id).limit(labelled))
        own = self.flagged(docs.select("doc_id", "text"))
        counts = own.select("text", self.flag).mapInArrow(_count(unigrams, leads, self.flag), "bucket int, raw long, target long")
        counts = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
        raw, target = np.zeros(unigrams + leads, np.int64), np.zeros(unigrams + leads, np.int64)
        raw[counts.bucket], target[counts.bucket] = counts.raw, counts.target
        self.model = spark.sparkContext.broadcast((raw, target, unigrams, leads, prior, usual(raw, target, prior), zone, self.flag))
        self.scores = written(own.mapInArrow(_score(self.model, seed), "doc_id long, good int, log_weight double, key double"), "weights")
        seen = self.scores.filter("good is not null").groupBy("good", "log_weight").agg(F.count("*").alias("times")).toPandas()
        self.threshold = cutoff(seen.good.to_numpy(), seen.log_weight.to_numpy(), seen.times.to_numpy())
        n = self.scores.count()
        self.k = self.scores.filter(F.col("log_weight") >= self.threshold).count() if self.threshold > -math.inf else n
        self.cut = (-math.inf, -1)
        if 0 < self.k < n:
            key = kth(self.scores, "key", self.k)
            ties = self.scores.filter(F.col("key") == key).select((-F.coalesce("doc_id", F.lit(-1))).alias("rev"))
            above = self.scores.filter(F.col("key") > key).count()
            self.cut = (key, -kth(ties, "rev", self.k - above))
        elif n:
            self.cut = (math.inf, -1) if self.k == 0 else self.cut

    def flagged(self, docs: DataFrame) -> DataFrame:
        text = docs.withColumn("text", F.col("text").cast("string")).withColumn("doc_id", F.col("doc_id").cast("long"))
        return text.join(self.known, text.doc_id == self.known[self.known_id], "left").select(text["*"], self.flag)

    def selected(self) -> DataFrame:
        """(doc_id, log_weight, key) of the documents kept."""
        key, last = self.cut
        keep = (F.col("key") > key) | ((F.col("key") == key) & (F.coalesce("doc_id", F.lit(-1)) <= last))
        return self.scores.filter(keep).select("doc_id", "log_weight", "key")

    def documents(self) -> DataFrame:
        """The documents kept, with all their columns; they are weighed again where they lie, so no text is shuffled."""
        columns = self.docs.columns
        own = self.flagged(self.docs)
        return own.mapInArrow(_keep(self.model, self.seed, self.cut, columns), own.select(*columns).schema)
