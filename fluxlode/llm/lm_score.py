"""LM scoring of whole documents: a gated recurrent model and a smoothed unigram model.

Counts cover every training token. The most frequent words (at most KNOWN) are broadcast; the rest of the
count table stays distributed and is joined. The recurrent model reads and predicts the HEAD most frequent words and
the end one by one and all others by bands of their counts: such a word has the probability of its band times its
smoothed share in it. Words that are not broadcast, unseen ones too, belong to the last band with the rarest.

The weights are fitted to every training document: first to a small sample in one task, then in ROUNDS, each with its
share of the documents. In a round each partition goes on from the same weights over all its documents, and the
weights that come out are averaged by their tokens.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import fold
from .quality import kth
from .recurrent import Model, classes_of
from .store import written
from .words import slices, words

KNOWN = 500_000
HEAD = 8192
#: The sample of the first weights.
FIRST_DOCS = 600
FIRST_TOKENS = 400_000
ROUNDS = 3
#: Of the first round; a step is of several thousand tokens.
RATE = 0.02
#: Tokens fitted together, about, and the numbers in a row of the weights that are averaged.
FITTED = 2_000_000
BLOCK = 8192
#: Broadcast words are found by so many bits of their hashes.
SLOTS = 20
#: Words of fewer occurrences are in the last band.
RARE = 4
#: Tokens scored together, about; the lanes of the recurrent model share them.
TOGETHER = 5_000_000
END = np.uint64(0x5EED0E2D5EED0E2D)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each row's lower-cased words and one end, rows' offsets)."""
    w = words(column, lower=True)
    return np.insert(w.hash, w.doc[1:], END), w.doc + np.arange(len(w.doc))


def _count(batches):
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])
    held, times, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def merge():
        every = np.concatenate([held, *(t for t, _ in waiting)])
        weight = np.concatenate([times, *(n for _, n in waiting)])
        distinct, at = np.unique(every, return_inverse=True)
        return distinct, np.bincount(at, weights=weight, minlength=len(distinct)).astype(np.int64)

    for batch in batches:
        for part in slices(batch):
            waiting.append(np.unique(tokens(part.column("text"))[0], return_counts=True))
            if sum(len(t) for t, _ in waiting) > max(500_000, len(held)):
                held, times = merge()
                waiting = []
        if len(held) > 2_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(times)], schema=schema)
            held, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held, times = merge()
    yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(times)], schema=schema)


class Lexicon:
    """The broadcast words: hashes by their slots, their counts, their numbers in the recurrent model (last: none is larger)
    and the sizes of their bands. total, distinct: of all words, the others belong to the last band."""

    def __init__(self, token: np.ndarray, count: np.ndarray, head: int, total: int, distinct: int):
        rank = np.lexsort((token, -count))
        self.head = min(head, len(token))
        self.head_counts, tail = count[rank[: self.head]], count[rank[self.head :]]
        octave = np.floor(np.log2(np.maximum(tail, 1))).astype(int)
        bands, band = np.unique(-octave[tail >= RARE], return_inverse=True)
        band = np.r_[band, np.full(len(tail) - len(band), len(bands))]  # tail goes down, so the rare ones end it
        self.last = self.head + len(bands)
        number = np.empty(len(token), np.int64)
        number[rank] = np.r_[np.arange(self.head), self.head + band]
        slot = self._slot(token)
        order = np.argsort(slot, kind="stable")
        self.token, self.count, self.number = token[order], count[order], number[order].astype(np.int32)
        self.shares = np.log10(self.count + 1.0)
        self.first = np.searchsorted(slot[order], np.arange((1 << SLOTS) + 1)).astype(np.int32)
        inner = band < len(bands)
        self.band_counts = np.bincount(band[inner], weights=tail[inner], minlength=len(bands)).astype(np.int64)
        self.band_sizes = np.bincount(band[inner], minlength=len(bands))
        self.other_count = total - int(self.head_counts.sum()) - int(self.band_counts.sum())
        self.other_size = distinct - self.head - int(self.band_sizes.sum())

    def model(self) -> Model:
        """The model before it has learned: the words' shares. Bands are classes of one word."""
        classes = classes_of(self.head_counts)
        counts = np.r_[self.head_counts, self.band_counts, self.other_count]
        return Model(np.r_[classes, classes[-1] + 1 + np.arange(len(self.band_counts))], counts=counts)

    def look_up(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is it here, log10 of its count and one or 0, its number)."""
        if not len(self.token):
            return np.zeros(len(token), bool), np.zeros(len(token)), np.zeros(len(token), np.int32)
        slot = self._slot(token)
        at, end = self.first[slot], self.first[1:][slot] - 1
        here = np.take(self.token, at, mode="clip") == token
        left = np.flatnonzero(~here & (at < end))
        while len(left):
            at[left] += 1
            here[left] = found = self.token[at[left]] == token[left]
            left = left[~found & (at[left] < end[left])]
        return here, np.where(here, np.take(self.shares, at, mode="clip"), 0.0), np.where(here, np.take(self.number, at, mode="clip"), np.int32(self.last))

    @staticmethod
    def _slot(token: np.ndarray) -> np.ndarray:
        return (token * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int32)


def _texts(lex: Lexicon, batches):
    """The numbers of each text's tokens."""
    for batch in batches:
        for part in slices(batch):
            token, at = tokens(part.column("text"))
            number = lex.look_up(token)[2]
            yield from (number[a:b] for a, b in zip(at[:-1], at[1:]))


def _first(lexicon, fit_tokens: int):
    """Weights of the texts that come, in their order, until fit_tokens have been seen; they go out in one row."""

    def run(batches):
        lex, texts, size = lexicon.value, [], 0
        for text in _texts(lex, batches):
            if size < fit_tokens:
                texts.append(text)
                size += len(text)
        model = lex.model()
        if texts:
            model.fit(texts)
        yield pa.RecordBatch.from_arrays([pa.array([model.flat().tobytes()], pa.binary())], names=["weights"])

    return run


def _goes_on(lexicon, weights, rate: float):
    """Fits on to all texts of the partition; BLOCK weights a row go out with the number of tokens seen."""

    def run(batches):
        lex = lexicon.value
        model, moments, held, size, seen = lex.model(), {}, [], 0, 0
        model.set_flat(weights.value)

        def fitted():
            lanes = min(256, max(1, size // max(map(len, held))))  # else most lanes would wait for the longest text
            model.fit(held, lanes=lanes, window=32, rate=rate, moments=moments)

        for text in _texts(lex, batches):
            held.append(text)
            size, seen = size + len(text), seen + len(text)
            if size >= FITTED:
                fitted()
                held, size = [], 0
        if held:
            fitted()
        if seen:
            flat, task = model.flat(), TaskContext.get().partitionId()
            blocks = [flat[a : a + BLOCK].tobytes() for a in range(0, len(flat), BLOCK)]
            k = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([task] * k, pa.int32()), pa.array([seen] * k, pa.int64()), pa.array(blocks, pa.binary())], names=["block", "task", "seen", "weights"])

    return run


def _mean(rows: pa.Table) -> pa.Table:
    """A block's mean over tasks, weighted by their tokens, added in the tasks' order."""
    rows = rows.sort_by("task")
    total, seen = 0.0, rows.column("seen").to_pylist()
    for n, own in zip(seen, rows.column("weights")):
        total = total + n * np.frombuffer(own.as_buffer(), np.float32).astype(np.float64)
    mean = (total / sum(seen)).astype(np.float32)
    return pa.table({"block": rows.column("block")[:1], "seen": pa.array([sum(seen)], pa.int64()), "weights": pa.array([mean.tobytes()], pa.binary())})


def fitted(train: DataFrame, lexicon, first_docs: int = FIRST_DOCS, first_tokens: int = FIRST_TOKENS, rounds: int = ROUNDS) -> tuple[Model, int]:
    """(the model fitted to all rows of train (doc_id, text), the tokens it saw after the sample of the first weights)."""
    spark, model, n_train, saw = train.sparkSession, lexicon.value.model(), train.count(), 0
    sample = train.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < 1_000_000 * min(1.0, first_docs / max(n_train, 1)))
    sample = sample.select("text", F.xxhash64("doc_id", F.lit(12)).alias("o")).repartition(1).sortWithinPartitions("o", "text").select("text")
    for row in sample.mapInArrow(_first(lexicon, first_tokens), "weights binary").collect():
        model.set_flat(np.frombuffer(row.weights, np.float32))
    for i in range(rounds):
        sent = spark.sparkContext.broadcast(model.flat())
        own = train.filter(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(rounds)) == i).select("text")
        out = own.mapInArrow(_goes_on(lexicon, sent, RATE / (i + 1)), "block int, task int, seen long, weights binary")
        blocks = sorted(out.groupBy("block").applyInArrow(_mean, "block int, seen long, weights binary").collect(), key=lambda r: r.block)
        if blocks:
            model.set_flat(np.concatenate([np.frombuffer(r.weights, np.float32) for r in blocks]))
            saw += blocks[0].seen
        sent.unpersist()
    return model, saw


def _score(lexicon, model):
    schema = pa.schema(
        [("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("shares", pa.float64()), ("others", pa.int64()), ("other_shares", pa.float64()), ("neural", pa.float64()), ("rare", pa.list_(pa.int64()))]
    )

    def run(batches):
        lex, net = lexicon.value, model.value
        sizes = np.log10(np.maximum(lex.band_counts + lex.band_sizes, 1.0))
        rid, held, size = TaskContext.get().partitionId() << 40, [], 0

        def scored():
            texts = [t for _, own in held for t in own]
            neural = net.score(texts) / math.log(10)
            at = 0
            for columns, own in held:
                columns[8] = neural[at : at + len(own)]
                at += len(own)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)

        for batch in batches:
            for part in slices(batch):
                token, at = tokens(part.column("text"))
                here, share, number = lex.look_up(token)
                row = np.repeat(np.arange(part.num_rows), np.diff(at))
                total = lambda v: np.bincount(row, weights=v, minlength=part.num_rows)  # noqa: B023, E731
                other = number == lex.last
                banded = (number >= lex.head) & ~other
                in_band = np.where(other, share, 0.0)
                in_band[banded] = share[banded] - sizes[number[banded] - lex.head]
                rare = np.r_[0, np.cumsum(~here)][at].astype(np.int32)
                columns = [
                    rid + np.arange(part.num_rows), part.column("doc_id"), part.column("held_out"), np.diff(at), total(here).astype(np.int64), total(share),
                    total(other).astype(np.int64), total(in_band), None, pa.ListArray.from_arrays(pa.array(rare), pa.array(token[~here].view(np.int64))),
                ]
                rid += part.num_rows
                held.append((columns, [number[a:b] for a, b in zip(at[:-1], at[1:])]))
                size += len(token)
                if size > TOGETHER:
                    yield from scored()
                    held, size = [], 0
        if held:
            yield from scored()

    return run


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2, known: int = KNOWN, head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row's whole text.

    Tokens are the A-Z lower-cased words and one end; a null text has only the end. Training documents are those
    whose crc32(doc_id) modulo `folds` is not `held` (a null doc_id is held out). base_score is the sum of
    log10((c+1)/(N+V+1)); score the recurrent model's log10 probability. Counts and the
    recurrent weights take all training documents, whole; how the input is dealt over partitions has a part in the
    weights. With nothing to learn from, both models give each word the same share. Rows that repeat another are learned from and scored one by one. Texts of any length are taken whole; an empty table gives
    no rows; other columns are not read. Tokens are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(True)))
    train = base.filter("not held_out")
    counts = train.select("text").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = written(counts, "counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts if v <= known else counts.filter(F.col("n") > kth(counts, "n", known))
    top = top.toPandas()
    lexicon = Lexicon(top.token.to_numpy().view(np.uint64), top.n.to_numpy(), head, n, v)
    sent = spark.sparkContext.broadcast(lexicon)
    model = spark.sparkContext.broadcast(fitted(train, sent)[0])
    schema = "rid long, doc_id long, held_out boolean, n_tokens long, known long, shares double, others long, other_shares double, neural double, rare array<long>"
    scored = written(base.mapInArrow(_score(sent, model), schema), "scored")
    rare = scored.select("rid", F.explode("rare").alias("token")).join(counts, "token")
    rare = rare.groupBy("rid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("rare_shares"))
    joined = scored.drop("rare").join(rare, "rid", "left").withColumn("r", F.coalesce("rare_shares", F.lit(0.0)))
    base_score = F.col("shares") + F.col("r") - F.col("n_tokens") * math.log10(n + v + 1)
    score = F.col("neural") + F.col("other_shares") + F.col("r") - F.col("others") * math.log10(lexicon.other_count + lexicon.other_size + 1)
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base_score.alias("base_score"), score.alias("score")
    )
