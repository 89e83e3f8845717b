"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the
sum over all its segmentations into pieces, by the forward algorithm; a text's is the product of its words'.
The probabilities are fitted by expectation maximisation, whose E-step is the forward-backward algorithm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import BYTE, Words, hashes, mix, powers, slices, words

#: Words up to so many bytes go many at a time, longer ones by themselves.
WIDE = 256
#: To learn from, longer words are cut at multiples of WIDE bytes.
SCALE = 1e3
RESCALE = 32
ROUNDS = 2
PER_LANGUAGE = 3000
UNKNOWN = "und"
_LOADED: dict = {}


class Vocabulary:
    """Pieces as bytes with a blank for a word's start: the 256 single bytes, then the model's other pieces. The
    pieces' prefixes are found by hash in tables of one probe each, so a search ends where no piece goes on."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        more = set()
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                piece = model.id_to_piece(i).replace("▁", " ").encode()
                if 1 < len(piece) and b" " not in piece[1:]:
                    more.add(piece)
        self.pieces = [*(bytes([b]) for b in range(256)), *sorted(more)]
        self.longest = max(map(len, self.pieces))
        number = {p: i for i, p in enumerate(self.pieces)}
        prefixes = sorted({p[:n] for p in self.pieces for n in range(2, len(p) + 1)})
        self.piece_of = np.array([number.get(p, -1) for p in prefixes], np.int32)
        data = np.frombuffer(b"".join(prefixes), np.uint8)
        ends = np.cumsum([len(p) for p in prefixes])
        self.hash = hashes(data, ends - [len(p) for p in prefixes], ends)
        self.bits = min(21, max(16, int(8 * len(prefixes)).bit_length()))
        self.table = np.full((3, 1 << self.bits), -1, np.int32)
        for i, h in enumerate(self.hash.tolist()):
            for t in range(3):
                at = (h >> (21 * t)) & ((1 << self.bits) - 1)
                if self.table[t, at] < 0:
                    self.table[t, at] = i
                    break
            else:
                raise ValueError("the table is too small for this vocabulary")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the prefix of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        for t in range(3):
            at = self.table[t][((h >> np.uint64(21 * t)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)]
            np.copyto(out, at, where=(at >= 0) & (self.hash[at] == h))
        return out


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def spans(matrix: np.ndarray, vocab: Vocabulary, upto: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, rows, pieces) of the rows of equal length whose bytes i..j are a piece, in order of i (below `upto`)."""
    n, length = matrix.shape
    up, down = powers()
    total = np.zeros((length + 1, n), np.uint64)
    np.cumsum((BYTE[matrix] * up[:length]).T, axis=0, out=total[1:])
    every = np.arange(n)
    for i in range(length if upto is None else upto):
        yield i, i + 1, every, matrix[:, i].astype(np.int32)
        rows = every
        for j in range(i + 2, min(i + vocab.longest, length) + 1):
            at = vocab.find(mix((total[j, rows] - total[i, rows]) * down[i] + np.uint64(j - i)))
            rows, at = rows[at >= 0], at[at >= 0]
            if not len(rows):
                break
            piece = vocab.piece_of[at]
            whole = piece >= 0
            if whole.any():
                yield i, j, rows[whole], piece[whole]


def forward(matrix: np.ndarray, vocab: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """Log probability of each row under each column of prob, over all segmentations."""
    n, length = matrix.shape
    alpha = np.zeros((length + 1, n, prob.shape[1]))
    alpha[0], log, done = 1, np.zeros((n, prob.shape[1])), 0
    for i, j, rows, at in spans(matrix, vocab):
        if i >= done + RESCALE:
            done = i
            most = alpha[i : i + vocab.longest].max(0)
            alpha[i : i + vocab.longest] /= most
            log += np.log(most)
        alpha[j, rows] += alpha[i, rows] * (prob[at] * SCALE ** (j - i))
    return np.log(alpha[length]) + log - length * np.log(SCALE)


def forward_long(data: np.ndarray, vocab: Vocabulary, prob: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """`forward` of one byte string of any length: block by block, with the sums that reach into the next one carried."""
    reach, log = vocab.longest, np.zeros(prob.shape[1])
    carried = np.zeros((reach + 1, prob.shape[1]))
    carried[0] = 1
    for a in range(0, len(data), block):
        part = data[a : a + block + reach - 1]
        size = min(block, len(data) - a)
        # all pieces that begin in the block, by their length
        begins, ends, pieces = [np.arange(size)], [np.arange(1, size + 1)], [part[:size].astype(np.int32)]
        at = np.arange(size)
        for n in range(2, reach + 1):
            at = at[at + n <= len(part)]
            found = vocab.find(_ranges(part, at, n))
            at, found = at[found >= 0], found[found >= 0]
            whole = vocab.piece_of[found] >= 0
            begins.append(at[whole])
            ends.append(at[whole] + n)
            pieces.append(vocab.piece_of[found[whole]])
        begin, end, piece = np.concatenate(begins), np.concatenate(ends), np.concatenate(pieces)
        order = np.argsort(begin, kind="stable")
        end, piece = end[order], piece[order]
        edge = np.searchsorted(begin[order], np.arange(size + 1))
        alpha = np.zeros((size + reach + 1, prob.shape[1]))
        alpha[: reach + 1] = carried
        step = prob[piece] * (SCALE ** (end - begin[order]))[:, None]
        for i in range(size):
            lo, hi = edge[i], edge[i + 1]
            alpha[end[lo:hi]] += alpha[i] * step[lo:hi]
            if i % RESCALE == RESCALE - 1:
                most = alpha[i + 1 : i + 1 + reach].max(0)
                alpha[i + 1 : i + 1 + reach] /= most
                log += np.log(most)
        carried = alpha[size : size + reach + 1]
    return np.log(carried[0]) + log - len(data) * np.log(SCALE)


def _ranges(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n bytes from each place."""
    up, down = powers()
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[at + n] - total[at]) * down[at] + np.uint64(n))


def expected(matrix: np.ndarray, weight: np.ndarray, vocab: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """Expected number of each piece over all segmentations of rows, each taken `weight` times."""
    n, length = matrix.shape
    reach, found = vocab.longest, list(spans(matrix, vocab))
    alpha, beta = np.zeros((length + 1, n)), np.zeros((length + 1, n))
    la, lb = np.zeros((length + 1, n)), np.zeros((length + 1, n))
    alpha[0], beta[length], done = 1, 1, 0
    for i, j, rows, at in found:
        if i >= done + RESCALE:
            done = i
            most = alpha[i : i + reach].max(0)
            alpha[i : i + reach] /= most
            la[i:] += np.log(most)
        alpha[j, rows] += alpha[i, rows] * (prob[at] * SCALE ** (j - i))
    done = length
    for i, j, rows, at in sorted(found, key=lambda x: -x[1]):
        if j <= done - RESCALE:
            done = j
            low = max(0, j - reach + 1)
            most = beta[low : j + 1].max(0)
            beta[low : j + 1] /= most
            lb[: j + 1] += np.log(most)
        beta[i, rows] += beta[j, rows] * (prob[at] * SCALE ** (j - i))
    out, whole = np.zeros(len(vocab.pieces)), np.log(alpha[length]) + la[length]
    for i, j, rows, at in found:
        share = alpha[i, rows] * (prob[at] * SCALE ** (j - i)) * beta[j, rows] * np.exp(la[i, rows] + lb[j, rows] - whole[rows])
        out += np.bincount(at, weights=share * weight[rows], minlength=len(out))
    return out


def _by_length(data: np.ndarray, first: np.ndarray, last: np.ndarray, lead: np.ndarray, cells: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(members, matrix of their bytes) of runs of equal length; `lead`: a blank goes before it."""
    length = last - first + lead
    order = np.lexsort((lead, length))
    edges = np.flatnonzero(np.diff(length[order] * 2 + lead[order])) + 1
    for run in np.split(order, edges):
        block = max(1, cells // (int(length[run[0]]) + 1)) if len(run) else 1
        for a in range(0, len(run), block):
            part = run[a : a + block]
            size, blank = int(last[part[0]] - first[part[0]]), bool(lead[part[0]])
            matrix = data[first[part][:, None] + np.arange(size)]
            yield part, np.hstack([np.full((len(part), 1), 32, np.uint8), matrix]) if blank else matrix


def _distinct(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, which of them each word is) of the distinct words."""
    _, sample, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    return w.first[sample], w.last[sample], inverse


def word_scores(data: np.ndarray, first: np.ndarray, last: np.ndarray, vocab: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """`forward` of each word, a blank before it."""
    out, wide = np.zeros((len(first), prob.shape[1])), last - first > WIDE
    short = np.flatnonzero(~wide)
    for members, matrix in _by_length(data, first[short], last[short], np.ones(len(short), np.int64)):
        out[short[members]] = forward(matrix, vocab, prob)
    for k in np.flatnonzero(wide):
        out[k] = forward_long(np.r_[np.uint8(32), data[first[k] : last[k]]], vocab, prob)
    return out


def _e_step(path: str, langs: list[str], prob):
    schema = pa.schema([("lang", pa.int32()), ("piece", pa.int32()), ("n", pa.float64())])

    def run(batches):
        vocab, total = vocabulary(path), np.zeros((len(langs), len(vocabulary(path).pieces)))
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"), lower=True)
                first, last, which = _distinct(w)
                lang = part.column("l").to_numpy()[np.repeat(np.arange(part.num_rows), np.diff(w.doc))]
                cuts = -(-(last - first) // WIDE)
                word = np.repeat(np.arange(len(first)), cuts)
                begin = first[word] + (np.arange(len(word)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * WIDE
                end, lead = np.minimum(begin + WIDE, last[word]), (begin == first[word]).astype(np.int64)
                for x in np.unique(lang):
                    times = np.bincount(which[lang == x], minlength=len(first))[word]
                    used = np.flatnonzero(times)
                    for members, matrix in _by_length(w.data, begin[used], end[used], lead[used]):
                        total[x] += expected(matrix, times[used][members].astype(float), vocab, prob.value[:, x])
        x, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[x, piece])], schema=schema)

    return run


def _predict(path: str, langs: list[str], prob):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                w = words(part.column("text"), lower=True)
                first, last, which = _distinct(w)
                value = word_scores(w.data, first, last, vocab, prob.value)
                row = np.repeat(np.arange(part.num_rows), np.diff(w.doc))
                total = np.stack([np.bincount(row, weights=value[which, x], minlength=part.num_rows) for x in range(len(langs))], 1)
                best = total.argmax(1)
                share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                letters = part.column("letters").to_numpy(zero_copy_only=False)
                said = [langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(said, pa.string()), pa.array(np.where(letters, share, 0.0))], schema=schema)

    return run


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def identify_languages(docs: DataFrame, model_path: str, folds: int = 5, held: int = 0, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row: the language under which the whole text is likeliest.

    Learns from rows with a text and a lang whose crc32(doc_id) modulo `folds` is not `held`: of each language
    about `per_language` of them, chosen by hash (all, if it has fewer). score is the prediction's share of the
    likelihood of all languages, 0 for `und`. A text that is null or has no letter is `und`, and all texts are if there
    is nothing to learn from; of equally likely languages the first in order is taken. Upper-case A-Z count
    as lower-case. A null doc_id counts as held out. Rows that repeat another are learned from and predicted one by one; an
    empty table gives no rows; other columns are not read. Texts and words of any length are taken whole (to learn from,
    words of more than WIDE bytes are cut). The probabilities, a row a piece and a column a language, are broadcast.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    base = base.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(True)))
    known = base.filter("not held_out and text is not null and lang is not null")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return base.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    pieces = len(vocabulary(model_path).pieces)
    share = spark.createDataFrame([(x, i, min(1.0, per_language / counts[x])) for i, x in enumerate(langs)], "lang string, l int, share double")
    sample = known.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("l", "text")
    prob = np.full((pieces, len(langs)), 1.0 / pieces)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(prob)
        got = sample.mapInArrow(_e_step(model_path, langs, sent), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        count = np.zeros((pieces, len(langs)))
        count[got.piece, got.lang] = got.n
        mean = (count / np.maximum(count.sum(0), 1)).mean(1, keepdims=True)
        prob = count + 20 * mean + 0.01  # what a language lacks is taken from the mean of all
        prob /= prob.sum(0)
    sent = spark.sparkContext.broadcast(prob)
    return base.select("doc_id", "text", "held_out", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")).mapInArrow(_predict(model_path, langs, sent), "doc_id long, held_out boolean, lang_pred string, score double")
