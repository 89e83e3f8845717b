"""Packing by first-fit decreasing over a tournament tree of bin capacities, in randomised groups."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import KIND, slices, words

CAPACITY = 2048
GROUP = 4096
CACHE = 250_000
_CACHE: dict = {}


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. The tree's inner nodes hold the largest free capacity below them,
    so the first bin that fits is found, and updated, in as many steps as the tree is high."""
    n = len(lengths)
    size = 1 << max(0, int(n - 1).bit_length()) if n else 1
    tree = [capacity] * (2 * size)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        need, at = int(lengths[i]), 1
        while at < size:
            at *= 2
            if tree[at] < need:
                at += 1
        bins[i], offsets[i] = at - size, capacity - tree[at]
        tree[at] -= need
        at //= 2
        while at:
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
            at //= 2
    return bins, offsets


class WordIds:
    """Token ids of words, each distinct word encoded once. The tokenizer drops blanks, lower-cases, and
    joins neither words across blanks nor letters with other marks, so a text's ids are its words' ids in order."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids on end, number of ids) of each word. A word of letters alone is one unit with one closing
        id, so many are encoded as one text and told apart by those."""
        parts: list[np.ndarray | None] = [None] * len(new)
        plain = [i for i, x in enumerate(new) if x.isalpha()]
        blocks = [plain[a : a + 500] for a in range(0, len(plain), 500)]
        for block, e in zip(blocks, self.tokenizer.encode_batch_fast([" ".join(new[i] for i in b) for b in blocks], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(block) and stops[-1] == len(ids):
                for i, part in zip(block, np.split(ids, stops[:-1])):
                    parts[i] = part
        rest = [i for i, x in enumerate(parts) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([new[i] for i in rest], add_special_tokens=False)):
            parts[i] = np.array(e.ids, np.uint32)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def of(self, w) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words on end, number of ids of each word)."""
        distinct, sample, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self.clear()
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != distinct[inside]
        if new.any():
            whole = w.data.tobytes()
            flat, count = self.encode([whole[a:b].decode() for a, b in zip(w.first[sample[new]].tolist(), w.last[sample[new]].tolist())])
            at = len(self.first) + np.arange(len(count))
            self.first = np.r_[self.first, len(self.ids) + np.cumsum(count) - count]
            self.count, self.ids = np.r_[self.count, count], np.r_[self.ids, flat]
            known, at = np.r_[self.known, distinct[new]], np.r_[self.at, at]
            order = np.argsort(known, kind="stable")
            self.known, self.at = known[order], at[order]
            place = np.searchsorted(self.known, distinct)
        entry = self.at[place][inverse]
        count = self.count[entry]
        begin = np.cumsum(count) - count
        flat = self.ids[np.repeat(self.first[entry] - begin, count) + np.arange(int(count.sum()))]
        return flat, count


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        if _CACHE.get("path") != path:
            _CACHE.update(path=path, ids=WordIds(path))
        encoder = _CACHE["ids"]
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"), lower="<|", cut=KIND)
                flat, count = encoder.of(w)
                total = np.r_[0, np.cumsum(count)][w.doc]
                rows: list[tuple] = []
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    ids = np.append(flat[total[i] : total[i + 1]], np.uint32(end_id)).astype("<u4")
                    for a in range(0, len(ids), capacity):
                        piece = ids[a : a + capacity]
                        rows.append((doc, a, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PIECES.types)], schema=PIECES)

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group: int = GROUP, end_id: int = 1) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    A document's ids (its text's, then end_id) are cut at multiples of `capacity`; the pieces of a
    random group of about `group` are packed by first-fit decreasing. A null or empty text is one
    piece of length 1. Rows that repeat a doc_id are separate documents. An empty table gives no
    rows. Only lengths are shuffled; a long document's pieces are spread over all groups. Pieces of equal length are
    packed by doc_id, then start; groups depend on the pieces, not on how the input is dealt.
    """
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = written(cut.mapInArrow(_pieces(tokenizer_path, capacity, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    groups = max(1, -(-cut.count() // group))
    # equal pieces are counted and numbered, so groups depend on the pieces alone and many equal ones are dealt out
    every = cut.groupBy(*cut.columns).agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    dealt = every.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy"), F.lit(groups))).drop("n", "copy")

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        return rows.drop(columns="grp").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    return dealt.groupBy("grp").applyInPandas(packed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
