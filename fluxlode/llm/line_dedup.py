"""Line dedup by a log-template tree of fixed depth.

A line's way through the tree: its token count, its leading tokens, then the half of the remaining
tokens that is kept while the other half is variable. Tokens that hold a digit are variable at every
level. Each node is a hash, so equal templates meet in one map-side combined aggregate, in no
order, and a line that every document carries is one row. Very short lines have leaves of their own, by all their
tokens, which must recur in more documents; an odd hash tells such a leaf.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import free, written
from .words import buffers, mix, slices, words

LEADING = 3
GENERAL = 8
LEAST = 3
DOCS = 5
#: Documents in which a line of fewer than LEAST tokens must recur.
SHORT_DOCS = 20


def _sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[end] - total[begin]


def templates(column: pa.Array, leading: int = LEADING, general: int = GENERAL, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines' offsets by row, first template, second template) of each line; 0 where there is none.

    A line of fewer than `general` tokens has only the template of all its tokens, in both places; a longer one has a template for
    each half of its body that may vary. Templates of lines of fewer than `least` tokens are odd, all others even; a blank line has none.
    """
    w = words(column)
    data, at = buffers(column)
    breaks = np.flatnonzero(data == 10)
    rows = np.repeat(np.arange(len(column)), np.diff(at))
    per_row = np.bincount(rows[breaks], minlength=len(column)) + (np.diff(at) > 0)
    lines = np.r_[0, np.cumsum(per_row)]
    starts = np.sort(np.r_[breaks + 1, at[:-1][np.diff(at) > 0]])
    ends = np.r_[breaks, at[1:][np.diff(at) > 0]]
    ends.sort()
    digits = np.r_[0, np.cumsum((data >= 48) & (data <= 57))]
    token = np.where(digits[w.last] > digits[w.first], np.uint64(1), w.hash)
    a, b = np.searchsorted(w.first, starts), np.searchsorted(w.first, ends)
    n = b - a
    place = np.arange(len(token)) - np.repeat(a, n) if len(token) else np.zeros(0, int)
    mixed = mix(token ^ (place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    lead, half = a + np.minimum(leading, n), a + np.minimum(leading, n) + (np.maximum(n - leading, 0) + 1) // 2
    head = _sums(mixed, a, lead) + mix(n.astype(np.uint64))
    front, back = _sums(mixed, lead, half), _sums(mixed, half, b)
    long = n >= general
    one = np.where(long, mix(mix(head + front) + np.uint64(1)), mix(head + front + back))
    two = np.where(long, mix(mix(head + back) + np.uint64(2)), one)
    few = (n < least).astype(np.uint64)
    one, two = ((x & ~np.uint64(1)) | few for x in (one, two))
    none = n == 0
    one[none], two[none] = 0, 0
    return lines, one.view(np.int64), two.view(np.int64)


def _parse(leading: int, general: int, least: int):
    schema = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("one", pa.list_(pa.int64())), ("two", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                lines, one, two = templates(part.column("text"), leading, general, least)
                lists = [pa.ListArray.from_arrays(pa.array(lines, pa.int32()), pa.array(x)) for x in (one, two)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("own"), *lists], schema=schema)

    return run


def _drop(columns: list[str], gone_lines: str, counted: tuple[str, str]):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts, counts, removed = [], [], []
                for text, gone in zip(part.column("text").to_pylist(), part.column(gone_lines).to_pylist()):
                    lines = text.split("\n") if text else []
                    out = set(gone or ())
                    texts.append("\n".join(x for i, x in enumerate(lines) if i not in out) if out else text)
                    counts.append(len(lines))
                    removed.append(len(out))
                own = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*columns, *counted])

    return run


def dedup_lines(docs: DataFrame, min_docs: int = DOCS, short_docs: int = SHORT_DOCS, leading: int = LEADING, general: int = GENERAL, least: int = LEAST, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with recurring lines taken out of text, and n_lines and n_removed.

    A line goes if one of its templates occurs in at least min_docs documents (short_docs, if it has fewer than `least` tokens),
    unless its document is the one of smallest doc_id that has the template. Lines end at \\n; blank ones stay. Every row
    counts as a document, also one that repeats a doc_id; a null doc_id is
    larger than any other. A null or empty text has no lines and stays as it is; a text that loses all its
    lines becomes empty. An empty table gives none; texts are taken whole, whatever their length. Other columns are
    passed on, whatever their names; `counts` are the names of the two counts, which replace columns of that name.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in counts]
    gone_lines, gone_id, gone_own = (free(x, docs.columns) for x in ("gone_lines", "gone_id", "gone_own"))
    docs = docs.select(*columns)
    text = F.col("text").cast("string")
    own = F.xxhash64(text)
    parsed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("own"), text.alias("text"))
    parsed = written(parsed.mapInArrow(_parse(leading, general, least), "doc_id long, own long, one array<long>, two array<long>"), "templates")
    keys = parsed.select("doc_id", F.explode(F.array_distinct(F.concat("one", "two"))).alias("key")).filter("key <> 0")
    often = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).filter(F.col("n") >= F.when(F.col("key").bitwiseAND(1) == 1, short_docs).otherwise(min_docs))
    often = written(often.select("key", "least"), "recurring")
    both = F.arrays_zip("one", "two")
    lines = parsed.select("doc_id", "own", F.posexplode(both).alias("line", "t"))
    keyed = lines.select("doc_id", "own", "line", F.explode(F.array_distinct(F.array("t.one", "t.two"))).alias("key")).filter("key <> 0")
    late = keyed.join(often, "key").filter(F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    gone = late.groupBy("doc_id", "own").agg(F.collect_set("line").alias(gone_lines)).select(F.col("doc_id").alias(gone_id), F.col("own").alias(gone_own), gone_lines)
    joined = docs.withColumn("text", text).join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (own == F.col(gone_own)), "left")
    schema = spark.createDataFrame([], docs.withColumn("text", text).schema).schema.add(counts[0], "long").add(counts[1], "long")
    return joined.select(*columns, gone_lines).mapInArrow(_drop(columns, gone_lines, counts), schema)

