"""Substring dedup: words covered by a window of words that occurs earlier are removed.

1. Whole copies of a text are one class; only its first document goes on, and later copies are covered whole.
2. Each window belongs to its anchor, the smallest hash among its word 8-grams, so equal windows have equal
   anchors. Anchors that occur once in the corpus have no repeated window and go no further.
3. What is around repeated anchors is dealt by anchor to shards. Each builds a compressed FM-index over its runs of words
   and streams the runs' windows through backward search: a window whose matching statistic reaches `window` occurs again,
   and its interval in the index names what it equals. Words confirm that, all but the first are reported, and neighbouring
   ones are one interval of a document. A run that a task has seen before goes without its words.
4. An anchor of very many documents is dealt by whole windows. Those that a task has seen before are late; of the others
   only the first of equal ones, found by a minimum that is combined before the shuffle, goes to a shard. So no task
   gathers a hot passage, and what the tasks have settled meets no other rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .store import written
from .words import Words, mix, runs, slices, words

WINDOW = 20
GRAM = 8
HOT = 2_000
SHARD_WORDS = 500_000


def anchors(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all windows inside rows, position of each one's anchor: the leftmost smallest gram hash)."""
    n = len(w.hash) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(w.doc) - 1), np.diff(w.doc))
    starts = np.flatnonzero(row[:n] == row[window - 1 :])
    g = runs(w.hash, gram)
    wide = window - gram + 1
    best, at = g[:n].copy(), np.arange(n)
    for j in range(1, wide):
        less = g[j : j + n] < best
        best[less], at[less] = g[j : j + n][less], np.arange(j, j + n)[less]
    return starts, at[starts]


def _distinct_anchors(window: int, gram: int):
    schema = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("own2", pa.int32()), ("anchors", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"))
                _, at = anchors(w, window, gram)
                at = np.unique(at)
                hashed = runs(w.hash, gram)[at].view(np.int64) if len(at) else np.zeros(0, np.int64)
                ends = np.searchsorted(at, w.doc)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("own"), part.column("own2"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashed))], schema=schema)

    return run


def _segments(window: int, gram: int):
    schema = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("hot", pa.bool_()), ("doc_id", pa.int64()), ("own", pa.int64()), ("start", pa.int64()), ("upto", pa.int64()), ("w", pa.list_(pa.int64()))])

    def run(batches):
        seen: dict[int, tuple[int, int, int]] = {}
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"))
                starts, at = anchors(w, window, gram)
                if not len(starts):
                    continue
                row = np.searchsorted(w.doc, starts, "right") - 1
                hashed = runs(w.hash, gram)[at]
                lists = part.column("often")
                owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                pair = mix(flat.field("key").to_numpy(zero_copy_only=False).view(np.uint64) ^ mix(owner.astype(np.uint64)))
                order = np.argsort(pair)
                hot = flat.field("hot").to_numpy(zero_copy_only=False)[order]
                pair = pair[order]
                mine = mix(hashed ^ mix(row.astype(np.uint64)))
                place = np.minimum(np.searchsorted(pair, mine), len(pair) - 1)
                often = pair[place] == mine
                starts, at, row, hashed, hot = starts[often], at[often], row[often], hashed[often], hot[place[often]]
                if not len(starts):
                    continue
                whole = runs(w.hash, window)[starts]
                new = np.r_[True, (at[1:] != at[:-1]) | (np.diff(starts) != 1) | hot[1:]]
                first = np.flatnonzero(new)
                last = np.r_[first[1:], len(starts)] - 1
                begin, end = starts[first], starts[last] + window
                key = np.where(hot[first], whole[first], hashed[first]).view(np.int64)
                size = end - begin
                offsets = np.r_[0, np.cumsum(size)]
                index = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
                mixed = mix(w.hash[index] ^ mix((np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)).astype(np.uint64)))
                content = mix(np.add.reduceat(mixed, offsets[:-1]) ^ key.view(np.uint64)).view(np.int64)
                ids, own = part.column("doc_id").to_numpy()[row[first]], part.column("own").to_numpy()[row[first]]
                start = begin - w.doc[row[first]]
                # a run equal to one of this task that comes earlier is covered whole and needs no words
                later = np.zeros(len(first), bool)
                for n, (c, place) in enumerate(zip(content.tolist(), zip(ids.tolist(), own.tolist(), start.tolist()))):
                    if (best := seen.get(c)) is not None and best < place:
                        later[n] = True
                    else:
                        seen[c] = place
                kept, upto, is_hot = np.where(later, 0, size), np.where(later, start + size, 0), hot[first]
                # hot windows that come again one after another are one interval
                gone = later & is_hot
                goes_on = np.r_[False, gone[1:] & gone[:-1] & (np.diff(begin) == 1) & (np.diff(row[first]) == 0)]
                heads = np.flatnonzero(~goes_on)
                upto = np.maximum.reduceat(upto, heads)
                values = w.hash[index[np.repeat(~later, size)]].view(np.int64)
                values = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept[heads])], pa.int32()), pa.array(values))
                columns = [pa.array(x[heads]) for x in (key, content, is_hot, ids, own, start)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(upto), values], schema=schema)

    return run


def later_windows(segments: list[np.ndarray], window: int) -> np.ndarray:
    """Positions, in the segments on end with a gap of one, of windows that occur earlier; segments in corpus order."""
    size = np.array([len(s) for s in segments])
    begin = np.r_[0, np.cumsum(size + 1)]
    text = np.zeros(begin[-1], np.uint64)
    inside = np.ones(begin[-1], bool)
    inside[begin[1:] - 1] = False
    text[inside] = np.concatenate(segments)
    symbols = np.where(inside, 1 + mix(text) % np.uint64(15), 0).astype(np.uint8)
    count = np.maximum(size - window + 1, 0)
    starts = np.repeat(begin[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    found, interval = FMIndex(symbols).repeated(symbols, starts, window)
    if not len(found):
        return found
    # few symbols stand for many words, so windows of one interval may still differ in words
    order = np.lexsort((found, runs(text, window)[found], interval))
    found, interval = found[order], interval[order]
    same = interval[1:] == interval[:-1]
    for j in range(window):
        same &= text[found[1:] + j] == text[found[:-1] + j]
    return np.sort(found[1:][same])


def _shard(window: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        done = rows.loc[rows["upto"] > 0, ["doc_id", "own", "start", "upto"]].rename(columns={"start": "from"})
        rows = rows[rows["upto"] == 0].drop_duplicates(["doc_id", "own", "start"]).sort_values(["doc_id", "own", "start"], kind="stable")
        if not len(rows):
            return done
        parts = [np.asarray(x).view(np.uint64) for x in rows["w"]]
        size = np.array([len(p) for p in parts])
        begin = np.r_[0, np.cumsum(size + 1)]
        late = later_windows(parts, window)
        seg = np.searchsorted(begin, late, "right") - 1
        out = pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[seg], "own": rows["own"].to_numpy()[seg], "at": rows["start"].to_numpy()[seg] + late - begin[seg]})
        # runs of neighbouring windows of one document are one row
        new = np.r_[True, (np.diff(out["at"]) != 1) | (np.diff(out["doc_id"]) != 0) | (np.diff(out["own"]) != 0)] if len(out) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        found = pd.DataFrame({"doc_id": out["doc_id"].to_numpy()[first], "own": out["own"].to_numpy()[first], "from": out["at"].to_numpy()[first], "upto": np.r_[out["at"].to_numpy()[first[1:] - 1], out["at"].to_numpy()[-1:]] + window})
        return pd.concat([done, found])

    return run


def _remove(window: int, columns: list[str]):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                counts, removed, kept = [], [], []
                for text, copy, gone in zip(part.column("text").to_pylist(), part.column("copy").to_pylist(), part.column("gone").to_pylist()):
                    w = (text or "").encode().split()
                    counts.append(len(w))
                    if copy and len(w) >= window:
                        w = []
                    elif gone:
                        edge = np.zeros(len(w) + 1, np.int64)
                        for g in gone:
                            edge[g["from"]] += 1
                            edge[g["upto"]] -= 1
                        w = [x for x, n in zip(w, np.cumsum(edge)) if n == 0]
                    removed.append(counts[-1] - len(w))
                    kept.append(b" ".join(w).decode())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*columns, "n_words", "n_removed", "kept"])

    return run


LAST = (1 << 63) - 1


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; kept: the words left, joined by one space.

    A word goes if a window of `window` consecutive words that covers it also starts earlier, in a document of
    smaller doc_id or earlier in its own; windows are those of the input. A null or short text has no windows. Rows that
    repeat doc_id and text are one document; of those that share only the doc_id, one comes first by its text's hash.
    A null doc_id comes last. Words are compared by 64-bit hashes, windows word by word (hot ones by 128 bits), whole texts
    by 96 bits. Texts of any length are taken whole; an empty table gives no rows; other columns are not read.
    """
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("own"), F.hash(text, F.length(text)).alias("own2"))
    listed = written(base.mapInArrow(_distinct_anchors(window, gram), "doc_id long, own long, own2 int, anchors array<long>"), "anchors")
    firsts = written(listed.groupBy("own", "own2").agg(F.min("doc_id").alias("first")), "firsts")
    one = listed.filter(F.size("anchors") > 0).join(firsts, ["own", "own2"]).filter("doc_id = first").select("doc_id", "own", F.explode("anchors").alias("key"))
    often = one.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", (F.col("n") > hot).alias("hot"))
    often = written(often, "often")
    flagged = one.dropDuplicates().join(often, "key").groupBy("doc_id", "own").agg(F.collect_list(F.struct("key", "hot")).alias("often"))
    flagged = written(flagged, "flagged")
    total = flagged.agg(F.sum(F.size("often"))).first()[0] or 0
    shards = max(1, -(-total * (window + window // 2) // shard_words))
    near = base.select("doc_id", "own", "text").join(flagged, ["doc_id", "own"]).mapInArrow(_segments(window, gram), "key long, content long, hot boolean, doc_id long, own long, start long, upto long, w array<long>")
    late = None
    if often.filter("hot").head(1):
        near = written(near, "segments")
        place, again = F.struct("doc_id", "own", "start"), near.filter("hot and upto > 0")  # which its own task has seen before
        first = near.filter("hot and upto = 0")
        least = written(first.groupBy("key", "content").agg(F.min(F.struct("doc_id", "own", "start", "w")).alias("x")), "hot-firsts")
        after = first.select("key", "content", place.alias("place")).join(least.select("key", "content", F.struct("x.doc_id", "x.own", "x.start").alias("lead")), ["key", "content"])
        late = after.filter("place > lead").select("place.doc_id", "place.own", F.col("place.start").alias("from"), (F.col("place.start") + window).alias("upto"))
        late = late.unionByName(again.select("doc_id", "own", F.col("start").alias("from"), "upto"))
        near = near.filter("not hot").select("key", "doc_id", "own", "start", "upto", "w").unionByName(least.select("key", "x.doc_id", "x.own", "x.start", F.lit(0).cast("long").alias("upto"), "x.w"))
    near = near.select("key", "doc_id", "own", "start", "upto", "w").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    found = near.groupBy("shard").applyInPandas(_shard(window), "doc_id long, own long, from long, upto long")
    late = found if late is None else found.unionByName(late)
    late = late.groupBy("doc_id", "own").agg(F.collect_set(F.struct("from", "upto")).alias("gone"))
    late = written(late, "late")
    verdict = listed.select("doc_id", "own", "own2").distinct().join(firsts, ["own", "own2"]).join(late, ["doc_id", "own"], "left")
    verdict = verdict.select("doc_id", "own", (F.col("doc_id") > F.col("first")).alias("copy"), "gone").filter("copy or gone is not null")
    out = base.join(verdict, ["doc_id", "own"], "left").select(F.col("id").alias("doc_id"), "text", "copy", "gone")
    return out.mapInArrow(_remove(window, ["doc_id"]), "doc_id long, n_words long, n_removed long, kept string")

