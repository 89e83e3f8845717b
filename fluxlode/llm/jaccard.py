"""N-gram Jaccard join by signature trees.

1. Equal sets are one class, named by a hash of the set. Candidates come from prefix filtering: in any order of all
   shingles, two similar sets share one of the first n - ceil(n num / den) + 1 of each. Ordered by the number of classes that
   hold them, shingles of one class come first and meet nobody, and a passage that many documents share comes last, so
   it chains nothing. Classes that share such a rare shingle are linked in stars, whose components are the candidates.
2. A component is dealt to chunks of bounded size. In each a signature tree is built, whose nodes hold
   the OR of their sets' token bitmaps and the range of their sizes; it is joined with itself by dual
   traversal, which drops a pair of nodes if their largest possible overlap is too small. Surviving pairs
   are checked exactly, unless links found before already join them.
3. Of a component of several chunks (many near copies), a few members of each larger linked group meet in
   further chunks, which joins the groups. What is still outside the component's largest group is then joined with every
   cell of near sizes, so all pairs have been compared or joined; a large group of copies costs its size, not its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shingles import fingerprint, lists, sets
from .store import written
from .words import mix, slices, words

NUM, DEN = 90, 100
CHUNK = 1024
SHINGLES = 3_000_000
#: So many candidates' ids may be broadcast, 56 bytes each at most.
BROADCAST_ROWS = 200_000
#: Pairs of a shingle and a class in a part, about.
PAIRS = 1_500_000
#: Shingles of about HOT sets are hot, as one in SAMPLE texts tells; at most HOTTEST are told apart, 8 bytes each.
HOT, SAMPLE, HOTTEST = 32_000, 64, 100_000
ENVOYS = 4


class Tree:
    """A binary signature tree over sets ordered by size; levels[0] are the sets, each next level ORs pairs."""

    def __init__(self, members: list[np.ndarray], bits: int):
        sizes = np.array([len(m) for m in members], np.int64)
        self.order = np.argsort(sizes, kind="stable")
        width = 1 << max(0, int(len(members) - 1).bit_length())
        maps = np.zeros((width, bits // 8), np.uint8)
        for row, i in enumerate(self.order):
            maps[row] = np.packbits(np.bincount((members[i] % np.uint64(bits)).astype(np.int64), minlength=bits) > 0)
        maps = maps.view(np.uint64)
        small = np.full(width, np.iinfo(np.int64).max >> 8)
        large, hidden = np.zeros(width, np.int64), np.zeros(width, np.int64)
        small[: len(members)] = large[: len(members)] = sizes[self.order]
        hidden[: len(members)] = large[: len(members)] - np.bitwise_count(maps[: len(members)]).sum(1).astype(np.int64)
        self.levels = [(maps, small, large, hidden)]
        while len(maps) > 1:
            maps, small, large, hidden = maps[::2] | maps[1::2], np.minimum(small[::2], small[1::2]), np.maximum(large[::2], large[1::2]), np.maximum(hidden[::2], hidden[1::2])
            self.levels.append((maps, small, large, hidden))


def traverse(x: Tree, y: Tree, num: int, den: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sets (in the trees' orders) that may be similar, and a lower bound of their difference."""
    top = max(len(x.levels), len(y.levels)) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(top, -1, -1):
        xm, xs, xl, xh = x.levels[min(level, len(x.levels) - 1)]
        ym, ys, yl, yh = y.levels[min(level, len(y.levels) - 1)]
        if level < top:
            if level < len(x.levels) - 1:
                i, j = (i[:, None] * 2 + [0, 1]).ravel(), np.repeat(j, 2)
            if level < len(y.levels) - 1:
                i, j = np.repeat(i, 2), (j[:, None] * 2 + [0, 1]).ravel()
            if same:
                i, j = i[i <= j], j[i <= j]
        keep = (xl[i] * den >= num * ys[j]) & (yl[j] * den >= num * xs[i]) & (xl[i] > 0) & (yl[j] > 0)
        i, j = i[keep], j[keep]
        parts = []
        for a in range(0, len(i), 65536):
            p, q = i[a : a + 65536], j[a : a + 65536]
            common = np.bitwise_count(xm[p] & ym[q]).sum(1).astype(np.int64) + np.minimum(xh[p], yh[q])
            parts.append(np.minimum(common, np.minimum(xl[p], yl[q])) * (num + den) >= num * (xs[p] + ys[q]))
        keep = np.concatenate(parts) if parts else np.zeros(0, bool)
        i, j = i[keep], j[keep]
    if same:
        i, j = i[i < j], j[i < j]
    apart = np.zeros(len(i), np.int64)
    for a in range(0, len(i), 65536):
        apart[a : a + 65536] = np.bitwise_count(x.levels[0][0][i[a : a + 65536]] ^ y.levels[0][0][j[a : a + 65536]]).sum(1)
    near = apart * (num + den) <= (den - num) * (x.levels[0][1][i] + y.levels[0][1][j])
    return i[near], j[near], apart[near]


def tree_links(ids: list[int], members: list[np.ndarray], num: int, den: int, group: list[int] | None = None, cut: int | None = None) -> list[tuple[int, int]]:
    """Links that join what is similar among the members; with `cut`, only pairs across members[:cut] and the rest.

    group: names of groups already joined. Not all links are returned, but enough for the same components.
    """
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    group = group or ids
    bits = 1 << min(16, max(8, int(2 * max(map(len, members)) - 1).bit_length()))
    if cut is None:
        tree = Tree(members, bits)
        i, j, apart = traverse(tree, tree, num, den, True)
        i, j = tree.order[i], tree.order[j]
    else:
        x, y = Tree(members[:cut], bits), Tree(members[cut:], bits)
        i, j, apart = traverse(x, y, num, den, False)
        i, j = x.order[i], y.order[j] + cut
    out = []
    for n in np.argsort(apart, kind="stable"):
        a, b = int(i[n]), int(j[n])
        p, q = root(group[a]), root(group[b])
        if p == q:
            continue
        s, t = members[a], members[b]
        at = np.searchsorted(t, s)
        common = int((t[np.minimum(at, len(t) - 1)] == s).sum())
        if den * common >= num * (len(s) + len(t) - common):
            parent[max(p, q)] = min(p, q)
            out.append((ids[a], ids[b]))
    return out


def prefix(n: int | np.ndarray, num: int, den: int):
    """So many of a set's shingles can't all be missed by a similar set."""
    return n - (n * num + den - 1) // den + 1


def _inside(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _common(k: int):
    """Shingles and the number of sets of the batch that hold them."""
    schema = pa.schema([("s", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch):
                found = {fingerprint(x): x for x in sets(words(part.column("text"), lower=True), k) if len(x)}
                if found:
                    value, n = np.unique(np.concatenate(list(found.values())), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], schema=schema)

    return run


def hot_shingles(text: DataFrame, k: int) -> np.ndarray:
    """Shingles of very many sets, HOTTEST at most, from a sample by hash. They only go last in the order of all shingles, so what
    the sample misses costs time, not links."""
    sample = text.filter(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(SAMPLE)) == 0)
    counts = written(sample.select("text").mapInArrow(_common(k), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")), "sampled")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.filter(F.col("n") >= max(HOT // SAMPLE, total // HOTTEST)).select("s").toPandas()["s"].to_numpy(np.int64)
    return np.sort(often.view(np.uint64))


def _digest(k: int, hot):
    schema = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("plain", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch):
                found = sets(words(part.column("text"), lower=True), k)
                cls = [fingerprint(s) if len(s) else None for s in found]
                plain = [int((~_inside(s, hot.value)).sum()) for s in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("own"), pa.array(map(len, found), pa.int64()), pa.array(cls, pa.int64()), pa.array(plain, pa.int64())], schema=schema)

    return run


def _dealt_blobs(part: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(parts, for each the columns' values of its rows, column after column)."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
    return part[edges[:-1]], [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(edges[:-1], edges[1:])]


def _read(blobs, *types) -> list[np.ndarray]:
    """The columns of blobs, on end."""
    width, out = sum(np.dtype(t).itemsize for t in types), [[] for _ in types]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for t, own in zip(types, out):
            own.append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(own) if own else np.zeros(0, t) for t, own in zip(types, out)]


BLOBS = "part int, hot boolean, pairs binary"


def _pairs(k: int, num: int, den: int, parts: int, hot, most: int = 1_000_000):
    """Shingles and classes, dealt by shingle; of the hot ones, dealt by class, as many as a prefix may take."""
    schema = pa.schema([("part", pa.int32()), ("hot", pa.bool_()), ("pairs", pa.binary())])

    def packed(held: list, is_hot: bool):
        s, c = np.concatenate([x for x, _ in held]), np.concatenate([np.full(len(x), cls, np.int64) for x, cls in held])
        part = (mix(c.view(np.uint64) if is_hot else s) % np.uint64(parts)).astype(np.int32)
        at, blobs = _dealt_blobs(part, s, c)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array([is_hot] * len(at)), pa.array(blobs, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]):
        held, size = ([], []), 0
        for batch in batches:
            for part in slices(batch):
                seen = set()
                for s in sets(words(part.column("text"), lower=True), k):
                    n = len(s)
                    if (den - num) * (n + n * den // num) < den + num or (c := fingerprint(s)) in seen:
                        continue  # such a small set has no similar set but an equal one
                    seen.add(c)
                    is_hot = _inside(s, hot.value)
                    held[0].append((s[~is_hot], c))
                    if is_hot.any():
                        held[1].append((s[is_hot][: prefix(n, num, den)], c))
                    size += n
                if size > most:
                    yield from (packed(x, i == 1) for i, x in enumerate(held) if x)
                    held, size = ([], []), 0
        yield from (packed(x, i == 1) for i, x in enumerate(held) if x)

    return run


LAST = np.iinfo(np.uint16).max


def _repeated(parts: int):
    """Pairs of a part's shingles that more than one class has, with that number, dealt by class; hot ones come as they are."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        s, c = _read(rows.loc[~rows["hot"], "pairs"], np.uint64, np.int64)
        order = np.lexsort((c, s))
        s, c = s[order], c[order]
        new = np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])][: len(s)]
        s, c = s[new], c[new]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]][: len(s)])
        sets_ = np.diff(np.r_[first, len(s)])
        sets_ = np.repeat(np.minimum(sets_, LAST - 1), sets_).astype(np.uint16)
        s, c, sets_ = s[sets_ > 1], c[sets_ > 1], sets_[sets_ > 1]
        hs, hc = _read(rows.loc[rows["hot"], "pairs"], np.uint64, np.int64)
        s, c, sets_ = np.r_[s, hs], np.r_[c, hc], np.r_[sets_, np.full(len(hs), LAST, np.uint16)]
        at, blobs = _dealt_blobs((mix(c.view(np.uint64) ^ np.uint64(9)) % np.uint64(parts)).astype(np.int32), c, s, sets_)
        return pd.DataFrame({"part": at, "pairs": blobs})

    return run


def _rarest(rows: pd.DataFrame, classes: pd.DataFrame) -> pd.DataFrame:
    """Of each class the shared shingles within its prefix."""
    c, s, sets_ = _read(rows["pairs"], np.int64, np.uint64, np.uint16)
    order = np.lexsort((s, sets_, c))
    c, s, sets_ = c[order], s[order], sets_[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])][: len(s)]
    c, s, sets_ = c[new], s[new], sets_[new]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]][: len(c)])
    size = np.diff(np.r_[first, len(c)])
    shared = np.add.reduceat((sets_ < LAST).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    known = classes.drop_duplicates("cls").sort_values("cls")
    ids, spare = known["cls"].to_numpy(np.int64), known["spare"].to_numpy(np.int64)
    at = np.minimum(np.searchsorted(ids, c[first]), max(len(ids) - 1, 0))
    take = np.where(ids[at] == c[first], spare[at] + shared, 0) if len(ids) else np.zeros(len(first), np.int64)
    keep = np.arange(len(c)) - np.repeat(first, size) < np.repeat(take, size)
    return pd.DataFrame({"cls": c[keep], "s": s[keep].view(np.int64)})


def rare_stars(text: DataFrame, digests: DataFrame, k: int, num: int, den: int, hot) -> DataFrame:
    """Stars (a, b) of the classes that share a shingle of both prefixes. Pairs of shingles and classes are dealt to parts of bounded
    size; a star has one row a class, and its smallest class is found by a minimum that is combined before the shuffle."""
    total = digests.agg(F.sum("plain")).first()[0] or 0
    parts = max(int(text.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PAIRS)
    n = F.col("x.n")
    spare = n - F.ceil(n * num / den) + 1 - F.col("x.plain")  # prefix less the shingles that aren't hot
    classes = digests.filter("cls is not null").groupBy("cls").agg(F.min(F.struct("n", "plain")).alias("x")).select("cls", spare.cast("long").alias("spare"))
    pairs = text.select("text").mapInArrow(_pairs(k, num, den, parts, hot), BLOBS).groupBy("part").applyInPandas(_repeated(parts), "part int, pairs binary")
    classes = classes.mapInArrow(_with_part(parts), "part int, cls long, spare long")
    signs = pairs.groupBy("part").cogroup(classes.groupBy("part")).applyInPandas(_rarest, "cls long, s long")
    signs = written(signs, "rare")
    least = signs.groupBy("s").agg(F.min("cls").alias("b"), F.count("*").alias("sets")).filter("sets > 1").select("s", "b")
    return signs.join(least.hint("merge"), "s").filter("cls <> b").select(F.col("cls").alias("a"), "b").distinct()


def _with_part(parts: int):
    schema = pa.schema([("part", pa.int32()), ("cls", pa.int64()), ("spare", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            cls = batch.column("cls").to_numpy()
            part = (mix(cls.view(np.uint64) ^ np.uint64(9)) % np.uint64(parts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column("cls"), batch.column("spare")], schema=schema)

    return run


def _members(k: int):
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("h", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch):
                # a row that repeats the doc_id may hold another text
                found = sets(words(part.column("text"), lower=True), k)
                right = np.array([len(s) > 0 and fingerprint(s) == c for c, s in zip(part.column("cls").to_pylist(), found)], bool)
                kept = part.select(["cls", "n"]).filter(pa.array(right))
                yield pa.RecordBatch.from_arrays([*kept.columns, lists([s for s, ok in zip(found, right) if ok])], schema=schema)

    return run


LINKS = "a long, b long"


def _join_chunk(num: int, den: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("cls").sort_values("cls")
        links = tree_links(rows["cls"].tolist(), [h.view(np.uint64) for h in rows["h"]], num, den, rows["grp"].tolist() if "grp" in rows else None)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _join_across(num: int, den: int):
    """Rows of side 0 with those of side 1."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["side", "cls"]).sort_values(["side", "cls"])
        cut = int((rows["side"] == 0).sum())
        links: list[tuple[int, int]] = []
        if 0 < cut < len(rows):
            links = tree_links(rows["cls"].tolist(), [h.view(np.uint64) for h in rows["h"]], num, den, rows["grp"].tolist(), cut)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _parts(df: DataFrame, chunk: int, most: int, by: tuple[str, ...], name: str) -> DataFrame:
    """by, and how many chunks of bounded size its rows fill."""
    return df.groupBy(*by).agg(F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("n") / most)).cast("long").alias(name))


def _dealt(df: DataFrame, chunk: int, most: int, k: str, cell: str) -> tuple[DataFrame, DataFrame]:
    """(k of each component and band, df with its cell): classes go to k cells of bounded size."""
    size = _parts(df, chunk, most, ("comp", "band"), k)
    return size, df.join(size, ["comp", "band"]).withColumn(cell, F.pmod(F.xxhash64("cls", F.lit(5)), F.col(k)))


def _bands(df: DataFrame, size: DataFrame, k: str, other: str, cell: str) -> DataFrame:
    """df with a row for each cell (other, cell) of its band and the next ones; no set further off can be similar."""
    near = df.withColumn("step", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn(other, F.col("band") + F.col("step"))
    near = near.join(size.select("comp", F.col("band").alias(other), F.col(k).alias("_k")), ["comp", other])
    return near.withColumn(cell, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1))).drop("_k", "step")


def _grouped(links: DataFrame, members: DataFrame) -> DataFrame:
    """members with grp, the smallest class that links join each with."""
    found = components(links).select(F.col("node").alias("cls"), F.col("component").alias("grp0"))
    return members.join(found, "cls", "left").withColumn("grp", F.coalesce("grp0", "cls")).drop("grp0")


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def similar_classes(docs: DataFrame, k: int = 3, num: int = NUM, den: int = DEN, chunk: int = CHUNK, most: int = SHINGLES) -> tuple[DataFrame, DataFrame]:
    """((doc_id, own, n, cls) of every row, links between classes); own is a hash of the text."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hot = spark.sparkContext.broadcast(hot_shingles(text, k))
    digests = written(text.withColumn("own", F.xxhash64("text")).mapInArrow(_digest(k, hot), "doc_id long, own long, n long, cls long, plain long"), "digests")
    near = components(rare_stars(text, digests, k, num, den, hot)).select(F.col("node").alias("cls"), F.col("component").alias("comp"))
    one = digests.filter("cls is not null and doc_id is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "n")).alias("x")).select("cls", "x.doc_id", "x.n")
    groups = written(near.join(one, "cls"), "near")
    texts = text.join(_small(groups.select("doc_id", "cls", "n")), "doc_id").select("cls", "n", "text")
    members = written(texts.mapInArrow(_members(k), "cls long, n long, h array<long>"), "members")
    # linked sets differ by one band at most
    band = F.floor(F.log("n") / (1.0001 * math.log(den / num))).cast("long")
    groups = groups.drop("doc_id").withColumn("band", band).join(_parts(groups, chunk, most, ("comp",), "parts"), "comp").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")))
    groups = written(groups.select("cls", "comp", "n", "band", "parts", "part"), "candidates")
    sets_of = members.select("cls", "h")
    links = written(sets_of.join(_small(groups), "cls").groupBy("comp", "part").applyInPandas(_join_chunk(num, den), LINKS), "chunk-links")
    large = groups.filter("parts > 1")
    if not large.head(1):
        return digests, links
    named = written(_grouped(links, large.select("cls", "comp", "part", "n")), "groups")
    envoys = named.withColumn("size", F.count("*").over(Window.partitionBy("comp", "part", "grp"))).filter(F.col("size") >= 2 * ENVOYS)
    envoys = envoys.withColumn("r", F.row_number().over(Window.partitionBy("comp", "part", "grp").orderBy(F.xxhash64("cls")))).filter(F.col("r") <= ENVOYS).drop("r", "size")
    while envoys.head(1):
        dealt = _parts(envoys, chunk, most, ("comp",), "k")
        deep = dealt.agg(F.max("k")).first()[0]
        at = envoys.join(dealt, "comp").withColumn("part", F.pmod(F.xxhash64("cls", F.lit(deep)), F.col("k")))
        more = sets_of.join(at.select("cls", "comp", "part", "grp"), "cls")
        found = written(more.groupBy("comp", "part").applyInPandas(_join_chunk(num, den), LINKS), "envoy-links")
        links = links.union(found)
        if deep == 1:
            break
        again = _grouped(links, at.select("cls", "comp", "part", "n"))
        again = again.withColumn("r", F.row_number().over(Window.partitionBy("comp", "part", "grp").orderBy(F.xxhash64("cls")))).filter(F.col("r") <= ENVOYS).drop("r")
        again = written(again, "envoys")
        if again.count() * 2 > envoys.count():
            break
        envoys = again
    named = written(_grouped(links, large.select("cls", "comp", "parts", "band", "n")), "groups")
    main = named.groupBy("comp", "grp").agg(F.count("*").alias("size")).groupBy("comp").agg(F.max_by("grp", F.struct("size", "grp")).alias("main"))
    rest = named.join(main, "comp").filter("grp <> main").select("cls", "comp", "grp", "band", "n")
    outside, rest = _dealt(rest, chunk, most, "k1", "c1")
    whole, named = _dealt(named, chunk, most, "k2", "c2")
    key = ["comp", "b1", "c1", "b2", "c2", "side", "cls", "grp"]
    left = _bands(rest, whole, "k2", "b2", "c2").withColumn("b1", F.col("band")).withColumn("side", F.lit(0))
    right = _bands(named, outside, "k1", "b1", "c1").withColumn("b2", F.col("band")).withColumn("side", F.lit(1))
    # only these narrow rows take part in the joins above; each set is shuffled to them once
    across = left.select(*key).unionByName(right.select(*key)).join(sets_of, "cls")
    last = written(across.groupBy("comp", "b1", "c1", "b2", "c2").applyInPandas(_join_across(num, den), LINKS), "last-links")
    return digests, links.union(last)


def jaccard_components(docs: DataFrame, k: int = 3, num: int = NUM, den: int = DEN, chunk: int = CHUNK, most: int = SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, own) of every row: its set's size, the smallest doc_id that links reach and a hash of its text.

    Words are A-Z lower-cased; a document's set holds its distinct shingles of k words, or its whole sequence
    if that is shorter. Two documents link when den * intersection >= num * union. A null text, or one
    without words, is empty and linked with nothing. Rows with a null doc_id get a null component and take part
    only through equal sets of other rows. Rows that repeat a doc_id are rows of their own, with their own sets. Texts of
    any length are taken whole; an empty table gives no rows; other columns are not read, so none can clash.
    """
    digests, links = similar_classes(docs, k, num, den, chunk, most)
    found = components(links)
    least = digests.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"))
    named = least.join(found, least.cls == found.node, "left").select("cls", "first", F.coalesce("component", "cls").alias("comp"))
    named = written(named, "named")
    heads = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    of = named.join(heads, "comp").select("cls", "component_id")
    out = digests.select("doc_id", "own", F.col("n").alias("n_shingles"), "cls").join(of, "cls", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "own")
