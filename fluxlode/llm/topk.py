"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions are dealt to `nodes` groups; a pair's score is the sum of its groups' partial scores.
Phase 1 takes each group's local list of best partial scores, whose exact sums give a safe cutoff:
no row below it can be among the best. Phase 2 broadcasts the cutoff; a pair is closed as soon as the parts it
has and the norms of the others can't reach it, and a row is collected if one shifted partial score reaches its even
share. Phase 3 bounds each collected row by what it sent and resolves those still open exactly. Shards keep k rows a query, so ties of any number stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import written

NONE = -(2.0**60)
TILE = 1024
#: From this share of open pairs of a tile on, they are resolved one by one.
FEW_OPEN = 1 / 8


def whole_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of rows with an id and a vector without null or non-finite components."""
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), x.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)


def _matrix(vectors, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(256.0 * out)


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best rows of each query: highest score, then smallest id."""
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    begin = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)]))
    keep = place < k
    return q[keep], ids[keep], score[keep]


def _tiles(frames: Iterator[pd.DataFrame], queries, dims: int):
    """(ids, rows, first query, queries, which pairs are a query's own row) of blocks of rows and queries."""
    qid, qm = queries.value
    for frame in frames:
        for a in range(0, len(frame), TILE):
            ids = frame["id"].to_numpy()[a : a + TILE]
            rows = _matrix(frame["v"].tolist()[a : a + TILE], dims)
            for b in range(0, len(qid), TILE):
                yield ids, rows, b, qm[b : b + TILE], ids[:, None] == qid[None, b : b + TILE]


def _groups(dims: int, nodes: int) -> list[np.ndarray]:
    return np.array_split(np.arange(dims), nodes)


def _phase1(queries, dims: int, nodes: int, k: int):
    def run(frames):
        n = len(queries.value[0])
        least = np.full((nodes, n), np.inf)
        top: tuple[np.ndarray, ...] = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        seen = False
        for ids, rows, b, qm, own in _tiles(frames, queries, dims):
            seen = True
            part = np.stack([rows[:, g] @ qm[:, g].T for g in _groups(dims, nodes)])
            width = part.shape[2]
            least[:, b : b + width] = np.minimum(least[:, b : b + width], part.min(1))
            listed = np.zeros(own.shape, bool)
            for g in range(nodes):
                p = np.where(own, -np.inf, part[g])
                at = np.argpartition(-p, min(k, len(ids)) - 1, axis=0)[:k]
                np.put_along_axis(listed, at, True, 0)
            r, q = np.nonzero(listed & ~own)
            top = _best(np.r_[top[0], q + b], np.r_[top[1], ids[r]], np.r_[top[2], part.sum(0)[r, q]], k)
        if seen:
            yield pd.DataFrame({"q": top[0], "node": -1, "id": top[1], "x": top[2]})
            for g in range(nodes):
                yield pd.DataFrame({"q": np.arange(n), "node": g, "id": 0, "x": least[g]})

    return run


def above(rows: np.ndarray, qm: np.ndarray, groups: list[np.ndarray], tau: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, query, score of every pair whose score reaches the query's tau, multiplications done).

    Group by group: a pair is closed when what it has and the other groups' norms can't reach tau. Once few are open, these
    alone are resolved. Else, with all parts there, a row is collected if one shifted part reaches its even share, and bounded
    by what it sent."""
    norm = lambda m: np.stack([np.sqrt((m[:, g] ** 2).sum(1)) for g in groups])
    rn, qn = norm(rows), norm(qm)
    parts, total, done = [], np.zeros((len(rows), len(qm))), 0
    for i, g in enumerate(groups):
        parts.append(rows[:, g] @ qm[:, g].T)
        total += parts[-1]
        done += total.size * len(g)
        rest = np.concatenate(groups[i + 1 :]) if i + 1 < len(groups) else np.zeros(0, int)
        if not len(rest):
            break
        open_ = total + rn[i + 1 :].T @ qn[i + 1 :] * (1 + 1e-12) >= tau
        if open_.mean() <= FEW_OPEN:
            r, q = np.nonzero(open_)
            score = total[r, q] + np.einsum("ij,ij->i", rows[np.ix_(r, rest)], qm[np.ix_(q, rest)])
            fit = score >= tau[q]
            return r[fit], q[fit], score[fit], done + len(r) * len(rest)
    floor = least.sum(0)
    share = (tau - floor) / len(groups)
    shifted = np.stack(parts) - least[:, None]
    sent = shifted >= share
    bound = np.where(sent, shifted, share).sum(0)
    r, q = np.nonzero(sent.any(0) & (bound >= tau - floor))
    fit = total[r, q] >= tau[q]
    return r[fit], q[fit], total[r[fit], q[fit]], done


def _phases23(queries, cut, dims: int, nodes: int, k: int):
    def run(frames):
        tau, least = cut.value
        qid = queries.value[0]
        top: tuple[np.ndarray, ...] = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        for ids, rows, b, qm, own in _tiles(frames, queries, dims):
            to = slice(b, b + len(qm))
            r, q, score, _ = above(rows, qm, _groups(dims, nodes), tau[to], least[:, to])
            fit = ~own[r, q]
            top = _best(np.r_[top[0], q[fit] + b], np.r_[top[1], ids[r[fit]]], np.r_[top[2], score[fit]], k)
        yield pd.DataFrame({"query_id": qid[top[0]], "vec_id": top[1], "score": top[2].astype(np.int64)})

    return run


def exact_topk(
    df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", nodes: int = 4, block: int = 4096
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products of floor(256 x) among
    the rows of another id; ties to the smaller id; fewer rows where there are fewer.

    Rows with a null id, or a vector that is null or holds a null or non-finite component, take no part.
    Vectors of different lengths are compared over their common components. Repeated rows count one by one
    as candidates; queries that repeat an id are taken once (any of its vectors). An empty table gives no rows; other columns are not read.
    Scores are exact while they are below 2**53. Queries are broadcast in blocks of about `block`.
    """
    spark: SparkSession = df.sparkSession
    rows, asked = whole_vectors(df, id_col, vec_col), whole_vectors(queries, id_col, vec_col)
    dims, n = asked.agg(F.max(F.size("v")), F.count("*")).first()
    schema = "query_id long, vec_id long, score long"
    found = spark.createDataFrame([], schema)
    dims, blocks = max(dims or 1, 1), -(-n // block)
    nodes = min(nodes, dims)
    rows = rows.withColumn("v", F.slice("v", 1, dims))
    for i in range(blocks):
        got = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").toPandas()
        if not len(got):
            continue
        sent = spark.sparkContext.broadcast((got["id"].to_numpy(), _matrix(got["v"].tolist(), dims)))
        lists = rows.mapInPandas(_phase1(sent, dims, nodes, k), "q long, node int, id long, x double")
        lists = lists.groupBy("q", "node", F.when(F.col("node") < 0, F.col("id")).alias("id"), F.when(F.col("node") < 0, F.col("x")).alias("s")).agg(
            F.min("x").alias("x"), F.count("*").alias("n")
        )
        ranked = lists.filter("node < 0").withColumn("upto", F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("x"), "id")))
        tau = ranked.filter(F.col("upto") >= k).groupBy("q").agg(F.max("x").alias("x")).withColumn("node", F.lit(-1))
        low = lists.filter("node >= 0").groupBy("q", "node").agg(F.min("x").alias("x"))
        cut = tau.unionByName(low.select("q", "x", "node")).toPandas()
        least, safe = np.zeros((nodes, len(got))), np.full(len(got), NONE)
        for g in range(nodes):
            part = cut[cut.node == g]
            least[g, part.q] = part.x
        part = cut[cut.node < 0]
        safe[part.q] = part.x
        late = spark.sparkContext.broadcast((safe, least))
        one = rows.mapInPandas(_phases23(sent, late, dims, nodes, k), schema)
        found = found.unionByName(written(one, "topk") if blocks > 1 else one)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
