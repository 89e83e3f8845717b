"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 1: the token counts, 0: any token may stand there. Whatever up to a fifth of 15 to 20 tokens is substituted, one of the masks
#: has a place where it sees none of that, so no passage is missed (tests go through all patterns).
MASKS = ("1101010011", "1000101111", "1111001100", "1111110000")
#: So many seeds of items may be broadcast, 32 bytes each, and so many of their tokens, 8 bytes each.
BROADCAST_ROWS = 1_000_000
BROADCAST_TOKENS = 4_000_000
PIECE = 1024
#: Items of fewer tokens have runs of tokens as seeds, which miss nothing.
SHORT = 15


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _pieces(df: DataFrame, span: int, reach: int) -> DataFrame:
    """(key, c, h, begin): texts in pieces of PIECE positions with `reach` more tokens at both ends, so no row carries a long text.
    c: the piece's first position in the text, h: its token hashes, begin: the position c in it."""
    begin = F.greatest(F.col("c") - reach, F.lit(0))
    at = df.select("key", "h", F.explode(F.when(F.size("h") >= span, F.sequence(F.lit(0), F.size("h") - span, F.lit(PIECE)))).alias("c"))
    return at.select("key", "c", F.slice("h", begin + 1, F.col("c") - begin + PIECE + span + reach).alias("h"), (F.col("c") - begin).alias("begin"))


def _seeds(pieces: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """pieces with a row for each mask at each position `at`, with the hash of the tokens that count."""
    last = F.least(F.col("begin") + PIECE - 1, F.size("h") - len(masks[0]))
    at = pieces.select("key", "c", "h", F.explode(F.sequence("begin", last)).alias("at"))
    seeds = [F.xxhash64(F.lit(n), *[F.get("h", F.col("at") + i) for i, bit in enumerate(mask) if bit == "1"]) for n, mask in enumerate(masks)]
    return at.select("key", "c", "h", "at", F.explode(F.array(*seeds)).alias("seed"))


def _run(n: int, share: float) -> int:
    """The tokens on end that any n have in common if `share` of them agree: the others cut them into so many runs at most."""
    agree = max(1, ceil(n * share))
    return ceil(agree / (n - agree + 1))


def _passages(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...], window: int, share: float) -> DataFrame:
    """`contaminated` with the seeds of `masks`, of sides that have `key` and the token hashes `h`."""
    span = len(masks[0])
    assert all(len(m) == span for m in masks)
    reach = window - span
    ipieces, pieces = _pieces(benchmark, span, reach), _pieces(docs, span, reach)
    # seeds meet without the items' tokens, which are fetched for the hits
    items = _seeds(ipieces, masks).select("seed", F.col("key").alias("item_id"), F.col("c").alias("ic"), F.col("at").alias("j"))
    tokens_of = ipieces.select(F.col("key").alias("item_id"), F.col("c").alias("ic"), F.col("h").alias("ih"))
    rows, held = ipieces.agg(F.coalesce(F.sum(F.size("h") * len(masks)), F.lit(0)), F.coalesce(F.sum(F.size("h")), F.lit(0))).first()
    seeds = _seeds(pieces, masks).select(F.col("key").alias("doc_id"), "c", "h", F.col("at").alias("p"), "seed")
    if rows <= BROADCAST_ROWS:
        hits = seeds.join(F.broadcast(items), "seed")
    else:  # the documents' tokens are not shuffled with each seed, but fetched too
        hits = seeds.drop("h").join(items.hint("merge"), "seed").join(pieces.select(F.col("key").alias("doc_id"), "c", "h").hint("merge"), ["doc_id", "c"])
    hits = hits.join(F.broadcast(tokens_of) if held <= BROADCAST_TOKENS else tokens_of.hint("merge"), ["item_id", "ic"])
    size, isize, reach = F.size("h"), F.size("ih"), F.lit(reach)
    need = F.least(isize, F.lit(window))
    left = F.least("j", "p", reach)
    right = F.least(isize - F.col("j") - span, size - F.col("p") - span, reach)
    width = left + span + right
    same = F.zip_with(F.slice("h", F.col("p") - left + 1, width), F.slice("ih", F.col("j") - left + 1, width), lambda x, y: (x == y).cast("int"))
    near = hits.select("doc_id", "item_id", need.alias("need"), F.explode(F.when(width >= need, F.array(same))).alias("same"))  # explode keeps this out of the join's condition
    least = F.ceil(F.col("need") * share)
    sums = F.transform(F.sequence(F.lit(1), F.size("same") - F.col("need") + 1), lambda s: F.aggregate(F.slice("same", s, F.col("need")), F.lit(0), lambda n, x: n + x))
    best = near.filter(F.aggregate("same", F.lit(0), lambda s, x: s + x) >= least).select("doc_id", "item_id", "need", F.array_max(sums).alias("matched")).filter(F.col("matched") >= least)
    return best.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("need").alias("compared"))


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = 20, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, matched, compared): documents that hold a passage of a benchmark item.

    A hit is a place where document and item agree on all tokens that one mask counts. Around it, along
    the same alignment, a passage of min(window, the item's tokens) tokens must agree in `share` of its
    places; substituted tokens may be anything. The best passage of each pair is returned.
    No passage of SHORT tokens or more is missed. Items of fewer than SHORT tokens need no mask: each passage of their length that agrees in `share` of its places is
    found, an item of one word in every document that has the word. Null texts have no tokens and are never reported;
    rows that repeat an id count as one document with the passages of all. Without rows on either side there is no result.
    Texts of any length are taken whole, in pieces; other columns are not read, so none can clash.

    The items' seeds are broadcast when there are at most BROADCAST_ROWS of them, else both sides are shuffled.
    """
    hashed = lambda df, key: df.select(F.col(key).alias("key"), F.transform(tokens(F.col("text")), lambda t: F.xxhash64(t)).alias("h")).filter(F.col("key").isNotNull())
    docs, items = hashed(docs, "doc_id"), hashed(benchmark, "item_id")
    shorter = [r.n for r in items.select(F.size("h").alias("n")).filter(F.col("n").between(1, SHORT - 1)).distinct().collect()]
    found = [_passages(docs, items.filter(F.size("h") >= SHORT), masks, window, share)]
    for run in sorted({_run(min(n, window), share) for n in shorter}):
        own = [n for n in shorter if _run(min(n, window), share) == run]
        found.append(_passages(docs, items.filter(F.size("h").isin(own)), ("1" * run,), window, share))
    if len(found) == 1:
        return found[0]
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("compared").alias("compared"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents of which `contaminated` reports none; rows of a null doc_id stay."""
    return docs.join(contaminated(docs, benchmark, **settings).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
