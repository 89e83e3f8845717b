"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.

All stages but the last return the columns of documents; the last returns pieces of packed sequences.
A stage's result has to be written before the next stage is called, as run() does: each stage begins by
deleting the tables that the stage before it left in the shared folder; other tables are not touched.

Of all stages: a null text, doc_id or label is allowed; an empty table gives no rows; rows that repeat another are
documents of their own, but for the join, which keeps one of them; texts of any length are taken whole; documents
may have further columns, whatever their names, and n_chars may be missing.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlode.llm.decontaminate import decontaminate
from fluxlode.llm.jaccard import BROADCAST_ROWS, jaccard_components
from fluxlode.llm.line_dedup import dedup_lines
from fluxlode.llm.packing import pack
from fluxlode.llm.quality import Resampling
from fluxlode.llm.queries import tokenizer_path
from fluxlode.llm.store import drop, free, scope, table, written

_LEFT: list[str] = []


def stage(f):
    """f with the intermediate tables of the stage before it deleted and its own noted."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _LEFT)
        with scope() as own:
            try:
                return f(spark, docs, sf_dir)
            finally:
                _LEFT.extend(own)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling selects. A null or empty text weighs 0 and is kept or not by its noise
    as any other; rows that repeat a doc_id and text stay or go together; without labels of both kinds all stay."""
    return Resampling(docs, table(spark, sf_dir, "labels")).documents()


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates; n_chars, if it is there, follows a text that has lost lines.
    No document goes; a null text stays null, one that loses all its lines becomes empty."""
    lines, removed = free("n_lines", docs.columns), free("n_removed", docs.columns)
    out = dedup_lines(docs, counts=(lines, removed))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each component at a similarity of 0.8 of five-word shingles, one row of it if
    rows repeat it. Texts without words stay, and rows of a null doc_id."""
    found = jaccard_components(docs, k=5, num=80, den=100)
    fate = found.filter("component_id is not null").groupBy("doc_id", "own").agg(F.max((F.col("component_id") != F.col("doc_id")).cast("int")).alias("late"), F.count("*").alias("times"))
    fate = written(fate.filter("late = 1 or times > 1").select(F.col("doc_id").alias("fate_id"), F.col("own").alias("fate_own"), "late"), "late-copies")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("own"))
    rows = rows.join(F.broadcast(fate) if fate.count() <= BROADCAST_ROWS else fate, (F.col("id") == F.col("fate_id")) & (F.col("own") == F.col("fate_own")), "left")
    kept = rows.filter("late is null").select("row.*")
    if not fate.filter("late = 0").head(1):
        return kept
    return kept.unionByName(rows.filter("late = 0").dropDuplicates(["id", "own"]).select("row.*"))


@stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item. Null texts hold none; all rows of a doc_id go with one of them."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens; a null or empty text is a piece of one token."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality), ("line_dedup", line_dedup), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", benchmark), ("packing", packing)]

#: The quality stage's smoothed ratios, the components of large groups and first-fit can't be put into SQL; tests/llm
#: holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, one in STAGES[:-1]:
        docs = written(one(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
