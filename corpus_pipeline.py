"""The corpus pipeline: quality rules, toxicity, line dedup, near-dedup and packing, in this order."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.llm import lines, minhash, packing, quality, toxicity
from pitspark.llm._io import delete, grows, mark, shared_dir, sweep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the threshold table (``quality.DEFAULT_RULES``) and the base rule.

    Null and empty texts have no words and go; very long ones are measured whole; equal rows get equal verdicts;
    doc_id and the other columns may be null or repeat and pass through; an empty table gives none; a
    column named ``quality`` would be dropped, others of any name stay."""
    return quality.evaluate(docs).where("quality.kept").drop("quality")


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, fitted on the labelled ones, does not predict toxic.

    Null and empty texts score 0 and stay; whole texts of any length are scored; equal texts fare alike; rows with a
    null or repeated doc_id are scored like others (labels join by doc_id, null labels count for nothing); without labels
    the seed terms are the lexicon; an empty table gives none; all columns pass through under any name."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.fit(docs, labels)
    return toxicity.without_toxic(docs, lexicon)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines that an earlier line matches (``lines.dedup_lines``); a document of which no word is left goes,
    n_chars follows the text where it changed.

    A null text stays null and a document that had no word stays; rows that repeat a doc_id are documents of their own, in
    the order of their texts' hashes, of equal rows one keeps its lines; rows with a null doc_id keep all lines and
    remove none; an empty table gives none; other columns pass through (n_lines and n_removed are dropped)."""
    out = lines.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & (F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) == 0)
    return out.where(~emptied | F.col("text").isNull()).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("n_lines", "n_removed")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard 0.8; it is the one of the smallest doc_id.

    Null, empty and blank texts link with nothing and stay. Rows that repeat a doc_id are documents of their own by their texts;
    rows of one doc_id and equal texts are one document, with the least of their other columns. Rows with a null
    doc_id are compared with nothing and stay. An empty table gives none; columns named text_hash would clash."""
    kept = minhash.near_duplicates(docs, shingle=5, percent=80).where("kept").select("doc_id", "text_hash").distinct()
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    chosen = docs.withColumn("text_hash", F.xxhash64("text")).join(grows(kept), ["doc_id", "text_hash"], "left_semi")
    once = chosen.groupBy("doc_id", "text_hash", "text").agg(F.min(F.struct(*rest)).alias("rest"))
    once = once.select(*(F.col(f"rest.{c}").alias(c) if c in rest else c for c in docs.columns))
    return once.unionByName(docs.where("doc_id IS NULL"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of ``packing.CAPACITY`` words: doc_id, piece, start, length, bin, place.

    A null, empty or blank text is a piece of length 0; a long text is cut into pieces; rows with a null or repeated
    doc_id and equal rows are packed like others; a null source conflicts with nothing; an empty table gives none;
    other columns are left out."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("line_dedup", repeated_lines),
    ("minhash_near_dedup", near_copies),
    ("best_fit_packing", packed),
]
#: Lexicon fitting, signatures and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again. A stage's scratch tables
    and its input, once its result is written, are deleted; the last result stays."""
    at = os.path.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        begun = mark()
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        sweep(spark, begun)
        if k:
            delete(spark, f"{at}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
