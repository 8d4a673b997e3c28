"""From raw documents to packed sequences: quality, near duplicates, mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill.llm import mixing, nbsvm, packing, shingles
from askmill.llm.frames import stored, table
from askmill.llm.queries import WORD_BPE, quality_model
from askmill.session import prepare


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; it learns from the labels not held out.

    Columns named like the classifier's own keep their values.
    """
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("doc"), "text")
    rows = nbsvm.scored(own, quality_model(prepare(spark), sf_dir)).where("predicted = 1")
    return rows.select(*(F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the first by doc_id, null ids last.

    Documents link at Jaccard similarity 0.8 of their five-word shingles. Rows count each on their own, with
    repeated and null ids too, so of rows that repeat one stays.
    """
    whole = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"))
    whole = stored(whole, "documents")
    groups = shingles.grouped(
        whole.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))
    )
    kept = groups.where("row = first.row").select("row")
    return whole.join(kept, "row", "left_semi").select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, those taken twice as two rows."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and the checksum of each piece's ids."""
    # workers that earlier stages have used keep some memory, so this one keeps fewer words
    cut = packing.pieces(docs, WORD_BPE, cached=250_000)
    return packing.packed(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]
#: No stage is expressible in SQL: a fitted model, components, a seeded subset sum, differencing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
