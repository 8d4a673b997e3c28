"""Term and tag statistics in XML: `<Collection termCount docCount>` around `<Term .../>` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW = "_name STRING, _ctf LONG, _df LONG, _idf DOUBLE, _ictf DOUBLE"


def _read(spark: SparkSession, path: str, row: str, compat: bool) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", row).schema(_ROW).load(path)
    stats = rows.select(
        F.col("_name").alias("term"),
        F.col("_ctf").alias("ctf"),
        F.col("_ctf" if compat else "_df").alias("df"),
        F.col("_idf").alias("idf"),
        F.col("_ictf").alias("ictf"),
    )
    twice = stats.groupBy("term").count().where(F.col("count") > 1).select("term").first()
    if twice is not None:
        raise ValueError(f"{row} {twice[0]!r} occurs more than once in {path}")
    return stats


def read_term_stats(spark: SparkSession, path: str, *, compat: bool = False) -> DataFrame:
    """term, ctf, df, idf, ictf. With `compat`, df is a copy of ctf. Repeated names are refused."""
    return _read(spark, path, "Term", compat)


def read_tag_stats(spark: SparkSession, path: str, *, compat: bool = False) -> DataFrame:
    """The same for `<Tag>` rows; the tag is in the column `term`."""
    return _read(spark, path, "Tag", compat)


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """One row: term_count (or the tag count) and doc_count of the collection.

    The file is read tag by tag, so the collection never becomes one row.
    """
    tags = spark.read.option("lineSep", ">").text(path)
    opening = tags.where(F.col("value").rlike(r"<Collection\s"))

    def attribute(name: str):
        return F.regexp_extract("value", rf"\b(?:{name})\s*=\s*[\"'](\d+)[\"']", 1).cast("long")

    return opening.select(
        attribute("termCount|tagCount").alias("term_count"), attribute("docCount").alias("doc_count")
    )
