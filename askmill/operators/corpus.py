"""Corpus statistics: how often terms and tags occur, over how many documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askmill.functions.text import GAP_RUN, WORD_RUN, words
from askmill.session import stored


def _document_terms(docs: DataFrame, terms: Column) -> DataFrame:
    """One row per term occurrence; `first` is 1 on one occurrence per document.

    Sorting the array inside its row brings equal terms together, so a document's own duplicates
    are told apart without a shuffle on (document, term). The outer explode keeps the optimizer from
    adding a "not empty" filter that would cut the text into words a second time.
    """
    bag = docs.select(F.sort_array(terms).alias("_bag"))
    numbered = bag.select("_bag", F.posexplode_outer("_bag").alias("_at", "term"))
    fresh = (F.col("_at") == 0) | (F.get("_bag", F.col("_at") - 1) != F.col("term"))
    return numbered.select("term", fresh.cast("long").alias("first"))


def _stats(docs: DataFrame, terms: Column) -> DataFrame:
    counts = (
        _document_terms(docs, terms)
        .where(F.col("term") != "")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("ctf"), F.sum("first").alias("df"))
    )
    n_docs = docs.select(F.count(F.lit(1)).cast("double")).scalar()
    # summing both columns keeps the subquery's shuffle equal to the main one, so that it is reused
    sums = counts.select(F.struct(F.sum("ctf").alias("ctf"), F.sum("df").alias("df"))).scalar()
    return counts.withColumns(
        {"idf": F.ln(n_docs / F.col("df")), "ictf": F.ln(sums["ctf"] / F.col("ctf"))}
    )


def term_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per word: occurrences (ctf), documents (df), idf = ln(N / df) and ictf = ln(T / ctf)."""
    return _stats(docs, words(F.col(text)))


def tag_stats(posts: DataFrame, tags: str = "tags") -> DataFrame:
    """The same statistics per tag, over the posts' tag arrays."""
    return _stats(posts, F.coalesce(tags, F.array().cast("array<string>")))


def totals(docs: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: total occurrences (term_count) and number of documents (doc_count)."""
    term_count = stats.select(F.coalesce(F.sum("ctf"), F.lit(0))).scalar()
    return docs.agg(F.count(F.lit(1)).alias("doc_count")).select(
        term_count.alias("term_count"), "doc_count"
    )


def term_frequency(docs: DataFrame, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Count of every group-1 match of `pattern` per document row, without a shuffle."""
    bag = F.sort_array(F.regexp_extract_all(F.col(text), F.lit(pattern), 1))
    bags = docs.select(id, bag.alias("_bag"))
    # a term's run in the sorted bag goes from its first position to the next term's first position
    starts = F.filter(
        F.transform("_bag", lambda t, i: F.when((i == 0) | (F.get("_bag", i - 1) != t), i)),
        lambda i: i.isNotNull(),
    )
    runs = bags.select(id, "_bag", starts.alias("_starts"))
    each = runs.select(id, "_bag", "_starts", F.posexplode_outer("_starts").alias("_n", "_start"))
    each = each.where(F.col("_start").isNotNull())
    end = F.coalesce(F.get("_starts", F.col("_n") + 1), F.size("_bag"))
    return each.select(
        id,
        F.get("_bag", F.col("_start")).alias("term"),
        (end - F.col("_start")).cast("long").alias("frequency"),
    )


def _word_occurrences(terms: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """term, occurrences of the terms that are one word."""
    tokens = docs.select(F.explode_outer(F.split(F.col(text), GAP_RUN)).alias("term"))
    some = tokens.where(F.col("term") != "").join(terms, "term", "left_semi")
    return some.groupBy("term").agg(F.count(F.lit(1)).alias("occurrences"))


def _phrase_occurrences(terms: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """term, occurrences of terms of any characters that begin and end at word boundaries of the text.

    Words and the gaps between them tile a text, so a term occurs where its own tiles stand in a row. Its rarest
    tile in the corpus is looked up; the rest is compared in place. Occurrences of a term do not overlap:
    they are taken from the left. Gaps at the ends of a text lie at no boundary.
    """
    tiles = lambda value: F.regexp_extract_all(value, F.lit(f"({WORD_RUN}|{GAP_RUN})"), 1)
    inner = F.regexp_replace(F.col(text), rf"\A{GAP_RUN}|{GAP_RUN}\z", "")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), tiles(inner).alias("tiles"))
    rows = stored(rows.where(F.size("tiles") > 0), "tiles")
    wanted = stored(terms.select("term", tiles(F.col("term")).alias("own")), "phrases")
    each = wanted.select("term", "own", F.explode(F.array_distinct("own")).alias("tile"))
    met = rows.select(F.explode("tiles").alias("tile")).join(each.select("tile").distinct(), "tile", "left_semi")
    counts = met.groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(counts, "tile", "left").groupBy("term", "own").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "tile")).alias("it"))
    anchors = stored(rarest.where("it.n > 0").select("term", "own", F.col("it.tile").alias("tile")), "anchors")
    at = rows.select("row", F.posexplode("tiles").alias("at", "tile"))
    starts = at.join(anchors.select("term", "tile", F.array_position("own", F.col("tile")).alias("nth")), "tile")
    starts = starts.select("row", "term", (F.col("at") - F.col("nth") + 2).cast("int").alias("start")).where("start > 0")
    told = stored(starts, "starts").join(rows, "row").join(anchors.select("term", "own"), "term")
    found = told.where(F.slice("tiles", F.col("start"), F.size("own")) == F.col("own"))
    places = found.groupBy("row", "term", F.size("own").alias("n")).agg(F.sort_array(F.collect_list("start")).alias("starts"))

    def further(state: Column, start: Column) -> Column:
        taken = F.struct((state["count"] + 1).alias("count"), (start + F.col("n")).alias("end"))
        return F.when(start >= state["end"], taken).otherwise(state)

    none = F.struct(F.lit(0).cast("long").alias("count"), F.lit(0).alias("end"))
    count = F.aggregate("starts", none, further, lambda state: state["count"])
    return places.select("term", count.alias("count")).groupBy("term").agg(F.sum("count").alias("occurrences"))


def occurrence_idf(terms: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """ln(N div occurrences) per term, in whole-number division.

    A term is any literal text: a word, several, or with punctuation. Occurrences are those between word
    boundaries, case kept, that do not overlap. More occurrences than documents give -infinity, no
    occurrence and the empty term give null.
    """
    wanted = terms.select("term").distinct().where(F.col("term").isNotNull())
    lone = F.col("term").rlike(rf"\A{WORD_RUN}\z")
    counts = _word_occurrences(wanted.where(lone), docs, text)
    counts = counts.unionByName(_phrase_occurrences(wanted.where(~lone & (F.col("term") != "")), docs, text))
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    found = wanted.join(counts, "term", "left").withColumn(
        "_whole", F.call_function("div", n_docs, "occurrences")
    )
    value = F.when(F.col("_whole") == 0, F.lit(float("-inf"))).otherwise(F.ln("_whole"))
    return found.select("term", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), value.alias("idf"))
