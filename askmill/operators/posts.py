"""Operators over the table of posts: null rules, structured filters, sorting and excerpts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askmill.functions import text as tx
from askmill.plans.ordered import row_number

DEFAULT_LINK = "http://www.stackoverflow.com/"  # fixed value
DEFAULT_SITE = "stackoverflow"  # fixed value

# The four sort names, and the words a user sees for two of them. Relevance is a score column.
SORT_COLUMNS = {
    "relevance": "relevance",
    "activity": "active",
    "creation": "created",
    "votes": "votes",
}
SORT_WORDS = {"newest": "creation", "active": "activity"}


def clean_posts(posts: DataFrame) -> DataFrame:
    """Fill nulls and add the display form of the tags (`[a] [b] `, empty for null tags)."""
    text_defaults = {"body": "", "excerpt": "", "title": "", "link": DEFAULT_LINK}
    filled = {
        name: F.coalesce(name, F.lit(default))
        for name, default in text_defaults.items()
        if name in posts.columns
    }
    return posts.withColumn("tag_text", tx.tag_display(F.col("tags"))).withColumns(
        {"tags": F.coalesce("tags", F.array().cast("array<string>")), **filled}
    )


def sort_name(sort: str) -> str:
    """The sort a name or a user's word stands for."""
    return SORT_WORDS.get(sort.lower(), sort.lower())


def _sort_column(sort: str) -> str:
    return SORT_COLUMNS[sort_name(sort)]


def _flag(column: str):
    return lambda value: F.col(column) == (value.lower() == "true")


def _listed(value: str) -> Column:
    return F.array(*[F.lit(tag) for tag in value.split(";")])


def _moment(value: str) -> Column:
    return F.timestamp_seconds(F.lit(int(value)))


def filter_posts(posts: DataFrame, request: Mapping[str, str]) -> DataFrame:
    """Posts that meet the structured components of one request.

    Component names are those of the search request; their meaning here is ours: `tagged` any of
    the `;`-separated tags and `nottagged` none; `fromdate`, `todate` creation time in epoch seconds,
    both included; `min`, `max` bounds of the sort column; `answers`, `views` least counts; `body`,
    `title`, `url` contained text; `user` the owner; `accepted`, `closed`, `migrated`, `notice`,
    `wiki` flags; `site` the site. `sort`, `order` (desc unless asc), `page` (from 1) and `pagesize`
    pick one page; `filter` names the columns to keep, comma-separated. Scalar tests reach the scan.
    """
    sort = _sort_column(request.get("sort", "relevance"))
    tests = {
        "tagged": lambda v: F.arrays_overlap("tags", _listed(v)),
        "nottagged": lambda v: ~F.arrays_overlap("tags", _listed(v)),
        "fromdate": lambda v: F.col("created") >= _moment(v),
        "todate": lambda v: F.col("created") <= _moment(v),
        "min": lambda v: F.col(sort) >= _bound(sort, v),
        "max": lambda v: F.col(sort) <= _bound(sort, v),
        "answers": lambda v: F.col("answers") >= int(v),
        "views": lambda v: F.col("views") >= int(v),
        "body": lambda v: F.col("body").contains(v),
        "title": lambda v: F.col("title").contains(v),
        "url": lambda v: F.col("url").contains(v),
        "user": lambda v: F.col("user") == v,
        "site": lambda v: F.col("site") == v,
        **{flag: _flag(flag) for flag in ("accepted", "closed", "migrated", "notice", "wiki")},
    }
    kept = posts
    for name, value in request.items():
        if name in tests:
            kept = kept.where(tests[name](value))
    if "sort" in request or "page" in request or "pagesize" in request:
        descending = request.get("order", "desc") != "asc"
        kept = kept.orderBy(F.col(sort).desc() if descending else F.col(sort).asc(), "post_id")
    if "page" in request or "pagesize" in request:
        size = int(request.get("pagesize", "30"))
        kept = kept.offset((int(request.get("page", "1")) - 1) * size).limit(size)
    if "filter" in request:
        kept = kept.select(*request["filter"].split(","))
    return kept


def _bound(sort: str, value: str) -> Column:
    return _moment(value) if sort in ("created", "active") else F.lit(float(value))


def sort_posts(found: DataFrame, sort: str, request: Sequence[str] = ("request_id",)) -> DataFrame:
    """Add `position`, the 0-based place of each post in its request's list.

    All sorts are descending; ties go by post_id.
    """
    column = _sort_column(sort)
    key = F.col(column)
    descending = -(F.unix_micros(key) if column in ("created", "active") else key)
    placed = row_number(
        found.withColumn("_key", descending).withColumn("_unknown", key.isNull()),
        request,
        ["_unknown", "_key", "post_id"],
        "position",
    )
    return placed.drop("_key", "_unknown")


def excerpt_posts(
    posts: DataFrame,
    open_mark: str = "<pre>",
    close_mark: str = "</pre>",
    cutoff: int = 300,
    tolerance: int = 100,
) -> DataFrame:
    """Add the excerpt that tears no marked block, and whether the body goes on after it."""
    body = F.coalesce("body", F.lit(""))
    length = F.greatest(tx.excerpt_cut(body, open_mark, close_mark, cutoff, tolerance), F.lit(0))
    return posts.withColumn("excerpt", F.substring(body, F.lit(1), length)).withColumn(
        "has_more", F.length(body) > F.length("excerpt")
    )
