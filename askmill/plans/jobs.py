"""End-to-end jobs: from logs and events to queries, and from queries to ranked posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askmill.operators import contexts as cx
from askmill.operators import difficulty as di
from askmill.operators import errors as er
from askmill.operators.editor import classify_editor_events, settings_gate, window_gate
from askmill.operators.personal import personal_ranks
from askmill.operators.posts import SORT_WORDS, excerpt_posts
from askmill.operators.requests import normalise_requests
from askmill.operators.search import Index, backoff_searches, error_searches
from askmill.plans import lists
from askmill.plans.ordered import hot_keys, row_number
from askmill.session import stored, unless_long

auto_query = cx.auto_query


USER_RUN = ("run_id", "user_id")


def compile_error_queries(
    messages: DataFrame,
    settings: DataFrame,
    stats: DataFrame,
    *,
    keys: Sequence[str] = ("run_id",),
    **options: str,
) -> DataFrame:
    """Queries of the failed compilations of users who have compile errors on.

    Columns run_id, user_id, category, pos, text; gives the keys, first_line and keywords.
    """
    allowed = settings_gate(messages, settings, "compile_error")
    return er.error_queries(allowed, stats, er.COMPILE, keys=keys, **options)


def line_messages(lines: DataFrame) -> DataFrame:
    """Console lines as messages; run_id is `console_id:run`.

    All patterns and tokens lie within a line, so one message per line gives the same queries as the
    whole text.
    """
    user = ["user_id"] if "user_id" in lines.columns else []
    return lines.select(
        F.concat_ws(":", "console_id", "run").alias("run_id"),
        *user,
        "category",
        F.col("line_no").alias("pos"),
        "text",
    )


def runtime_messages(
    console: DataFrame, settings: DataFrame, consoles: Sequence[str] = ("console_id",)
) -> DataFrame:
    """Console lines of the failed runs of users who have runtime errors on, as messages."""
    allowed = settings_gate(console, settings, "runtime_error")
    return line_messages(er.console_lines(allowed, consoles))


def runtime_error_queries(
    console: DataFrame,
    settings: DataFrame,
    stats: DataFrame,
    *,
    keys: Sequence[str] = ("run_id",),
    **options: str,
) -> DataFrame:
    """Queries of failed console runs: the keys, first_line, keywords."""
    consoles = ["console_id", *(key for key in keys if key != "run_id")]
    messages = runtime_messages(console, settings, consoles)
    return er.error_queries(messages, stats, er.RUNTIME, keys=keys, **options)


def _sort_kind(sort: Column) -> Column:
    """The order that a request's sort stands for: relevance unless it is another one of the four."""
    name = F.lower(sort)
    for word, meaning in SORT_WORDS.items():
        name = F.when(name == word, meaning).otherwise(name)
    return F.when(name.isin("votes", "creation", "activity"), name).otherwise("relevance")


def _sort_key(sort: Column) -> Column:
    """Larger is earlier, whatever the request sorts by."""
    name = _sort_kind(sort)
    return (
        F.when(name == "votes", F.col("votes").cast("double"))
        .when(name == "creation", F.unix_micros("created").cast("double"))
        .when(name == "activity", F.unix_micros("active").cast("double"))
        .otherwise(F.round("relevance", 9))
    )


def personalised_search(
    requests: DataFrame,
    posts: DataFrame,
    index: Index,
    profile: DataFrame,
    tag_stats: DataFrame,
    **marks: str,
) -> DataFrame:
    """Ranked, excerpted results of every request.

    Requests have request_id, user_id, q, tags, sort and backoff (automatic requests back off). Posts
    have post_id, title, body, tags, votes, created, active; `index` is their `index_posts`.
    """
    ready = normalise_requests(requests).withColumn("q", F.col("clean_q"))
    asked, hits = backoff_searches(ready, index)
    return ranked_searches(asked, hits, ready, posts, profile, tag_stats, **marks)


def error_results(
    errors: DataFrame,
    visible: DataFrame,
    posts: DataFrame,
    index: Index,
    profile: DataFrame,
    tag_stats: DataFrame,
    **marks: str,
) -> DataFrame:
    """Ranked, excerpted results of the errors of users whose tool window is open.

    Errors have run_id, user_id, first_line and keywords: the first line is searched for, and where it
    finds nothing the keywords; there is no back-off. The request_id is the run_id.
    """
    shown = stored(window_gate(errors, visible), "errors")
    asked, hits = error_searches(shown, index)
    requests = shown.select(F.col("run_id").alias("request_id"), "user_id", F.lit("relevance").alias("sort"))
    return ranked_searches(asked.withColumnRenamed("run_id", "request_id"), hits, requests, posts, profile, tag_stats, **marks)


def compile_error_search(
    messages: DataFrame,
    settings: DataFrame,
    visible: DataFrame,
    stats: DataFrame,
    posts: DataFrame,
    index: Index,
    profile: DataFrame,
    tag_stats: DataFrame,
    **marks: str,
) -> DataFrame:
    """From compiler messages to the ranked results of every failed compilation."""
    errors = compile_error_queries(messages, settings, stats, keys=USER_RUN)
    return error_results(errors, visible, posts, index, profile, tag_stats, **marks)


def runtime_error_search(
    console: DataFrame,
    settings: DataFrame,
    visible: DataFrame,
    stats: DataFrame,
    posts: DataFrame,
    index: Index,
    profile: DataFrame,
    tag_stats: DataFrame,
    **marks: str,
) -> DataFrame:
    """From console output to the ranked results of every failed run."""
    errors = runtime_error_queries(console, settings, stats, keys=USER_RUN)
    return error_results(errors, visible, posts, index, profile, tag_stats, **marks)


def ranked_results(
    found: DataFrame,
    requests: DataFrame,
    posts: DataFrame,
    profile: DataFrame,
    tag_stats: DataFrame,
    *,
    open_mark: str = "<pre>",
    close_mark: str = "</pre>",
) -> DataFrame:
    """What requests have found, in order and excerpted.

    `found` has request_id, query (one for each request), post_id (null where nothing was found) and relevance, requests have
    request_id, user_id and sort.
    """
    found = found.where(F.col("post_id").isNotNull())
    asked = stored(found.select("request_id", "query", F.col("request_id").alias("search")).distinct(), "asked")
    hits = found.select(F.col("request_id").alias("search"), "post_id", "relevance")
    return _ranked(asked, hits, found, requests, posts, profile, tag_stats, open_mark, close_mark)


def ranked_searches(
    asked: DataFrame,
    hits: DataFrame,
    requests: DataFrame,
    posts: DataFrame,
    profile: DataFrame,
    tag_stats: DataFrame,
    *,
    open_mark: str = "<pre>",
    close_mark: str = "</pre>",
) -> DataFrame:
    """The results of requests that share searches, in order and excerpted.

    asked(request_id, query, search) and hits(search, post_id, relevance) are what requests have found, requests have
    request_id, user_id and sort. A request sorted by relevance is re-ranked by its user's tag profile;
    any other keeps its order. Lists are given out by `lists.given_out`; those too long for a task are ranked by windows, and so is
    everything if posts or requests share an id.
    """
    hits = hits.where(F.col("post_id").isNotNull())
    return _ranked(asked, hits, asked.join(hits, "search"), requests, posts, profile, tag_stats, open_mark, close_mark)


def _ranked(
    asked: DataFrame, hits: DataFrame, found: DataFrame, requests: DataFrame, posts: DataFrame, profile: DataFrame, tag_stats: DataFrame, *marks: str
) -> DataFrame:
    """The same; `found` has the hits of each request."""
    # rows of one request and post are told apart by nothing but their place
    alike = _repeats(posts, "post_id") or _repeats(requests, "request_id")
    # only posts that some list has are cut
    some = posts.join(hits.select("post_id").distinct(), "post_id", "left_semi")
    shown = stored(excerpt_posts(some, *marks).select("post_id", "title", "excerpt", "has_more"), "shown")
    facts, sets = posts.select("post_id", "tags", "votes", "created", "active"), None
    if alike:
        return _ranked_by_rows(found, requests, facts, sets, shown, profile, tag_stats)
    sets, facts = _by_tag_set(facts)
    counts = stored(hits.groupBy("search").agg(F.count(F.lit(1)).alias("posts")), "counts")
    held = counts.where(F.col("posts") <= lists.LIST_ROWS)
    asks = asked.join(requests.select("request_id", "user_id", "sort"), "request_id").join(held, "search")
    personal = F.coalesce(F.col("sort") == "relevance", F.lit(False))
    asks = asks.withColumns({"kind": _sort_kind(F.col("sort")), "personal": personal})
    texts = stored(facts.join(shown, "post_id"), "texts")
    results = lists.given_out(asks, hits, _sort_key(F.col("kind")), texts, sets, profile, tag_stats)
    long = counts.where(F.col("posts") > lists.LIST_ROWS).select("search")
    if not long.head(1):
        return results
    found = asked.join(long, "search").join(hits, "search")
    return results.unionByName(_ranked_by_rows(found, requests, facts, sets, shown, profile, tag_stats))


def _ranked_by_rows(
    found: DataFrame, requests: DataFrame, facts: DataFrame, sets: DataFrame | None, shown: DataFrame, profile: DataFrame, tag_stats: DataFrame
) -> DataFrame:
    """The same by windows over result rows: found(request_id, query, post_id, relevance), facts with the tags of posts, or with their
    tag_set if no two rows share an id.

    Ranks are found on narrow rows, which one shuffle by request brings together; tags stay with their sets and queries with their
    requests. Excerpts join last, so bodies never travel.
    """
    alike = sets is None
    asked = requests.select("request_id", "user_id", "sort")
    # written once: every rank below reads it
    listed = stored(found.drop("search").join(facts, "post_id").join(asked, "request_id"), "listed")
    hot = hot_keys(listed, ["request_id"])
    key = _sort_key(F.col("sort"))
    keyed = listed.withColumns({"_key": -key, "_last": key.isNull()})
    order = ["_last", "_key", "post_id"]
    personal = F.col("sort") == "relevance"
    if alike:
        placed = row_number(keyed, ["request_id"], order, "position", hot=hot).drop("_key", "_last")
        results = placed.where(personal).select("request_id", "user_id", "post_id", "position", "tags")
        ranks = personal_ranks(results, profile, tag_stats, hot=hot).select("request_id", "post_id", "score", "final_rank")
        both = placed.join(ranks, ["request_id", "post_id"], "left")
    else:
        narrow = keyed.select("request_id", "user_id", "post_id", "tag_set", "sort", *order[:2])
        results = narrow.where(personal).drop("sort")
        ranked = personal_ranks(results, profile, tag_stats, order, hot, sets)
        ranked = ranked.select("request_id", "post_id", F.col("initial_rank").alias("position"), "score", "final_rank")
        others = narrow.where(~F.coalesce(personal, F.lit(False))).select("request_id", "post_id", *order[:2])
        kept = row_number(others, ["request_id"], order, "position", hot=hot).select("request_id", "post_id", "position")
        placed = ranked.unionByName(kept, allowMissingColumns=True)
        told = listed.select("request_id", "query", "sort").distinct()
        both = placed.join(unless_long(stored(told, "told")), "request_id")
    return both.join(unless_long(shown), "post_id").select(
        "request_id",
        "query",
        "sort",
        F.coalesce("final_rank", "position").alias("final_rank"),
        F.col("position").alias("initial_rank"),
        "score",
        "post_id",
        "title",
        "excerpt",
        "has_more",
    )


def _repeats(rows: DataFrame, id: str) -> bool:
    """Whether rows share an id."""
    return bool(rows.groupBy(id).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").head(1))


def _by_tag_set(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tag_set and tags of each different list of tags, and the facts with tag_set in place of their tags."""
    sets = facts.select(F.col("tags").alias("_tags")).distinct()
    sets = stored(sets.withColumn("tag_set", F.monotonically_increasing_id()), "tag-sets")
    named = facts.join(sets, F.col("tags").eqNullSafe(F.col("_tags"))).drop("tags", "_tags")
    return sets.withColumnRenamed("_tags", "tags"), unless_long(stored(named, "facts"))


def difficulty_to_search(
    raw: DataFrame,
    contexts: DataFrame,
    settings: DataFrame,
    visible: DataFrame,
    posts: DataFrame,
    index: Index,
    stats: DataFrame,
    doc_count: Column,
    profile: DataFrame,
    tag_stats: DataFrame,
    keys: Sequence[str] = ("user_id",),
    **marks: str,
) -> DataFrame:
    """From raw editor actions to the ranked results of the searches they set off.

    `keys` hold user_id and say whose events make up one machine, such as those of a user in a project;
    raw actions and contexts have them. The request_id is the keys and event_id of the trigger between
    colons. Contexts without terms search for nothing.
    """
    events = classify_editor_events(raw)
    triggers = di.difficulty_triggers(di.detect_difficulty(events, keys), keys)
    stuck = di.difficulty_queries(triggers, contexts, settings, visible, keys)
    requests = stored(trigger_requests(stuck, stats, doc_count), "requests")
    return personalised_search(requests, posts, index, profile, tag_stats, **marks)


def trigger_requests(stuck: DataFrame, stats: DataFrame, doc_count: Column) -> DataFrame:
    """Automatic requests for the contexts of `difficulty_queries`.

    The user is part of what names a context on the way, so it needs no join.
    """
    named = stuck.withColumn("context", F.struct("context_id", "user_id"))
    queries = cx.auto_query(named, stats, doc_count, "context").where(F.col("query") != "")
    return queries.select(
        F.col("context.context_id").alias("request_id"),
        "context.user_id",
        F.col("query").alias("q"),
        F.array().cast("array<string>").alias("tags"),
        F.lit("relevance").alias("sort"),
        F.lit(True).alias("backoff"),
    )
