"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill import prepare
from askmill.functions import scoring as sc
from askmill.functions import text as tx
from askmill.operators import browse as br
from askmill.operators import contexts as cx
from askmill.operators import corpus as cp
from askmill.operators import difficulty as di
from askmill.operators import editor as ed
from askmill.operators import errors as er
from askmill.operators import history as hi
from askmill.operators import personal as pe
from askmill.operators import posts as po
from askmill.operators import requests as rq
from askmill.operators import paging as pa
from askmill.operators import search as se
from askmill.operators import telemetry as te
from askmill.plans import jobs
from askmill.session import shared_folder, stored
from askmill.sources import responses as rs
from askmill.sources import stats_xml, streams
from askmill.sources import telemetry as tl
from askmill.streaming import sinks
from askmill.streaming.console import console_lines_stream, console_rows_stream
from askmill.streaming.gates import settings_gate_stream
from askmill.streaming.profile import effective_interactions_stream
from askmill.streaming.state import detect_difficulty_stream as _difficulty_stream
from askmill.workload.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ENVIRONMENT = "test"


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(Tables(prepare(spark), folder))

    QUERIES[build.__name__] = run
    return build


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays of strings as one string each."""
    return df.withColumns({c: F.array_join(c, "|") for c in columns})


def _micros(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.unix_micros(c) for c in columns})


# sources and sinks


def _stats_file(t: Tables, stats: DataFrame, row: str, counted: str, terms: int, docs: int) -> str:
    path = shared_folder(t.spark, row)
    tagged = stats.select(*[F.col(c).alias(f"_{n}") for c, n in _ATTRIBUTES.items()])
    root = f'Collection {counted}="{terms}" docCount="{docs}"'
    tagged.write.format("xml").option("rootTag", root).option("rowTag", row).save(path)
    return path


_ATTRIBUTES = {"term": "name", "ctf": "ctf", "df": "df", "idf": "idf", "ictf": "ictf"}


def _part_stats(t: Tables) -> DataFrame:
    return cp.term_stats(t.part_names())


def _tag_stats(t: Tables) -> DataFrame:
    return cp.tag_stats(t.tagged_parts())


@query
def read_term_stats(t: Tables) -> DataFrame:
    stats = _part_stats(t)
    count = cp.totals(t.part_names(), stats).first()
    path = _stats_file(t, stats, "Term", "termCount", count["term_count"], count["doc_count"])
    total = stats_xml.read_totals(t.spark, path).agg(F.max(F.struct("term_count", "doc_count")))
    both = stats_xml.read_term_stats(t.spark, path).withColumn("_total", total.scalar())
    return _rounded(
        both.select("term", "ctf", "df", "idf", "ictf", "_total.term_count", "_total.doc_count"),
        "idf", "ictf",
    )


@query
def read_tag_stats(t: Tables) -> DataFrame:
    stats = _tag_stats(t)
    count = cp.totals(t.tagged_parts(), stats).first()
    path = _stats_file(t, stats, "Tag", "tagCount", count["term_count"], count["doc_count"])
    tags = stats_xml.read_tag_stats(t.spark, path, compat=True)
    return _rounded(tags, "idf", "ictf")


@query
def read_responses(t: Tables) -> DataFrame:
    """Parts as saved responses of up to 20 posts, and an empty response beside every tenth."""
    path = shared_folder(t.spark, "responses")
    parts = t.part_posts().select(
        F.col("post_id").alias("question_id"), "tags", "body", "title", "link"
    )
    listed = parts.groupBy(F.floor(F.col("question_id") / 20).alias("n")).agg(
        F.array_sort(F.collect_list(F.struct("question_id", "tags", "body", "title", "link"))).alias(
            "items"
        )
    )
    empty = listed.where(F.col("n") % 10 == 0).withColumn("items", F.filter("items", lambda _: F.lit(False)))
    listed = listed.withColumn("more", F.col("n") % 2 == 0).unionByName(empty.withColumn("more", F.lit(False)))
    response = listed.select(
        "items",
        F.col("more").alias("has_more"),
        F.lit(100).alias("quota_max"),
        (F.col("n") % 100).cast("int").alias("quota_remaining"),
    )
    response.write.option("compression", "gzip").json(path)
    read = rs.read_responses(t.spark, path)
    return _joined(read, "tags").drop("response_id", "file", "excerpt")


def _query_lines(t: Tables) -> DataFrame:
    events = te.query_events(t.searches()).withColumn("project", F.lit("project one"))
    return tl.telemetry_lines(events, ENVIRONMENT, t.settings())


@query
def write_telemetry(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "telemetry")
    tl.write_telemetry(_query_lines(t), path)
    lines = tl.read_telemetry(t.spark, path)
    kept = ["User", "ProjectCode", "Environment", "QueryEventType", "Tags", "sort", "Visible"]
    return _joined(lines.select(*kept).withColumn("Tags", F.col("Tags").cast("array<string>")), "Tags")


def _envelopes(t: Tables) -> str:
    """Telemetry lines shipped in envelopes, 50 sequence numbers of a user in each."""
    path = shared_folder(t.spark, "envelopes")
    events = te.query_events(t.searches()).withColumn("nth", F.col("seq"))
    line = F.to_json(
        F.struct(F.col("user_id").cast("string").alias("User"), "QueryEventType", "Tags", "sort")
    )
    shipped = events.select("user_id", "seq", line.alias("line")).groupBy(
        "user_id", F.floor(F.col("seq") / 50)
    ).agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda e: e["line"]), ", ")
    shipped.select(F.concat(F.lit('{"Logs": ['), body, F.lit("]}")).alias("value")).write.text(path)
    return path


def _counted(lines: DataFrame) -> DataFrame:
    return lines.groupBy("User", "QueryEventType", "sort").agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.size("Tags")).alias("tags")
    )


@query
def read_log_batches(t: Tables) -> DataFrame:
    return _counted(tl.read_log_batches(t.spark, _envelopes(t)))


@query
def log_batch_stream(t: Tables) -> DataFrame:
    return _counted(_drained(t, tl.log_batch_stream(t.spark, _envelopes(t))))


def _repeated_envelopes(t: Tables) -> str:
    """The envelopes, all of them sent twice and torn once."""
    path = _envelopes(t)
    lines = stored(t.spark.read.text(path), "sent")
    lines.write.mode("append").text(path)
    lines.select(F.substring_index("value", ",", 1)).write.mode("append").text(path)
    return path


def _sent(events: DataFrame) -> DataFrame:
    return _joined(events.select("User", "QueryEventType", F.col("Tags").cast("array<string>"), "sort"), "Tags")


@query
def log_events_once(t: Tables) -> DataFrame:
    return _sent(tl.events_once(tl.read_envelopes(t.spark, _repeated_envelopes(t))))


@query
def log_events_once_stream(t: Tables) -> DataFrame:
    stream = tl.envelope_stream(t.spark, _repeated_envelopes(t), files_per_trigger=4)
    return _sent(_drained(t, tl.events_once(stream)))


@query
def dead_letters(t: Tables) -> DataFrame:
    return tl.dead_letters(tl.read_envelopes(t.spark, _repeated_envelopes(t))).select("value")


@query
def console_stream(t: Tables) -> DataFrame:
    """The console's chunks through the reader of its stream."""
    console = t.console().select("console_id", "user_id", "ts", "seq", "content_type", "chunk")
    path = shared_folder(t.spark, "console")
    console.write.parquet(path)
    return _drained(t, streams.console_stream(t.spark, path, files_per_trigger=1)).drop("ts")


@query
def read_compiler_messages(t: Tables) -> DataFrame:
    return er.failed_compilations(t.compiler_messages()).drop("event_id")


@query
def editor_event_stream(t: Tables) -> DataFrame:
    """Raw edits as a stream, classified on the way into a table."""
    raw = _streamed(t, "raw_edits")
    return _micros(_drained(t, ed.classify_editor_events(raw)), "ts")


def _streamed(t: Tables, adapter: str) -> DataFrame:
    """An adapter of the event table over a stream of that table's files."""

    class Stream(Tables):
        def read(self, name: str) -> DataFrame:
            schema = super().read(name).schema
            return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}.parquet*")

    return getattr(Stream(t.spark, t.folder), adapter)()


def _drained(t: Tables, stream: DataFrame) -> DataFrame:
    """Everything a stream gives on the data there is, as a table."""
    path = shared_folder(t.spark, "drained")
    running = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state")
    running.trigger(availableNow=True).start(path).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(path)


# projections and scalar work


@query
def clean_posts(t: Tables) -> DataFrame:
    kept = t.part_posts().select("post_id", "title", "body", "tags", "link")
    return _joined(po.clean_posts(kept), "tags")


@query
def normalise_requests(t: Tables) -> DataFrame:
    return _joined(rq.normalise_requests(t.requests()), "tags")


@query
def filter_posts(t: Tables) -> DataFrame:
    request = {
        "tagged": "ring;bolt;gear", "nottagged": "cold", "fromdate": "864000", "min": "5", "max": "40",
        "answers": "1", "title": "l", "accepted": "true", "sort": "votes", "order": "asc",
        "filter": "post_id,title,votes",
    }
    return po.filter_posts(t.part_posts(), request)


@query
def filter_posts_page(t: Tables) -> DataFrame:
    request = {"body": "Brand#1", "todate": "86400000", "sort": "creation", "page": "2", "pagesize": "25"}
    return po.filter_posts(t.part_posts(), {**request, "filter": "post_id,body"})


@query
def filter_for_requests(t: Tables) -> DataFrame:
    found = br.filter_for_requests(t.full_posts(), t.browse_requests())
    return found.select("request_id", "position", "post_id", "title")


@query
def classify_editor_events(t: Tables) -> DataFrame:
    return _micros(ed.classify_editor_events(t.raw_edits()), "ts")


@query
def settings_gate(t: Tables) -> DataFrame:
    return _micros(ed.settings_gate(t.editor_events(), t.settings(), "runtime_error"), "ts")


@query
def settings_gate_as_of(t: Tables) -> DataFrame:
    return _micros(ed.settings_gate(t.editor_events(), t.setting_changes(), "runtime_error"), "ts")


@query
def settings_gate_as_of_stream(t: Tables) -> DataFrame:
    """Events and changes as two streams; what neither has passed still waits."""
    passed = settings_gate_stream(_streamed(t, "editor_events"), _streamed(t, "setting_changes"), "runtime_error", "0 seconds")
    return _micros(_drained(t, passed), "ts")


@query
def window_gate_as_of(t: Tables) -> DataFrame:
    return _micros(ed.window_gate(t.editor_events(), t.window_changes()), "ts")


@query
def strip_comments(t: Tables) -> DataFrame:
    return t.sources().select("file_id", tx.strip_comments(F.col("text")).alias("text"))


@query
def extract_imports(t: Tables) -> DataFrame:
    found = tx.extract_imports(F.col("text"))
    return t.sources().select("file_id", F.array_join(found, "|").alias("imports"))


@query
def context_terms(t: Tables) -> DataFrame:
    return cx.context_terms(t.contexts())


@query
def find_patterns(t: Tables) -> DataFrame:
    """Java versions in the messages of each compilation."""
    messages = t.compiler_messages()
    return er.message_patterns(messages, tx.JAVA_VERSION, 6).select(
        "run_id", "category", F.col("pos").cast("long").alias("pos"), "nth", "match"
    )


@query
def find_patterns_in_blocks(t: Tables) -> DataFrame:
    blocks = er.group_messages(t.compiler_messages())
    texts = F.concat("errors", "warnings", "informations")
    names = {"versions": (tx.JAVA_VERSION, 6), "lang": (tx.JAVA_LANG_EXCEPTION, 1), "io": (tx.JAVA_IO_EXCEPTION, 1)}
    found = {n: F.array_join(tx.find_patterns(texts, p, g), "|") for n, (p, g) in names.items()}
    return blocks.select("run_id", "part", *[value.alias(name) for name, value in found.items()])


@query
def first_line(t: Tables) -> DataFrame:
    return er.first_lines(t.compiler_messages())


def _error_queries(t: Tables, token_split: str) -> DataFrame:
    return er.error_keywords(
        t.compiler_messages(), _part_stats(t), er.COMPILE, token_split=token_split
    )


@query
def error_keywords(t: Tables) -> DataFrame:
    return _error_queries(t, er.WHOLE_LINES)


@query
def error_keywords_by_word(t: Tables) -> DataFrame:
    return _error_queries(t, er.SINGLE_WORDS)


@query
def excerpt_posts(t: Tables) -> DataFrame:
    return po.excerpt_posts(t.pages(), "<p>", "</p>").select("page_id", "excerpt", "has_more")


@query
def hash_tags(t: Tables) -> DataFrame:
    hashes = tx.hash_tags(F.col("p_name")).cast("array<string>")
    return t.read("part").select(
        "p_partkey",
        F.array_join(hashes, ",").alias("hashes"),
        tx.string_hash(F.col("p_brand")).alias("code"),
    )


# aggregations


@query
def term_stats(t: Tables) -> DataFrame:
    return _rounded(cp.term_stats(t.corpus()), "idf", "ictf")


@query
def tag_stats(t: Tables) -> DataFrame:
    return _rounded(cp.tag_stats(t.part_posts()), "idf", "ictf")


@query
def corpus_totals(t: Tables) -> DataFrame:
    corpus = t.corpus()
    return cp.totals(corpus, cp.term_stats(corpus))


@query
def term_frequency(t: Tables) -> DataFrame:
    """Words of every document that are a capital and plain letters, digits or underscores."""
    counts = cp.term_frequency(t.corpus(), f"({tx.WORD_RUN})")
    return counts.where(F.col("term").rlike("^[A-Z][A-Za-z0-9_]+$"))


@query
def occurrence_idf(t: Tables) -> DataFrame:
    terms = t.corpus().select(F.explode_outer(F.split(F.lower("text"), tx.GAP_RUN)).alias("term"))
    return _rounded(cp.occurrence_idf(terms.where(F.col("term") != ""), t.corpus()), "idf")


@query
def occurrence_idf_phrases(t: Tables) -> DataFrame:
    """Two words, a word with the gap behind it or before it, three words."""
    tiles = F.regexp_extract_all("text", F.lit(f"({tx.WORD_RUN}|{tx.GAP_RUN})"), 1)
    spans = F.array(*(F.array_join(F.slice(F.col("tiles"), a, n), "") for a, n in ((1, 3), (3, 2), (4, 2), (7, 5))))
    terms = t.read("benchmark").select(tiles.alias("tiles")).select(F.explode(spans).alias("term"))
    return _rounded(cp.occurrence_idf(terms, t.corpus()), "idf")


@query
def weighted_terms(t: Tables) -> DataFrame:
    return cx.weighted_terms(t.contexts())


@query
def tag_profile(t: Tables) -> DataFrame:
    return pe.tag_profile(t.clicks_on_parts())


@query
def tag_profile_from_actions(t: Tables) -> DataFrame:
    return pe.tag_profile(pe.effective_interactions(t.actions()))


@query
def console_runs(t: Tables) -> DataFrame:
    return er.console_runs(t.console())


@query
def group_messages(t: Tables) -> DataFrame:
    return _joined(er.group_messages(t.compiler_messages()), "errors", "warnings", "informations")


@query
def group_messages_in_parts(t: Tables) -> DataFrame:
    return _joined(er.group_messages(t.compiler_messages(), 3), "errors", "warnings", "informations")


# joins


def _scores(t: Tables, *names: str) -> DataFrame:
    terms = cx.context_terms(t.contexts()).select("term").distinct()
    stats = cp.term_stats(t.corpus())
    scorers = {name: sc.SCORERS[name] for name in names or sc.SCORERS}
    scored = cx.score_terms(terms, stats, t.doc_count(), scorers)
    return _rounded(scored, *scorers, "score").drop("known")


@query
def score_ictf(t: Tables) -> DataFrame:
    return _scores(t, "ictf").drop("score")


@query
def score_idf(t: Tables) -> DataFrame:
    return _scores(t, "idf").drop("score")


@query
def score_scq(t: Tables) -> DataFrame:
    return _scores(t, "scq").drop("score")


@query
def score_var(t: Tables) -> DataFrame:
    return _scores(t, "var").drop("score")


@query
def combine_scores(t: Tables) -> DataFrame:
    return _scores(t)


def _personal(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return t.results(), pe.tag_profile(t.clicks_on_parts()), _tag_stats(t)


@query
def score_posts_for_user(t: Tables) -> DataFrame:
    return _rounded(pe.score_posts_for_user(*_personal(t)), "score")


def _search_inputs(t: Tables) -> tuple[DataFrame, se.Index]:
    requests = rq.normalise_requests(t.requests()).withColumn("q", F.col("clean_q"))
    return requests.drop("backoff"), se.index_posts(t.document_posts())


@query
def match_posts(t: Tables) -> DataFrame:
    return _rounded(se.match_posts(*_search_inputs(t)), "relevance")


def _paged_inputs(t: Tables) -> tuple[DataFrame, pa.PagedIndex]:
    requests, index = _search_inputs(t)
    page, size = (F.col("user_id") % 3 + 1).cast("int"), (F.col("user_id") % 5 + 2).cast("int")
    return requests.withColumn("page", page).withColumn("pagesize", size), pa.bounds_of(index)


@query
def match_posts_page(t: Tables) -> DataFrame:
    return _rounded(pa.first_pages(*_paged_inputs(t))[0], "relevance")


@query
def search_with_backoff_page(t: Tables) -> DataFrame:
    return _rounded(pa.backoff_pages(*_paged_inputs(t))[0], "relevance")


@query
def keep_vocabulary(t: Tables) -> DataFrame:
    names = t.read("part").select(
        "p_partkey", F.split(F.lower(F.concat_ws(" ", "p_type", "p_name", "p_brand", "p_name")), " ").alias("words")
    )
    return _joined(se.keep_vocabulary(names, _part_stats(t), "p_partkey"), "words")


@query
def search_with_backoff(t: Tables) -> DataFrame:
    return _rounded(se.search_with_backoff(*_search_inputs(t)), "relevance")


def _error_inputs(t: Tables) -> tuple[DataFrame, se.Index]:
    """Errors whose first line is a sentence, and whose keywords are the sentence's last word."""
    requests, index = _search_inputs(t)
    errors = requests.select(
        F.col("request_id").alias("run_id"),
        F.col("q").alias("first_line"),
        F.element_at(F.split(F.trim(F.translate("q", "{}", "")), r"\s"), -1).alias("keywords"),
    )
    return errors, index


@query
def error_search(t: Tables) -> DataFrame:
    return _rounded(se.error_search(*_error_inputs(t)), "relevance")


# windows and ranks


@query
def initial_rank(t: Tables) -> DataFrame:
    lines = t.read("lineitem").select(
        F.col("l_orderkey").alias("request_id"), "l_linenumber", "l_partkey", "l_suppkey"
    )
    return pe.initial_rank(lines, ["l_linenumber", "l_partkey", "l_suppkey"])


@query
def weighted_rank(t: Tables) -> DataFrame:
    ranked = pe.personal_ranks(*_personal(t))
    return ranked.select("request_id", "post_id", "position", "weighted_rank")


@query
def final_rank(t: Tables) -> DataFrame:
    return _rounded(pe.personal_ranks(*_personal(t)), "score")


@query
def top_terms(t: Tables) -> DataFrame:
    """Queries of three known terms at most, with the terms' weights counted."""
    return cx.auto_query(
        t.contexts(), cp.term_stats(t.corpus()), t.doc_count(), n=3, use_weights=True, drop_unknown=True
    )


@query
def auto_query(t: Tables) -> DataFrame:
    return cx.auto_query(t.contexts(), cp.term_stats(t.corpus()), t.doc_count())


@query
def event_mix(t: Tables) -> DataFrame:
    return _micros(_rounded(ed.event_mix(t.editor_events()), "delete_ratio", "edit_share"), "ts")


@query
def query_history(t: Tables) -> DataFrame:
    return hi.query_history(t.searches())


@query
def sort_posts(t: Tables) -> DataFrame:
    posts = t.part_posts().select(F.col("user").alias("request_id"), "post_id", "votes")
    return po.sort_posts(posts, "votes")


@query
def sort_posts_by_activity(t: Tables) -> DataFrame:
    posts = t.part_posts().select(F.col("user").alias("request_id"), "post_id", "active")
    return po.sort_posts(posts, "active").drop("active")


# streaming and stateful


@query
def debounce(t: Tables) -> DataFrame:
    return _micros(di.debounce(t.editor_events(10_000)), "ts")


def _log(df: DataFrame) -> DataFrame:
    return _micros(df, "ts")


@query
def detect_difficulty(t: Tables) -> DataFrame:
    return _log(di.detect_difficulty(t.editor_events()))


@query
def detect_difficulty_fast(t: Tables) -> DataFrame:
    return _log(di.detect_difficulty(t.editor_events(10_000)))


@query
def inactivity_pause(t: Tables) -> DataFrame:
    return _micros(di.inactivity_pauses(t.editor_events(50)), "paused", "resumed")


@query
def cool_down(t: Tables) -> DataFrame:
    events = t.editor_events(10_000)
    triggers = di.difficulty_triggers(di.detect_difficulty(events))
    return _micros(di.cool_down(events, triggers), "ts")


@query
def detect_difficulty_stream(t: Tables) -> DataFrame:
    """The log as a stream gives it, with the timers that have fallen due by the last event."""
    return _log(_drained(t, _difficulty_stream(_streamed(t, "editor_events"), "0 seconds")))


@query
def runtime_error_stream(t: Tables) -> DataFrame:
    return _drained(t, console_lines_stream(_streamed(t, "console"), None, "0 seconds"))


@query
def silent_console_runs(t: Tables) -> DataFrame:
    """The same lines where a run waits on disk once it is silent for a second, or has two chunks."""
    path = shared_folder(t.spark, "lines")
    rows = console_rows_stream(_streamed(t, "console"), None, "0 seconds", silence=timedelta(seconds=1), hold=2)
    sinks.keep_console_lines(rows, path, f"{path}-state", available_now=True).awaitTermination()
    return sinks.console_lines_at(t.spark, path, {"console_id": t.console().schema["console_id"].dataType.simpleString()})


@query
def tag_profile_stream(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "profile")
    weighted = effective_interactions_stream(_streamed(t, "actions"), "0 seconds")
    running = sinks.keep_profile(weighted, path, f"{path}-state", available_now=True)
    running.awaitTermination()
    return sinks.latest_profile(t.spark, path)


def _event_contexts(t: Tables) -> DataFrame:
    """The document at each event: a part's source file."""
    files = t.sources()
    n_files = files.select(F.count(F.lit(1))).scalar()
    events = t.events().select("user_id", "event_id", (F.col("event_id") % n_files).alias("file_id"))
    return events.join(files, "file_id").select(
        "user_id",
        "event_id",
        "text",
        (F.col("event_id") % 4).cast("int").alias("caret_line"),
        F.lit(None).cast("string").alias("selected"),
    )


@query
def difficulty_queries(t: Tables) -> DataFrame:
    triggers = di.difficulty_triggers(di.detect_difficulty(t.editor_events()))
    return di.difficulty_queries(triggers, _event_contexts(t), t.generous_settings(), t.visible())


@query
def difficulty_queries_as_of(t: Tables) -> DataFrame:
    """Triggers by the settings and windows of their instant."""
    triggers = di.difficulty_triggers(di.detect_difficulty(t.editor_events()))
    return di.difficulty_queries(triggers, _event_contexts(t), t.setting_changes(), t.window_changes())


# telemetry


@query
def query_events(t: Tables) -> DataFrame:
    events = te.query_events(t.searches())
    return _joined(events.withColumn("Tags", F.col("Tags").cast("array<string>")), "Tags")


@query
def result_events(t: Tables) -> DataFrame:
    return te.result_events(t.result_clicks(), t.result_queries())


@query
def difficulty_events(t: Tables) -> DataFrame:
    log = di.detect_difficulty(t.editor_events())
    return _log(te.difficulty_events(log, t.generous_settings(), t.visible()))


PROJECT_KEYS = ["project", "user_id"]


@query
def difficulty_events_by_project(t: Tables) -> DataFrame:
    log = di.detect_difficulty(t.editor_events().withColumn("project", t.project()), PROJECT_KEYS)
    return _log(te.difficulty_events(log, t.generous_settings(), t.visible(), PROJECT_KEYS))


@query
def settings_events(t: Tables) -> DataFrame:
    return te.settings_events(t.settings())


# end-to-end jobs


@query
def compile_error_queries(t: Tables) -> DataFrame:
    return jobs.compile_error_queries(t.compiler_messages(), t.settings(), _part_stats(t))


@query
def runtime_error_queries(t: Tables) -> DataFrame:
    return jobs.runtime_error_queries(t.console(), t.generous_settings(), _part_stats(t))


def _document_profile(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Users' clicks on languages and sources, and the statistics of those tags."""
    posts = t.document_posts()
    clicks = t.events().select(
        (F.col("user_id") % 40).alias("user_id"),
        F.when(F.col("event_type") == "view", F.array(F.lit("en"), F.concat(F.lit("src"), F.col("event_id") % 7)))
        .otherwise(F.array(F.concat(F.lit("src"), F.col("event_id") % 5))).alias("tags"),
        F.when(F.col("event_type") == "click", 3).otherwise(1).alias("weight"),
    )
    return pe.tag_profile(clicks), cp.tag_stats(posts)


@query
def personalised_search(t: Tables) -> DataFrame:
    posts = t.document_posts()
    profile, tags = _document_profile(t)
    found = jobs.personalised_search(
        t.requests(),
        posts,
        se.index_posts(posts),
        stored(profile, "profile"),
        tags,
        open_mark="the",
        close_mark="and",
    )
    return _rounded(found, "score")


def _error_search(t: Tables, job: Callable[..., DataFrame], messages: DataFrame, settings: DataFrame) -> DataFrame:
    posts = stored(t.error_posts(), "posts")
    found = job(
        messages,
        settings,
        t.visible(),
        stored(_part_stats(t), "stats"),
        posts,
        se.index_posts(posts),
        stored(pe.tag_profile(t.clicks_on_parts()), "profile"),
        stored(_tag_stats(t), "tags"),
    )
    return _rounded(found, "score")


@query
def compile_error_search(t: Tables) -> DataFrame:
    return _error_search(t, jobs.compile_error_search, t.compiler_messages(), t.settings())


@query
def runtime_error_search(t: Tables) -> DataFrame:
    return _error_search(t, jobs.runtime_error_search, t.console(), t.generous_settings())


@query
def difficulty_to_search(t: Tables) -> DataFrame:
    return _searched_when_stuck(t, t.raw_edits(), _event_contexts(t), ["user_id"])


@query
def difficulty_to_search_by_project(t: Tables) -> DataFrame:
    """The same for each project of a user apart."""
    raw, contexts = (df.withColumn("project", t.project()) for df in (t.raw_edits(), _event_contexts(t)))
    return _searched_when_stuck(t, raw, contexts, PROJECT_KEYS)


def _searched_when_stuck(t: Tables, raw: DataFrame, contexts: DataFrame, keys: list[str]) -> DataFrame:
    posts = t.part_posts().withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    found = jobs.difficulty_to_search(
        raw,
        contexts,
        t.generous_settings(),
        t.visible(),
        posts,
        se.index_posts(posts),
        stored(_part_stats(t), "stats"),
        t.read("part").select(F.count(F.lit(1))).scalar(),
        stored(pe.tag_profile(t.clicks_on_parts()), "profile"),
        stored(_tag_stats(t), "tags"),
        keys=keys,
    )
    return _rounded(found, "score")
