"""Operator inputs built from the test tables. `oracle.py` builds the same ones in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill.plans.ordered import row_number
from askmill.session import spread

PROJECT_RUN = 500  # events in a row at one project
START = "2024-01-01 00:00:00"  # earliest second of the event table


class Tables:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # texts

    def corpus(self) -> DataFrame:
        return spread(self.read("documents").select("doc_id", "text"), "doc_id")

    def doc_count(self):
        return self.read("documents").select(F.count(F.lit(1))).scalar()

    def part_names(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))

    def sources(self) -> DataFrame:
        text = F.concat(
            F.lit("import "), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), "p_type",
            F.lit(";\n// "), "p_brand", F.lit("\nimport "), "p_type", F.lit(";/* "), "p_brand",
            F.lit("\n*/ end"),
        )
        return self.read("part").select(
            F.col("p_partkey").alias("file_id"), text.alias("text"), F.col("p_size").alias("size")
        )

    def contexts(self) -> DataFrame:
        talk = self.read("conversations")
        spoken = talk.select(
            F.concat_ws(":", "conv_id", "turn").alias("context_id"),
            "text",
            (F.col("turn") % 3).cast("int").alias("caret_line"),
            F.when(F.col("conv_id") % 2 == 1, F.col("text")).alias("selected"),
        )
        files = self.sources().select(
            F.concat(F.lit("file:"), "file_id").alias("context_id"),
            "text",
            (F.col("size") % 4).cast("int").alias("caret_line"),
            F.lit(None).cast("string").alias("selected"),
        )
        return spread(spoken.unionByName(files), "context_id")

    # posts and results

    def part_posts(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_partkey").alias("post_id"),
            F.col("p_name").alias("title"),
            F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).alias("body"),
            F.when(
                F.col("p_size") % 7 > 0, F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
            ).alias("tags"),
            F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("p/"), "p_partkey")).alias("link"),
            F.col("p_size").alias("votes"),
            F.timestamp_seconds(F.col("p_partkey") * 86400).alias("created"),
            F.timestamp_seconds(F.col("p_size") * 86400).alias("active"),
            (F.col("p_partkey") % 4).cast("int").alias("answers"),
            (F.col("p_size") % 2 == 0).alias("accepted"),
            F.col("p_brand").alias("user"),
        )

    def full_posts(self) -> DataFrame:
        """Parts with every column that a request can test."""
        extra = self.read("part").selectExpr(
            "p_partkey post_id", "p_retailprice relevance", "cast(p_partkey % 1000 as int) views", "p_size % 3 = 0 closed",
            "p_partkey % 5 = 0 migrated", "p_size % 11 = 0 notice", "p_partkey % 7 > 0 wiki",
            "concat('site', p_partkey % 3) site", "CASE WHEN p_size % 5 > 0 THEN concat('p/', p_partkey) END url",
        )
        return self.part_posts().drop("link").join(extra, "post_id")

    def browse_requests(self) -> DataFrame:
        """One structured request per customer; each component is set in some of them."""
        day = "CASE WHEN c_custkey % 4 > 1 THEN 86400 ELSE 1 END"
        return self.read("customer").selectExpr(
            "c_custkey request_id",
            "CASE c_custkey % 4 WHEN 0 THEN 'relevance' WHEN 1 THEN 'votes' WHEN 2 THEN 'Newest' ELSE 'active' END sort",
            "CASE WHEN c_custkey % 3 = 2 THEN 'asc' END `order`",
            "CASE WHEN c_custkey % 3 = 0 THEN array('ring', 'bolt', 'ring') END tagged",
            "CASE WHEN c_custkey % 5 = 0 THEN array('cold') END nottagged",
            "CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 50 * 86400 END fromdate",
            "CASE WHEN c_custkey % 3 = 1 THEN (c_custkey % 50 + 100) * 86400 END todate",
            f"CASE WHEN c_custkey % 4 > 0 AND c_custkey % 7 = 1 THEN c_custkey % 20 * {day} END min",
            f"CASE WHEN c_custkey % 4 > 0 AND c_custkey % 7 = 2 THEN (c_custkey % 20 + 20) * {day} END max",
            "CASE WHEN c_custkey % 6 = 1 THEN c_custkey % 4 END answers",
            "CASE WHEN c_custkey % 8 = 3 THEN c_custkey % 500 END views",
            "CASE WHEN c_custkey % 9 = 4 THEN concat('Brand#', c_custkey % 5 + 1) END body",
            "CASE WHEN c_custkey % 10 = 5 THEN 'l' END title",
            "CASE WHEN c_custkey % 11 = 6 THEN 'p/1' END url",
            "CASE WHEN c_custkey % 12 = 7 THEN 'Brand#13' END user",
            "CASE WHEN c_custkey % 13 = 3 THEN concat('site', c_custkey % 3) END site",
            "CASE WHEN c_custkey % 7 = 3 THEN c_custkey % 2 = 0 END accepted",
            "CASE WHEN c_custkey % 7 = 4 THEN c_custkey % 2 = 0 END closed",
            "CASE WHEN c_custkey % 7 = 5 THEN c_custkey % 2 = 0 END migrated",
            "CASE WHEN c_custkey % 7 = 6 THEN c_custkey % 2 = 0 END notice",
            "CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 2 = 0 END wiki",
            "CASE WHEN c_custkey % 20 > 0 THEN c_custkey % 3 + 1 END page",
            "CASE WHEN c_custkey % 4 = 1 THEN 7 END pagesize",
        )

    def tagged_parts(self) -> DataFrame:
        """Every part with its tags, none missing."""
        tags = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
        return self.read("part").select(F.col("p_partkey").alias("post_id"), tags.alias("tags"))

    def document_posts(self) -> DataFrame:
        docs = self.read("documents").select(
            F.col("doc_id").alias("post_id"),
            F.concat(F.lit("doc "), "doc_id").alias("title"),
            F.col("text").alias("body"),
            F.array("lang", "source").alias("tags"),
            (F.col("doc_id") % 10).cast("int").alias("votes"),
            F.timestamp_seconds(F.col("doc_id")).alias("created"),
            F.timestamp_seconds(F.col("doc_id") * 7 % 1000).alias("active"),
        )
        return spread(docs, "post_id")

    def requests(self) -> DataFrame:
        """One request per sentence of the benchmark texts, written with marks to be removed."""
        sentences = self.read("benchmark").select(
            "item_id", F.posexplode(F.split("text", r"\.")).alias("n", "sentence")
        )
        first = F.element_at(F.split(F.trim("sentence"), " "), 1)
        marked = F.concat(
            F.lit(" <scr<script>ipt>{"), F.trim("sentence"), F.lit("}</script> ")
        )
        number = F.col("item_id") + F.col("n")
        return sentences.select(
            F.concat_ws(":", "item_id", "n").alias("request_id"),
            F.col("item_id").alias("user_id"),
            F.when(first != "", marked).otherwise("").alias("q"),
            F.when(number % 3 == 0, F.array(F.lit("en"))).otherwise(
                F.array().cast("array<string>")
            ).alias("tags"),
            F.element_at(
                F.array(*[F.lit(s) for s in ("relevance", "relevance", "votes", "newest", "active")]),
                (F.col("n") % 5 + 1).cast("int"),
            ).alias("sort"),
            (number % 2 == 0).alias("backoff"),
        )

    def clicks_on_parts(self) -> DataFrame:
        """Weighted interactions of users with tagged posts."""
        lines = self.read("lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
        lines = spread(lines, "l_orderkey")
        orders = self.read("orders").select("o_orderkey", "o_custkey")
        weight = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2)
        return (
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.tagged_parts(), F.col("l_partkey") == F.col("post_id"))
            .select(F.col("o_custkey").alias("user_id"), "tags", weight.otherwise(1).alias("weight"))
        )

    def results(self) -> DataFrame:
        """The parts of an order as the result list of one request."""
        lines = self.read("lineitem").select(
            F.col("l_orderkey").alias("request_id"), "l_linenumber", "l_partkey", "l_suppkey"
        )
        lines = spread(lines, "request_id")
        order = ["l_linenumber", "l_partkey", "l_suppkey"]
        placed = row_number(lines, ["request_id"], order, "position")
        users = self.read("orders").select(
            F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id")
        )
        return (
            placed.join(users, "request_id")
            .join(self.tagged_parts(), F.col("l_partkey") == F.col("post_id"))
            .select("request_id", "user_id", "post_id", "position", "tags")
        )

    def pages(self) -> DataFrame:
        return spread(self.read("pages").select("page_id", F.col("html").alias("body")), "page_id")

    # events

    def events(self) -> DataFrame:
        return self.read("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def editor_events(self, speed: int = 1) -> DataFrame:
        kind = (
            F.when(F.col("event_type") == "click", "Click")
            .when(F.col("event_type") == "view", "Scroll")
            .when(F.col("event_type") == "error", "Delete")
            .otherwise("Insert")
        )
        start = F.unix_micros(F.lit(START).cast("timestamp"))
        passed = F.call_function("div", F.unix_micros("ts") - start, F.lit(speed))
        return self.events().select(
            "user_id", "event_id", F.timestamp_micros(start + passed).alias("ts"), kind.alias("kind")
        )

    def raw_edits(self) -> DataFrame:
        kind = F.col("event_type")
        return self.events().select(
            "user_id",
            "event_id",
            "ts",
            F.when(kind == "click", "click").when(kind == "view", "scroll").otherwise("change").alias(
                "action"
            ),
            F.when((kind == "error") | (F.col("event_id") % 5 == 0), F.col("props")).otherwise("").alias(
                "old_text"
            ),
            F.when(kind.isin("purchase", "signup"), F.col("props")).otherwise("").alias("new_text"),
            F.when(F.col("event_id") % 3 > 0, F.floor("value").cast("double")).alias("old_center"),
            F.floor(F.col("value") / 2 + 1).cast("double").alias("new_center"),
        )

    def settings(self) -> DataFrame:
        user = F.col("user_id")
        flags = {"auto_query": 2, "runtime_error": 3, "compile_error": 5, "difficulty": 7, "logging": 11}
        return (
            self.events().where(user % 13 > 0).select("user_id").distinct().select(
                "user_id", *[(user % n > 0).alias(flag) for flag, n in flags.items()]
            )
        )

    def generous_settings(self) -> DataFrame:
        """Settings in which most users have everything on."""
        user = F.col("user_id")
        flags = {"auto_query": 9, "runtime_error": 8, "compile_error": 5, "difficulty": 7, "logging": 11}
        return (
            self.events().where(user % 13 > 0).select("user_id").distinct().select(
                "user_id", *[(user % n > 0).alias(flag) for flag, n in flags.items()]
            )
        )

    def visible(self) -> DataFrame:
        return self.events().where(F.col("user_id") % 4 > 0).select("user_id").distinct()

    def setting_changes(self) -> DataFrame:
        """Settings as users change them in time: their purchases."""
        number = F.col("event_id")
        flags = {"auto_query": 9, "runtime_error": 3, "compile_error": 5, "difficulty": 4, "logging": 11}
        return self.events().where(F.col("event_type") == "purchase").select(
            "user_id", "ts", number.alias("seq"), *[(number % n > 0).alias(flag) for flag, n in flags.items()]
        )

    def window_changes(self) -> DataFrame:
        """Tool windows opened and closed in time: users' signups; some say nothing."""
        number = F.col("event_id")
        return self.events().where(F.col("event_type") == "signup").select(
            "user_id", "ts", number.alias("seq"), F.when(number % 7 > 0, number % 3 > 0).alias("visible")
        )

    def project(self) -> Column:
        """The project of an event: a user works at two in turn."""
        return F.concat(F.lit("p"), F.call_function("div", F.col("event_id"), F.lit(PROJECT_RUN)) % 2)

    def error_posts(self) -> DataFrame:
        """Parts as posts about errors."""
        body = F.concat(F.lit("Compile error, runtime error: IOException IllegalStateException, java "), F.col("votes") % 9 + 1)
        tags = F.coalesce("tags", F.array().cast("array<string>"))
        return self.part_posts().withColumns({"body": F.concat_ws("; ", body, "body"), "tags": tags})

    def console(self) -> DataFrame:
        kind = F.col("event_type")
        error = F.concat(
            F.lit("java.lang.IllegalState"), F.lit("Exception: "), "props", F.lit("\nat jdk 1."),
            (F.col("user_id") % 9 + 1).cast("string"),
            F.when(F.col("event_id") % 2 == 0, F.lit("\n")).otherwise(F.lit("")),
        )
        content = F.when(kind.isin("purchase", "view"), "SYSTEM").when(kind == "error", "ERROR_OUTPUT")
        chunk = (
            F.when(kind == "purchase", F.lit("\nProcess finished with exit code 1\n"))
            .when(kind == "error", error)
            .otherwise(F.concat(F.lit("java 1."), (F.col("event_id") % 9 + 1).cast("string")))
        )
        return self.events().select(
            F.col("user_id").alias("console_id"),
            "user_id",
            "ts",
            F.col("event_id").alias("seq"),
            content.otherwise("NORMAL").alias("content_type"),
            chunk.alias("chunk"),
        )

    def compiler_messages(self) -> DataFrame:
        kind = F.col("event_type")
        word = F.element_at(
            F.array(*[F.lit(w) for w in ("small", "zzz", "ring", "cold", "anvil", "red", "yyy")]),
            (F.col("event_id") % 7 + 1).cast("int"),
        )
        error = F.concat(
            F.lit("java.io.IOException: "), "props", F.lit("\n"), word, F.lit(";\njava.lang.Error")
        )
        text = (
            F.when((kind == "error") & (F.col("event_id") % 3 == 0), F.concat(word, F.lit(":\nblue bolt")))
            .when(kind == "error", error)
            .when(kind == "view", F.concat(F.lit("Javac v 1."), (F.col("event_id") % 9 + 1).cast("string")))
            .otherwise(F.lit("done"))
        )
        category = F.when(kind == "error", "ERROR").when(kind == "view", "WARNING")
        rows = self.events().select(
            F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("run_id"),
            "user_id",
            category.otherwise("INFORMATION").alias("category"),
            text.alias("text"),
            "event_id",
        )
        return row_number(rows, ["run_id", "category"], ["event_id"], "pos")

    def searches(self) -> DataFrame:
        kind = F.col("event_type")
        number = F.col("event_id")
        query_type = (
            F.when(number % 3 > 0, "manual")
            .when(kind == "error", "runtime")
            .when(kind == "view", "compiler")
            .when(kind == "click", "difficulty")
            .otherwise("action")
        )
        return self.events().select(
            "user_id",
            number.alias("seq"),
            F.when(number % 11 == 0, "").otherwise(kind).alias("query"),
            F.when(number % 4 == 0, "").otherwise(F.concat_ws(" ", kind, "props")).alias("tags"),
            (number % 3 > 0).alias("manual"),
            (number % 17 == 0).alias("replay"),
            query_type.alias("query_type"),
            F.upper(F.when(number % 2 == 0, "relevance").otherwise("votes")).alias("sort"),
            (number % 5 > 0).alias("visible"),
        )

    def result_clicks(self) -> DataFrame:
        number = F.col("event_id")
        names = F.array(*[F.lit(t) for t in ("expand", "contract", "browser")])
        return self.events().where(F.col("event_type") == "click").select(
            "user_id",
            number.alias("seq"),
            F.element_at(names, (number % 3 + 1).cast("int")).alias("type"),
            (number % 10).cast("int").alias("index"),
            F.lit(10).alias("total"),
        )

    def result_queries(self) -> DataFrame:
        return self.searches().join(
            self.result_clicks().select("user_id", "seq"), ["user_id", "seq"], "left_anti"
        ).select("user_id", "seq", "query_type")

    def actions(self) -> DataFrame:
        kind, number = F.col("event_type"), F.col("event_id")
        action = (
            F.when(kind == "click", "add")
            .when(kind == "view", "expand")
            .when(kind == "purchase", "browser")
            .when((kind == "signup") & (number % 4 == 0), "clear")
            .when((kind == "signup") & (number % 4 == 1), "replay")
            .when(kind == "signup", "contract")
            .otherwise("remove")
        )
        picked = F.concat(F.lit("t"), (number % 3).cast("string"))
        pair = F.concat(F.lit("t0,t"), (number % 2 + 1).cast("string"))
        return self.events().select(
            "user_id",
            "ts",
            number.alias("seq"),
            action.alias("action"),
            F.when(kind.isin("click", "error"), picked).otherwise(pair).alias("tags"),
        )
