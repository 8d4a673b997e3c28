"""First pages against a full sort, request tables against one request at a time."""

import random

import pytest
from pyspark.sql import functions as F

from askmill import session
from askmill.operators import browse, paging
from askmill.operators import corpus as cp
from askmill.operators import search as se
from askmill.operators.posts import filter_posts

VOCABULARY = ["alpha", "beta", "gamma", "delta", "eps", "the", "of"]


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(21)
    posts = [
        (i, "title", " ".join(rng.choices(VOCABULARY, [1, 2, 3, 4, 5, 20, 20], k=rng.randint(1, 40))), rng.sample(["x", "y"], rng.randint(0, 2)))
        for i in range(400)
    ]
    requests = [
        (f"r{i}", " ".join(rng.choices([*VOCABULARY, "none"], k=rng.randint(0, 3))), rng.sample(["x", "y"], rng.randint(0, 1)), rng.choice([None, 1, 1, 2, 40]), rng.choice([None, 0, 1, 3, 10]))
        for i in range(60)
    ]
    index = se.index_posts(spark.createDataFrame(posts, "post_id int, title string, body string, tags array<string>"), buckets=2, block=4)
    return spark.createDataFrame(requests, "request_id string, q string, tags array<string>, page int, pagesize int"), index


def pages_of(found, requests):
    by_request = {}
    for r in found:
        by_request.setdefault(r.request_id, []).append((-round(r.relevance, 9), r.post_id))
    out = {}
    for r in requests.collect():
        posts, size, page = sorted(by_request.get(r.request_id, [])), 30 if r.pagesize is None else r.pagesize, r.page or 1
        for at in range((page - 1) * size, min(page * size, len(posts))):
            out[r.request_id, at] = posts[at][1], len(posts) > page * size
    return out


def test_pages_equal_a_full_sort(world):
    requests, index = world
    pages, blocks = paging.first_pages(requests, paging.bounds_of(index))
    got = {(r.request_id, r.position): (r.post_id, r.has_more) for r in pages.collect()}
    assert got == pages_of(se.match_posts(requests, index).collect(), requests) and len(got) > 60
    counts = blocks.collect()
    assert all(r.blocks_read <= r.blocks for r in counts)
    assert sum(r.blocks_read for r in counts) < 0.7 * sum(r.blocks for r in counts)


def test_pages_of_searches_that_back_off(world):
    requests, index = world
    pages, _ = paging.backoff_pages(requests, paging.bounds_of(index))
    got = {(r.request_id, r.position): (r.post_id, r.has_more) for r in pages.collect()}
    full = se.search_with_backoff(requests, index).where("post_id IS NOT NULL").collect()
    assert got == pages_of(full, requests)
    used = {r.request_id: r.query for r in full}
    assert all(r.query == used[r.request_id] for r in pages.collect())


def test_rounds_are_few_and_forward_stays_where_it_is(spark, world, monkeypatch):
    requests, index = world
    names = []
    monkeypatch.setattr(paging, "stored", lambda df, name, *folders: names.append(name) or session.stored(df, name, *folders))
    paging.first_pages(requests, paging.bounds_of(index))
    assert names.count("placed") <= 3  # of 100 blocks
    candidates = session.stored(spark.range(50).selectExpr("cast(id as int) post_id"), "candidates")
    plan = candidates.hint("merge").join(index.forward, "post_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(post_id") == 1


def test_pages_of_nothing(spark, world):
    requests, index = world
    pages, blocks = paging.first_pages(requests.limit(0), paging.bounds_of(index))
    assert pages.collect() == [] and blocks.collect() == []


def test_request_table_equals_single_requests(spark):
    rng = random.Random(5)
    flag = lambda: rng.choice([None, True, False])
    posts = [
        (i, rng.choice([None, ["a", "b", "a"], ["b"], ["c"], []]), rng.choice([None, "one body", "two"]), f"t{i % 7}", rng.choice([None, "u/1", "u/2"]),
         f"user{i % 4}", rng.choice([None, 1, 5, 5, 9, i % 60]), rng.randrange(4), rng.randrange(9), *(flag() for _ in range(5)))
        for i in range(300)
    ]
    schema = "post_id int, tags array<string>, body string, title string, url string, user string, votes int, answers int, views int"
    df = spark.createDataFrame(posts, f"{schema}, accepted boolean, closed boolean, migrated boolean, notice boolean, wiki boolean")
    moment = lambda seconds: F.when(F.col("post_id") % 9 > 0, F.timestamp_seconds(seconds))
    df = df.withColumn("created", moment(F.col("post_id") * 100)).withColumn("active", moment(F.col("post_id") * 7 % 50)).withColumn("relevance", F.lit(1.0))
    some = lambda *values: rng.choice([None, None, *values])
    given = []
    for n in range(60):
        request = {
            "tagged": some("a", "b;c"), "nottagged": some("b"), "fromdate": some("5000"), "todate": some("20000"), "answers": some("1"), "views": some("3"),
            "body": some("bod"), "title": some("1"), "url": some("u/"), "user": some("user2"),
            "sort": some("votes", "Newest", "active", "creation"), "order": some("asc", "desc"),
            **{f: some("true", "false") if rng.random() < 0.3 else None for f in browse.FLAGS}, "page": some("1", "2"), "pagesize": some("4"),
        }
        if (request["sort"] or "").lower() in ("votes", "active"):
            request |= {"min": some("3"), "max": some("30")}
        given.append((n, request))
    kinds = {"array<string>": lambda v: v.split(";"), "boolean": lambda v: v == "true", "int": int, "long": int, "double": float, "string": str}
    rows = [(n, *(None if r.get(c) is None else kinds[k](r[c]) for c, k in browse.COMPONENTS.items())) for n, r in given]
    requests = spark.createDataFrame(rows, "request_id int, " + ", ".join(f"`{c}` {k}" for c, k in browse.COMPONENTS.items()))
    got = {}
    for r in browse.filter_for_requests(df, requests).collect():
        assert got.setdefault((r.request_id, r.position), r.post_id) == r.post_id
    for n, request in given:
        plain = {"sort": "relevance"} | {k: v for k, v in request.items() if v is not None}
        want = [r.post_id for r in filter_posts(df, plain).select("post_id").collect()]
        start = (int(plain.get("page", 1)) - 1) * int(plain.get("pagesize", 30)) if "page" in plain or "pagesize" in plain else 0
        assert [got.get((n, start + i)) for i in range(len(want))] == want, plain
        assert len(want) == sum(k[0] == n for k in got)
    assert browse.filter_for_requests(df, requests.limit(0)).count() == 0
    assert browse.filter_for_requests(df.limit(0), requests).count() == 0


def test_pages_of_requests_read_few_posts(spark, monkeypatch):
    kept = {}

    def stored(df, name, *folders):
        table = session.stored(df, name, *folders)
        kept.setdefault(name, []).append(table.count())
        return table

    monkeypatch.setattr(browse, "stored", stored)
    monkeypatch.setattr(browse, "CHUNK", 32, raising=False)
    df = spark.range(3000).selectExpr("id post_id", "array(concat('t', id % 3)) tags", "id % 50 votes", "timestamp_seconds(id) created")
    requests = spark.range(40).selectExpr(
        "id request_id", "IF(id % 2 = 0, 'votes', 'creation') sort", "IF(id % 4 < 2, 'asc', 'desc') `order`", "IF(id % 5 = 0, array('t1', 't2'), null) tagged",
        "IF(id % 5 = 1, 2000L, null) fromdate", "IF(id % 5 = 2, 40D, null) min", "IF(id % 5 = 3, 9D, null) max", "cast(id % 3 + 1 as int) page", "10 pagesize",
    )
    got = {(r.request_id, r.position): r.post_id for r in browse.filter_for_requests(df, requests).collect()}
    want = {}
    for r in requests.collect():
        plain = {k: str(int(v) if isinstance(v, float) else v) for k, v in r.asDict().items() if v is not None and k not in ("request_id", "tagged")}
        for n, post in enumerate(filter_posts(df, plain | ({"tagged": "t1;t2"} if r.tagged else {})).collect()):
            want[(r.request_id, (r.page - 1) * 10 + n)] = post.post_id
    assert got == want and len(got) >= 380
    assert sum(kept["matches"]) <= 40 * 100  # all matches are 64,680


def test_occurrences_of_any_term(spark):
    import re

    texts = ["a b a b a", "C++ is C++, not C+", " a b", "x.y.z x.y", "été  là été", None, "", "a  b", "++a++", "a b a"]
    terms = ["a b", "a b a", "C++ ", "C++", ", ", "x.y", "été", "++", " a", "none at all", "", "b a b", ".", "  ", "a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    found = {r["term"]: r["occurrences"] for r in cp.occurrence_idf(spark.createDataFrame([(t,) for t in terms], "term string"), docs).collect()}
    assert found == {t: sum(len(re.findall(rf"\b{re.escape(t)}\b", x or "")) if t else 0 for x in texts) for t in terms}
