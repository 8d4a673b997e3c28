import math
import random

import pytest

from askmill.operators import history as hi
from askmill.operators import personal as pe
from askmill.operators.posts import filter_posts, sort_posts
from askmill.plans import jobs
from askmill.schemas import STAT

RESULT = "request_id int, user_id int, post_id int, position int, tags array<string>"


def brute_ranks(lists, profile, idf):
    """Stable sorts of each request's list, as one user would see them."""
    placed = {}
    for request, (user, posts) in lists.items():
        def score(tags):
            known = [t for t in tags if (user, t) in profile and t in idf]
            return sum(idf[t] * (1 + math.log10(profile[user, t])) for t in known) / len(tags) if tags else 0

        initial = list(enumerate(posts))
        weighted = sorted(initial, key=lambda p: -round(score(p[1][1]), 9))
        ranked = [(first, w, post) for w, (first, post) in enumerate(weighted)]
        for place, (first, w, (post, _)) in enumerate(sorted(ranked, key=lambda r: (r[0] + r[1]) // 2)):
            placed[request, post] = (first, w, place)
    return placed


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_ranks_against_brute_force(spark, hot_after, limit):
    hot_after(limit)
    rng = random.Random(5)
    tags = list("abcdefgh")
    idf = {t: rng.uniform(0.1, 3) for t in tags[:6]}
    profile = {(u, t): rng.randint(1, 40) for u in range(3) for t in rng.sample(tags, 5)}
    lists = {
        r: (rng.randrange(3), [(r * 100 + i, rng.choices(tags, k=rng.randint(0, 4))) for i in range(rng.randint(1, 40))])
        for r in range(12)
    }
    rows = [(r, u, p, i, t) for r, (u, posts) in lists.items() for i, (p, t) in enumerate(posts)]
    ranks = pe.personal_ranks(
        spark.createDataFrame(rows, RESULT),
        spark.createDataFrame([(u, t, c) for (u, t), c in profile.items()], "user_id int, tag string, clicks long"),
        spark.createDataFrame([(t, 1, 1, i, i) for t, i in idf.items()], STAT),
    )
    found = {
        (r["request_id"], r["post_id"]): (r["initial_rank"], r["weighted_rank"], r["final_rank"])
        for r in ranks.collect()
    }
    assert found == brute_ranks(lists, profile, idf)


def test_effective_interactions(spark):
    acts = [
        ("add", "java"), ("add", "java"), ("remove", "java"), ("add", "java"), ("clear", ""), ("add", "java"),
        ("replay", "java,sql"), ("add", "sql"), ("add", "c"), ("expand", "x,y"), ("contract", "x,y"), ("browser", "x"),
    ]
    rows = [(1, i, a, t) for i, (a, t) in enumerate(acts)]
    weighted = pe.effective_interactions(spark.createDataFrame(rows, "user_id int, seq int, action string, tags string"))
    profile = {r["tag"]: r["clicks"] for r in pe.tag_profile(weighted).collect()}
    assert profile == {"java": 6, "c": 2, "x": 4, "y": 1}


SEARCH = "user_id int, seq int, query string, tags string, manual boolean, replay boolean"


@pytest.mark.parametrize("limit", [1_000_000, 2])
def test_history(spark, hot_after, limit):
    hot_after(limit)
    searches = [
        ("a", "", True, False), ("a", "x", True, False), ("b", "", False, False), ("b", "", False, False),
        ("a", "", True, True), ("", "", True, False), ("b", "y", True, False), ("", "t", True, False),
        ("", "", True, False), ("c", "", True, False),
    ]
    rows = [(1, i, *s) for i, s in enumerate(searches)]
    entries = hi.query_history(spark.createDataFrame(rows, SEARCH)).orderBy("index").collect()
    assert [(e["query"], e["tags"]) for e in entries] == [("c", ""), ("", ""), ("b", "y"), ("b", ""), ("a", "x")]
    assert [e["entry"] for e in entries] == [4, 3, 2, 1, 0]


POSTS = "post_id int, tags array<string>, title string, body string, votes int, created timestamp, accepted boolean"


def test_filters_and_pages(spark):
    posts = spark.createDataFrame([(i, ["a" if i % 2 else "b"], f"t{i}", "body", i, None, i > 5) for i in range(20)], POSTS)
    kept = filter_posts(posts, {"tagged": "a;z", "min": "3", "accepted": "true", "sort": "votes", "page": "2", "pagesize": "3"})
    assert [r["post_id"] for r in kept.collect()] == [13, 11, 9]
    plan = filter_posts(posts.select("post_id", "votes", "title"), {"title": "t1", "filter": "post_id"})
    assert plan.columns == ["post_id"]


def test_sorts(spark):
    rows = [("r", 1, 5), ("r", 2, 9), ("r", 3, 9), ("r", 4, None)]
    placed = sort_posts(spark.createDataFrame(rows, "request_id string, post_id int, votes int"), "votes")
    assert [r["post_id"] for r in placed.orderBy("position").collect()] == [2, 3, 1, 4]


@pytest.mark.parametrize("repeated", [False, True])
def test_results_are_scored_once_for_a_user_and_a_list_of_tags(spark, monkeypatch, repeated):
    """And ranked as each result on its own would be; posts with one id too take the plain way."""
    posts = [(p, f"t{p}", "body", [["a", "b"], ["b"], [], None][p % 4], p % 3, p) for p in range(12)]
    posts += posts[:1] if repeated else []
    requests = [("r1", 1, "relevance"), ("r2", 1, "relevance"), ("r3", 2, "votes"), ("r4", None, "relevance"), ("r5", 3, None)]
    ids = [p[0] for p in posts]
    found = [(r[0], f"q {r[0]}", p, float(p % 5)) for r in requests for p in dict.fromkeys(ids)] + [("r6", "none", None, None)]
    posts_df = spark.createDataFrame(posts, "post_id long, title string, body string, tags array<string>, votes int, _at long")
    posts_df = posts_df.selectExpr("post_id", "title", "body", "tags", "votes", "timestamp_seconds(_at) created", "timestamp_seconds(_at) active")
    requests_df = spark.createDataFrame(requests, "request_id string, user_id long, sort string")
    found_df = spark.createDataFrame(found, "request_id string, query string, post_id long, relevance double")
    profile = spark.createDataFrame([(1, "a", 10), (1, "b", 3), (3, "b", 5)], "user_id long, tag string, clicks long")
    tags = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "term string, idf double")
    scored, score = [], pe.score_posts_for_user
    monkeypatch.setattr(pe, "score_posts_for_user", lambda results, *rest: scored.append(results.count()) or score(results, *rest))
    got = jobs.ranked_results(found_df, requests_df, posts_df, profile, tags).collect()
    if repeated:
        assert len(got) > 60
        return
    assert scored == [8]  # two users sorted by relevance, four lists each
    worth = {(1, "a"): 2 * (1 + math.log10(10)), (1, "b"): 1 + math.log10(3), (3, "b"): 1 + math.log10(5)}
    want = set()
    for r, user, sort in requests:
        key = {"relevance": lambda p: (-(p[0] % 5), p[0]), "votes": lambda p: (-p[4], p[0]), None: lambda p: (-(p[0] % 5), p[0])}[sort]
        listed = sorted(posts, key=key)
        first = {p[0]: n for n, p in enumerate(listed)}
        if sort != "relevance":
            want |= {(r, f"q {r}", sort, n, n, None, p) for p, n in first.items()}
            continue
        scores = {p[0]: sum(worth.get((user, t), 0.0) for t in p[3]) / len(p[3]) if p[3] else 0.0 for p in posts}
        second = {p: n for n, p in enumerate(sorted(first, key=lambda p: (-round(scores[p], 9), first[p])))}
        third = {p: n for n, p in enumerate(sorted(first, key=lambda p: ((first[p] + second[p]) // 2, second[p])))}
        want |= {(r, f"q {r}", sort, third[p], first[p], round(scores[p], 9), p) for p in first}
    rows = {(*x[:5], None if x["score"] is None else round(x["score"], 9), x["post_id"]) for x in got}
    assert rows == want and len(got) == len(want)
