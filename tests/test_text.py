import random

import pytest
from pyspark.sql import functions as F

from askmill.functions import text as tx
from askmill.operators.contexts import auto_query, context_terms
from askmill.operators.posts import clean_posts, excerpt_posts
from askmill.operators.requests import normalise_requests
from askmill.schemas import POST, STAT


def column(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", expression(F.col("text")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def test_strip_comments(spark):
    texts = ["a // b\nc", "a // b\r\nc", "x /* 1\n2 */ y /* 3 */ z", "/* a\r b */", "// end"]
    assert column(spark, texts, tx.strip_comments) == [
        "a c", "a // b\r\nc", "x  y  z", "/* a\r b */", "// end",
    ]


def test_a_long_comment_does_not_overflow(spark):
    assert column(spark, ["/*" + "x\n" * 100_000 + "*/!"], tx.strip_comments) == ["!"]


def test_extract_imports(spark):
    text = "import a.b.C;\nimport static x.y;\nimport a.b.*;\nimport  d;import a.b.C;"
    assert column(spark, [text], tx.extract_imports) == [["a.b.C", "d"]]


def java_hash(text):
    h = 0
    for unit in memoryview(text.encode("utf-16-le")).cast("H"):
        h = (31 * h + unit) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def test_string_hash(spark):
    texts = ["", "java", "c++", "ünï", "a😀b", "x" * 500]
    assert column(spark, texts, tx.string_hash) == [java_hash(t) for t in texts]
    assert column(spark, ["", "a b"], tx.hash_tags) == [[0], [97, 98]]


def nested(depth):
    return "<scr" * depth + "<script>" + "ipt>" * depth


@pytest.mark.parametrize("text", ["a<script>b</script>c", nested(9), "</scr<script>ipt>x", "a > b"])
def test_strip_script_marks(spark, text):
    expected = text
    while "<script>" in expected or "</script>" in expected:
        expected = expected.replace("<script>", "").replace("</script>", "")
    assert column(spark, [text], tx.strip_script_marks) == [expected]


def test_lines_of_a_text(spark):
    df = spark.createDataFrame(
        [("a\nb\n\n", 1), ("a\nb\n\n", 2), ("\n\n", 0), ("", 0), ("\na", 0)], "text string, n int"
    )
    found = [r[0] for r in df.select(tx.line_at(F.col("text"), F.col("n"))).collect()]
    assert found == ["b", None, None, "", ""]


def find_blocks(body, opening, closing):
    blocks, last_open, last_close = [], -1, -1
    while True:
        start = body.find(opening, last_open + 1)
        end = body.find(closing, last_close + 1)
        if start == -1:
            return blocks
        blocks.append((start, end))
        last_open, last_close = start, end


def brute_excerpt(body, opening, closing):
    for start, end in reversed(find_blocks(body, opening, closing)):
        if abs(end - 300) < 100:
            return body[:end]
        if abs(start - 300) < 100 or start < 300 < end:
            return body[: max(start - 1, 0)]
    return body[:300]


def test_excerpts_against_brute_force(spark):
    rng = random.Random(7)
    bodies = ["", "<p>" * 60 + "x" * 90 + "</p>" * 3 + "<p>" * 40, "</p>" * 90 + "<p>" * 300]
    for _ in range(400):
        pieces = rng.choices(["<p>", "</p>", "x" * rng.randint(1, 90), "y"], k=rng.randint(0, 60))
        bodies.append("".join(pieces))
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    rows = excerpt_posts(df, "<p>", "</p>").orderBy("i").collect()
    for row, body in zip(rows, bodies):
        expected = brute_excerpt(body, "<p>", "</p>")
        assert row["excerpt"] == expected
        assert row["has_more"] == (len(body) > len(expected))


def test_null_fills_and_tag_display(spark):
    rows = [(1, ["Tag1", "Tag2"], "b", "e", "t", "l"), (2, None, None, None, None, None)]
    full, empty = clean_posts(spark.createDataFrame(rows, POST)).orderBy("post_id").collect()
    assert full["tag_text"] == "[Tag1] [Tag2] " and full["tags"] == ["Tag1", "Tag2"]
    assert empty["tags"] == [] and empty["tag_text"] == ""
    assert [empty[c] for c in ("body", "excerpt", "title")] == ["", "", ""]
    assert empty["link"] == "http://www.stackoverflow.com/"


def test_requests(spark):
    rows = [
        ("1", " {a} b ", ["x", "y"], None, {"title": "\t{t} "}),
        ("2", "<scr<script>ipt>", [], "VOTES", None),
        ("3", "q", None, "Votes", None),
    ]
    schema = "request_id string, q string, tags array<string>, sort string, extra map<string,string>"
    first, third = normalise_requests(spark.createDataFrame(rows, schema)).orderBy("request_id").collect()
    assert first["sent_q"] == "a b  [x] [y]" and first["tag_text"] == "x y"
    assert first["sort"] == "relevance" and first["site"] == "stackoverflow"
    assert first["extra"] == {"title": "t"}
    assert third["sent_q"] == "q" and third["sort"] == "votes"


CONTEXT = "context_id string, text string, caret_line int, selected string"


def test_context_terms(spark):
    rows = [
        ("doc", "import java.util.List;\nfoo(bar, foo)\n", 1, " \t"),
        ("past", "import a.B;", 5, None),
        ("chosen", "import a.B;", 0, "Xy = 1"),
        ("nothing", "\n\n", 0, None),
        ("blank line", "\nx", 0, None),
    ]
    found = {}
    for row in context_terms(spark.createDataFrame(rows, CONTEXT)).collect():
        found.setdefault(row["context_id"], []).append((row["term"], row["weight"]))
    assert sorted(found["doc"]) == sorted(
        [("java", 1), ("util", 1), ("list", 1)]
        + [(t, 2) for t in ("foo", "(", "bar", ", ", "foo", ")")]
    )
    assert sorted(found["past"]) == [("a", 1), ("b", 1)]
    assert found["chosen"] == [("xy", 2), (" = ", 2), ("1", 2)]
    assert "nothing" not in found
    assert found["blank line"] == [("", 2)]


def test_auto_query_takes_the_four_best_terms(spark):
    stats = spark.createDataFrame(
        [(t, 10, 5, i, i) for t, i in zip("abcdef", (1.0, 2.0, 3.0, 4.0, 5.0, 6.0))], STAT
    )
    rows = [("q", "", 0, "a b c d e f zzz"), ("none", "\n", 0, None)]
    queries = auto_query(spark.createDataFrame(rows, CONTEXT), stats, F.lit(100))
    assert {r["context_id"]: r["query"] for r in queries.collect()} == {"q": "f e d c", "none": ""}
