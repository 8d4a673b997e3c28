import pytest
from pyspark.sql import functions as F

from askmill.functions import text as tx
from askmill.operators import errors as er
from askmill.schemas import STAT

MESSAGE = "run_id string, category string, pos int, text string"

# Texts and the results they must give.
GOLDEN = [
    (
        "(java.lang.IllegalArgumentException)here abcdjava 1.7 banana jdk1.8.6_1\njava.io.IOError geography",
        ["7", "8"], ["IllegalArgumentException"], ["IOError"],
    ),
    (
        "java.lang.AssertionError: Already disposed\n            at com.intellij.openapi.components.impl"
        ".ComponentMa\n            java.lang.StackOverflowErrorasdf",
        [], ["AssertionError", "StackOverflowError"], [],
    ),
    ("jav1::jdk 1.3pyhtonjavac 1.5.9javac1.6", ["3", "5", "6"], [], []),
    ("java 1x8", ["8"], [], []),
]


@pytest.mark.parametrize("text, versions, lang, io", GOLDEN)
def test_patterns(spark, text, versions, lang, io):
    df = spark.createDataFrame([([text],)], "texts array<string>")
    for pattern, group, expected in (
        (tx.JAVA_VERSION, 6, versions), (tx.JAVA_LANG_EXCEPTION, 1, lang), (tx.JAVA_IO_EXCEPTION, 1, io),
    ):
        assert df.select(tx.find_patterns(F.col("texts"), pattern, group)).first()[0] == expected


@pytest.mark.parametrize(
    "texts, line",
    [
        (["aiwugno\niwernf"], "aiwugno"), (["hfk ikdmn  dkj"], "hfk ikdmn  dkj"),
        (["java is awesome\t\t  "], "java is awesome\t\t  "), (["\nasdf"], ""), ([""], ""), (["\n"], ""),
        (["\n\n"], ""), ([], None), (["a: b:c\nd", "e"], "a bc"),
    ],
)
def test_first_line(spark, texts, line):
    df = spark.createDataFrame([(texts,)], "texts array<string>")
    assert df.select(tx.first_line(F.col("texts"))).first()[0] == line


def test_group_messages_keeps_order_and_nothing_is_lost(spark):
    rows = [("r", c, i, f"{c} {i}") for c in er.CATEGORIES for i in (2, 0, 1)] + [("e", "ERROR", 0, "x")]
    grouped = {
        (r["run_id"], r["part"]): r for r in er.group_messages(spark.createDataFrame(rows, MESSAGE), 2).collect()
    }
    assert grouped["r", 0]["errors"] == ["ERROR 0", "ERROR 1"] and grouped["r", 1]["errors"] == ["ERROR 2"]
    assert grouped["r", 1]["warnings"] == ["WARNING 2"]
    assert grouped["e", 0]["errors"] == ["x"] and grouped["e", 0]["informations"] == []


def keywords(spark, rows, words, **options):
    stats = spark.createDataFrame([(w, 1, 1, 1.0, 1.0) for w in words], STAT)
    found = er.error_keywords(spark.createDataFrame(rows, MESSAGE), stats, er.COMPILE, **options)
    return {r["run_id"]: r["keywords"] for r in found.collect()}


def test_keywords_in_order(spark):
    rows = [
        ("r", "ERROR", 0, 'known: "line"\njava.io.IOException x'),
        ("r", "ERROR", 1, "java.lang.LinkageError jdk 1.8\nother\nknown line"),
        ("r", "WARNING", 0, "java 1.7"),
        ("w", "WARNING", 0, "java 1.7"),
    ]
    assert keywords(spark, rows, ["known line", "other"]) == {
        "r": "compile error LinkageError IOException java 8 java 7 known line other"
    }
    by_word = keywords(spark, rows, ["known", "x"], token_split=er.SINGLE_WORDS)
    assert by_word["r"] == "compile error LinkageError IOException java 8 java 7 known x"


def test_ten_keywords_at_most(spark):
    rows = [("r", "ERROR", 0, "\n".join(f"w{i:02d}" for i in range(30)))]
    found = keywords(spark, rows, [f"w{i:02d}" for i in range(30)])["r"].split()
    assert found == ["compile", "error", *[f"w{i:02d}" for i in range(9)]]


EXIT = "\nProcess finished with exit code 1\n"


def console(spark, rows):
    numbered = [(c, s, t, x) for s, (c, t, x) in enumerate(rows)]
    return spark.createDataFrame(numbered, "console_id int, seq int, content_type string, chunk string")


@pytest.mark.parametrize("limit", [1_000_000, 2])
def test_console_runs(spark, hot_after, limit):
    hot_after(limit)
    rows = [
        (1, "ERROR_OUTPUT", "java.lang.Ill"), (2, "SYSTEM", "hello"), (1, "SYSTEM", "info"),
        (1, "NORMAL", "ignored"), (1, "ERROR_OUTPUT", "egalException: a\nb\n"), (1, "SYSTEM", EXIT),
        (2, "SYSTEM", EXIT), (2, "ERROR_OUTPUT", "late"), (1, "SYSTEM", "x" + EXIT),
        (1, "ERROR_OUTPUT", "second"), (1, "SYSTEM", EXIT), (1, "ERROR_OUTPUT", "open"),
    ]
    found = {(r["console_id"], r["run"], r["category"]): r["text"] for r in er.console_runs(console(spark, rows)).collect()}
    assert found == {
        (1, 0, "ERROR"): "java.lang.IllegalException: a\nb\n", (1, 0, "INFORMATION"): "info",
        (1, 1, "INFORMATION"): "x" + EXIT, (1, 1, "ERROR"): "second",
    }


def test_a_long_run_goes_on_in_parts(spark):
    rows = [(1, "ERROR_OUTPUT", f"line {i}\n") for i in range(25)] + [(1, "SYSTEM", EXIT)]
    parts = er.console_runs(console(spark, rows), 10).orderBy("part").collect()
    assert len(parts) == 3
    assert "\n".join(p["text"] for p in parts) == "".join(f"line {i}\n" for i in range(25))
