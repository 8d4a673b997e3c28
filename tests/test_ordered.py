import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from askmill.plans import ordered as od

# the folds below go to the workers with their code
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [
        (rng.choice([1, 1, 1, 1, 2, 3, None]), i, rng.choice([None, *range(9)])) for i in range(2000)
    ]
    return spark.createDataFrame(data, "k int, o int, v int").repartition(5).cache()


def counting(rows, state):
    """Forgets everything at a 9, so that slices soon agree."""
    state = state or {"sum": 0}
    out = []
    for order, value in rows:
        state["sum"] = 0 if value == 8 else (state["sum"] + order) % 97
        out.append((order, state["sum"]))
    return out, state


def adding(rows, state):
    """Never forgets, so that every slice needs the one before."""
    state = state or {"sum": 0}
    out = []
    for order, value in rows:
        state["sum"] += value or 0
        out.append((order, state["sum"]))
    return out, state


PLANS = {
    "running_sum": lambda d: od.running_sum(d, ["k"], ["o"], F.col("v"), "x"),
    "row_number": lambda d: od.row_number(d, ["k"], ["o"], "x"),
    "last_known": lambda d: od.last_known(d, ["k"], ["o"], F.col("v"), "x"),
    "last_known_before": lambda d: od.last_known(d, ["k"], ["o"], F.col("v"), "x", before=True),
    "looking_back": lambda d: od.looking_back(
        d, ["k"], ["o"], 24,
        lambda w: {"x": F.sum("v").over(w.rowsBetween(-24, 0)), "y": F.lag("v", 3).over(w)},
    ),
    "fold_forgetting": lambda d: od.fold_rows(d, ["k"], ["o"], counting, "o int, x int"),
    "fold_remembering": lambda d: od.fold_rows(d, ["k"], ["o"], adding, "o int, x int"),
}


@pytest.mark.parametrize("name", PLANS)
def test_hot_keys_give_what_one_window_gives(spark, rows, hot_after, name):
    plain = sorted(map(str, PLANS[name](rows).collect()))
    hot_after(150)
    assert od.hot_keys(rows, ["k"]).count() >= 3
    assert sorted(map(str, PLANS[name](rows).collect())) == plain
    assert len(plain) == rows.count()


def test_slices_are_bounded_and_ordered(spark, rows, hot_after):
    hot_after(150)
    slices = od._slices(rows, od.hot_keys(rows, ["k"]), ["k"], ["o"])
    spans = slices.groupBy("k", od.SLICE).agg(F.count("o").alias("n"), F.min("o").alias("a"), F.max("o").alias("b"))
    spans = sorted((str(r["k"]), r[od.SLICE], r["n"], r["a"], r["b"]) for r in spans.collect())
    assert max(s[2] for s in spans) <= 150
    for left, right in zip(spans, spans[1:]):
        if left[0] == right[0]:
            assert left[4] < right[3]
