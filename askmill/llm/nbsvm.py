"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed n-grams: runs of `CHARACTERS` bytes and of `WORDS` words, in `SLOTS` slots, and runs of
one word whatever it is. Each is scaled by the log ratio of its counts in the two classes, smoothed by 1, and documents to unit
length; on these features a linear model with hinge loss and no bias is fitted by dual coordinate descent,
each class with the same total penalty. The margin becomes a score from 0 to 1 by a logistic curve fitted on
margins of training documents that the model has not seen, with the classes in the shares that all training
labels have, so 0.5 is where either label is as likely.

The fit takes a bounded sample of the labelled rows: the `SAMPLE` rows of each class with the smallest
hashes of their ids, so one task holds it whatever the tables' size. The model is one array of weights
(`SLOTS` numbers) and two numbers of the curve, and goes to all tasks; every document is scored whole.

Nulls, empty and repeated rows: a null text is empty; texts without a feature get the curve's value at
margin 0. Labels other than 0 and 1 and labels without a document are not learnt from, and of several rows
of one `doc_id` all texts and all labels count. Without labels of both classes every score is 0.5. An empty
table gives no rows. Other columns stay in `scored`; label, language, source and id are never features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askmill.llm.frames import add_fields, stored
from askmill.llm.wordhash import mix, raw_texts, word_hashes

SLOTS = 1 << 18
CHARACTERS = (3,)
WORDS = (1, 2)
#: Runs of one and the same word of these lengths are n-grams too, whatever the word.
REPEATS = (2, 3, 4)
#: Labelled rows of each class that the fit takes at most.
SAMPLE = 2_500
SEED = 5
EPOCHS = 12
PENALTY = 10.0
#: Part of the sample that only the curve is fitted on.
HELD_BACK = 0.25


def features(text: bytes) -> np.ndarray:
    """The slots of a text's n-grams, each once, ascending."""
    data = np.frombuffer(text, np.uint8)
    on = np.zeros(SLOTS, bool)
    for start in range(0, len(data), 1 << 20):
        some = data[start : start + (1 << 20) + max(CHARACTERS) - 1].astype(np.uint64)
        gram = some
        for size in range(2, max(CHARACTERS) + 1):
            gram = gram[:-1] << np.uint64(8) | some[size - 1 :]
            if size in CHARACTERS:
                with np.errstate(over="ignore"):
                    hashed = (gram + np.uint64(size << 40)) * np.uint64(0x9E3779B97F4A7C15)
                on[(hashed >> np.uint64(46)).astype(np.int64)] = True
    words = gram = word_hashes(data, lower=False)
    for size in range(1, max(WORDS) + 1):
        if size > 1:
            with np.errstate(over="ignore"):
                gram = mix(gram[:-1] * np.uint64(3) + words[size - 1 :])
        if size in WORDS:
            on[(gram >> np.uint64(46)).astype(np.int64)] = True
    same = words[1:] == words[:-1]
    for size in REPEATS:
        same = same & np.append(same[1:], False) if size > 2 else same
        on[size] |= bool(same.any())
    return np.flatnonzero(on)


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.ones((2, SLOTS))
    for slots, label in zip(rows, labels.tolist(), strict=True):
        counts[label, slots] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def _values(slots: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    values = ratios[slots]
    size = np.sqrt((values * values).sum())
    return values / size if size else values


def margin(slots: np.ndarray, weights: np.ndarray, ratios: np.ndarray) -> float:
    return float((weights[slots] * _values(slots, ratios)).sum())


def hinge(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by dual coordinate descent; each class has the same total penalty."""
    sign = np.where(labels == 1, 1.0, -1.0)
    most = PENALTY * len(labels) / 2 / np.maximum(1, np.where(labels == 1, (labels == 1).sum(), (labels == 0).sum()))
    values = [_values(s, ratios) for s in rows]
    norm = np.array([max(float((v * v).sum()), 1e-12) for v in values])
    weights, dual = np.zeros(SLOTS), np.zeros(len(rows))
    rng = np.random.default_rng(SEED)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            slots, value = rows[i], values[i]
            gradient = sign[i] * (weights[slots] * value).sum() - 1
            new = min(max(dual[i] - gradient / norm[i], 0.0), most[i])
            if step := (new - dual[i]) * sign[i]:
                weights[slots] += step * value
                dual[i] = new
    return weights


def curve(margins: np.ndarray, labels: np.ndarray, positive: float = 0.5) -> tuple[float, float]:
    """Slope and intercept of the logistic curve of labels over margins, where `positive` of labels are 1."""
    goal = (labels * 2 - 1).astype(float)
    share = np.where(labels == 1, positive / max(1, (labels == 1).sum()), (1 - positive) / max(1, (labels == 0).sum()))
    slope, shift = 1.0, 0.0
    x = np.stack([margins, np.ones_like(margins)])
    for _ in range(100):
        p = 1 / (1 + np.exp(np.clip(goal * (slope * margins + shift), -50, 50)))
        gradient = -(x * (share * goal * p)).sum(axis=1) + np.array([1e-3 * (slope - 1), 1e-3 * shift])
        curvature = (x * (share * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(slope, 1e-6)), float(shift)


def fitted(texts: list[bytes], labels: np.ndarray, positive: float = 0.5) -> tuple[np.ndarray, float, float]:
    """Weights and log ratios by slot, and the curve's slope and intercept."""
    if len(set(labels.tolist())) < 2:
        return np.zeros((2, SLOTS)), 0.0, 0.0
    rows = [features(t) for t in texts]
    ratios = log_ratios(rows, labels)
    held = np.zeros(len(rows), bool)
    for label in (0, 1):
        own = np.flatnonzero(labels == label)
        held[own[: int(len(own) * HELD_BACK)]] = True
    known = np.flatnonzero(~held)
    own_ratios = log_ratios([rows[i] for i in known], labels[known])
    weights = hinge([rows[i] for i in known], labels[known], own_ratios)
    unseen = np.flatnonzero(held) if held.any() and len(set(labels[held].tolist())) == 2 else known
    margins = np.array([margin(rows[i], weights, own_ratios) for i in unseen])
    slope, shift = curve(margins, labels[unseen], positive)
    return np.stack([hinge(rows, labels, ratios), ratios]), slope, shift


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[bytes, float, float]:
    """The model from docs(doc_id, text) and labels(doc_id, label): weights and ratios, slope, shift."""
    rows = labels.where("label in (0, 1)").select(F.col("doc_id").cast("long"), F.col("label").cast("int").alias("label"))
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    positive = counts.get(1, 0) / max(1, sum(counts.values()))
    rows = rows.withColumn("draw", F.xxhash64(F.lit(SEED), "doc_id"))
    drawn = [rows.where(F.col("label") == k).orderBy("draw", "doc_id").limit(sample) for k in (0, 1)]
    chosen = stored(drawn[0].unionByName(drawn[1]), "sample")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.orderBy("draw", "doc_id", F.xxhash64("text")).limit(2 * sample)

    def fit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in rows if b.num_rows]
        raw = [t for b in held for t in raw_texts(b["text"])]
        marks = np.concatenate([b["label"].to_numpy() for b in held]) if held else np.zeros(0, int)
        weights, slope, shift = fitted(raw, marks, positive)
        yield pa.RecordBatch.from_pydict({"model": [np.asarray(weights, "<f4").tobytes()], "slope": [slope], "shift": [shift]})

    model = texts.select("text", "label").coalesce(1).mapInArrow(fit, "model binary, slope double, shift double").first()
    if model is None:  # no task ran: there are no documents
        return np.zeros(2 * SLOTS, "<f4").tobytes(), 0.0, 0.0
    return model.model, model.slope, model.shift


def scored(docs: DataFrame, model: tuple[bytes, float, float]) -> DataFrame:
    """docs with score and predicted."""
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = add_fields(docs.schema, score=T.DoubleType(), predicted=T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, slope, shift = sent.value
        weights, ratios = np.frombuffer(raw, "<f4").astype(float).reshape(2, SLOTS)
        for batch in batches:
            margins = []
            for text in raw_texts(batch["text"]):
                margins.append(margin(features(text), weights, ratios))
            score = 1 / (1 + np.exp(-np.clip(slope * np.array(margins) + shift, -50, 50)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[f.name for f in schema.fields]
            )

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learnt: the checksum of the id, as text, leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 3 == 1, F.lit(False))
