"""Quality classifier: Naive Bayes support vectors over word n-grams.

A text's features are which word unigrams and bigrams it has, and which runs of ``SHAPE_RUNS`` word
shapes (lower case, capitalised, capitals, digits, same as the word before, or the sign itself),
hashed to ``2**BITS`` slots. Each slot is scaled by its class log-count ratio, rows are brought to unit length, and a linear hinge-loss model
is fitted by dual coordinate descent (L2 loss, so every step has a closed form). Weights are then
mixed with their mean size, and a logistic curve, fitted on margins of rows left out in turn, maps
margins to 0..1. Both classes weigh alike throughout.

Fitting reads at most ``per_class`` labelled rows of each class, those with the least hash of the
id: a bounded sample, whatever the size of the tables (some 30 MB of slot numbers on the driver at
the default). Scoring reads every row whole; only the text counts.

Rows: null and empty texts have no features and get the score of the bias alone. Labels with a
null id or a value other than 0 and 1 are not read; labels without a document neither. Without
both classes every score is 0.5. Repeated rows and null ids are kept as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobtide.llm.common import per_value

BITS = 18
PER_CLASS = 3000
SHAPE_RUNS = (2, 3, 4)
EPOCHS, COST, MIX, SMOOTH, FOLDS = 12, 1.0, 0.5, 1.0, 3
KNOWN_WORDS = 200_000  # word hashes that a worker remembers at most
TOKENS = re.compile(r"[^\W_]+|[^\w\s]")


def slot_maker():
    """A function from a text to its distinct slots, ascending."""
    known: dict[str, int] = {}

    def hashed(word: str) -> int:
        if len(known) >= KNOWN_WORDS:
            known.clear()
        value = known[word] = xxhash.xxh64_intdigest(word.lower()) >> 1
        return value

    def shape(word: str, before: str) -> int:
        if word == before:
            return 1
        if word.isalpha():
            return 2 if word.islower() else 3 if len(word) > 1 and word.isupper() else 4
        return 5 if word.isalnum() else 64 + ord(word)

    def slots(text: str | None) -> np.ndarray:
        words = TOKENS.findall(text) if text else []
        if not words:
            return np.empty(0, np.int32)
        one = np.array([known.get(w) or hashed(w) for w in words], np.uint64)
        own = np.array([shape(w, before) for w, before in zip(words, ["", *words])], np.uint64)
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        runs, rolled = [], own
        for size in range(2, SHAPE_RUNS[-1] + 1):
            rolled = rolled[:-1] * np.uint64(0x9FB21C651E98DF25) + own[size - 1:]
            if size in SHAPE_RUNS:
                runs.append((rolled + np.uint64(size)) * np.uint64(0xA0761D6478BD642F))
        every = np.concatenate([one * np.uint64(0xD6E8FEB86659FD93), two, *runs])
        return np.unique((every >> np.uint64(64 - BITS)).astype(np.int32))

    return slots


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Of each slot: log of its smoothed share in class 1 over that in class 0."""
    counts = np.zeros((2, 1 << BITS))
    for slots, label in zip(rows, labels):
        counts[label][slots] += 1
    many = [max(int((labels == n).sum()), 1) for n in (0, 1)]
    unseen = SMOOTH / len(rows)  # the same in both classes, so a slot never seen says nothing
    return np.log(counts[1] / many[1] + unseen) - np.log(counts[0] / many[0] + unseen)


def descend(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Weights (the bias last) of the squared hinge loss by dual coordinate descent; classes weigh alike."""
    weights, dual = np.zeros((1 << BITS) + 1), np.zeros(len(rows))
    signs, slack = labels * 2.0 - 1.0, 0.5 / (COST * balance(labels))
    norms = np.array([v @ v + 1.0 for v in values]) + slack
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            gap = 1.0 - signs[i] * (weights[rows[i]] @ values[i] + weights[-1]) - dual[i] * slack[i]
            step = max(dual[i] + gap / norms[i], 0.0) - dual[i]
            if step:
                dual[i] += step
                weights[rows[i]] += step * signs[i] * values[i]
                weights[-1] += step * signs[i]
    return weights


def balance(labels: np.ndarray) -> np.ndarray:
    """A weight for each row by which both classes weigh alike, 1 on average."""
    many = np.bincount(labels, minlength=2)
    return len(labels) / (2.0 * many[labels])


def scaled(slots: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    values = ratios[slots]
    size = np.sqrt(values @ values)
    return values / size if size > 0 else values


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the score curve, by Newton steps on ridged log loss; classes weigh alike."""
    a, b, share = 2.0, 0.0, balance(labels)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        w, miss = share * p * (1 - p), share * (p - labels)
        grad = np.array([miss @ margins + 0.1 * (a - 2.0), miss.sum() + 0.1 * b])
        cross = (w * margins).sum()
        hess = np.array([[(w * margins) @ margins + 0.1, cross], [cross, w.sum() + 0.1]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    return max(float(a), 1e-3), float(b)


def weights_of(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ratios), the weights mixed with their mean size."""
    ratios = log_ratios(rows, labels)
    weights = descend(rows, [scaled(r, ratios) for r in rows], labels)
    body = weights[:-1]
    used = body != 0
    if used.any():
        weights[:-1] = np.where(used, MIX * body + (1 - MIX) * np.abs(body[used]).mean() * np.sign(body), 0.0)
    return weights, ratios


def margin_of(weights: np.ndarray, ratios: np.ndarray, slots: np.ndarray) -> float:
    return float(weights[slots] @ scaled(slots, ratios) + weights[-1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> dict:
    """The model of a labelled sample; without both classes one that scores 0.5.

    The score curve is fitted on margins of rows that their own model has not seen (FOLDS models).
    """
    if len(set(labels.tolist())) < 2:
        return {"weights": np.zeros((1 << BITS) + 1), "ratios": np.zeros(1 << BITS), "curve": (1.0, 0.0)}
    weights, ratios = weights_of(rows, labels)
    margins = np.array([margin_of(weights, ratios, r) for r in rows])
    fold = np.zeros(len(rows), int)
    for label in (0, 1):  # each fold has its share of both classes
        fold[labels == label] = np.arange((labels == label).sum()) % FOLDS
    if np.bincount(labels).min() >= 2 * FOLDS:
        for n in range(FOLDS):
            own = np.flatnonzero(fold != n)
            part = weights_of([rows[i] for i in own], labels[own])
            for i in np.flatnonzero(fold == n):
                margins[i] = margin_of(*part, rows[i])
    return {"weights": weights, "ratios": ratios, "curve": logistic(margins, labels)}


def score_one(model: dict, slots: np.ndarray) -> float:
    a, b = model["curve"]
    margin = margin_of(model["weights"], model["ratios"], slots)
    return float(1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30))))


def sample_ids(labels: DataFrame, label_col: str, id_col: str, usable: Column, per_class: int) -> DataFrame:
    """(id, label) of at most ``per_class`` distinct ids a class, those of least hash."""
    sound = labels.where(F.col(id_col).isNotNull() & usable)
    parts = [sound.where(F.col(label_col) == n).select(F.col(id_col).alias("sample_id"), F.lit(n).alias("label")).distinct()
             .orderBy(F.xxhash64("sample_id"), "sample_id").limit(per_class) for n in (0, 1)]
    return parts[0].unionByName(parts[1])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", usable: Column | None = None, per_class: int = PER_CLASS) -> dict:
    """Model of the labelled rows for which ``usable`` holds (a condition on the labels' columns)."""
    spark = docs.sparkSession
    ids = sample_ids(labels, label_col, id_col, F.lit(True) if usable is None else usable, per_class)
    slots = per_value(spark, lambda: _packed(slot_maker()), "binary", pa.binary())
    texts = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("sample_text"))
    found = (texts.join(ids, "sample_id").select("sample_id", "label", slots("sample_text").alias("slots"))
             .orderBy(F.xxhash64("sample_id"), "sample_id", "label", "slots").limit(4 * per_class).collect())
    return fit_rows([np.frombuffer(r.slots, np.int32) for r in found], np.array([r.label for r in found], int))


def _packed(slots):
    return lambda text: slots(text).tobytes()


def scorer(spark: SparkSession, model: dict):
    """Column function from a text to its score."""
    shared = spark.sparkContext.broadcast(model)

    def make():
        slots = slot_maker()
        return lambda text: score_one(shared.value, slots(text))

    return per_value(spark, make, "double", pa.float64())


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double) for every row of ``docs``."""
    return docs.select(F.col(id_col), scorer(docs.sparkSession, model)(F.col(text_col)).alias("score"))
