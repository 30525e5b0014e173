"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by class log-count ratios.

Indicators (whether an n-gram occurs, not how often) are taken of byte trigrams, of n-grams of byte classes with
runs taken as one, and of a word followed by itself, hashed into a fixed number of columns. Each column is scaled by the log ratio of its smoothed
frequency in the two classes, the row is brought to unit length, and a support vector machine is fitted by dual
coordinate descent. Out-of-fold margins calibrate a sigmoid, so that a score is a probability.

The model is fitted on a bounded sample of labelled rows (``max_rows``); every row is scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import held_out, training_rows

COLUMNS = 1 << 18
MAX_ROWS = 4000
MAX_CHARS = 30_000
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    """Class of each byte: letters by case, digits, white space; other signs are their own class."""
    table = np.arange(256, dtype=np.uint32)
    table[ord("a") : ord("z") + 1] = ord("a")
    table[128:] = ord("a")
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[ord("0") : ord("9") + 1] = ord("0")
    table[[9, 11, 12, 13]] = ord(" ")
    return table


_CLASS = _classes()
_flags = np.zeros(COLUMNS, bool)
#: Lengths of the n-grams of byte classes, runs of one class taken as one.
SHAPE_GRAMS = (2, 4, 6)


def features(text: str) -> np.ndarray:
    """Sorted distinct columns of the n-grams that occur in the whole text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.int32)

    def mark(keys: np.ndarray, family: int) -> None:
        _flags[(keys + np.uint32(family)) * np.uint32(0x9E3779B1) >> np.uint32(14)] = True

    wide = raw.astype(np.uint32)
    mark((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:], 1 << 24)
    kind = _CLASS[raw]
    change = np.empty(len(kind), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    shape = kind[change]
    # the shape with runs as one, and whether a run is long, give what trigrams of bytes do not see
    length = np.diff(np.append(np.flatnonzero(change), len(kind)))
    mark(shape * np.uint32(32) + np.minimum(np.log2(length) * 2, 31).astype(np.uint32), 2 << 24)
    for n in SHAPE_GRAMS:
        if len(shape) >= n:
            h = np.zeros(len(shape) - n + 1, np.uint32)
            for k in range(n):
                h = (h ^ shape[k : len(shape) - n + 1 + k]) * np.uint32(0x01000193)
            mark(h, n << 25)
    words = text.split()
    repeats = sum(map(str.__eq__, words, words[1:]))
    if repeats:  # the bigram of a word and itself, by how often it occurs
        mark(np.arange(min(int(repeats).bit_length(), 12), dtype=np.uint32), 3 << 24)
    found = np.flatnonzero(_flags).astype(np.int32)
    _flags[found] = False
    return found


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, n_columns: int = COLUMNS, alpha: float = 1.0) -> np.ndarray:
    """log of the smoothed share of each column in class 1 over its share in class 0."""
    counts = [np.full(n_columns, alpha), np.full(n_columns, alpha)]
    for row, label in zip(rows, labels):
        counts[int(label)][row] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, n_columns: int, cost: float = 1.0, epochs: int = 30, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss support vector machine with labels 0 and 1.

    One dual variable at a time is set to its optimum between 0 and the cost, and the weights follow; an epoch
    goes through the rows in random order, until no projected gradient exceeds 1e-3.
    """
    rng = np.random.default_rng(seed)
    sign = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    weight, bias = np.zeros(n_columns), 0.0
    dual = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (weight[rows[i]] @ values[i] + bias) - 1.0
            moved = min(max(dual[i] - gradient / square[i], 0.0), cost)
            if moved != dual[i]:
                step = (moved - dual[i]) * sign[i]
                weight[rows[i]] += step * values[i]
                bias += step
                worst = max(worst, abs(moved - dual[i]) * square[i])
                dual[i] = moved
        if worst < 1e-3:
            break
    return weight, bias


def calibrate(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of the sigmoid of the margin, by Newton's method on smoothed targets."""
    n1 = float(labels.sum())
    n0 = len(labels) - n1
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, math.log((n1 + 1) / (n0 + 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        d, w = p - target, np.maximum(p * (1 - p), 1e-9)
        ga, gb = float(d @ margins) + 1e-6 * a, float(d.sum())
        haa, hab, hbb = float(w @ margins**2) + 1e-6, float(w @ margins), float(w.sum()) + 1e-6
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - max(-1.0, min(1.0, da)), b - max(-1.0, min(1.0, db))
        if abs(da) + abs(db) < 1e-8:
            break
    return a, b


class QualityModel:
    """Fitted weights (already scaled by the log-count ratios), bias and the sigmoid."""

    def __init__(self, weight: np.ndarray, ratios: np.ndarray, bias: float, slope: float, intercept: float):
        self.weight = (weight * ratios).astype(np.float32)
        self.square = (ratios**2).astype(np.float32)
        self.bias, self.slope, self.intercept = bias, slope, intercept

    def margin(self, row: np.ndarray) -> float:
        norm = math.sqrt(float(self.square[row].sum())) or 1.0
        return float(self.weight[row].sum()) / norm + self.bias

    def score(self, row: np.ndarray) -> float:
        z = max(-500.0, min(500.0, self.slope * self.margin(row) + self.intercept))
        return 1 / (1 + math.exp(-z))


def _svm(rows: list[np.ndarray], labels: np.ndarray, cost: float) -> QualityModel:
    ratios = log_count_ratios(rows, labels)
    values = [ratios[row] / (np.linalg.norm(ratios[row]) or 1.0) for row in rows]
    weight, bias = dual_coordinate_descent(rows, values, labels, COLUMNS, cost)
    return QualityModel(weight, ratios, bias, 1.0, 0.0)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, folds: int = 3) -> QualityModel:
    """The model of labelled rows. With fewer than two rows of a class, a constant: the smoothed share of class 1."""
    labels = np.asarray(labels, float)
    if min(labels.sum(), len(labels) - labels.sum()) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return QualityModel(np.zeros(COLUMNS), np.zeros(COLUMNS), 0.0, 1.0, math.log(share / (1 - share)))
    # folds are dealt within each class, so that each fold has both
    fold = np.empty(len(labels), int)
    for label in (0, 1):
        fold[labels == label] = np.arange(int((labels == label).sum())) % folds
    margins = np.empty(len(labels))
    for k in range(folds):
        inside = np.flatnonzero(fold != k)
        part = labels[inside]
        if min(part.sum(), len(part) - part.sum()) < 1:
            margins[fold == k] = 0.0
            continue
        model = _svm([rows[i] for i in inside], part, cost)
        margins[fold == k] = [model.margin(rows[i]) for i in np.flatnonzero(fold == k)]
    model = _svm(rows, labels, cost)
    model.slope, model.intercept = calibrate(margins, labels)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> QualityModel:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold (texts of up to ``max_chars``)."""

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"label": frame["_label"], "row": [features(t) for t in frame["_text"]]})

    sample = training_rows(docs, labels, label, max_rows, max_chars).mapInPandas(extract, "label int, row array<int>").toPandas()
    order = sorted(range(len(sample)), key=lambda i: (sample["label"][i], bytes(np.asarray(sample["row"][i], np.int32))))
    return fit_rows([np.asarray(sample["row"][i], np.int32) for i in order], np.array([sample["label"][i] for i in order], float))


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """score and predicted for every row, behind the columns ``keep`` (doc_id if None); a null text counts as empty."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: two floats per column

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        fitted = shared.value
        return pd.Series([fitted.score(features(t)) for t in texts], dtype="float64")

    # only the text goes to Python; a second select keeps the score from being computed twice
    out = docs.select(F.struct(*keep).alias("_row"), scored(F.coalesce("text", F.lit(""))).alias("_score"))
    return out.select("_row.*", F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model predicts to be of quality, with the columns of ``docs``.

    Null texts count as empty; repeated rows share their fate; columns may have any names.
    """
    out = score(docs.select(F.struct("*").alias("_doc"), "text"), model, threshold, ["_doc"])
    return out.where("predicted = 1").select("_doc.*")


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model fitted on the rest of the folds.

    Null texts count as empty, which have a score of their own; long texts are scored whole. Null ids are in the fold
    of the empty text, repeated rows have equal results, an empty table gives an empty result, and other columns of
    ``docs`` (``score`` or ``predicted`` too) are not read. Without labels every score is one half.
    """
    scored = score(docs, fit(docs, labels, **options))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
