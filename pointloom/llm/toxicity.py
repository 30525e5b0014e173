"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score, and a document is toxic if any of its
sentences is: its probability is the noisy-or 1 - prod(1 - p). Only documents carry labels; the weights are
trained through the noisy-or by stochastic gradient steps. The sentence scores then say where a toxic document
offends.

Features of a sentence are its words and the beginnings and ends of words (in bytes), hashed. The model is fitted on a
bounded sample of labelled rows (``max_rows``); every row is scored over its whole text.
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
MAX_ROWS = 6000
MAX_CHARS = 10_000
THRESHOLD = 0.5
FIRST_BIAS = -6.0
#: Bytes of a word's beginning and end that are features.
HEADS = (3, 4, 5, 6, 7, 8, 10)
TAILS = (4, 6)
#: Kinds of bytes: 1 in a word, 2 the end of a sentence, 0 others.
_KIND = np.zeros(256, np.uint8)
_KIND[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_", *range(128, 256)]] = 1
_KIND[list(b".!?\n")] = 2
_PRIME = np.uint64(0x100000001B3)
_POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64), dtype=np.uint64)


def _lower(text: str) -> str:
    lower = text.lower()
    if len(lower) != len(text):  # a few letters grow; they stay as they are, so that offsets hold
        lower = "".join(low if len(low := c.lower()) == 1 else c for c in text)
    return lower


def features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each sentence that holds a word: its byte span in the lowered text, and its features.

    Returns the spans, the columns (a fixed number for each word; column 0 where a word is too short for one) and
    where each sentence's columns start.
    """
    raw = np.frombuffer(_lower(text).encode("utf-8", "surrogatepass"), np.uint8)
    kind = _KIND[raw]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = kind == 1
    edge = np.diff(inside)
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return np.empty((0, 2), np.int64), np.empty(0, np.int32), np.empty(0, np.int64)
    size = after - first
    padded = np.zeros(len(raw) + 16, np.uint64)
    padded[: len(raw)] = raw
    flat = np.zeros((len(first), len(HEADS) + len(TAILS) + 1), np.uint64)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    terms = padded[np.repeat(first, size) + at] * _POWERS[at & 63]
    flat[:, 0] = np.add.reduceat(terms, np.cumsum(size) - size) * _PRIME + np.uint64(1)
    h, k = np.zeros(len(first), np.uint64), 0
    for n in range(max(HEADS)):
        h = (h ^ (padded[first + n] + np.uint64(1))) * _PRIME
        if n + 1 in HEADS:
            k += 1
            flat[:, k] = np.where(size >= n + 1, h ^ np.uint64(n + 2), 0)
    h = np.zeros(len(first), np.uint64)
    for n in range(max(TAILS)):
        h = (h ^ (padded[np.maximum(after - 1 - n, 0)] + np.uint64(3))) * _PRIME
        if n + 1 in TAILS:
            k += 1
            flat[:, k] = np.where(size >= n + 1, h ^ np.uint64(n + 102), 0)
    columns = ((flat * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int32)
    ends = np.flatnonzero(kind == 2)
    sentence = np.searchsorted(ends, first)
    new = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    bounds = np.r_[0, ends + 1, len(raw)]
    spans = np.stack([bounds[sentence[new]], bounds[sentence[new] + 1]], axis=1)
    return spans, columns.ravel(), new * columns.shape[1]


def char_span(text: str, span: np.ndarray) -> tuple[int, int]:
    """A byte span of the lowered text in code points."""
    raw = np.frombuffer(_lower(text).encode("utf-8", "surrogatepass"), np.uint8)
    leads = (raw & 0xC0) != 0x80
    start = int(leads[: span[0]].sum())
    return start, start + int(leads[span[0] : span[1]].sum())


class ToxicityModel:
    """Weights per column and the bias of a sentence."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), float(bias)

    def sentence_scores(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.empty(0)
        z = np.add.reduceat(self.weight[flat].astype(np.float64), starts) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, flat: np.ndarray, starts: np.ndarray) -> float:
        """The noisy-or of the sentences. A text without a sentence is no evidence: 0."""
        return float(-np.expm1(np.log1p(-np.minimum(self.sentence_scores(flat, starts), 1 - 1e-12)).sum()))


def fit_rows(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, rate: float = 0.05, least: int = 4, seed: int = 1) -> ToxicityModel:
    """Noisy-or likelihood by adaptive gradient steps, one document at a time, in random order.

    For a toxic document the gradient by a sentence's logit is p (1 - P) / P, for another -p, where p is the
    sentence's and P the document's probability. Weights start at a share of the log ratio of the columns'
    document frequencies in the two classes, where that is over 1.5; columns in fewer than ``least`` documents
    stay at zero.
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels)
    n1 = int(labels.sum())
    if n1 == 0 or not bags:
        return ToxicityModel(np.zeros(COLUMNS), FIRST_BIAS)
    df = np.zeros((2, COLUMNS))
    for (flat, _), label in zip(bags, labels):
        df[int(label)][np.unique(flat)] += 1
    ratio = np.log((df[1] + 0.5) / (n1 + 1)) - np.log((df[0] + 0.5) / (len(labels) - n1 + 1))
    live = df.sum(axis=0) >= least
    live[0] = False
    weight = np.where(live & (ratio > 1.5), 0.8 * ratio, 0.0)
    seen = np.full(COLUMNS, 1e-3)
    bias, bias_seen = FIRST_BIAS, 1.0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            flat, starts = bags[i]
            if not len(starts):
                continue
            z = np.add.reduceat(weight[flat], starts) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            if labels[i]:
                whole = max(-math.expm1(float(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), 1e-9)
                g = p * (1 - whole) / whole
            else:
                g = -p
            if np.abs(g).max() < 1e-3:
                continue
            each = np.repeat(g, np.diff(np.append(starts, len(flat))))
            used = live[flat]
            columns, where = np.unique(flat[used], return_inverse=True)
            step = np.bincount(where, each[used], len(columns))
            seen[columns] += step**2
            weight[columns] += rate * step / np.sqrt(seen[columns])
            g0 = float(g.sum())
            bias_seen += g0 * g0
            bias += rate * g0 / math.sqrt(bias_seen)
    return ToxicityModel(weight, bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold (texts of up to ``max_chars``)."""

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [features(t) for t in frame["_text"]]
            yield pd.DataFrame({"label": frame["_label"], "flat": [f.astype("<i4").tobytes() for _, f, _ in found], "starts": [s.astype("<i4").tobytes() for _, _, s in found]})

    sample = training_rows(docs, labels, label, max_rows, max_chars).mapInPandas(extract, "label int, flat binary, starts binary").toPandas()
    order = sorted(range(len(sample)), key=lambda i: (sample["label"][i], bytes(sample["flat"][i])))
    bags = [(np.frombuffer(sample["flat"][i], "<i4"), np.frombuffer(sample["starts"][i], "<i4").astype(np.int64)) for i in order]
    return fit_rows(bags, np.array([sample["label"][i] for i in order]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, and where the document offends most.

    worst_start and worst_end are the character span of the sentence of highest score (null without a sentence),
    n_offending counts the sentences of a score of at least one half. Null and empty texts have no sentence and score
    0; long texts are scored whole. Null ids are in the fold of the empty text, repeated rows have equal results, an
    empty table gives an empty result, and other columns of ``docs`` (``score`` or ``predicted`` too) are not read.
    Without any label of one kind every score is 0.
    """
    model = fit(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: one float per column

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for frame in frames:
            out = []
            for text in frame["text"]:
                spans, flat, starts = features(text)
                p = fitted.sentence_scores(flat, starts)
                at = char_span(text, spans[int(p.argmax())]) if len(p) else (None, None)
                out.append((fitted.score(flat, starts), *at, int((p >= 0.5).sum())))
            scored = pd.DataFrame(out, columns=["score", "worst_start", "worst_end", "n_offending"])
            scored[["worst_start", "worst_end"]] = scored[["worst_start", "worst_end"]].astype("Int64")
            yield pd.concat([frame[["id"]].reset_index(drop=True), scored], axis=1)

    rows = docs.select(F.struct(F.col("doc_id")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, worst_start long, worst_end long, n_offending long")
    return out.select("id.doc_id", "score", "worst_start", "worst_end", "n_offending").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_start", "worst_end", "n_offending"
    )
