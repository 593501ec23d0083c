"""Operator 1: quality classifier by positive-unlabelled learning (non-negative unbiased risk)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import bounded_sample, per_text, stage, with_null_safe_text

N_FEATURES = 22


def _char_classes() -> np.ndarray:
    """A class for each UTF-16 unit: 0 other, 1 lower case, 2 upper case, 3 digit, 4 blank, 5 line end, 6 .,;:?, 7 !, 8 |, 9 symbol, 10 bracket or quote."""
    table = np.zeros(65536, np.uint8)
    for i in [*range(0xD800), *range(0xE000, 65536)]:
        c = chr(i)
        table[i] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c.isspace() else 1 if c.isalpha() else 0
    for chars, kind in (("\n\r", 5), (".,;:?", 6), ("!", 7), ("|", 8), ("*#$%&@^~_+=<>\\/-", 9), ("()[]{}\"'`", 10)):
        for c in chars:
            table[ord(c)] = kind
    return table


_TABLE: list[np.ndarray] = []


def text_features(text: str) -> list[float]:
    """Shape of a whole text: shares of character classes, word and line repetition, lengths. An empty text gives zeros but for its flag."""
    if not _TABLE:
        _TABLE.append(_char_classes())
    out = [0.0] * N_FEATURES
    words = text.split()
    if not words:
        out[-1] = 1.0
        return out
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    share = np.bincount(_TABLE[0][units], minlength=11) / len(units)
    out[:11] = share.tolist()
    n = len(words)
    distinct = len(set(words))
    out[11] = distinct / n
    out[12] = np.log(distinct) / np.log(n + 1)
    out[13] = sum(map(str.__eq__, words, words[1:])) / n
    out[14] = min(len(text) / n, 40.0) / 10
    out[15] = np.log1p(n) / 10
    lines = text.split("\n")
    out[16] = 1 - len(set(lines)) / len(lines)
    out[17] = np.log1p(n / len(lines)) / 5
    out[18] = share[2] / (share[1] + share[2] + 1e-9)
    out[19] = sum(map(str.isupper, words)) / n
    out[20] = len(set(zip(words, words[1:], words[2:], strict=False))) / max(n - 2, 1) if n > 2 else 1.0
    return out


def with_features(frame: DataFrame, text: str, name: str) -> DataFrame:
    """frame without its text column (whose nulls count as empty), and the features of each whole text beside its other columns."""

    def shape(texts: list[str]) -> Iterator[tuple[None, dict]]:
        yield None, {name: [text_features(t or "") for t in texts]}

    return per_text(frame, f"{name} array<double>", shape, text)


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of every whole text, written to the shared folder: the texts are read once."""
    return stage(with_features(with_null_safe_text(docs), "text", "features"), "quality")


#: Deviations count as at least so much: a share of characters, any other feature. What hardly varies in training says little when it is a little off.
LEAST_SCALE = np.r_[np.full(11, 0.02), np.full(N_FEATURES - 11, 0.05)]
REACH = 4.0


@dataclass
class PuModel:
    """Standardised features, kept within REACH deviations, random tanh units, and a linear layer; prior is the estimated share of positives."""

    mean: np.ndarray
    scale: np.ndarray
    units: np.ndarray
    weights: np.ndarray
    prior: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -REACH, REACH)
        return np.hstack([np.ones((len(z), 1)), z, np.tanh(z @ self.units[1:] + self.units[0])])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.weights, -30, 30)))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, N_FEATURES)


def total(features: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of features of part(their matrix), a vector of `size` numbers: each task adds up its rows, then Spark adds up the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            x = matrix(batch.column(0))
            for i in range(0, len(x), 4096):
                out += part(x[i : i + 4096])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(out)], names=["place", "value"])

    got = features.select("features").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").toPandas()
    return got["value"].to_numpy() if len(got) else np.zeros(size)


def risks(s_p: np.ndarray, u_negative: float, prior: float) -> tuple[float, float]:
    """Of positives' scores and the unlabelled's mean loss as negatives: the positives' risk as positives, and the risk of negatives, which is that of the unlabelled less the positives' share."""
    return prior * float(np.logaddexp(0, -s_p).mean()), u_negative - prior * float(np.logaddexp(0, s_p).mean())


def curvature(phi: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows' sums of: 1, the loss as negatives, its gradient, and its second derivatives (as one vector)."""
    s = phi @ w
    p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
    return np.r_[len(phi), np.logaddexp(0, s).sum(), p @ phi, (phi.T @ (phi * (p * (1 - p))[:, None])).ravel()]


def minimise(phi_p: np.ndarray, unlabelled: Callable[[np.ndarray], np.ndarray], prior: float | None, *, steps: int, decay: float) -> np.ndarray:
    """Newton steps on the non-negative risk prior*R_p(+) + max(0, R_u(-) - prior*R_p(-)), logistic loss with weight decay.

    unlabelled: gives for weights the sums of `curvature` over all unlabelled rows. A step is halved until the risk falls and the
    part of the negatives isn't negative, so weights that only fit the sample's noise are never taken. With the logistic loss
    R_p(+) - R_p(-) is linear, so the second derivatives are those of R_u(-). Without a prior: positives against unlabelled
    rows, each class weighing the same.
    """
    size = phi_p.shape[1]
    ridge = np.full(size, decay)
    ridge[0] = decay * 1e-3

    def measure(w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        sums = unlabelled(w)
        n, loss, grad, hess = sums[0], sums[1] / sums[0], sums[2 : 2 + size] / sums[0], sums[2 + size :].reshape(size, size) / sums[0]
        s_p = phi_p @ w
        p = 1 / (1 + np.exp(-np.clip(s_p, -30, 30)))
        if prior is None:
            return float(np.logaddexp(0, -s_p).mean()) + loss + ridge @ (w * w) / 2, 0.0, (p - 1) @ phi_p / len(p) + grad + ridge * w, (phi_p.T @ (phi_p * (p * (1 - p))[:, None])) / len(p) + hess
        plus, rest = risks(s_p, loss, prior)
        return plus + max(rest, 0.0) + ridge @ (w * w) / 2, rest, grad - prior * phi_p.mean(0) + ridge * w, hess

    w = np.zeros(size)
    now = measure(w)
    for _ in range(steps):
        step = np.linalg.solve(now[3] + np.diag(ridge + 1e-9), now[2])
        for share in (1.0, 0.5, 0.25, 0.125, 0.0625):
            new = measure(w - share * step)
            if new[0] < now[0] and new[1] >= 0:
                break
        else:
            return w
        w, gain, now = w - share * step, now[0] - new[0], new
        if gain < 1e-6:
            break
    return w


def estimate_prior(score_p: np.ndarray, above_u: Callable[[np.ndarray], np.ndarray], n_u: int, confidence: float = 0.1) -> float:
    """Least ratio, over thresholds, of the unlabelled share above (by above_u) to the positive share above, with a bound for its sampling error."""
    cuts = np.quantile(score_p, np.linspace(0, 0.9, 181))
    above_p = 1 - np.searchsorted(np.sort(score_p), cuts, side="left") / len(score_p)
    above = above_u(cuts)
    slack = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(score_p)) + 1 / np.sqrt(n_u))
    best = np.argmin((above + slack) / np.maximum(above_p, 1e-9))
    return float(np.clip(above[best] / max(above_p[best], 1e-9), 0.01, 0.99))


def train_quality(features: DataFrame, positives: DataFrame, *, max_positive: int = 12_000, hidden: int = 64, steps: int = 12, decay: float = 1e-3, seed: int = 7) -> PuModel:
    """Train on at most max_positive trusted positives (a table of doc_id), and on all rows of `features` as the unlabelled side.

    A separator of positives from unlabelled texts gives the prior, then the non-negative risk is minimised with it. Each step is
    a pass over the features. Where there are no positives a model comes back that scores everything 0.5.
    """
    ids = positives.select("doc_id").distinct()
    few = bounded_sample(features.join(ids, "doc_id", "left_semi"), "doc_id", max_positive).select("features").collect()
    p = np.array([r[0] for r in few], float).reshape(-1, N_FEATURES)
    if not len(p):
        return PuModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros((N_FEATURES + 1, 1)), np.zeros(N_FEATURES + 2), 0.5)
    n, *sums = total(features, lambda x: np.r_[len(x), x.sum(0), (x * x).sum(0)], 1 + 2 * N_FEATURES)
    mean, square = np.array(sums[:N_FEATURES]) / n, np.array(sums[N_FEATURES:]) / n
    rng = np.random.default_rng(seed)
    model = PuModel(mean, np.maximum(np.sqrt(np.maximum(square - mean**2, 0)), LEAST_SCALE), rng.normal(0, 1, (N_FEATURES + 1, hidden)) / np.sqrt(N_FEATURES), np.zeros(0), 0.5)
    phi = model.expand(p)
    size = phi.shape[1]
    all_rows = lambda w: total(features, lambda x: curvature(model.expand(x), w), 2 + size + size * size)
    apart = minimise(phi, all_rows, None, steps=steps, decay=1e-3)
    model.prior = estimate_prior(phi @ apart, lambda cuts: total(features, lambda x: (model.expand(x) @ apart >= cuts[:, None]).sum(1).astype(float), len(cuts)) / n, int(n))
    model.weights = minimise(phi, all_rows, model.prior, steps=steps, decay=decay)
    return model


def with_scores(frame: DataFrame, model: PuModel, features: str, name: str) -> DataFrame:
    """frame with the model's score in place of the features."""
    others = [c for c in frame.columns if c != features]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(model.score(matrix(batch.column(features))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), score], names=[*others, name])

    return frame.mapInArrow(apply, T.StructType([*frame.select(*others).schema, T.StructField(name, T.DoubleType())]))


def quality_scores(docs: DataFrame, positives: DataFrame, trainable: Column | None = None, **fit) -> DataFrame:
    """Score every whole text of docs (doc_id, text) for quality: (doc_id, score in 0..1), one row for each row of docs.

    positives: (doc_id) of trusted texts. trainable: a condition on doc_id for the rows that training may look at.
    Null texts count as empty; empty texts are scored by their flag feature. Rows with a null id are scored like others, and ids
    keep their values. Repeated rows get equal scores. An empty table gives an empty result, and no positives the score 0.5
    throughout.
    """
    features = feature_table(docs)
    model = train_quality(features.filter(trainable) if trainable is not None else features, positives, **fit)
    return with_scores(features, model, "features", "score")


def keep_good(docs: DataFrame, positives: DataFrame, bar: float, trainable: Column | None = None, **fit) -> DataFrame:
    """The rows of docs (doc_id, text, ...) whose text scores `bar` at least, with all their columns; each row is judged by its own text."""
    held = stage(with_features(docs.withColumn("__text", F.col("text")), "__text", "__features"), "quality-rows")
    features = held.select("doc_id", F.col("__features").alias("features"))
    model = train_quality(features.filter(trainable) if trainable is not None else features, positives, **fit)
    return with_scores(held, model, "__features", "__score").filter(F.col("__score") >= bar).drop("__score")
