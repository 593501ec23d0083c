"""Operator 8: language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import bounded_sample, per_text, with_null_safe_text

UNDETERMINED = "und"
_KINDS: list[np.ndarray] = []


def _lower_letters() -> np.ndarray:
    """For each code point of the basic plane its lower-case form if it is a letter, else a blank."""
    if not _KINDS:
        table = np.full(65536, 32, np.uint32)
        for i in range(65536):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _KINDS.append(table)
    return _KINDS[0]


def lower_letters(text: str) -> np.ndarray:
    """A text's code points, letters in lower case, anything else as blanks."""
    points = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    if not ((points >= 0xD800) & (points < 0xE000)).any():
        return _lower_letters()[points]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _lower_letters()[np.minimum(points, 0xFFFF)]
    for p in np.unique(points[points > 0xFFFF]).tolist():
        low = chr(p).lower()
        out[points == p] = (ord(low) if len(low) == 1 else p) if chr(p).isalpha() else 32
    return out


def ngram_buckets(text: str, bits: int) -> np.ndarray:
    """Buckets of all character 1-, 2- and 3-grams of a whole text, lower case, runs of other characters as one blank; empty without letters."""
    units = lower_letters(text)
    blank = units == 32
    if blank.all():
        return np.zeros(0, np.int64)
    units = np.r_[np.uint32(32), units[~(blank & np.r_[False, blank[:-1]])], np.uint32(32)]
    h1 = units * np.uint32(2654435761)
    h2 = (h1[:-1] ^ (h1[:-1] >> np.uint32(13))) * np.uint32(2246822519) + units[1:] * np.uint32(3266489917)
    h3 = (h2[:-1] ^ (h2[:-1] >> np.uint32(11))) * np.uint32(668265263) + units[2:] * np.uint32(374761393)
    grams = np.concatenate([h1[1:-1], h2, h3])
    return ((grams ^ (grams >> np.uint32(15))) * np.uint32(2146121005) >> np.uint32(32 - bits)).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages, sparse by training
    bias: np.ndarray
    temperature: float = 1.0
    bits: int = 15
    live: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def logits(self, text: str) -> np.ndarray | None:
        buckets, values = tfidf(text, self.idf, self.bits)
        return None if not len(buckets) else values @ self.weights[buckets] + self.bias


def tfidf(text: str, idf: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets and values: (1 + ln count) * idf, scaled to length 1."""
    grams = ngram_buckets(text, bits)
    if not len(grams):
        return grams, np.zeros(0)
    if len(grams) > 4096:
        counts = np.bincount(grams, minlength=1 << bits)
        buckets = np.flatnonzero(counts)
        counts = counts[buckets]
    else:
        buckets, counts = np.unique(grams, return_counts=True)
    values = (1 + np.log(counts)) * idf[buckets]
    return buckets, values / (np.sqrt(values @ values) + 1e-12)


def document_frequencies(docs: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """How many of all texts of docs (doc_id, text) hold each bucket, and how many texts have letters; a count per bucket is all that leaves the executors."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros((1 << bits) + 1, np.int64)
        flag = np.zeros(1 << bits, bool)
        for pdf in batches:
            for text in pdf["text"]:
                grams = ngram_buckets(text, bits)
                if len(grams):
                    flag[:] = False
                    flag[grams] = True
                    df[:-1] += flag
                    df[-1] += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": at, "n": df[at]})

    rows = with_null_safe_text(docs).select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((1 << bits) + 1, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out[:-1], int(out[-1])


def fit_ftrl(samples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, size: int, *, alpha: float = 0.8, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, epochs: int = 3, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with an elastic net: weights are recomputed from the accumulated gradients where a row touches them, and are zero below l1."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))
    rng = np.random.default_rng(seed)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            at, x = samples[i]
            at, x = np.r_[at, size], np.r_[x, 1.0]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    w = weights(z, n)
    return w[:size], w[size]


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood on held-back rows, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    a, b, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(50):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train_language(docs: DataFrame, trainable: Column, *, rows: int = 4_000, bits: int = 15, held_back: float = 0.2, **fit) -> LanguageModel:
    """Train on the rows of docs (doc_id, text, lang) that satisfy `trainable`: idf over all of them, weights and temperature on at most `rows`.

    Rows without a language or without letters teach nothing; with no language at all the model knows none.
    """
    able = docs.filter(trainable & F.col("lang").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    df, n = document_frequencies(able, bits)
    idf = np.log((1 + n) / (1 + df)) + 1
    few = bounded_sample(able.select("doc_id", "lang"), "doc_id", rows).select("doc_id").distinct()
    got = sorted(able.join(F.broadcast(few), "doc_id", "left_semi").collect())
    got = [(r["lang"], x) for r in got if len((x := tfidf(r["text"], idf, bits))[0])]
    languages = sorted({lang for lang, _ in got})
    if not languages:
        return LanguageModel([], idf, np.zeros((1 << bits, 0)), np.zeros(0), bits=bits)
    y = np.array([languages.index(lang) for lang, _ in got])
    mix = np.random.default_rng(3).permutation(len(got))
    back = mix[: int(len(got) * held_back)]
    front = mix[len(back) :]
    weights, bias = fit_ftrl([got[i][1] for i in front], y[front], len(languages), 1 << bits, **fit)
    logits = np.array([got[i][1][1] @ weights[got[i][1][0]] + bias for i in back]).reshape(-1, len(languages))
    return LanguageModel(languages, idf, weights, bias, calibrate(logits, y[back]), bits)


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs (doc_id, text), over whole texts.

    lang_pred: a language of the model, und with score 0 for texts that are null or without letters, and where the model knows
    no language; score: its calibrated probability. Ids keep their values, nulls too. Repeated rows get equal results; an empty table gives an empty one.
    """

    def predict(texts: list[str]) -> Iterator[tuple[None, dict]]:
        names, scores = [], []
        for text in texts:
            s = model.logits(text) if model.languages else None
            if s is None:
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            p = np.exp((s - s.max()) / model.temperature)
            p /= p.sum()
            k = int(p.argmax())
            names.append(model.languages[k])
            scores.append(float(p[k]))
        yield None, {"lang_pred": names, "score": scores}

    return per_text(with_null_safe_text(docs), "lang_pred string, score double", predict)
