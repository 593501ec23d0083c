"""Operator 2: toxic spans by a linear-chain conditional random field; marginals aggregate to document scores."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import bounded_sample, per_text, stage, with_null_safe_text

#: A token is a run of word characters; a run of sentence marks or line ends closes a chain.
TOKEN = re.compile(r"\w+|[.!?\n]+")
#: Numbers that a matrix of chains may hold.
CELLS = 2_000_000


def lowered(text: str) -> str:
    """Lower case of the same length: a few capitals whose lower case is longer stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


@dataclass
class CrfModel:
    """Two labels. Each token's score for toxic against other is a common offset and its own, its left and its right neighbour's weights."""

    vocabulary: dict[str, int]  # from 1; 0 is any other token, and a chain's edge
    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    trans: np.ndarray  # [from, to]
    offset: np.ndarray  # of one element
    calibration: tuple[float, float] = (1.0, 0.0)

    def emissions(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        before, after = np.r_[0, ids[:-1]], np.r_[ids[1:], 0]
        before[starts] = 0
        after[np.r_[starts[1:] - 1, len(ids) - 1]] = 0
        return self.offset + self.own[ids] + self.left[before] + self.right[after]


def _step(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Log-odds message along one transition whose scores are a[from, to]."""
    return np.logaddexp(a[0, 1], a[1, 1] + x) - np.logaddexp(a[0, 0], a[1, 0] + x)


def _padded(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chains of like length together, CELLS tokens at most unless one chain has more: positions as a matrix with a column a chain, and which of them are real."""
    order = np.argsort(-sizes, kind="stable")
    i = 0
    while i < len(order):
        rows = order[i : i + max(1, CELLS // int(sizes[order[i]]))]
        rows = rows[2 * sizes[rows] > sizes[rows[0]]]  # little padding: the rest are much shorter
        i += len(rows)
        rows = rows[::-1]
        step = np.arange(sizes[rows[-1]])[:, None]
        real = step < sizes[rows]
        yield np.where(real, starts[rows] + step, 0), real


def messages(e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log-odds, with a token's own score, and backward ones, without it; all chains of about the same length move together."""
    f_all, b_all = np.zeros(len(e)), np.zeros(len(e))
    for at, real in _padded(starts, sizes):
        x = e[at]
        f, b = x.copy(), np.zeros_like(x)
        for t in range(1, len(x)):
            f[t] += _step(f[t - 1], trans)
        for t in range(len(x) - 2, -1, -1):
            b[t] = np.where(real[t + 1], _step(x[t + 1] + b[t + 1], trans.T), 0.0)
        f_all[at[real]], b_all[at[real]] = f[real], b[real]
    return f_all, b_all


def forward_backward(e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Each token's marginal log-odds of being toxic."""
    f, b = messages(e, starts, sizes, trans)
    return f + b


def tokenise(texts: list[str], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token ids of all texts one after another, the chains' starts and sizes, and each token's text."""
    get = vocabulary.get
    ids, owner = [], []
    for text in texts:
        got = [-1 if w[0] in ".!?\n" else get(w, 0) for w in TOKEN.findall(lowered(text))]
        ids.append(np.array([*got, -1], np.int64))
        owner.append(len(got) + 1)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    whose = np.repeat(np.arange(len(texts)), owner)
    real = flat >= 0
    first = np.r_[True, ~real[:-1]] if len(flat) else np.zeros(0, bool)
    run = np.cumsum(first)[real]
    flat, whose = flat[real], whose[real]
    if not len(flat):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    return flat, starts, np.diff(np.r_[starts, len(flat)]), whose


def fit_crf(chains: Counter[tuple[str, ...]], words: set[str], *, steps: int = 80, rate: float = 0.4, decay: float = 0.15) -> CrfModel:
    """Maximum likelihood by Adam, over chains of tokens and how often each occurs; a token's label is whether it is among `words`. decay: weight decay against the sum over all chains, so a word's weight doesn't shrink as more chains come in."""
    counts: Counter[str] = Counter()
    for chain, n in chains.items():
        for w in chain:
            counts[w] += n
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in counts.items() if n >= 2), 1)}
    size = len(vocabulary) + 1
    flat = [w for chain in chains for w in chain]
    ids = np.array([vocabulary.get(w, 0) for w in flat], np.int64)
    y = np.array([w in words for w in flat], float)
    sizes = np.array([len(chain) for chain in chains], np.int64)
    often = np.repeat(np.array(list(chains.values()), float), sizes)
    total = sum(chains.values())
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    model = CrfModel(vocabulary, np.zeros(size), np.zeros(size), np.zeros(size), np.zeros((2, 2)), np.full(1, -6.0))
    before, after = np.r_[0, ids[:-1]], np.r_[ids[1:], 0]
    before[starts] = 0
    after[starts + sizes - 1] = 0
    inner = np.ones(len(ids), bool)
    inner[starts] = False
    now = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[now - 1].astype(int), y[now].astype(int)), often[now])
    parts = (model.own, model.left, model.right, model.trans, model.offset)
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in parts]
    for t in range(1, steps + 1):
        e = model.offset + model.own[ids] + model.left[before] + model.right[after]
        f, b = messages(e, starts, sizes, model.trans)
        p = 1 / (1 + np.exp(-np.clip(f + b, -40, 40)))
        # joint marginals of neighbours, from what reaches them on either side and the transition between them
        lo, hi = f[now - 1], e[now] + b[now]
        joint = np.stack([model.trans[i, j] + i * lo + j * hi for i in (0, 1) for j in (0, 1)])
        joint = np.exp(joint - joint.max(0))
        joint = (joint / joint.sum(0) @ often[now]).reshape(2, 2)
        residual = (p - y) * often / total
        grads = [np.bincount(i, residual, minlength=size) for i in (ids, before, after)] + [(joint - seen) / total, residual.sum(keepdims=True)]
        for w, g, (m, v) in zip(parts, grads, state, strict=True):
            g = g + decay / total * w * (w is not model.offset)
            m[:], v[:] = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    return model


def label_tokens(texts: DataFrame, labels: DataFrame, *, least: int = 6, z_bar: float = 4.0) -> list[str]:
    """Words that mark toxic texts: found after at least `least` different words in them, and much less in the others (two-proportion z over z_bar, share ten times as high).

    Text labels become token labels by these words. A word counts once for each word before it, so the words of a toxic text
    that was copied often don't count as often. Such words are few among those of a bounded sample of texts; all come back.
    """
    words = F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")
    pairs = F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words)), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b)))  # of strings, so that they are hashed
    seen = texts.join(labels, "doc_id").select("toxic", F.explode(pairs).alias("pair")).distinct().withColumn("word", F.substring_index("pair", " ", -1)).filter("word <> ''")
    size = labels.join(texts.select("doc_id"), "doc_id", "left_semi").agg(F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") != 1).alias("n0"))
    n1, n0 = size.first()
    if not n1 or not n0:
        return []
    df = seen.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("k1"), F.count_if(F.col("toxic") != 1).alias("k0"))
    p1, p0, p = F.col("k1") / n1, F.col("k0") / n0, (F.col("k1") + F.col("k0")) / (n1 + n0)
    z = (p1 - p0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    found = df.filter((F.col("k1") >= least) & (p1 >= 10 * p0)).withColumn("z", z).filter(F.col("z") >= z_bar)
    return [r[0] for r in found.orderBy("word").select("word").collect()]


def _chains(texts: list[str]) -> Counter[tuple[str, ...]]:
    """All different chains of the texts, and how often each occurs."""
    out: Counter[tuple[str, ...]] = Counter()
    for text in texts:
        chain: list[str] = []
        for w in [*TOKEN.findall(lowered(text)), "."]:
            if w[0] not in ".!?\n":
                chain.append(w)
            elif chain:
                out[tuple(chain)] += 1
                chain = []
    return out


def _doc_logit(model: CrfModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's evidence, then all tokens' marginal log-odds and texts.

    Evidence is half the logarithm of the sum of the tokens' squared odds: many tokens that are hardly suspect weigh little, so
    a text isn't suspect for its length.
    """
    ids, starts, sizes, whose = tokenise(texts, model.vocabulary)
    if not len(ids):
        return np.full(len(texts), -12.0), np.zeros(0), whose
    logit = forward_backward(model.emissions(ids, starts), starts, sizes, model.trans)
    total = np.bincount(whose, np.exp(2 * np.clip(logit, -30, 30)), minlength=len(texts))
    return np.clip(np.log(total + 1e-12) / 2, -12, 12), logit, whose


def _slices(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters together (one text at least), so that a batch's arrays stay small."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def train_toxicity(docs: DataFrame, labels: DataFrame, *, per_class: int = 3_000, fitted: int = 800, **fit) -> CrfModel | None:
    """Train on labelled texts of labels (doc_id, toxic): words are marked by at most per_class texts of each class, counted in Spark; the field and its calibration are fitted on all of at most `fitted` of them a class.

    None if no word tells the classes apart (or a class is missing).
    """
    few = stage(bounded_sample(labels.filter("toxic = 1"), "doc_id", per_class).unionByName(bounded_sample(labels.filter("toxic = 0"), "doc_id", per_class)), "toxic-labels")
    texts = stage(with_null_safe_text(docs).join(F.broadcast(few.select("doc_id")), "doc_id", "left_semi"), "toxic-texts")
    words = set(label_tokens(texts, few))
    if not words:
        return None
    own = [bounded_sample(few.filter(F.col("toxic") == y), "doc_id", fitted) for y in (1, 0)]
    rows = texts.join(F.broadcast(own[0].unionByName(own[1])), "doc_id").orderBy("doc_id", "text").select("text", "toxic").collect()
    texts_of = [r["text"] for r in rows]
    model = fit_crf(_chains(texts_of), words, **fit)
    x = np.concatenate([_doc_logit(model, texts_of[i:j])[0] for i, j in _slices(texts_of)])
    y = np.array([r["toxic"] for r in rows], float)
    often = {r["toxic"]: r["count"] for r in labels.filter("toxic in (0, 1)").groupBy("toxic").count().collect()}
    share = np.where(y == 1, often[1] / max(1, y.sum()), often[0] / max(1, (1 - y).sum()))
    model.calibration = _platt(x, y, share / share.mean())
    return model


def _platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope (not negative) and offset of a weighted logistic fit with a ridge on the slope, by Newton steps that are halved until the loss falls. The weights give each class its share among all labels."""

    def loss(v: np.ndarray) -> float:
        s = v[0] * x + v[1]
        return float(weight @ (np.logaddexp(0, s) - y * s) + ridge / 2 * v[0] ** 2)

    v = np.array([0.5, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(v[0] * x + v[1], -40, 40)))
        w = weight * p * (1 - p) + 1e-9
        g = np.array([(weight * x * (p - y)).sum() + ridge * v[0], (weight * (p - y)).sum()])
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        d, step = np.linalg.solve(h, g), 1.0
        while step > 1e-4 and loss(v - step * d) > loss(v):
            step /= 2
        v = v - step * d
        if np.abs(step * d).max() < 1e-8:
            break
    return max(float(v[0]), 0.0), float(v[1])


def spans_of(text: str, flags: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans of the flagged tokens of a text; neighbours with only blanks between them form one span."""
    spans: list[tuple[int, int]] = []
    found = (m.span() for m in TOKEN.finditer(lowered(text)) if m[0][0] not in ".!?\n")
    for (a, b), hit in zip(found, flags.tolist(), strict=True):
        if hit:
            if spans and not text[spans[-1][1] : a].strip():
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
    return spans


def toxicity_scores(docs: DataFrame, model: CrfModel | None, *, token_bar: float = 0.5) -> DataFrame:
    """(doc_id, score, n_spans, spans) for each row of docs (doc_id, text), over whole texts.

    score: calibrated probability that the text is toxic; spans: start:end of toxic tokens, comma-joined, code points, end
    exclusive. A null or empty text has no spans and the score of a text without toxic tokens; without a model every score
    is 0. Ids keep their values, nulls too. Repeated rows get equal results; an empty table gives an empty one.
    """

    def tag(whole: list[str]) -> Iterator[tuple[np.ndarray, dict]]:
        for i, j in _slices(whole):
            texts = whole[i:j]
            if model is None:
                yield np.arange(i, j), {"score": np.zeros(j - i), "n_spans": np.zeros(j - i, np.int64), "spans": [""] * (j - i)}
                continue
            evidence, logit, whose = _doc_logit(model, texts)
            a, b = model.calibration
            ends = np.searchsorted(whose, np.arange(len(texts) + 1))
            bar = np.log(token_bar / (1 - token_bar))
            spans: list[list[tuple[int, int]]] = [[] for _ in texts]
            for k in np.unique(whose[logit > bar]).tolist():
                spans[k] = spans_of(texts[k], logit[ends[k] : ends[k + 1]] > bar)
            score = 1 / (1 + np.exp(-np.clip(a * evidence + b, -40, 40)))
            yield np.arange(i, j), {"score": score, "n_spans": np.array([len(s) for s in spans], np.int64), "spans": [",".join(f"{x}:{y}" for x, y in s) for s in spans]}

    return per_text(with_null_safe_text(docs), "score double, n_spans long, spans string", tag)


def trainable_labels(labels: DataFrame, condition: Column) -> DataFrame:
    """Rows (doc_id, toxic) of labels that hold a label and satisfy the condition; one for each doc_id."""
    return labels.filter(condition & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
