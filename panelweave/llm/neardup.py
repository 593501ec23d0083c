"""Operator 5: near duplicates: Jaccard join on word shingles with Bayesian pruning of MinHash candidates and exact verification."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import connected_components, discard, per_text, stage, staged, with_null_safe_text
from panelweave.llm.urls import probed, without_listed

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class JoinParams:
    """words: shingle length. bands x rows: MinHash values. Two texts of similarity 0.8 share no band with probability (1 - 0.8**rows)**bands.

    tolerance: a pair goes when its posterior probability of reaching the threshold is below. small: buckets of up to so many
    texts are listed as pairs, larger ones are handled in blocks. block_rows, block_shingles: what a block may hold.
    """

    words: int = 5
    threshold: float = 0.8
    bands: int = 26
    rows: int = 5
    tolerance: float = 1e-6
    step: int = 13
    small: int = 8
    block_rows: int = 512
    block_shingles: int = 1_500_000

    @property
    def values(self) -> int:
        return self.bands * self.rows


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles: runs of `words` lower-case words; a shorter text is one shingle, a text without words none."""
    found = WORD.findall(text.lower())
    if not found:
        return np.zeros(0, np.uint64)
    h = pd.util.hash_array(np.array(found, dtype=object), categorize=False)
    n = max(1, len(h) - words + 1)
    out = np.full(n, len(h) if len(h) < words else words, np.uint64)
    for j in range(min(words, len(h))):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(27)))


def _multipliers(values: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 62, values, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 62, values, dtype=np.uint64)


def minhash(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each) of a set of hashes, a piece at a time so that memory stays small."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        part = s[i : i + 1024]
        np.minimum(best, (part[None, :] * a[:, None] + b[:, None]).min(1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def least_matches(params: JoinParams) -> list[tuple[int, int]]:
    """(values compared, least number of equal ones): with fewer, P(similarity >= threshold) under a uniform prior is below the tolerance."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    high = grid >= params.threshold
    out = []
    for n in range(params.step, params.values + 1, params.step):
        m = np.arange(n + 1)
        logp = m[:, None] * np.log(grid) + (n - m)[:, None] * np.log1p(-grid)
        p = np.exp(logp - logp.max(1, keepdims=True))
        tail = (p * high).sum(1) / p.sum(1)
        out.append((n, int(np.flatnonzero(tail >= params.tolerance)[0])))
    return out


def signatures(docs: DataFrame, params: JoinParams) -> DataFrame:
    """(doc_id, content, n, h1, h2, sig, keys): the text's hash, shingle count, a 128-bit digest of the shingle set, MinHash values and band keys. Texts without words have n = 0 and no keys."""

    def sign(texts: list[str]) -> Iterator[tuple[None, dict]]:
        a, b = _multipliers(params.values)
        mix = np.random.default_rng(77).integers(1, 1 << 62, params.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        tag = np.arange(params.bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        rows = []
        for text in texts:
            s = shingles(text, params.words)
            if not len(s):
                rows.append((0, 0, 0, b"", []))
                continue
            sig = minhash(s, a, b)
            t = (s ^ (s >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            key = sig.reshape(params.bands, params.rows).astype(np.uint64) @ mix + tag
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            rows.append((len(s), int(s.sum().astype(np.int64)), int((t ^ (t >> np.uint64(29))).sum().astype(np.int64)), sig.tobytes(), (key ^ (key >> np.uint64(32))).astype(np.int64)))
        yield None, dict(zip(("n", "h1", "h2", "sig", "keys"), zip(*rows, strict=True) if rows else [[]] * 5, strict=True))

    rows = with_null_safe_text(docs).filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("content"), "text")
    return per_text(rows, "n long, h1 long, h2 long, sig binary, keys array<long>", sign)


def _prune(sig_a: np.ndarray, sig_b: np.ndarray, bars: list[tuple[int, int]]) -> np.ndarray:
    """Which of the pairs row by row survive: values are compared a step at a time, and pairs below a step's bar go."""
    alive, done, m = np.arange(len(sig_a)), 0, np.zeros(len(sig_a), np.int32)
    for n, bar in bars:
        m[alive] += (sig_a[alive, done:n] == sig_b[alive, done:n]).sum(1)
        alive, done = alive[m[alive] >= bar], n
        if not len(alive):
            break
    return alive


def _prune_block(left: np.ndarray, right: np.ndarray, bars: list[tuple[int, int]]) -> np.ndarray:
    """The same for all pairs of two blocks, as a matrix; the few that are alive after the first steps go on one by one."""
    m = np.zeros((len(left), len(right)), np.uint8)
    for i in range(bars[0][0]):
        m += left[:, i, None] == right[None, :, i]
    out = np.zeros(m.shape, bool)
    x, y = np.nonzero(m >= bars[0][1])
    for i in range(0, len(x), 8192):  # both sides' values are laid out for each pair, a kilobyte a pair
        xs, ys = x[i : i + 8192], y[i : i + 8192]
        keep = _prune(left[xs], right[ys], bars)
        out[xs[keep], ys[keep]] = True
    return out


def _intersections(left: list[np.ndarray], right: list[np.ndarray], want: np.ndarray) -> np.ndarray:
    """Sizes of the intersections that `want` asks for; the others are 0. Shared shingles become columns of 0/1 matrices, multiplied a slice at a time."""
    rows_l, rows_r = np.flatnonzero(want.any(1)), np.flatnonzero(want.any(0))
    out = np.zeros(want.shape, np.int64)
    if not len(rows_l):
        return out
    pairs = int(want.sum())
    lens = [len(right[j]) for j in rows_r]
    if pairs * 20_000 < len(rows_l) * sum(lens) or pairs < 64:
        for i, j in zip(*np.nonzero(want), strict=True):
            out[i, j] = len(np.intersect1d(left[i], right[j], assume_unique=True))
        return out
    cat_l, cat_r = np.concatenate([left[i] for i in rows_l]), np.concatenate([right[j] for j in rows_r])
    who_l, who_r = np.repeat(np.arange(len(rows_l)), [len(left[i]) for i in rows_l]), np.repeat(np.arange(len(rows_r)), lens)
    common = np.intersect1d(cat_l, cat_r)
    at_l, at_r = np.searchsorted(common, cat_l), np.searchsorted(common, cat_r)
    in_l, in_r = common[np.minimum(at_l, len(common) - 1)] == cat_l if len(common) else np.zeros(len(cat_l), bool), common[np.minimum(at_r, len(common) - 1)] == cat_r if len(common) else np.zeros(len(cat_r), bool)
    at_l, who_l, at_r, who_r = at_l[in_l], who_l[in_l], at_r[in_r], who_r[in_r]
    order_l, order_r = np.argsort(at_l, kind="stable"), np.argsort(at_r, kind="stable")
    at_l, who_l, at_r, who_r = at_l[order_l], who_l[order_l], at_r[order_r], who_r[order_r]
    part, width = np.zeros((len(rows_l), len(rows_r)), np.float32), 2048
    for c in range(0, len(common), width):
        a, b = np.searchsorted(at_l, [c, c + width]), np.searchsorted(at_r, [c, c + width])
        x, y = np.zeros((len(rows_l), width), np.float32), np.zeros((len(rows_r), width), np.float32)
        x[who_l[a[0] : a[1]], at_l[a[0] : a[1]] - c] = 1
        y[who_r[b[0] : b[1]], at_r[b[0] : b[1]] - c] = 1
        part += x @ y.T
    out[np.ix_(rows_l, rows_r)] = np.rint(part).astype(np.int64)
    return out * want


def linked(left: list[np.ndarray], right: list[np.ndarray], sig_l: np.ndarray, sig_r: np.ndarray, params: JoinParams, bars: list[tuple[int, int]]) -> np.ndarray:
    """Matrix of the pairs of two blocks whose exact similarity reaches the threshold."""
    n_l, n_r = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    want = _prune_block(sig_l, sig_r, bars)
    want &= np.minimum(n_l[:, None], n_r[None, :]) >= params.threshold * np.maximum(n_l[:, None], n_r[None, :]) - 1e-9
    inter = _intersections(left, right, want)
    return want & (inter >= params.threshold * (n_l[:, None] + n_r[None, :] - inter) - 1e-9)


def _roots(link: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Least name of each row's component under a symmetric matrix of links."""
    label = names.copy()
    while True:
        low = np.minimum(label, np.where(link, label[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
        if (low == label).all():
            return label
        label = low


def candidate_edges(reps: DataFrame, params: JoinParams) -> DataFrame:
    """(src, dst): edges that join every pair of texts sharing a band.

    Small buckets give their pairs, pruned by their MinHash values; larger ones give a star around their least member, so a
    bucket never makes more rows than it has members.
    """
    bands = reps.select("rep", F.explode("keys").alias("key"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("least")).filter("size > 1")
    members = stage(bands.join(sizes, "key"), "buckets")
    stars = members.filter(F.col("size") > params.small).select(F.col("rep").alias("src"), F.col("least").alias("dst")).filter("src <> dst").distinct()
    few = members.filter(F.col("size") <= params.small).select("key", "rep")
    pairs = few.alias("a").join(few.alias("b"), "key").filter("a.rep < b.rep").select(F.col("a.rep").alias("src"), F.col("b.rep").alias("dst")).distinct()
    sigs = reps.select("rep", "sig", "n")
    both = pairs.join(sigs.select(F.col("rep").alias("src"), F.col("sig").alias("sa"), F.col("n").alias("na")), "src").join(sigs.select(F.col("rep").alias("dst"), F.col("sig").alias("sb"), F.col("n").alias("nb")), "dst")
    both = both.filter(F.least("na", "nb") >= params.threshold * F.greatest("na", "nb") - 1e-9)
    bars = least_matches(params)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a, b = (np.frombuffer(b"".join(pdf[c]), np.uint32).reshape(len(pdf), -1) for c in ("sa", "sb"))
                yield pdf.iloc[_prune(a, b, bars)][["src", "dst"]]

    return stars.unionByName(both.select("src", "dst", "sa", "sb").mapInPandas(prune, "src long, dst long"))


def _blocks(groups: DataFrame, params: JoinParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts of groups that are one block, texts of larger groups with their block, and the pairs of blocks (root, p, q) of these that can hold a link.

    A group that fits a block is one. In larger ones texts of one first band key, which are likely to be alike, lie together: a
    block takes several such keys, or a part of a key that has too many texts. Two blocks are a pair if some band key lies in both.
    """
    parts = lambda rows, shingles: F.greatest(F.ceil(rows / params.block_rows), F.ceil(shingles / params.block_shingles), F.lit(1)).cast("int")
    size = groups.groupBy("root").agg(parts(F.count("*"), F.sum("n")).alias("blocks"))
    sized = stage(groups.join(size, "root"), "sized")
    large = sized.filter("blocks > 1").withColumn("key", F.element_at("keys", 1))
    per_key = large.groupBy("root", "key").agg(parts(F.count("*"), F.sum("n")).alias("parts"))
    some = F.when(F.col("parts") > 1, F.xxhash64("key", F.pmod(F.xxhash64(F.lit(9), "rep"), F.col("parts")))).otherwise(F.pmod(F.xxhash64("key"), F.col("blocks").cast("long")))
    own = ["root", "rep", "copies", "sig", "content", "keys"]
    large = stage(large.join(per_key, ["root", "key"]).select(*own, some.alias("block")), "blocks")
    held = large.select("root", "block", F.explode("keys").alias("key")).distinct()
    met = held.alias("a").join(held.alias("b"), ["root", "key"]).filter("a.block <= b.block").select("root", F.col("a.block").alias("p"), F.col("b.block").alias("q")).distinct()
    small = sized.filter("blocks = 1").select(*own, F.lit(0).cast("long").alias("block"))
    return small, large, met


def _verified(groups: DataFrame, texts: DataFrame, params: JoinParams) -> DataFrame:
    """(rep, links, linked_copies, root) parts of all exact links inside candidate groups.

    groups: (rep, root, sig, copies, n, keys, content); texts: (rep, content, text). Each group that fits a block, and each pair
    of blocks of a larger group, is one task, which returns a row for each of its texts that has a link.
    """
    small, large, met = _blocks(groups, params)
    both = met.select("root", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
    columns = ["root", "p", "q", "rep", "copies", "block", "sig", "content"]
    tasks = small.withColumns({"p": F.col("block"), "q": F.col("block")}).select(*columns).unionByName(large.join(both, ["root", "block"]).select(*columns))
    tasks = tasks.join(texts, ["rep", "content"])
    bars = least_matches(params)

    def verify(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        rep, copies, block = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), pdf["block"].to_numpy()
        sets = [shingles(t, params.words) for t in pdf["text"]]
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), -1)
        left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
        link = np.zeros((len(pdf), len(pdf)), bool)
        for i in range(0, len(left), 512):
            for j in range(0, len(right), 512):
                x, y = left[i : i + 512], right[j : j + 512]
                if key[1] == key[2] and y[-1] < x[0]:
                    continue
                got = linked([sets[k] for k in x], [sets[k] for k in y], sig[x], sig[y], params, bars)
                link[np.ix_(x, y)] |= got
                link[np.ix_(y, x)] |= got.T
        np.fill_diagonal(link, False)
        root = _roots(link, rep)
        has = link.any(1)
        return pd.DataFrame({"rep": rep, "links": link.sum(1), "linked_copies": link @ copies, "root": root})[has]

    return tasks.groupBy("root", "p", "q").applyInPandas(verify, "rep long, links long, linked_copies long, root long")


def near_duplicates(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """One row per distinct doc_id of docs (doc_id, text): (doc_id, class_id, n_links, rep_id, n_copies, n_linked).

    rep_id: least id with the same set of shingles, n_copies how many ids have it. n_links: other sets whose similarity reaches
    the threshold, n_linked: documents that have one of them. class_id: least id of those that can be reached over links.
    Links are exact for every pair that shares a MinHash band and is not pruned; copies are counted, never expanded. Texts
    without words (null, empty) are alone in their class. Null ids are left out; rows that repeat an id count once (the first by
    content). An empty table gives an empty result.
    """
    mark = staged()
    signed = stage(signatures(docs, params), "signed")
    sets = signed.groupBy("doc_id").agg(F.min(F.struct("n", "h1", "h2", "content")).alias("s")).select("doc_id", "s.*")
    worded = sets.filter("n > 0")
    least = F.min(F.struct(F.col("doc_id").alias("rep"), "content"))
    classes = stage(worded.groupBy("n", "h1", "h2").agg(least.alias("r"), F.count("*").alias("copies")).select("n", "h1", "h2", "r.*", "copies"), "classes")
    reps = classes.join(signed.select(F.col("doc_id").alias("rep"), "content", "sig", "keys"), ["rep", "content"]).dropDuplicates(["rep"])
    reps = stage(reps.select("rep", "content", "n", "copies", "sig", "keys"), "reps")
    groups = stage(connected_components(candidate_edges(reps, params)).withColumnRenamed("node", "rep"), "groups")
    texts = probed(with_null_safe_text(docs).withColumnRenamed("doc_id", "rep").withColumn("content", F.xxhash64("text")), groups.select("rep"), "rep", "maybe")
    texts = texts.filter("maybe").drop("maybe").join(groups.select("rep"), "rep", "left_semi")
    found = stage(_verified(groups.join(reps, "rep"), texts.dropDuplicates(["rep", "content"]), params), "links")
    total = found.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("linked_copies").alias("linked"))
    joined = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "rep")
    per_class = classes.join(total, "rep", "left").join(joined, "rep", "left")
    per_class = per_class.select("n", "h1", "h2", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("root", "rep").alias("root"))
    out = sets.join(per_class, ["n", "h1", "h2"], "left")
    zero = F.lit(0).cast("long")
    out = out.select(
        "doc_id",
        F.coalesce("root", "doc_id").alias("class_id"),
        F.coalesce("links", zero).alias("n_links"),
        F.coalesce("rep", "doc_id").alias("rep_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("n_copies"),
        F.coalesce("linked", zero).alias("n_linked"),
    )
    out = stage(out, "near-duplicates")
    discard(docs.sparkSession, mark, keep=1)
    return out


def keep_one_of_each(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """docs without those whose class has a smaller id; all columns stay. Rows with a null id stay."""
    gone = near_duplicates(docs, params).filter("doc_id <> class_id").select("doc_id")
    return without_listed(docs, gone, "doc_id")
