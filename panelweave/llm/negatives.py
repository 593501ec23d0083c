"""Operator 13: hard negatives, found by segment summaries that bound inner products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.llm.common import discard, stage, staged

#: Labels are dealt into so many buckets; only rows of an anchor's bucket can have its label.
BUCKETS = 64
#: Segments a vector is cut into, level by level; the next level only sees what the one before couldn't rule out.
LEVELS = (1, 4, 16)
NONE = np.iinfo(np.int64).min
MOST = np.iinfo(np.int64).max


def summaries(v: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of each vector's segments, both times the root of the segment's length.

    The inner product of two vectors lies between the means' product less, and plus, the deviations' product
    (Cauchy and Schwarz on what is left of each segment without its mean).
    """
    cuts = np.linspace(0, v.shape[1], segments + 1).astype(int)
    length = np.diff(cuts)
    mean = np.add.reduceat(v, cuts[:-1], axis=1) / length
    rest = v - np.repeat(mean, length, axis=1)
    return mean * np.sqrt(length), np.sqrt(np.add.reduceat(rest * rest, cuts[:-1], axis=1))


class Rows:
    """Integer vectors of one length: exact values, and each level's summaries."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.labels, self.values = ids, labels, values
        self.real = values.astype(np.float64)
        self.largest = float(np.abs(self.real).max()) if self.real.size else 0.0
        self.norm = np.sqrt((self.real * self.real).sum(1))
        self.levels = [summaries(self.real, s) for s in LEVELS if 2 * s < values.shape[1]]

    def take(self, at: np.ndarray) -> Rows:
        part = Rows.__new__(Rows)
        part.ids, part.labels, part.values, part.real, part.norm, part.largest = self.ids[at], self.labels[at], self.values[at], self.real[at], self.norm[at], self.largest
        part.levels = [(m[at], d[at]) for m, d in self.levels]
        return part

    def products(self, other: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact inner products of rows i of self with rows j of other: in doubles or longs where no sum can leave them, else in whole numbers of any size, cut at the range of a long."""
        bound = self.largest * other.largest * self.values.shape[1]
        if bound < 2**52:
            if len(i) > 0.2 * len(self.ids) * len(other.ids):
                return (self.real @ other.real.T)[i, j].astype(np.int64)
            step = max(1, 4_000_000 // max(1, self.values.shape[1]))
            parts = [np.einsum("ij,ij->i", self.real[i[a : a + step]], other.real[j[a : a + step]]) for a in range(0, len(i), step)]
            return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
        if bound < 2**62:
            return (self.values[i] * other.values[j]).sum(1)
        whole = [sum(x * y for x, y in zip(self.values[a].tolist(), other.values[b].tolist(), strict=True)) for a, b in zip(i, j, strict=True)]
        return np.array([min(max(s, NONE + 1), MOST - 1) for s in whole], np.int64)

    def possible(self, other: Rows, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose product may lie between least and most of the row of self, as far as the summaries tell: each level looks at the pairs left by the one before."""
        slack = 1e-9 * self.norm.max(initial=0.0) * other.norm.max(initial=0.0) + 1e-6
        low, high = least - slack, most + slack
        open_ = np.repeat((least <= most)[:, None], len(other.ids), 1)
        for (mean, dev), (mean_o, dev_o) in zip(self.levels, other.levels, strict=True):
            if open_.mean() > 0.2:
                middle, spread = mean @ mean_o.T, dev @ dev_o.T
                open_ &= (middle + spread >= low[:, None]) & (middle - spread <= high[:, None])
            else:
                i, j = np.nonzero(open_)
                for a in range(0, len(i), 200_000):
                    x, y = i[a : a + 200_000], j[a : a + 200_000]
                    middle, spread = np.einsum("ij,ij->i", mean[x], mean_o[y]), np.einsum("ij,ij->i", dev[x], dev_o[y])
                    out = (middle + spread < low[x]) | (middle - spread > high[x])
                    open_[x[out], y[out]] = False
        return np.nonzero(open_)


@dataclass
class Asked:
    """Anchors of one vector length with the windows of scores they look for. floor, top: anchors x windows, both inclusive."""

    key: np.ndarray
    bucket: np.ndarray
    rows: Rows
    floor: np.ndarray
    top: np.ndarray


class Best:
    """The `keep` best (score, id) of each anchor and window so far; a window's floor rises with them."""

    def __init__(self, asked: Asked, keep: int, same_label: bool) -> None:
        self.asked, self.keep, self.same = asked, keep, same_label
        self.floor = asked.floor.copy()
        self.score = np.full((*self.floor.shape, keep), NONE)
        self.id = np.zeros((*self.floor.shape, keep), np.int64)

    def meet(self, found: Rows, bucket: int, most_pairs: int = 2_000_000) -> None:
        rows = self.asked.rows
        at = np.flatnonzero(self.asked.bucket == bucket) if self.same else np.arange(len(rows.ids))
        step = max(1, most_pairs // max(1, len(found.ids)))
        for a in range(0, len(at), step):
            some = at[a : a + step]
            part = rows.take(some)
            open_ = self.floor[some] <= self.asked.top[some]
            least = np.where(open_, self.floor[some], MOST).min(1).astype(float)
            most = np.where(open_, self.asked.top[some], NONE).max(1).astype(float)
            i, j = part.possible(found, least, most)
            fine = (part.labels[i] == found.labels[j]) == self.same
            fine &= part.ids[i] != found.ids[j]
            i, j = i[fine], j[fine]
            s = part.products(found, i, j)
            for w in range(self.floor.shape[1]):
                own = (s >= self.floor[some[i], w]) & (s <= self.asked.top[some[i], w])
                if own.any():
                    self._add(w, some[i[own]], s[own], found.ids[j[own]])

    def _add(self, w: int, i: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(i)
        old = self.score[touched, w] != NONE
        i = np.r_[np.repeat(touched, old.sum(1)), i]
        s, ids = np.r_[self.score[touched, w][old], s], np.r_[self.id[touched, w][old], ids]
        order = np.lexsort((ids, -s, i))
        i, s, ids = i[order], s[order], ids[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
        kept = rank < self.keep
        self.score[i[kept], w, rank[kept]], self.id[i[kept], w, rank[kept]] = s[kept], ids[kept]
        full = self.score[touched, w, -1]
        self.floor[touched, w] = np.maximum(self.floor[touched, w], full)  # NONE where not yet full

    def out(self) -> pd.DataFrame:
        i, w, r = np.nonzero(self.score != NONE)
        return pd.DataFrame({"key": self.asked.key[i], "w": w.astype(np.int32), "vec_id": self.id[i, w, r], "score": self.score[i, w, r]})


def _values(packed: list[bytes], size: int) -> np.ndarray:
    """Rows of packed integers, of 2, 4 or 8 bytes each."""
    widths = np.array([len(b) for b in packed]) // max(size, 1)
    out = np.zeros((len(packed), size), np.int64)
    for w in np.unique(widths[widths > 0]):
        at = np.flatnonzero(widths == w)
        out[at] = np.frombuffer(b"".join(packed[k] for k in at), f"<i{w}").reshape(len(at), size)
    return out


ROW = "vec_id long, label long, size int, bucket int, q binary"


def quantised(vectors: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, size, bucket, q): each component x as floor(256 x), packed in the fewest bytes; rows with a null id, label or vector, or any null or non-finite component, are left out.

    A component beyond the range of 62 bits counts as that bound.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), "embedding").filter("label is not null")
    keyed = rows.select("vec_id", "label", "embedding", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int").alias("bucket"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            size = np.asarray(lists.value_lengths())
            flat = np.clip(np.floor(256.0 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), -(2.0**62), 2.0**62).astype(np.int64)
            end = np.cumsum(size)
            width = np.full(len(size), 8)
            if len(flat):
                big = np.maximum.reduceat(np.abs(flat), np.minimum(end - size, len(flat) - 1))
                width = np.where(big < 2**15, 2, np.where(big < 2**31, 4, 8))
            narrow = {w: flat.astype(f"<i{w}").tobytes() for w in np.unique(width).tolist()}
            packed = [narrow[w][w * (e - n) : w * e] for w, e, n in zip(width.tolist(), end.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(size, pa.int32()), batch.column("bucket"), pa.array(packed, pa.binary())], names=["vec_id", "label", "size", "bucket", "q"])

    return keyed.mapInArrow(pack, ROW)


def _search(rows: DataFrame, anchors: DataFrame, rounds: int, total: int, *, keep: int, same_label: bool, label: str) -> DataFrame:
    """(key, w, vec_id, score): for each anchor's windows the `keep` best rows, ties to smaller ids.

    anchors: (key, round, vec_id, label, size, bucket, q, floor array, top array). One round's anchors, bounded in number and
    bytes, are sent to all tasks, and every row meets them where it lies; a task hands on `keep` rows of each window at most.
    Rows are met in shares of the table, each sixteen times the one before: the best of a share are the next one's floors, so what all
    tasks hand on stays some `keep` times sixteen for each window however large the table is.
    """
    spark, best = rows.sparkSession, None
    share = F.pmod(F.xxhash64(F.lit(13), "vec_id"), F.lit(1 << 30))
    cuts = [1 << 30]
    while total * cuts[0] >> 30 > 400_000:
        cuts.insert(0, cuts[0] >> 4)
    for number in range(rounds):
        mark, found = staged(), None
        for low, high in zip([0, *cuts], cuts, strict=False):
            some = anchors.filter(F.col("round") == number)
            if found is not None:
                tenth = found.groupBy("key", "w").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") == keep).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("known"))
                risen = F.transform("floor", lambda f, w: F.greatest(f, F.element_at("known", w.cast("int"))))
                some = some.join(tenth, "key", "left").withColumn("floor", F.when(F.col("known").isNull(), F.col("floor")).otherwise(risen)).drop("known")
            pdf = some.select("key", "vec_id", "label", "size", "bucket", "q", "floor", "top").orderBy("key").toPandas()
            if pdf.empty:
                break
            sent = spark.sparkContext.broadcast(pdf)
            got = rows.filter((share >= low) & (share < high)).mapInArrow(_meeting(sent, keep, same_label), "key long, w int, vec_id long, score long")
            merged = got if found is None else got.unionByName(found)
            by = Window.partitionBy("key", "w").orderBy(F.desc("score"), "vec_id")
            found = stage(merged.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= keep).drop("r"), label)
            sent.destroy()
        if found is not None:
            discard(spark, mark, keep=1)
            best = found if best is None else best.unionByName(found)
    return best if best is not None else spark.createDataFrame([], "key long, w int, vec_id long, score long")


def _meeting(sent, keep: int, same_label: bool):  # noqa: ANN001, ANN202
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pdf, all_best = sent.value, {}
        for size, some in pdf.groupby("size"):
            rows = Rows(some["vec_id"].to_numpy(), some["label"].to_numpy(), _values(some["q"].to_list(), size))
            floor, top = (np.array(some[c].to_list(), np.int64).reshape(len(some), -1) for c in ("floor", "top"))
            all_best[size] = Best(Asked(some["key"].to_numpy(), some["bucket"].to_numpy(), rows, floor, top), keep, same_label)
        for batch in batches:
            size, bucket = batch.column("size").to_numpy(), batch.column("bucket").to_numpy()
            ids, labels, q = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), batch.column("q").to_pylist()
            runs = np.flatnonzero(np.r_[True, (size[1:] != size[:-1]) | ((bucket[1:] != bucket[:-1]) & same_label)]) if len(size) else []
            for a, b in zip(runs, [*runs[1:], len(size)], strict=True):
                if size[a] in all_best:
                    all_best[size[a]].meet(Rows(ids[a:b], labels[a:b], _values(q[a:b], size[a])), bucket[a])
        for best in all_best.values():
            yield pa.RecordBatch.from_pandas(best.out(), preserve_index=False)

    return meet


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column, *, positives: int = 5, negatives: int = 10, least: int = 3, most: int = 9, most_anchors: int = 32_768, most_bytes: int = 32 << 20) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of vectors (vec_id, embedding, label) that meet the condition `anchor`.

    Scores are integer inner products of components floor(256 x), exact. An anchor's positives are the `positives` best other rows of
    its label; for each of them the `negatives` best rows of other labels whose score lies between least and most tenths of the
    positive's. Higher scores come first, then smaller ids. All rows take part but those with a null id, label or vector or with a null or
    non-finite component; vectors of different lengths are never compared; a row is never compared with rows of its own id; repeated rows
    count as often as they stand there. Anchors without positives or negatives have no rows, and an empty table gives none. Other columns
    are left out. Scores beyond 64 bits count as that bound.

    Every row carries summaries of its segments (1, 4, then 16): means' product plus and minus deviations' product bound a score, and only
    pairs that no level rules out, given what an anchor has already, are scored. Anchors are sent in rounds of at most most_anchors rows
    and about most_bytes bytes.
    """
    spark, mark = vectors.sparkSession, staged()
    total = vectors.count()
    packed = quantised(vectors, label)
    rows = stage(packed.repartition(max(8, total // 50_000), "vec_id").sortWithinPartitions("size", "bucket"), "quantised")
    chosen = rows.filter(anchor)
    n, size = chosen.agg(F.count("*"), F.coalesce(F.sum(F.length("q")), F.lit(0))).first()
    rounds = max(1, -(-n // most_anchors), -(-size // most_bytes))
    dealt = chosen.withColumn("round", F.pmod(F.xxhash64("vec_id", "q", "label"), F.lit(rounds)).cast("int")).withColumn("key", F.monotonically_increasing_id())
    anchors = stage(dealt, "anchors")
    whole = anchors.withColumns({"floor": F.array(F.lit(int(NONE) + 1)), "top": F.array(F.lit(int(MOST) - 1))})
    near = _search(rows, whole, rounds, total, keep=positives, same_label=True, label="positives")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    near = stage(near.select("key", (F.row_number().over(order) - 1).cast("int").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # from ceil(least p / 10) up to floor(most p / 10), without leaving the range of a long
    tens = F.expr("(positive_score - pmod(positive_score, 10)) div 10")
    top = tens * most + F.expr(f"(pmod(positive_score, 10) * {most}) div 10")
    floor = tens * least + F.expr(f"(pmod(positive_score, 10) * {least} + 9) div 10")
    windows = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("w", floor.alias("floor"), top.alias("top")))).alias("ws"))
    none = F.array_repeat(F.struct(F.lit(0).alias("w"), F.lit(int(MOST) - 1).alias("floor"), F.lit(int(NONE) + 1).alias("top")), positives)
    full = F.slice(F.concat("ws", none), 1, positives)
    asked = anchors.join(windows, "key").withColumn("ws", full).withColumns({"floor": F.col("ws.floor"), "top": F.col("ws.top")}).drop("ws")
    far = _search(rows, stage(asked, "asked"), rounds, total, keep=negatives, same_label=False, label="negatives")
    by = Window.partitionBy("key", "w").orderBy(F.desc("score"), "vec_id")
    ranked = far.select("key", "w", F.row_number().over(by).alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("key", F.col("vec_id").alias("anchor_id")).join(near, "key")
    out = stage(ranked.join(named, ["key", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard_negatives")
    discard(spark, mark, keep=1)
    return out
