"""Operator 9: approximate nearest neighbours by shifted space-filling curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.llm.common import discard, stage, staged


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points whose coordinates (n x d) are integers of `bits` bits; d*bits must be below 64.

    Coordinates are turned into the curve's transposed form (exchange and inversion from the highest bit down, then Gray
    coding) and their bits interleaved.
    """
    x = cells.T.astype(np.uint64).copy()
    d = len(x)
    q = np.uint64(1 << (bits - 1))
    one = np.uint64(1)
    while q > one:
        p = q - one
        for i in range(d):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0], x[i] = np.where(high, x[0] ^ p, x[0] ^ t), np.where(high, x[i], x[i] ^ t) if i else np.where(high, x[0] ^ p, x[0])
        q >>= one
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > one:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_keys(vectors: np.ndarray, curves: int, dims: int, bits: int, seed: int) -> np.ndarray:
    """A key per vector and curve (n x curves): projection on random directions of the curve's own, shifted by a random part of the range, cut into cells."""
    rng = np.random.default_rng(seed)
    out = np.empty((len(vectors), curves), np.int64)
    unit = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-300) * np.sqrt(vectors.shape[1])
    for c in range(curves):
        directions = np.linalg.qr(rng.normal(size=(vectors.shape[1], min(dims, vectors.shape[1]))))[0]
        shift = rng.uniform(-0.5, 0.5, directions.shape[1])
        cells = np.clip(np.floor((unit @ directions + shift + 4.0) / 8.0 * (1 << bits)), 0, (1 << bits) - 1)
        out[:, c] = hilbert_keys(cells.astype(np.int64), bits)
    return out


def _usable(v: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _clean(v: Column) -> Column:
    """Components as doubles, -0 as 0, so that equal vectors are equal as groups."""
    return F.transform(v, lambda x: F.when(x == 0, 0.0).otherwise(x.cast("double")))


def distinct_vectors(vectors: DataFrame, keep: int, *, salts: int = 64) -> DataFrame:
    """(vid, v, ids): each distinct usable vector once, vid its least vec_id, with its `keep` least ids.

    Equal vectors have equal scores, and ties go to smaller ids, so further copies can be in no result. Copies of a very common
    vector are first reduced in salted parts.
    """
    v = _clean(F.col("embedding"))
    rows = vectors.filter(F.col("vec_id").isNotNull() & _usable(F.col("embedding"))).select("vec_id", v.alias("v"))
    some = Window.partitionBy("v", "salt").orderBy("vec_id")
    part = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).withColumn("r", F.row_number().over(some)).filter(F.col("r") <= keep)
    both = part.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, keep).alias("ids"))
    return both.select(F.element_at("ids", 1).alias("vid"), "v", "ids")


def packed_vectors(unique: DataFrame) -> DataFrame:
    """(vid, data): each vector as little-endian bytes, of four-byte numbers where these hold every component exactly, else of eight-byte ones."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for v in pdf["v"]:
                with np.errstate(over="ignore"):
                    short = (v := np.asarray(v, "<f8")).astype("<f4")
                out.append((short if (short == v).all() else v).tobytes())
            yield pd.DataFrame({"vid": pdf["vid"], "data": out})

    return unique.select("vid", "v").mapInPandas(pack, "vid long, data binary")


def _matrix(data: pd.Series, size: int) -> np.ndarray:
    """The packed vectors of one length as rows of doubles."""
    out, wide = np.empty((len(data), size)), data.map(len).to_numpy() == 8 * size
    for at, kind in ((~wide, "<f4"), (wide, "<f8")):
        if at.any():
            out[at] = np.frombuffer(b"".join(data[at]), kind).reshape(-1, size)
    return out


def _best(s: np.ndarray, keep: int) -> np.ndarray:
    """Columns of each row's `keep` largest values, in no order; of equal values the first columns."""
    if s.shape[1] <= keep:
        return np.broadcast_to(np.arange(s.shape[1]), s.shape)
    at = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
    least = np.take_along_axis(s, at, 1).min(1)
    for i in np.flatnonzero((s >= least[:, None]).sum(1) > keep):
        some = np.flatnonzero(s[i] >= least[i])
        at[i] = some[np.argsort(-s[i, some], kind="stable")[:keep]]
    return at


KEYED = "size int, curve int, part int, place long, vid long"


def curve_index(unique: DataFrame, total: int, curves: int, dims: int, bits: int, seed: int) -> DataFrame:
    """(size, curve, place, vid): each vector's place in each curve's order, among vectors of its length, staged.

    One range partitioning by (size, curve, key); rows are numbered as they lie in a partition, and the counts of the partitions
    before are added.
    """

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["v"].map(len).to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                v = np.array(pdf["v"].iloc[at].tolist(), float)
                keys, vid = curve_keys(v, curves, dims, bits, seed), pdf["vid"].to_numpy()[at]
                for c in range(curves):
                    yield pd.DataFrame({"size": size, "curve": c, "key": keys[:, c], "vid": vid})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("size").to_numpy().astype(np.int64) * curves + batch.column("curve").to_numpy()
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            place = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
            place += np.repeat([seen.get(g, 0) for g in group[first].tolist()], np.diff(np.r_[first, len(group)]))
            last = np.r_[first[1:] - 1, len(group) - 1]
            seen |= dict(zip(group[last].tolist(), (place[last] + 1).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("size"), batch.column("curve"), pa.array(np.full(len(group), part, np.int32)), pa.array(place.astype(np.int64)), batch.column("vid")], names=[x.split()[0] for x in KEYED.split(", ")])

    rows = unique.select("vid", "v").mapInPandas(key, "size int, curve int, key long, vid long")
    dealt = rows.repartitionByRange(max(8, total * curves // 200_000), "size", "curve", "key", "vid").sortWithinPartitions("size", "curve", "key", "vid")
    return stage(dealt.mapInArrow(number, KEYED), "curves")


def _placed(index: DataFrame) -> DataFrame:
    """The index with places counted over all partitions of a curve."""
    sizes = index.groupBy("size", "curve", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("size", "curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return index.join(before, ["size", "curve", "part"]).select("size", "curve", (F.col("place") + F.col("before")).alias("place"), "vid")


def _calibrated(index: DataFrame, unique: DataFrame, asked: DataFrame, total: int, *, k: int, sample: int, target: float) -> int:
    """The least number of rows in a block for which a query's own block and its neighbours, over all curves, hold `target` of the nearest.

    Measured on at most `sample` queries (the hash's least, all of them from one bounded sample) against all vectors. What the
    driver gets is a place for each curve of these queries and of their k nearest.
    """
    few = asked.select("qid").distinct().orderBy(F.xxhash64("qid"), "qid").limit(sample).join(unique.select(F.col("vid").alias("qid"), "v"), "qid").collect()
    groups = {}
    for qid, v in few:
        groups.setdefault(len(v), []).append((qid, v))
    groups = {n: (np.array([x[0] for x in g]), np.array([x[1] for x in g], float)) for n, g in groups.items()}

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["v"].map(len).to_numpy()
            for size, (qid, q) in groups.items():
                at = np.flatnonzero(sizes == size)
                if len(at):
                    s = q @ np.array(pdf["v"].iloc[at].tolist(), float).T
                    vid = pdf["vid"].to_numpy()[at]
                    s[qid[:, None] == vid[None, :]] = -np.inf
                    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    found = pd.DataFrame({"qid": np.repeat(qid, best.shape[1]), "vid": vid[best].ravel(), "s": np.take_along_axis(s, best, 1).ravel()})
                    yield found[np.isfinite(found["s"])]

    by = Window.partitionBy("qid").orderBy(F.desc("s"), "vid")
    near = unique.select("vid", "v").mapInPandas(top, "qid long, vid long, s double").withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k).select("qid", "vid").collect()
    if not near:
        return 256
    wanted = asked.sparkSession.createDataFrame(pd.DataFrame({"vid": sorted({x for r in near for x in r} | {r[0] for r in few})}, dtype="int64"), "vid long")
    place = index.join(F.broadcast(wanted), "vid").select("vid", "curve", "place").toPandas().pivot(index="vid", columns="curve", values="place")
    q, x = (place.loc[[r[i] for r in near]].to_numpy() for i in (0, 1))
    rows = 64
    while rows < total and (np.abs(q // rows - x // rows).min(1) <= 1).mean() < target:
        rows = rows * 11 // 10 + 1
    return rows


def nearest(vectors: DataFrame, queries: Column, *, k: int = 20, curves: int = 24, dims: int = 20, bits: int = 3, target: float = 0.96, sample: int = 256, window: int | None = None, most_rows: int = 65_536, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k vectors of largest inner product that were found, ties to smaller vec_id.

    vectors: (vec_id, embedding); queries: a condition on vec_id. All rows are indexed: for each of `curves` shifted Hilbert
    curves over `dims` projected dimensions of `bits` bits the vectors are range-partitioned by key, numbered in that order and
    cut into blocks of `window` rows; a query is compared with its own block and the two beside it. Without `window` the blocks
    are as small as lets a sample of `sample` queries find `target` of its true neighbours: of constant size where vectors lie in
    clusters, a share of the table where they lie like noise. Blocks hold at most most_rows rows; a wider window takes more of
    them, and of a window as wide as the table one curve is enough. In a block the original vectors are compared in double
    precision, whatever their lengths and however near they lie; the best k and a quarter more of each block, ties by id, are merged and scored again.
    Null, zero and non-finite vectors take no part (neither as queries), nor do null ids; equal vectors all count. Vectors of
    different lengths are never compared. Results with fewer than k candidates are shorter, and an empty table gives an empty
    result. Repeated ids count once per distinct vector.
    """
    spark, mark = vectors.sparkSession, staged()
    unique = stage(distinct_vectors(vectors, k + 1), "vectors")
    total = unique.count()
    ids = vectors.filter(queries & F.col("vec_id").isNotNull() & _usable(F.col("embedding"))).select(F.col("vec_id").alias("query_id"), _clean(F.col("embedding")).alias("v"))
    asked = stage(ids.join(unique.select(F.col("vid").alias("qid"), "v"), "v").select("query_id", "qid"), "asked")
    index = _placed(curve_index(unique, total, curves, dims, bits, seed))
    window = window or _calibrated(index, unique, asked, total, k=k, sample=sample, target=target)
    window = max(window, min(1024, total // 256))  # smaller blocks would cost more to hand out than to compare
    parts = -(-window // most_rows)  # blocks that make up a window
    rows, keep = -(-window // parts), k + k // 4 + 1
    if window >= total:
        index = index.filter("curve = 0")  # each curve's window holds all
    packed = stage(packed_vectors(unique), "packed")
    placed = index.select("size", "curve", (F.expr(f"place div {rows}")).cast("int").alias("block"), "vid")
    own = placed.join(asked.select(F.col("qid").alias("vid")).distinct(), "vid", "left_semi").join(packed, "vid")
    home_of = F.expr(f"block div {parts}").cast("int") * parts
    targets = own.select("size", "curve", F.explode(F.sequence(home_of - parts, home_of + 2 * parts - 1)).alias("block"), F.col("vid").alias("qid"), "data").filter("block >= 0")

    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"qid": [], "vid": [], "s": []}, dtype=object)
        right = right.sort_values("in_vid")
        q, c = _matrix(left["data"], int(key[0])), _matrix(right["in_data"], int(key[0]))
        qid, vid, out = left["qid"].to_numpy(), right["in_vid"].to_numpy(), []
        many = max(1, 2_000_000 // len(c))
        for i in range(0, len(q), many):
            s = q[i : i + many] @ c.T
            at = _best(s, keep)
            out.append((at, np.take_along_axis(s, at, 1)))
        at, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"qid": qid, "vid": list(vid[at]), "s": list(s)})

    home = placed.join(packed, "vid").select(F.col("size").alias("in_size"), F.col("curve").alias("in_curve"), F.col("block").alias("in_block"), F.col("vid").alias("in_vid"), F.col("data").alias("in_data"))
    pairs = targets.groupBy("size", "curve", "block").cogroup(home.groupBy("in_size", "in_curve", "in_block")).applyInPandas(compare, "qid long, vid array<long>, s array<double>")

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for qid, some in pdf.groupby("qid", sort=False):
            vid, s = np.concatenate(some["vid"].to_list()), np.concatenate(some["s"].to_list())
            vid, first = np.unique(vid, return_index=True)
            best = vid[np.lexsort((vid, -s[first]))[: keep + 1]]
            out.append(pd.DataFrame({"qid": qid, "vid": best}))
        return pd.concat(out)

    lists = max(8, asked.count() // 300)
    few = pairs.withColumn("some", F.pmod(F.xxhash64("qid"), F.lit(lists))).groupBy("some").applyInPandas(merge, "qid long, vid long")
    found = stage(few, "found")
    exact = found.join(unique, "vid").join(unique.select(F.col("vid").alias("qid"), F.col("v").alias("q")), "qid")
    score = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    # of a distinct query's candidates k+1 at most can be among a query's k, whichever copy asks
    each = exact.select("qid", score.alias("score"), F.explode("ids").alias("vec_id"))
    best = each.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1).drop("r")
    hits = asked.join(best, "qid").filter("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out = stage(ranked, "neighbours")
    discard(spark, mark, keep=1)
    return out
