"""Lead-lag statistics of all pairs of series, by blocked matrix products.

Series are packed into tiles of (entity block x position part), dense matrices with NaN where a series has no value. A pair of
entity blocks meets once per part, as two matrices: the statistics of all their pairs and lags are products of them. What is
shuffled is each tile once per entity block, not a row per pair and position.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelweave.functions.windows import complete_corr

#: Cells of a tile at most (8 bytes each).
CELLS = 1 << 21
#: Entities of a block on average, where positions are few.
ENTITIES = 64
Kernel = Callable[["Tile", "Tile", np.ndarray], dict]


class Tile:
    """Series of one entity block over one part's positions and `reach` more on either side. at: the first of the part's positions."""

    def __init__(self, names: np.ndarray, values: np.ndarray, at: int, reach: int) -> None:
        self.names, self.values, self.at, self.reach = names, values, at, reach
        self.span = values.shape[1] - 2 * reach

    def shifted(self, lag: int = 0) -> np.ndarray:
        """Values at the part's positions plus lag."""
        return self.values[:, self.reach + lag : self.reach + lag + self.span]


def pair_blocks(df: DataFrame, kernel: Kernel, schema: str, *, entity: str, pos: str, value: str, reach: int = 0, ordered: bool = True, whole: bool = False, cells: int = CELLS) -> DataFrame:
    """The kernel's rows for all pairs of different entities (a < b unless ordered) of df (entity, pos, value), with a and b in front.

    kernel(x, y, keep) gets the tiles of the first and of the second entities, and which pairs of their rows are wanted; it returns columns by name, and
    for each row the places `i` in x and `j` in y. Positions are cut into parts of at most `cells` // ENTITIES; values up to `reach` positions outside
    of a part are in its tiles. whole: one part for all positions, for statistics that need a series' every value; blocks then
    hold fewer entities, and a series can't span more than `cells` positions. Null values and null keys are left out; of repeated
    (entity, pos) rows the largest value counts.
    """
    rows = df.select(F.col(entity).alias("k"), F.col(pos).cast("long").alias("p"), F.col(value).cast("double").alias("v")).filter("k is not null and p is not null and v is not null")
    low, high, n = rows.agg(F.min("p"), F.max("p"), F.count_distinct("k")).first()
    kind = rows.schema["k"].dataType
    out = T.StructType([T.StructField("a", kind), T.StructField("b", kind), *T.StructType.fromDDL(schema)])
    if not n:
        return df.sparkSession.createDataFrame([], out)
    length = high - low + 1
    if whole and length + 2 * reach > cells:
        raise ValueError(f"series span {length} positions; this statistic takes {cells} at most")
    span = length if whole else min(length, max(1, cells // ENTITIES - 2 * reach))
    width = span + 2 * reach
    blocks = max(1, -(-n // max(1, min(ENTITIES, cells // width))))
    near = [F.expr(f"cast((p - ({low}) {sign} {reach}) div {span} as int)") for sign in "-+"]
    part = F.explode(F.sequence(F.greatest(near[0], F.lit(0)), F.least(near[1], F.lit((length - 1) // span))))
    dealt = rows.select("k", "p", "v", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int").alias("block"), part.alias("part"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        code, names = pd.factorize(pdf["k"], sort=True)
        values = np.full((len(names), width), np.nan)
        np.fmax.at(values, (code, pdf["p"].to_numpy() - low - key[1] * span + reach), pdf["v"].to_numpy())
        return pd.DataFrame({"block": [key[0]], "part": [key[1]], "names": [list(names)], "data": [values.tobytes()]})

    packed = T.StructType([*T.StructType.fromDDL("block int, part int"), T.StructField("names", T.ArrayType(kind)), *T.StructType.fromDDL("data binary")])
    tiles = dealt.groupBy("block", "part").applyInPandas(pack, packed)
    left = tiles.select(F.col("block").alias("x"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("y"), "part", "names", "data")
    right = tiles.select(F.explode(F.sequence(F.lit(0), "block")).alias("rx"), F.col("block").alias("ry"), *(F.col(c).alias(f"r{c}") for c in ("part", "names", "data")))
    fields = [f.name for f in out.fields]

    def tile(names: list, data: bytes, at: int) -> Tile:
        return Tile(np.asarray(names), np.frombuffer(data).reshape(len(names), width), at, reach)

    def meet(key: tuple, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(one) and len(two):
            at = low + key[2] * span
            a, b = tile(one["names"].iloc[0], one["data"].iloc[0], at), tile(two["rnames"].iloc[0], two["rdata"].iloc[0], at)
            for x, y in [(a, b)] if key[0] == key[1] else [(a, b), (b, a)]:
                keep = x.names[:, None] != y.names[None, :] if ordered else x.names[:, None] < y.names[None, :]
                if keep.any():
                    got = kernel(x, y, keep)
                    found.append(pd.DataFrame({"a": x.names[got.pop("i")], "b": y.names[got.pop("j")], **got}))
        found = [f for f in found if len(f)]
        return pd.concat(found, ignore_index=True)[fields] if found else pd.DataFrame({f: pd.Series(dtype=object) for f in fields})

    return left.groupBy("x", "y", "part").cogroup(right.groupBy("rx", "ry", "rpart")).applyInPandas(meet, out)


def _there(v: np.ndarray) -> np.ndarray:
    return (~np.isnan(v)).astype(float)


def lagged_sums(df: DataFrame, terms: dict[str, tuple[Callable, Callable]], *, entity: str, pos: str, value: str, lags: Sequence[int], ordered: bool = True, **options: int) -> DataFrame:
    """(a, b, lag, n, one column per term): sums of f(x) g(y) over the positions where a has x and b, `lag` later, has y; n counts them.

    terms: name to (f, g), functions of an array of values. Pairs that never meet at a lag have no row.
    """
    reach, names = max(map(abs, lags)), [*terms]

    def kernel(x: Tile, y: Tile, keep: np.ndarray) -> dict:
        u, parts = x.shifted(), []
        here, first = _there(u), [np.nan_to_num(f(u).astype(float)) * _there(u) for f, _ in terms.values()]
        for lag in lags:
            v = y.shifted(lag)
            there = _there(v)
            n = here @ there.T
            i, j = np.nonzero(keep & (n > 0))
            sums = {c: (a @ (np.nan_to_num(g(v).astype(float)) * there).T)[i, j] for c, a, (_, g) in zip(names, first, terms.values(), strict=True)}
            parts.append({"i": i, "j": j, "lag": np.full(len(i), lag, np.int32), "n": n[i, j].astype(np.int64), **sums})
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    each = pair_blocks(df, kernel, "lag int, n long" + "".join(f", {c} double" for c in names), entity=entity, pos=pos, value=value, reach=reach, ordered=ordered, **options)
    return each.groupBy("a", "b", "lag").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names))


def _moments(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
    """n, means and central second moments (xx, yy, xy) of all pairs of rows, over the columns where both have a value.

    Rows lose their own means first, so the sums don't cancel digits.
    """
    mu, mv = (np.nanmean(np.where(np.isnan(z).all(1, keepdims=True), 0.0, z), 1) for z in (u, v))
    p, q = _there(u), _there(v)
    a, b = np.nan_to_num(u - mu[:, None]), np.nan_to_num(v - mv[:, None])
    n = p @ q.T
    safe = np.maximum(n, 1)
    sx, sy = a @ q.T, p @ b.T
    return n, mu[:, None] + sx / safe, mv[None, :] + sy / safe, (a * a) @ q.T - sx * sx / safe, p @ (b * b).T - sy * sy / safe, a @ b.T - sx * sy / safe


def _corr(n: np.ndarray, xx: np.ndarray, yy: np.ndarray, xy: np.ndarray, least: int = 1) -> np.ndarray:
    """Correlations; NaN where a side has a deviation of 1e-12 or less, or fewer than `least` positions are shared."""
    fine = (n >= least) & (xx > 1e-24 * n) & (yy > 1e-24 * n)
    return np.where(fine, xy / np.sqrt(np.where(fine, xx * yy, 1.0)), np.nan)


def lagged_correlations(df: DataFrame, *, entity: str, pos: str, value: str, lags: Sequence[int], ordered: bool = True, least: int = 1, **options: int) -> DataFrame:
    """(a, b, lag, n, corr): Pearson correlation of a's values with b's `lag` positions later, where both have one; null below `least` positions or without spread.

    Parts of positions are merged by their means and central moments.
    """

    def kernel(x: Tile, y: Tile, keep: np.ndarray) -> dict:
        parts = []
        for lag in lags:
            n, *moments = _moments(x.shifted(), y.shifted(lag))
            i, j = np.nonzero(keep & (n > 0))
            parts.append({"i": i, "j": j, "lag": np.full(len(i), lag, np.int32), "n": n[i, j].astype(np.int64)} | {c: m[i, j] for c, m in zip(("mx", "my", "xx", "yy", "xy"), moments, strict=True)})
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    each = pair_blocks(df, kernel, "lag int, n long, mx double, my double, xx double, yy double, xy double", entity=entity, pos=pos, value=value, reach=max(map(abs, lags)), ordered=ordered, **options)
    n, x, y = F.col("n"), F.col("mx"), F.col("my")
    # sums of the parts' moments, and of what their means add: taken about the least part's mean, so that parts alike cancel nothing
    w = Window.partitionBy("a", "b", "lag")
    each = each.withColumns({"mx": x - F.min("mx").over(w), "my": y - F.min("my").over(w)})
    s = each.groupBy("a", "b", "lag").agg(F.sum("n").alias("n"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"), F.sum(F.col("xx") + n * x * x).alias("sxx"), F.sum(F.col("yy") + n * y * y).alias("syy"), F.sum(F.col("xy") + n * x * y).alias("sxy"))
    xx, yy, xy = (F.col(c) - F.col(d) * F.col(e) / n for c, d, e in (("sxx", "sx", "sx"), ("syy", "sy", "sy"), ("sxy", "sx", "sy")))
    return s.select("a", "b", "lag", "n", F.when((n >= least) & (xx > 1e-24 * n) & (yy > 1e-24 * n), xy / F.sqrt(xx * yy)).alias("corr"))


def event_responses(df: DataFrame, hit: Callable[[np.ndarray], np.ndarray], *, entity: str, pos: str, value: str, lags: Sequence[int], **options: int) -> DataFrame:
    """(a, b, lag, n, mean, median, up): b's values `lag` positions after those where a's value is a hit, over all of them, and the share above 0."""

    def kernel(x: Tile, y: Tile, keep: np.ndarray) -> dict:
        u, rows = x.shifted(), []
        struck = hit(u) & ~np.isnan(u)
        for lag in lags:
            v = y.shifted(lag)
            for i in np.flatnonzero(struck.any(1)):
                some = v[:, struck[i]]
                n = (~np.isnan(some)).sum(1)
                j = np.flatnonzero(keep[i] & (n > 0))
                some = some[j]
                rows.append({"i": np.full(len(j), i), "j": j, "lag": np.full(len(j), lag, np.int32), "n": n[j], "mean": np.nanmean(some, 1) if len(j) else n[j] * 1.0, "median": np.nanmedian(some, 1) if len(j) else n[j] * 1.0, "up": (some > 0).sum(1) / n[j]})
        if not rows:
            return {"i": np.empty(0, int), "j": np.empty(0, int), "lag": [], "n": [], "mean": [], "median": [], "up": []}
        return {c: np.concatenate([r[c] for r in rows]) for c in rows[0]}

    return pair_blocks(df, kernel, "lag int, n long, mean double, median double, up double", entity=entity, pos=pos, value=value, reach=max(map(abs, lags)), whole=True, **options)


def tail_dependence(df: DataFrame, *, entity: str, pos: str, value: str, level: float, ordered: bool = False, **options: int) -> DataFrame:
    """(a, b, tail): how often b lies in its lower tail when a does; tails up to the `level` quantile of the positions that both have (within 1e-12)."""

    def kernel(x: Tile, y: Tile, keep: np.ndarray) -> dict:
        u, v = x.shifted(), y.shifted()
        i, j = np.nonzero(keep & (_there(u) @ _there(v).T > 0))
        full_x, full_y = ~np.isnan(u).any(1), ~np.isnan(v).any(1)
        known = [np.where(np.isnan(z).any(1), np.nan, np.quantile(np.nan_to_num(z), level, axis=1)) for z in (u, v)]
        tail = np.empty(len(i))
        for r, (p, q) in enumerate(zip(i, j, strict=True)):
            if full_x[p] and full_y[q]:
                a, b, qa, qb = u[p], v[q], known[0][p], known[1][q]
            else:
                both = ~np.isnan(u[p]) & ~np.isnan(v[q])
                a, b = u[p][both], v[q][both]
                qa, qb = np.quantile(a, level), np.quantile(b, level)
            tail[r] = (b[a <= qa + 1e-12] <= qb + 1e-12).mean()
        return {"i": i, "j": j, "tail": tail}

    return pair_blocks(df, kernel, "tail double", entity=entity, pos=pos, value=value, ordered=ordered, whole=True, **options)


def median_information(df: DataFrame, *, entity: str, pos: str, value: str, ordered: bool = False, **options: int) -> DataFrame:
    """(a, b, mi): mutual information, in nats, of lying above the median, over the positions that both have."""

    def kernel(x: Tile, y: Tile, keep: np.ndarray) -> dict:
        u, v = x.shifted(), y.shifted()
        i, j = np.nonzero(keep & (_there(u) @ _there(v).T > 0))
        mi = np.empty(len(i))
        for r, (p, q) in enumerate(zip(i, j, strict=True)):
            both = ~np.isnan(u[p]) & ~np.isnan(v[q])
            a, b = (z[both] > np.quantile(z[both], 0.5) for z in (u[p], v[q]))
            n = np.array([[(~a & ~b).sum(), (~a & b).sum()], [(a & ~b).sum(), (a & b).sum()]], float)
            t = n.sum()
            free = n.sum(1, keepdims=True) * n.sum(0, keepdims=True)
            some = n > 0
            mi[r] = (n[some] / t * np.log(n[some] * t / free[some])).sum()
        return {"i": i, "j": j, "mi": mi}

    return pair_blocks(df, kernel, "mi double", entity=entity, pos=pos, value=value, ordered=ordered, whole=True, **options)


def window_correlations(df: DataFrame, ends: Sequence[int], size: int, *, entity: str, pos: str, value: str, lag: int, ordered: bool = False, **options: int) -> DataFrame:
    """(a, b, end_pos, n, corr): correlation at one lag over a's last `size` positions up to each of `ends`."""

    def kernel(x: Tile, y: Tile, keep: np.ndarray) -> dict:
        parts = []
        for end in ends:
            last = end - x.at
            if not 0 <= last < x.span:
                continue  # another part's
            stop = x.reach + last + 1
            n, _, _, xx, yy, xy = _moments(x.values[:, stop - size : stop], y.values[:, stop - size + lag : stop + lag])
            i, j = np.nonzero(keep & (n > 0))
            parts.append({"i": i, "j": j, "end_pos": np.full(len(i), end, np.int32), "n": n[i, j].astype(np.int64), "corr": _corr(n, xx, yy, xy)[i, j]})
        if not parts:
            return {"i": np.empty(0, int), "j": np.empty(0, int), "end_pos": [], "n": [], "corr": []}
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    # a window's last position may lie behind the last value: positions up to the last end belong to some part
    last = max(ends)
    rows = df.select(entity, pos, value)
    found = pair_blocks(_reaching(rows, entity, pos, value, min(ends), last), kernel, "end_pos int, n long, corr double", entity=entity, pos=pos, value=value, reach=size + abs(lag), ordered=ordered, **options)
    return found.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))


def _reaching(rows: DataFrame, entity: str, pos: str, value: str, low: int, high: int) -> DataFrame:
    """The rows, and one entity's NaN at each of two positions, so that parts cover them."""
    one = rows.filter(F.col(entity).isNotNull()).select(entity).limit(1)
    marks = one.select(entity, F.explode(F.array(F.lit(low), F.lit(high))).alias(pos), F.lit(float("nan")).alias(value))
    return rows.withColumns({pos: F.col(pos).cast("long"), value: F.col(value).cast("double")}).unionByName(marks.withColumn(pos, F.col(pos).cast("long")))


def rolling_relations(df: DataFrame, size: int, *, entity: str, pos: str, value: str, ordered: bool = False, **options: int) -> DataFrame:
    """(a, b, pos, corr, spread_z): over the last `size` positions that both have, the correlation and how many deviations their difference lies from its mean; from the first full window on."""

    def kernel(x: Tile, y: Tile, keep: np.ndarray) -> dict:
        u, v = x.shifted(), y.shifted()
        i, j = np.nonzero(keep & (_there(u) @ _there(v).T >= size))
        rows = []
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            at = np.flatnonzero(~np.isnan(u[p]) & ~np.isnan(v[q]))
            a, b = (np.lib.stride_tricks.sliding_window_view(z[at], size) for z in (u[p], v[q]))
            da, db, d = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True), a - b
            corr = _corr(np.full(len(a), size), (da * da).sum(1), (db * db).sum(1), (da * db).sum(1))
            std = d.std(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                z = np.where(std > 0, (d[:, -1] - d.mean(1)) / std, np.nan)
            rows.append({"i": np.full(len(a), p), "j": np.full(len(a), q), "pos": x.at + at[size - 1 :], "corr": corr, "spread_z": z})
        if not rows:
            return {"i": np.empty(0, int), "j": np.empty(0, int), "pos": [], "corr": [], "spread_z": []}
        return {c: np.concatenate([r[c] for r in rows]) for c in rows[0]}

    found = pair_blocks(df, kernel, "pos long, corr double, spread_z double", entity=entity, pos=pos, value=value, ordered=ordered, whole=True, **options)
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("corr", "spread_z")})


def shuffled(values: np.ndarray, name: object, stage: str, draws: int, block: int, seed: int) -> np.ndarray:
    """draws x positions: a series with its blocks of `block` positions in a drawn order, seeded by the series' name: the same for all that lead it."""
    rng = np.random.default_rng(zlib.crc32(f"{seed}|{name}|{stage}".encode()))
    cuts = [values[k : k + block] for k in range(0, len(values), block)]
    return np.stack([np.concatenate([cuts[k] for k in rng.permutation(len(cuts))]) for _ in range(draws)])


def maxstat(u: np.ndarray, v: np.ndarray, lags: Sequence[int], least: int) -> np.ndarray:
    """Largest |corr| over the lags of each row of u with each row of v; NaN where no lag has one."""
    best = np.full((len(u), len(v)), np.nan)
    for k in lags:
        a, b = u[:, max(0, -k) : u.shape[1] - max(0, k)], v[:, max(0, k) : v.shape[1] - max(0, -k)]
        if a.shape[1]:
            n, _, _, xx, yy, xy = _moments(a, b)
            best = np.fmax(best, np.abs(_corr(n, xx, yy, xy, least)))
    return best


def maxstat_permutation(df: DataFrame, *, entity: str, pos: str, value: str, lags: Sequence[int], draws: int = 99, refined: int = 499, trigger: float = 0.05, block: int = 5, least: int = 10, seed: int = 0, ordered: bool = False, **options: int) -> DataFrame:
    """(a, b, stat, p, draws): the largest |corr| over lags, and how often block shuffles of b reach it: p = (1 + reaching) / (1 + valid draws).

    A shuffled path of b is used for all lags and all a: all draws and lags of a pair of blocks are matrix products. Pairs with p up to
    `trigger` are judged anew by `refined` draws; the others, nearly all, are done. stat and p are null where no lag has `least` shared
    positions with spread on both sides.
    """

    def judge(x: np.ndarray, seen: np.ndarray, name: object, series: np.ndarray, stage: str, many: int) -> tuple[np.ndarray, np.ndarray]:
        reached, valid = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        paths = shuffled(series, name, stage, many, block, seed)
        step = max(1, CELLS // max(paths.shape[1], len(x)))
        for k in range(0, many, step):
            null = maxstat(x, paths[k : k + step], lags, least)
            reached += (null >= seen[:, None] - 1e-12).sum(1)
            valid += (~np.isnan(null)).sum(1)
        return (1 + reached) / (1 + valid), valid

    def kernel(x: Tile, y: Tile, keep: np.ndarray) -> dict:
        u, v = x.shifted(), y.shifted()
        seen, p, used = maxstat(u, v, lags, least), np.full(keep.shape, np.nan), np.zeros(keep.shape, np.int64)
        for j, name in enumerate(y.names.tolist()):
            at = np.flatnonzero(keep[:, j] & ~np.isnan(seen[:, j]))
            if len(at):
                p[at, j], used[at, j] = judge(u[at], seen[at, j], name, v[j], "screen", draws)
                at = at[p[at, j] <= trigger]
                if len(at) and refined > draws:
                    p[at, j], used[at, j] = judge(u[at], seen[at, j], name, v[j], "refine", refined)
        i, j = np.nonzero(keep)
        return {"i": i, "j": j, "stat": seen[i, j], "p": p[i, j], "draws": used[i, j]}

    found = pair_blocks(df, kernel, "stat double, p double, draws long", entity=entity, pos=pos, value=value, ordered=ordered, whole=True, **options)
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("stat", "p")})


def edge_correlations(df: DataFrame, edges: DataFrame, *, entity: str, pos: str, value: str, salts: int = 16) -> DataFrame:
    """(a, b, lag, n, corr) of the given edges (a, b, lag) only: each edge meets its leader's rows, dealt over salts, and then its follower's by position."""
    rows = df.select(F.col(entity).alias("k"), F.col(pos).cast("long").alias("p"), F.col(value).cast("double").alias("v")).filter("p is not null and v is not null")
    spread = edges.select("a", "b", "lag").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    one = rows.select(F.col("k").alias("a"), F.col("p"), F.col("v").alias("x"), F.pmod(F.xxhash64("p"), F.lit(salts)).cast("int").alias("salt"))
    two = rows.select(F.col("k").alias("b"), F.col("p").alias("at"), F.col("v").alias("y"))
    met = one.join(spread, ["a", "salt"]).withColumn("at", F.col("p") + F.col("lag")).join(two, ["b", "at"])
    return met.groupBy("a", "b", "lag").agg(F.count("*").alias("n"), complete_corr(F.col("x"), F.col("y")).alias("corr"))


def _grid(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(k, pos): each name at each position from the first to the last."""
    low, high = rows.agg(F.min("pos"), F.max("pos")).first()
    return names.select("k", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("pos")) if low is not None else names.select("k", F.lit(0).cast("long").alias("pos")).limit(0)


def other_leaders(df: DataFrame, shock: float, *, entity: str, pos: str, value: str, lags: Sequence[int]) -> DataFrame:
    """(k, pos, mean, top, low, shocks): what all other series had `lag` positions before, over all lags together; for every series and position with any.

    A position's values are reduced to their sum, count, shocks, and the two largest and two smallest once; a series then takes its own value out of
    them. So the work grows with the rows of the result, not with pairs of series. One row per (entity, pos) is expected.
    """
    rows = df.select(F.col(entity).alias("k"), F.col(pos).cast("long").alias("pos"), F.col(value).cast("double").alias("v")).filter("k is not null and pos is not null and v is not null")
    one = rows.groupBy("pos").agg(F.sum("v").alias("s"), F.count("*").alias("n"), F.count_if(F.col("v") >= shock).alias("h"), F.max(F.struct("v", "k")).alias("t1"), F.min(F.struct("v", "k")).alias("b1"))
    ends = one.select("pos", "t1", "b1")
    rest = rows.join(ends, "pos").groupBy("pos").agg(F.max(F.when(F.col("k") != F.col("t1.k"), F.col("v"))).alias("t2"), F.min(F.when(F.col("k") != F.col("b1.k"), F.col("v"))).alias("b2"))
    at = one.join(rest, "pos")
    own = _grid(rows, rows.select("k").distinct()).join(rows, ["k", "pos"], "left").join(at, "pos")
    n = F.col("n") - F.col("v").isNotNull().cast("long")
    less = F.coalesce(F.col("v"), F.lit(0.0))
    without = own.filter(n > 0).select(
        "k", F.explode(F.array(*(F.col("pos") + k for k in lags))).alias("pos"), (F.col("s") - less).alias("s"), n.alias("n"), (F.col("h") - F.coalesce((F.col("v") >= shock).cast("long"), F.lit(0))).alias("h"),
        F.when(F.col("k") == F.col("t1.k"), F.col("t2")).otherwise(F.col("t1.v")).alias("t"), F.when(F.col("k") == F.col("b1.k"), F.col("b2")).otherwise(F.col("b1.v")).alias("b"),
    )
    return without.groupBy("k", "pos").agg((F.sum("s") / F.sum("n")).alias("mean"), F.max("t").alias("top"), F.min("b").alias("low"), F.sum("h").alias("shocks"))


def edge_leaders(df: DataFrame, edges: DataFrame, shock: float, *, entity: str, pos: str, value: str, most: int = 5, salts: int = 16) -> DataFrame:
    """(k, pos, consensus, pressure, top, low, ups, downs): what a series' `most` strongest leaders had at their edges' lags before.

    edges: (src, dst, lag, weight), lag at least 0, so nothing later is used. consensus: mean weighted by |weight|, each value with its weight's sign;
    pressure: their weighted sum; ups, downs: leaders beyond +-shock. Ties of weight go to the lesser leader. A leader of very many
    has its rows dealt over salts; edges are joined, not sent to all tasks.
    """
    ranked = edges.filter("lag >= 0 and weight is not null and weight <> 0").withColumn("r", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc(F.abs("weight")), "src", "lag"))).filter(F.col("r") <= most)
    rows = df.select(F.col(entity).alias("src"), F.col(pos).cast("long").alias("at"), F.col(value).cast("double").alias("v")).filter("at is not null and v is not null")
    deal: Column = F.pmod(F.xxhash64("at"), F.lit(salts)).cast("int")
    spread = ranked.select("src", "dst", "lag", "weight").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = rows.withColumn("salt", deal).join(spread, ["src", "salt"])
    w, signed = F.abs("weight"), F.col("v") * F.signum("weight")
    return met.groupBy(F.col("dst").alias("k"), (F.col("at") + F.col("lag")).alias("pos")).agg((F.sum(w * signed) / F.sum(w)).alias("consensus"), F.sum(F.col("weight") * F.col("v")).alias("pressure"), F.max("v").alias("top"), F.min("v").alias("low"), F.count_if(F.col("v") >= shock).alias("ups"), F.count_if(F.col("v") <= -shock).alias("downs"))
