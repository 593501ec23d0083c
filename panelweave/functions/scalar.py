"""Scalar column functions: keys, names, numbers and small arrays. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is missing."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE 754 and SQL's engine have it: infinite at b = 0, NaN for 0 / 0. Spark's own division is an error there."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


def ln(c: Column) -> Column:
    """Natural logarithm, -infinity at 0, where Spark's own is null."""
    return F.when(c == 0, F.lit(float("-inf"))).otherwise(F.log(c))


def sign(c: Column) -> Column:
    """-1, 0 or 1; 0 for NaN, where Spark's own is NaN."""
    return F.nanvl(F.signum(c), F.lit(0.0))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def sigmoid(c: Column, bound: float = 35.0) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(c, -bound, bound)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1.0 - q))


def softplus(c: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))


def softmax(cols: list[Column]) -> list[Column]:
    top = F.greatest(*cols)
    parts = [F.exp(c - top) for c in cols]
    total = reduce(lambda a, b: a + b, parts)
    return [p / total for p in parts]


def positive_log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b), null unless both are positive."""
    return F.when((a > 0) & (b > 0), F.log(a / b))


def normal_key(c: Column, width: int = 6, missing: str = "UNKNOWN") -> Column:
    """Trimmed, without a trailing .0, all-digit codes padded on the left; null and empty become `missing`."""
    t = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(t.isNull() | (t == ""), F.lit(missing)).when(t.rlike(r"^[0-9]+$") & (F.length(t) < width), F.lpad(t, width, "0")).otherwise(t)


def parse_bool(c: Column) -> Column:
    """true, 1, yes, y and t (any case, trimmed), and numbers other than zero, are true; everything else is false."""
    t = F.lower(F.trim(c.cast("string")))
    number = t.try_cast("double")
    return F.coalesce(t.isin("true", "yes", "y", "t") | F.coalesce(number != 0, F.lit(False)), F.lit(False))


def parse_date(c: Column) -> Column:
    """A date of yyyymmdd, yyyy.mm.dd, yyyy/mm/dd or yyyy-mm-dd; anything else is null."""
    t = F.regexp_replace(F.trim(c), r"[./-]", "")
    return F.when(t.rlike(r"^\d{8}$"), F.to_date(F.try_to_timestamp(t, F.lit("yyyyMMdd"))))


def parse_number(c: Column) -> Column:
    """A number, thousands commas and a percent sign left out; anything else is null."""
    return finite(F.regexp_replace(F.trim(c.cast("string")), r"[,%]", "").try_cast("double"))


def name_stem(c: Column) -> Column:
    """A name without its trailing _<digits>."""
    return F.regexp_replace(c, r"_[0-9]+$", "")


def name_horizon(c: Column) -> Column:
    """The trailing number of a name, or null."""
    return F.regexp_extract(c, r"_([0-9]+)$", 1).try_cast("int")


def any_token(c: Column, tokens: list[str]) -> Column:
    """Whether the text holds one of the tokens."""
    return F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(c, t))


def stable_seed(*parts: Column) -> Column:
    """A 60-bit seed from the SHA-256 of the parts joined with |."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("long")


def next_business_day(c: Column) -> Column:
    """The day after, Saturdays and Sundays skipped."""
    return F.date_add(c, F.when(F.dayofweek(c) == 6, 3).when(F.dayofweek(c) == 7, 2).otherwise(1))


def lookup(key: Column, table: dict[str, float], default: float) -> Column:
    """A value of a small map, or the default."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(float(default)))


def interpolate(c: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise-linear through the knots (by rising x), level beyond the ends."""
    out = F.when(c <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(c <= x1, F.lit(float(y0)) + (c - x0) * (float(y1 - y0) / float(x1 - x0)))
    return F.when(c.isNotNull(), out.otherwise(F.lit(float(knots[-1][1]))))


def bin_of(c: Column, edges: list[float]) -> Column:
    """How many inner edges are at or below the value: 0 for the first bin."""
    return F.when(c.isNotNull(), F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= c)))


def row_mean(cols: list[Column]) -> Column:
    """Mean of the values of a row that are there."""
    present = F.filter(F.array(*cols), lambda x: x.isNotNull())
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))


def row_weighted_mean(cols: list[Column], weights: list[float]) -> Column:
    """Weighted mean of the values of a row that are there; null without any."""
    top = reduce(lambda a, b: a + b, [F.coalesce(c * w, F.lit(0.0)) for c, w in zip(cols, weights, strict=True)])
    total = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in zip(cols, weights, strict=True)])
    return F.when(total > 0, top / total)


def row_std(cols: list[Column]) -> Column:
    """Population standard deviation of the values of a row that are there."""
    mean = row_mean(cols)
    return F.sqrt(row_mean([(c - mean) * (c - mean) for c in cols]))


def wilson_lower(k: Column, n: Column, z: float = 1.959964) -> Column:
    """Lower Wilson bound of k successes in n; 0 without trials."""
    p = k / n
    centre = p + z * z / (2.0 * n)
    spread = z * F.sqrt((p * (1.0 - p) + z * z / (4.0 * n)) / n)
    return F.when(n > 0, F.greatest((centre - spread) / (1.0 + z * z / n), F.lit(0.0))).otherwise(0.0)


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal p-value by the complementary error function's rational approximation (error under 1.2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.5 * x)
    #: The approximation's published coefficients, highest power last.
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = reduce(lambda acc, a: acc * t + a, reversed(coefficients[:-1]), F.lit(coefficients[-1]))
    return t * F.exp(-x * x + poly)
