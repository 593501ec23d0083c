"""Operator 6: URL filter: host and path rules, then a blocked Bloom filter of listed canonical URLs with an exact hash join behind it. The filter serves other operators' keys too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import stage

#: Rows of the filter that may be broadcast: each is a block number and four words, 40 bytes.
BROADCAST_BLOCKS = 100_000
WORDS = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z in lower case; path: from there up to ? # or the end. Both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www. or m., and the path without a trailing slash or .html."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(/|\.html)$", ""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host, path prefix, verdict) that fits, as (rule text, verdict); nulls where none does. The rules are a short list of the caller's."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def _probe(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """A key's block, and in each of the block's words one bit of 64."""
    second = F.xxhash64(F.lit(2), key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(second, 8 * i), F.lit(64)).cast("int")) for i in range(WORDS)]
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(blocks)), bits


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as a table (block, w0..w3): the bits of all keys of a block or-ed together. It grows with the list, so it is a table and not a value."""
    block, bits = _probe(F.col(key), blocks)
    return listed.select(block.alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def probed(rows: DataFrame, names: DataFrame, key: str, flag: str, *, bits_per_key: int = 16) -> DataFrame:
    """rows with the column `flag`: whether the blocked filter of `names` (distinct keys, no nulls) passes the row's key.

    Each row is probed where it lies: the filter is broadcast up to BROADCAST_BLOCKS blocks; only a larger one is joined by block.
    """
    n = names.count()
    if not n:
        return rows.withColumn(flag, F.lit(False))
    blocks = max(1, n * bits_per_key // (64 * WORDS))
    block, bits = _probe(F.col(key), blocks)
    table = bloom_blocks(names, key, blocks).withColumnRenamed("block", "__block").withColumnsRenamed({f"w{i}": f"__w{i}" for i in range(WORDS)})
    table = F.broadcast(table) if blocks <= BROADCAST_BLOCKS else table
    hit = F.lit(True)
    for i, b in enumerate(bits):
        hit = hit & (F.col(f"__w{i}").bitwiseAND(b) == b)
    return rows.withColumn("__block", block).join(table, "__block", "left").select(*rows.columns, F.coalesce(hit, F.lit(False)).alias(flag))


def mark_listed(rows: DataFrame, listed: DataFrame, key: str, flag: str, *, where: Column | None = None) -> DataFrame:
    """rows with the column `flag`: whether the row's key is in `listed` (one column of the same name) and `where` holds.

    Rows that the filter stops are done without a shuffle. The few that pass are staged and meet the list in an exact hash
    join, which finds the filter's false positives. Null keys match nothing.
    """
    names = stage(listed.select(key).filter(F.col(key).isNotNull()).distinct(), "listed")
    seen = probed(rows, names, key, "__maybe")
    maybe = F.col("__maybe") & F.coalesce(where, F.lit(False)) if where is not None else F.col("__maybe")
    stopped = seen.filter(~maybe).drop("__maybe").withColumn(flag, F.lit(False))
    passed = stage(seen.filter(maybe).drop("__maybe"), "passed")
    sure = passed.join(names.withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return stopped.unionByName(sure)


def without_listed(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows without those whose key is in `gone` (one column of the same name); rows with a null key stay.

    Only rows that the blocked filter passes take part in a join, so the others, with all their columns, are never shuffled.
    """
    return mark_listed(rows, gone, key, "__listed").filter(~F.col("__listed")).select(*rows.columns)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, *, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row: the longest rule's verdict, else block for a listed canonical URL, else allow.

    listed: a table with one column `canon` of canonical URLs. Null urls and such without :// have an empty host and path,
    fit no rule and are allowed. Ids are never joined on, so null and repeated ones are rows like others. Repeated rows give
    repeated rows; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "ruled": verdict, "canon": canonical(F.col("host"), F.col("path"))})
    marked = mark_listed(rows, listed, "canon", "hit", where=F.col("rule").isNull())
    return marked.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))
