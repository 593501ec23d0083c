"""Registered queries of the operators for training data: thin, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.common import fold_of
from panelweave.llm.decontaminate import decontaminate
from panelweave.llm.language import identify_languages, train_language
from panelweave.llm.licences import TEMPLATES, bigrams_of, scan_licences
from panelweave.llm.neardup import near_duplicates
from panelweave.llm.negatives import hard_negatives
from panelweave.llm.neighbours import nearest
from panelweave.llm.packing import pack_documents
from panelweave.llm.quality import keep_good, quality_scores
from panelweave.llm.secrets import described, find_secrets
from panelweave.llm.toxicity import toxicity_scores, train_toxicity, trainable_labels
from panelweave.llm.trie import prefix_trie
from panelweave.llm.urls import canonical, host_and_path, judge_urls
from panelweave.llm.wrappers import extract_main_text

#: The URL rules of the contract, and the host labels whose pages make up the list of canonical URLs.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
LISTED_HOSTS = ("ads-track", "casino-win", "spam-farm", "adult-x", "cheap-pills", "free-bets")
QUALITY_BAR, TOXICITY_BAR = 0.3, 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Place of the public tokenizer file; it is installed with the tokenizers and never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positives among the labels' training rows."""
    return table(spark, sf_dir, "labels").filter((F.col("quality") == 1) & (fold_of(F.col("doc_id"), 5) != 0))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that op1_quality's model doesn't reject."""
    return keep_good(docs, trusted(spark, sf_dir), QUALITY_BAR, fold_of(F.col("doc_id"), 5) != 0)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), trusted(spark, sf_dir), fold_of(F.col("doc_id"), 5) != 0)
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_BAR).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = trainable_labels(table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 5) != 0)
    tagged = toxicity_scores(docs, train_toxicity(docs, labels))
    return tagged.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= TOXICITY_BAR).cast("int").alias("predicted"), "n_spans", "spans")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(described(F.col("base")), 256).alias("base_sha256"), described(F.col("found")).alias("spans"), (F.size("found") - F.size("base")).cast("long").alias("n_entropy"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host, path = host_and_path(F.col("url"))
    listed = pages.filter(host.rlike(r"(^|\.)(" + "|".join(LISTED_HOSTS) + r")\.")).select(canonical(host, path).alias("canon")).distinct()
    return judge_urls(pages, URL_RULES, listed)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    found = identify_languages(docs, train_language(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    return prefix_trie(table(spark, sf_dir, "conversations"), head=fold_of(c, 6), base=c - c % 100)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


_ALL = (op1_quality, op2_toxicity, op3_licences, op4_secrets, op5_near_duplicates, op6_urls, op7_decontaminate, op8_language, op9_neighbours, op10_packing, op11_main_text, op12_prefix_trie, op13_hard_negatives)
LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_HOSTS = r"regexp_extract(regexp_extract(url, '://(.*)$', 1, 's'), '^[^/?#]*', 0)"
_SQL_URLS = f"""
WITH p AS (SELECT page_id, coalesce(translate({_HOSTS}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(regexp_extract(url, '://(.*)$', 1, 's'), '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
c AS (SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(/|\\.html)$', '') AS canon FROM p),
listed AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '(^|\\.)({"|".join(LISTED_HOSTS)})\\.')),
r AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


def _licence_sql(threshold: float = 0.8) -> str:
    rows = ", ".join(f"('{name}', {bigrams_of(text)!r})" for name, text in sorted(TEMPLATES.items()))
    return f"""
WITH t(name, grams) AS (VALUES {rows}),
l AS (SELECT doc_id, i - 1 AS line, string_split(coalesce(text, ''), chr(10))[i] AS body FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)),
w AS (SELECT doc_id, line, list_filter(string_split(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM l),
g AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM w WHERE len(words) >= 2),
m AS (SELECT doc_id, line, name, 2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice FROM g JOIN t ON list_has_any(g.grams, t.grams)),
b AS (SELECT * FROM m WHERE dice >= {threshold} QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, name) = 1),
s AS (SELECT doc_id, count(*) AS n_matches, first(name ORDER BY dice DESC, line) AS licence, round(max(dice), 6) AS dice, string_agg(line || ':' || name, ',' ORDER BY line) AS matches FROM b GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_matches, 0) AS n_matches, licence, dice, coalesce(matches, '') AS matches FROM documents d LEFT JOIN s USING (doc_id)
"""


_SQL_NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, CAST(list_dot_product(a.v, e.v) AS BIGINT) AS score FROM e AS a JOIN e ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s AS n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 10
"""

_SQL_TRIE = """
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tbl),
t AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id AS c, list(d ORDER BY turn NULLS FIRST, d) AS ds, list(n ORDER BY turn NULLS FIRST, d) AS ns FROM t GROUP BY conv_id),
h AS (SELECT o.*, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM o, crc),
r AS (SELECT h.c, coalesce(b.ds[1:h.h], []) || h.ds[h.h + 1:] AS ds, coalesce(b.ns[1:h.h], []) || h.ns[h.h + 1:] AS ns FROM h LEFT JOIN o AS b ON b.c = h.base),
p AS (SELECT c, d, array_to_string(ds[1:d], '') AS key, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n, len(ds) = d AS last FROM r, unnest(range(0, len(ds) + 1)) AS u(d)),
g AS (SELECT key, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM p GROUP BY key),
k AS (SELECT left(key, 64 * (depth - 1)::BIGINT) AS key, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY 1),
v AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (key)),
s AS (SELECT left(key, 64 * a) AS key, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * n) AS saved_tokens FROM v, unnest(range(0, depth + 1)) AS u(a) GROUP BY 1)
SELECT v.conv_id, v.depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (key) LEFT JOIN g AS up ON v.depth > 0 AND up.key = left(v.key, 64 * (v.depth - 1)::BIGINT)
"""

LLM_SQL: dict[str, str] = {"op3_licences": _licence_sql(), "op6_urls": _SQL_URLS, "op12_prefix_trie": _SQL_TRIE, "op13_hard_negatives": _SQL_NEGATIVES}
