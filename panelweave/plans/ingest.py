"""Queries: scans, cleaning, filters, contracts and joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.functions import scalar as S
from panelweave.functions.windows import complete_corr
from panelweave.operators import contracts as C
from panelweave.operators import joins as J
from panelweave.operators.leadlag import lagged_correlations
from panelweave.plans.registry import Tables, query, rd, sql
from panelweave.sources import ingest as I

FOLDS = [(f, "2024-01-01", f"2024-01-{5 * f - 2:02d}", f"2024-01-{5 * f - 1:02d}", f"2024-01-{5 * f:02d}", f"2024-01-{5 * f + 1:02d}", f"2024-01-{5 * f + 5:02d}") for f in range(1, 6)]
FOLD_SCHEMA = "fold_id int, train_start string, train_end string, purge_start string, purge_end string, validation_start string, validation_end string"
FOLD_SQL = "folds(fold_id, train_start, train_end, purge_start, purge_end, validation_start, validation_end) AS (VALUES " + ", ".join("(" + ", ".join([str(f[0]), *[f"DATE '{d}'" for d in f[1:]]]) + ")" for f in FOLDS) + ")"


def folds(t: Tables):
    df = t.spark.createDataFrame(FOLDS, FOLD_SCHEMA)
    return df.select("fold_id", *[F.to_date(c).alias(c) for c in df.columns[1:]])


@query("r1_1_column_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'")
def _(t):
    return I.read_table(t.spark, f"{t.sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice", "o_orderdate"]).filter(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp")).drop("o_orderdate")


@query("r1_2_schema_probe", "SELECT position, name, (SELECT count(*) FROM part) AS n_rows FROM (VALUES (0, 'p_partkey'), (1, 'p_name'), (2, 'p_brand'), (3, 'p_type'), (4, 'p_size'), (5, 'p_retailprice')) v(position, name)")
def _(t):
    return I.schema_probe(t.read("part")).drop("kind")


@query("r1_3_union_by_name", "SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(t):
    a = t.read("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = t.read("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@query("r1_4_column_resolution", "SELECT event_id, CAST(ts AS DATE) AS date, user_id AS ticker, NULL::DOUBLE AS weight FROM events")
def _(t):
    df = t.read("events")
    return df.select("event_id", F.to_date(I.first_column(df, ["date", "trade_date", "TS"])).alias("date"), I.first_column(df, ["ticker", "code", "USER_ID"]).alias("ticker"), I.first_column(df, ["weight", "w"]).cast("double").alias("weight"))


@query("r1_5_canonical_header", "SELECT p_partkey AS part, p_retailprice AS price, p_size FROM part")
def _(t):
    return I.canonical_header(t.read("part").select("p_partkey", "p_retailprice", "p_size"), {"P Part-Key": "part", "P_(RetailPrice)": "price"})


@query("r1_6_normal_key", "SELECT event_id, CASE WHEN k = '' THEN 'UNKNOWN' WHEN regexp_matches(k, '^[0-9]+$') AND length(k) < 6 THEN lpad(k, 6, '0') ELSE k END AS ticker FROM (SELECT event_id, regexp_replace(CASE WHEN event_id % 7 = 0 THEN '' ELSE ' ' || user_id || CASE WHEN event_id % 2 = 0 THEN '.0' ELSE '' END END, '\\.0$', '') AS k0, trim(k0) AS k FROM events)")
def _(t):
    raw = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ".0").otherwise("")))
    return t.read("events").select("event_id", S.normal_key(raw).alias("ticker"))


@query("r1_7_parse_bool", "SELECT event_id, event_type IN ('click', 'view', 'error') AS flag FROM events")
def _(t):
    word = F.when(F.col("event_type") == "click", " Yes").when(F.col("event_type") == "view", "2.5").when(F.col("event_type") == "error", "TRUE").when(F.col("event_type") == "signup", "0").otherwise("nope")
    return t.read("events").select("event_id", S.parse_bool(word).alias("flag"))


@query("r1_8_parse_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderkey % 4 <> 3")
def _(t):
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy.MM.dd")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise("n/a")
    return t.read("orders").select("o_orderkey", S.parse_date(text).alias("date")).filter("date is not null")


@query("r1_9_clean_numbers", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(round(o_totalprice) AS BIGINT)::DOUBLE END AS price FROM orders")
def _(t):
    text = F.when(F.col("o_orderkey") % 5 == 0, "n/a").when(F.col("o_orderkey") % 5 == 1, F.concat(F.format_number(F.round("o_totalprice"), 0), F.lit("%"))).otherwise(F.format_number(F.round("o_totalprice"), 0))
    return t.read("orders").select("o_orderkey", S.parse_number(text).alias("price"))


@query("r1_10_unit_detection", "SELECT l_orderkey, l_linenumber, round(CASE WHEN q > 1 THEN pct / 100.0 ELSE pct END, 6) AS pct, round(l_discount, 6) AS l_discount FROM (SELECT l_orderkey, l_linenumber, l_discount, l_discount * 100 AS pct FROM lineitem), (SELECT quantile_cont(abs(l_discount * 100), 0.99) AS q FROM lineitem)")
def _(t):
    df = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_discount", (F.col("l_discount") * 100).alias("pct"))
    return I.unit_scaled(df, "pct")


@query("r1_11_row_identity", sql("panel", "SELECT ticker, date, row_number() OVER (ORDER BY date, ticker) - 1 AS source_row_id FROM panel"))
def _(t):
    return I.stamp_rows(t.panel.select("ticker", "date"), "date", "ticker")


@query("r1_12_upsert", "SELECT event_id, user_id, value, src FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, src DESC) AS n FROM (SELECT event_id, user_id, ts, value, 0 AS src FROM events WHERE event_type IS DISTINCT FROM 'purchase' UNION ALL SELECT event_id, user_id, ts, -value, 1 FROM events WHERE event_type = 'purchase')) WHERE n = 1")
def _(t):
    e = t.read("events").select("event_id", "user_id", "ts", "value", "event_type")
    bought = F.col("event_type").eqNullSafe("purchase")
    old = e.filter(~bought).drop("event_type").withColumn("src", F.lit(0))
    new = e.filter(bought).drop("event_type").withColumn("value", -F.col("value")).withColumn("src", F.lit(1))
    return I.upsert(old, new, ["user_id"], "ts").drop("ts")


@query("r1_13_coalescing_merge", sql("panel", "SELECT date, round(coalesce(a.total, b.total), 6) AS total, a.n, round(b.best, 6) AS best FROM (SELECT date, CASE WHEN count(*) % 2 = 0 THEN max(close) END AS total, count(*) AS n FROM panel WHERE market = 'M0' GROUP BY 1) a FULL JOIN (SELECT date, min(close) AS total, max(close) AS best FROM panel WHERE market = 'M1' AND extract(day FROM date) > 3 GROUP BY 1) b USING (date)"))
def _(t):
    a = t.panel.filter("market = 'M0'").groupBy("date").agg(F.when(F.count("*") % 2 == 0, F.max("close")).alias("total"), F.count("*").alias("n"))
    b = t.panel.filter("market = 'M1' and day(date) > 3").groupBy("date").agg(F.min("close").alias("total"), F.max("close").alias("best"))
    return I.coalescing_merge([a, b], ["date"])


@query("r1_14_overlap_ratio", sql("panel", "SELECT ticker, date, coalesce(CASE WHEN errors > 1 THEN errors END, buys) AS status, CASE WHEN volume <> 0 THEN round(buys::DOUBLE / volume, 6) END AS ratio FROM panel"))
def _(t):
    return t.panel.select("ticker", "date", F.coalesce(F.when(F.col("errors") > 1, F.col("errors")), F.col("buys")).alias("status"), S.safe_div(F.col("buys"), F.col("volume")).alias("ratio"))


@query("r1_15_collapse_endpoints", "SELECT user_id, " + ", ".join(f"max_by(value, event_id) FILTER (event_type = '{k}') AS {k}" for k in ("view", "click", "purchase")) + " FROM events GROUP BY user_id")
def _(t):
    return I.collapse_endpoints(t.read("events"), ["user_id"], "event_type", "value", "event_id", ["view", "click", "purchase"])


@query("r1_16_correction_chain", "SELECT event_id, user_id || '|' || event_type AS chain, row_number() OVER w AS seq, lag(event_id) OVER w AS previous_id, lead(event_id) OVER w IS NULL AS is_latest FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def _(t):
    title = F.regexp_replace(F.concat(F.when(F.col("event_id") % 3 == 0, "[amended] ").otherwise(""), F.col("event_type")), r"\[[^\]]*\]\s*", "")
    return I.correction_chains(t.read("events"), "user_id", title, ["ts", "event_id"], "event_id").select("event_id", "chain", "seq", "previous_id", "is_latest")


@query("r1_17_available_from", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(d + 31 AS DATE) ELSE CAST(d + CASE dayofweek(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS DATE) END AS available FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def _(t):
    return t.read("orders").select("o_orderkey", I.available_from(F.to_date("o_orderdate"), F.col("o_orderkey") % 2 == 0).alias("available"))


@query("r1_18_coverage", sql("ret", "SELECT ticker, count(*) AS n_rows, max(date) - min(date) AS span, round(avg((r IS NOT NULL)::INT), 6) AS r_ratio, count(*) >= 20 AND max(date) - min(date) >= 25 AND avg((r IS NOT NULL)::INT) >= 0.95 AS ready FROM ret GROUP BY ticker"))
def _(t):
    return I.coverage(t.ret, "ticker", "date", ["r"], least_rows=20, least_span=25, least_ratio=0.95)


@query("r1_19_classify_titles", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^(red|blue)') THEN 'colour' WHEN regexp_matches(p_name, 'ring|bolt') THEN 'fastener' ELSE 'other' END AS category, CASE WHEN regexp_matches(p_name, '^(red|blue)') THEN 2 WHEN regexp_matches(p_name, 'ring|bolt') THEN 1 ELSE 0 END AS severity FROM part")
def _(t):
    kind, level = I.classify(F.col("p_name"), [("^(red|blue)", "colour", 2), ("ring|bolt", "fastener", 1)])
    return t.read("part").select("p_partkey", kind.alias("category"), level.alias("severity"))


@query("r1_22_fingerprint")
def _(t):
    return I.fingerprint(t.read("orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("r2_1_valid_rows", sql("labelled", "SELECT ticker, date, label FROM labelled WHERE target_valid AND label IN (0, 1)"))
def _(t):
    return C.valid_rows(t.labelled, "label", "target_valid").select("ticker", "date", "label")


@query("r2_2_sealed_check", "SELECT o_orderkey FROM orders")
def _(t):
    return C.require_none(t.read("orders"), F.col("o_totalprice") < 0, "sealed rows are present").select("o_orderkey")


@query("r2_3_leakage_names", "SELECT p_partkey, CASE WHEN p_partkey % 6 IN (1, 3) THEN 'contains target' WHEN p_partkey % 6 = 2 THEN 'contains future' END AS reason FROM part")
def _(t):
    names = F.element_at(F.array(*map(F.lit, ["f_close", "target_up", "future_ret", "my_Target", "target_lag", "u_vol"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t.read("part").select("p_partkey", C.leakage_reason(names).alias("reason"))


@query("r2_4_candidate_features", sql("features", "SELECT feature, count(*) AS n FROM features WHERE feature LIKE 'f\\_%' ESCAPE '\\' GROUP BY 1"))
def _(t):
    return t.features.filter(F.col("feature").startswith("f_") & C.leakage_reason(F.col("feature")).isNull()).groupBy("feature").agg(F.count("*").alias("n"))


@query("r2_5_leakage_correlation", sql("features", "SELECT feature, round(corr(value, target), 6) AS corr, count(DISTINCT value) AS n_values, abs(corr(value, target)) >= 0.999999 OR (count(DISTINCT value) <= 2 AND abs(corr(value, target)) >= 0.999) AS leaks FROM features GROUP BY feature"))
def _(t):
    c = complete_corr(F.col("value"), F.col("target"))
    return t.features.groupBy("feature").agg(c.alias("corr"), F.count_distinct("value").alias("n_values")).withColumn("leaks", (F.abs("corr") >= 0.999999) | ((F.col("n_values") <= 2) & (F.abs("corr") >= 0.999)))


@query("r2_6_feature_family", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'magnitude' WHEN 1 THEN 'direction' WHEN 2 THEN 'mixed' WHEN 3 THEN 'metadata' ELSE 'unknown' END AS family FROM part")
def _(t):
    names = F.element_at(F.array(*map(F.lit, ["vol_20", "ret_5", "ret_std_10", "row_id", "misc"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.read("part").select("p_partkey", C.feature_family(names).alias("family"))


@query("r2_7_label_audit", sql("labelled", "SELECT count(*) AS n, sum((stored <> label)::INT) AS mismatches, round(avg((stored <> label)::INT), 6) AS rate FROM (SELECT label, CASE WHEN ticker % 10 = 0 THEN 1 - label ELSE label END AS stored FROM labelled WHERE target_valid)"))
def _(t):
    from panelweave.operators.labels import label_audit

    v = t.labelled.filter("target_valid")
    return label_audit(v, F.when(F.col("ticker") % 10 == 0, 1 - F.col("label")).otherwise(F.col("label")), F.col("label"))


@query("r2_8_key_contract", "SELECT sum(n) AS n_rows, count(*) AS n_keys, count(*) FILTER (n > 1) AS repeated_keys, 0 AS null_rows FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def _(t):
    return C.key_contract(t.read("lineitem"), ["l_orderkey", "l_linenumber"])


@query("r2_8_join_contract", "SELECT count(*) FILTER (r IS NULL) AS left_only, count(*) FILTER (l IS NULL) AS right_only, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS \"both\" FROM (SELECT DISTINCT o_custkey AS k, 1 AS l FROM orders) FULL JOIN (SELECT c_custkey AS k, 1 AS r FROM customer) USING (k)")
def _(t):
    return C.join_contract(t.read("orders").select(F.col("o_custkey").alias("k")), t.read("customer").select(F.col("c_custkey").alias("k")), ["k"])


@query("r2_9_family_available", sql("ret", "SELECT ticker, date, (r IS NOT NULL OR (CASE WHEN errors > 0 THEN errors END) IS NOT NULL)::INT AS is_available FROM ret"))
def _(t):
    return t.ret.withColumn("e", F.when(F.col("errors") > 0, F.col("errors"))).select("ticker", "date", C.family_available(["r", "e"]).alias("is_available"))


@query("r2_10_mask_scope", sql("panel", "SELECT ticker, date, CASE WHEN bucket <> 'B2' THEN close END AS close, CASE WHEN bucket <> 'B2' THEN volume END AS volume FROM panel"))
def _(t):
    return C.mask_scope(t.panel, ["close", "volume"], F.col("bucket") == "B2").select("ticker", "date", "close", "volume")


_DAY_HASH = "(day(date) * 7919 + 13) % 31"


@query("r2_11_whole_date_sample", sql("panel", f", s AS (SELECT date, count(*) AS n FROM panel GROUP BY 1), c AS (SELECT date, n, sum(n) OVER (ORDER BY {_DAY_HASH}, date) - n AS before FROM s) SELECT ticker, date FROM panel WHERE date IN (SELECT date FROM c WHERE before + n <= 1000 OR before = 0)"))
def _(t):
    return C.whole_group_sample(t.panel, "date", F.expr(_DAY_HASH), 1000).select("ticker", "date")


@query("r2_12_negative_sample", sql("scored", "SELECT row_id, target FROM (SELECT row_id, target, row_number() OVER (PARTITION BY fold_id, target ORDER BY (row_id * 7919) % 10007, row_id) AS n FROM scored) WHERE target = 1 OR n <= 50"))
def _(t):
    w = Window.partitionBy("fold_id", "target").orderBy(F.expr("(row_id * 7919) % 10007"), "row_id")
    return t.scored.withColumn("n", F.row_number().over(w)).filter("target = 1 or n <= 50").select("row_id", "target")


@query("r2_13_spread_sample", sql("panel", "SELECT ticker, date FROM (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS p, count(*) OVER (PARTITION BY ticker) AS n FROM panel) WHERE p = 0 OR floor(p * 7 / n::DOUBLE) > floor((p - 1) * 7 / n::DOUBLE)"))
def _(t):
    return C.spread_sample(t.panel.select("ticker", "date"), 7, ["ticker"], ["date"])


@query("r2_14_common_start", sql("ret", ", d AS (SELECT date, avg((r IS NOT NULL)::INT) AS c FROM ret GROUP BY 1), s AS (SELECT date, quantile_cont(c, 0.5) OVER (ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM d), h AS (SELECT date, m, avg((m >= 0.8)::INT) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS held FROM s) SELECT min(date) AS start FROM h WHERE m >= 0.8 AND held >= 0.9"))
def _(t):
    return C.common_start(t.ret, ["r"])


@query("r3_1_sidecar_join", "SELECT o_orderkey, o_totalprice, n_lines FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) USING (o_orderkey)")
def _(t):
    side = t.read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    return t.read("orders").select("o_orderkey", "o_totalprice").join(side, "o_orderkey", "left")


@query("r3_2_composite_join", sql("ret scored", "SELECT ticker, date, s.target, round(r.r, 6) AS r FROM scored s JOIN ret r USING (ticker, date)"))
def _(t):
    return t.scored.select("ticker", "date", "target").join(t.ret.select("ticker", "date", "r"), ["ticker", "date"])


@query("r3_3_history_payload", sql("labelled", "SELECT ticker, date, label FROM labelled WHERE date >= DATE '2024-01-20' AND target_valid"))
def _(t):
    recent = t.panel.filter(F.col("date") >= F.lit("2024-01-20").cast("date")).select("ticker", "date")
    return recent.join(t.labelled.filter("target_valid").select("ticker", "date", "label"), ["ticker", "date"])


@query("r3_4_date_join", sql("panel", "SELECT ticker, date, round(close / d.total, 6) AS share FROM panel JOIN (SELECT date, sum(close) AS total FROM panel GROUP BY 1) d USING (date)"))
def _(t):
    return t.panel.join(F.broadcast(t.panel.groupBy("date").agg(F.sum("close").alias("total"))), "date", "left").select("ticker", "date", (F.col("close") / F.col("total")).alias("share"))


@query("r3_5_asof_global", "SELECT o.o_orderkey, d.price FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders) o ASOF LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS price FROM lineitem GROUP BY 1) d ON o.date >= d.date")
def _(t):
    left = t.read("orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    right = t.read("lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.max("l_extendedprice").alias("price"))
    days = left.select("date").distinct()
    return left.join(J.asof_backward(days, right, on="date", values=["price"]), "date").select("o_orderkey", "price")


@query("r3_6_asof_by_entity", sql("panel", "SELECT p.ticker, p.date, e.last_value FROM panel p ASOF LEFT JOIN (SELECT user_id AS ticker, CAST(ts AS DATE) AS date, max(value) AS last_value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) e ON p.ticker = e.ticker AND p.date >= e.date"))
def _(t):
    right = t.read("events").filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date")).agg(F.max("value").alias("last_value"))
    return J.asof_backward(t.panel.select("ticker", "date"), right, on="date", by=["ticker"], values=["last_value"])


@query("r3_7_next_date", "SELECT event_id, (SELECT min(d) FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE day(ts) % 3 <> 0) WHERE d > CAST(e.ts AS DATE)) AS effective FROM events e")
def _(t):
    e = t.read("events").select("event_id", F.to_date("ts").alias("day"))
    cal = t.read("events").filter("day(ts) % 3 <> 0").select(F.to_date("ts").alias("date"))
    return J.next_date(e, cal, at="day").select("event_id", "effective")


@query("r3_8_fold_membership", sql("panel", f", {FOLD_SQL} SELECT ticker, date, fold_id, CASE WHEN date BETWEEN validation_start AND validation_end THEN 'validation' ELSE 'train' END AS role FROM panel JOIN folds ON date BETWEEN train_start AND train_end OR date BETWEEN validation_start AND validation_end"))
def _(t):
    return J.fold_membership(t.panel.select("ticker", "date"), folds(t))


@query("r3_9_prior_folds", sql("scored", "SELECT ticker, fold_id, sum(n) OVER w AS prior_rows, sum(p) OVER w AS prior_hits FROM (SELECT ticker, fold_id, count(*) AS n, sum(target) AS p FROM scored GROUP BY 1, 2) WINDOW w AS (PARTITION BY ticker ORDER BY fold_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
def _(t):
    return J.prior_fold_sums(t.scored, "fold_id", ["ticker"], {"prior_rows": F.lit(1), "prior_hits": F.col("target")})


_MATCH = """, m AS (SELECT c.row_id AS case_id, k.row_id AS control_id, round(abs(c.score - k.score) + CASE WHEN c.market = k.market THEN 0 ELSE 0.08 END + CASE WHEN c.bucket = k.bucket THEN 0 ELSE 0.04 END + CASE WHEN c.industry = k.industry THEN 0 ELSE 0.02 END, 9) AS penalty
FROM scored c JOIN scored k ON c.date = k.date AND c.target = 1 AND k.target = 0 WHERE c.score >= 0.7)
SELECT case_id, control_id, round(penalty, 6) AS penalty, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY penalty, control_id) AS rank FROM m) WHERE rank <= 3"""


@query("r3_10_matched_controls", sql("scored", _MATCH))
def _(t):
    return J.matched_controls(t.scored, case=(F.col("target") == 1) & (F.col("score") >= 0.7), control=F.col("target") == 0, score="score", row_id="row_id", same=["date"], penalties={"market": 0.08, "bucket": 0.04, "industry": 0.02}, k=3)


@query("r3_11_temporal_pairs", sql("scored", ", m AS (SELECT c.row_id AS case_id, k.row_id AS control_id, round(abs(c.score - k.score) + 0.1 * least(abs(c.date - k.date), 756) / 756.0, 9) AS distance FROM scored c JOIN scored k ON c.ticker = k.ticker AND c.target = 1 AND k.target = 0) SELECT case_id, control_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY distance, control_id) AS n FROM m) WHERE n <= 2"))
def _(t):
    a = t.scored.filter("target = 1").select("ticker", F.col("row_id").alias("case_id"), F.col("score").alias("sa"), F.col("date").alias("da"))
    b = t.scored.filter("target = 0").select("ticker", F.col("row_id").alias("control_id"), F.col("score").alias("sb"), F.col("date").alias("db"))
    d = F.round(F.abs(F.col("sa") - F.col("sb")) + 0.1 * F.least(F.abs(F.datediff("da", "db")), F.lit(756)) / 756.0, 9)
    w = Window.partitionBy("case_id").orderBy("distance", "control_id")
    return a.join(b, "ticker").select("case_id", "control_id", d.alias("distance")).withColumn("n", F.row_number().over(w)).filter("n <= 2").drop("n")


@query("r3_12_reuse_capped_matching")
def _(t):
    return J.hierarchical_matching(t.scored, case=F.col("target") == 1, control=F.col("target") == 0, row_id="row_id", score="score", date="date", levels=[["ticker"], ["bucket"], ["market"], []], most=3)


@query("r3_13_pair_enumeration", sql("panel", ", d AS (SELECT market, date, sum(close) AS v FROM panel GROUP BY 1, 2) SELECT a.market AS a, b.market AS b, count(*) AS n, round(corr(a.v, b.v), 6) AS corr FROM d a JOIN d b ON a.date = b.date AND a.market < b.market GROUP BY 1, 2"))
def _(t):
    d = t.panel.groupBy("market", "date").agg(F.sum("close").alias("v"))
    p = d.select(F.col("market").alias("a"), "date", F.col("v").alias("x")).join(d.select(F.col("market").alias("b"), "date", F.col("v").alias("y")), "date").filter("a < b")
    return p.groupBy("a", "b").agg(F.count("*").alias("n"), complete_corr(F.col("x"), F.col("y")).alias("corr"))


@query("r3_14_lag_align", sql("panel", ", d AS (SELECT industry, day(date) AS pos, sum(close) AS v FROM panel GROUP BY 1, 2), l(lag) AS (VALUES (-1), (0), (1), (2)) SELECT a.industry AS a, b.industry AS b, lag, count(*) AS n, round(corr(a.v, b.v), 6) AS corr FROM d a CROSS JOIN l JOIN d b ON b.pos = a.pos + lag AND a.industry <> b.industry GROUP BY 1, 2, 3"))
def _(t):
    d = t.panel.groupBy("industry", F.dayofmonth("date").alias("pos")).agg(F.sum("close").alias("v"))
    return lagged_correlations(d, entity="industry", pos="pos", value="v", lags=[-1, 0, 1, 2])


_EDGES = "e AS (SELECT 'N' || (l_suppkey % 9) AS src, 'N' || (l_partkey % 9) AS dst, CAST(1 + min(l_linenumber) % 3 AS INTEGER) AS lag, count(*)::DOUBLE AS weight FROM lineitem WHERE l_suppkey % 9 <> l_partkey % 9 GROUP BY 1, 2)"


def edges(t):
    x, y = F.col("l_suppkey") % 9, F.col("l_partkey") % 9
    return t.read("lineitem").filter(x != y).groupBy(F.concat(F.lit("N"), x.cast("string")).alias("src"), F.concat(F.lit("N"), y.cast("string")).alias("dst")).agg((1 + F.min("l_linenumber") % 3).cast("int").alias("lag"), F.count("*").cast("double").alias("weight"))


@query("r3_15_two_hop", f"WITH {_EDGES} SELECT x.src AS a, x.dst AS b, y.dst AS c, x.lag + y.lag AS lag, round(sqrt(x.weight * y.weight), 6) AS score FROM e x JOIN e y ON x.dst = y.src WHERE x.src <> y.dst AND x.lag + y.lag <= 5")
def _(t):
    return J.two_hop(edges(t))


@query("r3_16_same_keys", "SELECT (SELECT count(*) FROM (SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT o_custkey FROM orders)) AS left_extra, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer)) AS right_extra")
def _(t):
    return J.same_keys(t.read("customer").select(F.col("c_custkey").alias("k")), t.read("orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("r3_17_semi_anti", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t):
    cust = t.read("customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    gone = t.read("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.read("orders").join(cust, "o_custkey", "left_semi").join(gone, "o_orderkey", "left_anti").select("o_orderkey")


__all__ = ["FOLDS", "FOLD_SQL", "edges", "folds", "rd"]
