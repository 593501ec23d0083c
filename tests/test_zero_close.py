"""Queries on events where some users' days sum up to a close of 0, so that the return of the day after is infinite (or NaN, 0 against 0)."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from panelweave.functions.scalar import ln, ratio, sign
from panelweave.plans import QUERIES, SQL
from panelweave.plans.registry import Tables, sql
from tests.test_queries import FOLDER, TABLES, order, plain

#: Each failed by DIVIDE_BY_ZERO in the panel's returns.
NAMES = """
r10_10_two_stage
r10_11_calibration_choice
r10_14_15_historical_rank
r10_12_apply_calibrator
r10_17_rank_average
r10_13_tie_break
r10_16_score_blend
r10_18_family_ensemble
r10_20_stack
r10_19_simplex_search
r10_1_calibration_error
r10_21_meta_features
r10_22_logit_blend
r10_23_hard_negative_weights
r10_24_ablation_plan
r10_25_paired_deltas
r10_27_sensitivity_pivot
r10_26_ablation_tiers
r10_28_nonadditivity
r10_29_permutation_importance
r10_2_brier_logloss
r10_30_base_matched
r10_31_champion
r10_32_matched_probe
""".split()
#: These divide by prices themselves, cast or fit what comes of it; r10_8_forward_logistic stands for all fits on the same features.
NAMES += """
r4_6_label_from_closes
r5_10_drawdown
r5_13_signed_streak
r5_20_range_volatility
r5_20_range_volatility_full
r5_21_microstructure
r5_22_limit_stress
r5_24_price_block
r7_50_granger
r10_8_forward_logistic
""".split()


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    folder, con = tmp_path_factory.mktemp("zeros"), duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if t != "events" and os.path.exists(f"{FOLDER}/{t}.parquet"):
            (folder / f"{t}.parquet").symlink_to(f"{FOLDER}/{t}.parquet")
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN (user_id * 3 + day(ts)) % 11 < 2 OR event_id % 17 = 0 THEN 0.0 ELSE value END AS value) FROM '{FOLDER}/events.parquet' ORDER BY event_id) TO '{folder}/events.parquet' (FORMAT parquet)")
    for p in folder.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_zero_close(spark, zeros, name):
    folder, con = zeros
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=order)
    assert got
    if name in SQL:
        rel = con.sql(SQL[name])
        at = [rel.columns.index(c) for c in columns]
        want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=order)
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            for x, y in zip(a, b, strict=True):
                assert x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-6 * max(1, abs(y)), (name, a, b)


def test_returns_after_a_close_of_zero(spark, zeros):
    """Infinite and NaN returns, and the labels that come of them, are SQL's."""
    folder, con = zeros
    columns = "ticker", "date", "r", "best", "label", "target_valid", "first_hit_day"
    tell = lambda rows: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    got = tell(Tables(spark, folder).labelled.select(*columns).collect())
    assert got == tell(con.sql(sql("labelled", f"SELECT {', '.join(columns)} FROM labelled")).fetchall())
    assert {"inf", "nan", "-1"} <= {r[2] for r in got} and {"inf", "nan"} <= {r[3] for r in got}


def test_division_logarithm_and_sign(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 0.0), (-3.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None)], "a double, b double")
    assert [str(r[0]) for r in df.select(ratio(F.col("a"), F.col("b"))).collect()] == ["0.5", "inf", "-inf", "nan", "None", "None"]
    x = spark.createDataFrame([(0.0,), (1.0,), (math.inf,), (math.nan,), (None,)], "x double").select(ln(F.col("x")), sign(F.col("x"))).collect()
    assert [tuple(map(str, r)) for r in x] == [("-inf", "0.0"), ("0.0", "1.0"), ("inf", "1.0"), ("nan", "0.0"), ("None", "None")]
