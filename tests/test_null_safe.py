"""Columns that do not vary and windows that hold almost nothing: defined results, no errors."""
import pytest
from pyspark.sql import functions as F

from tickframe.operators import asof, audit, diagnostics, metrics, micro, prep


@pytest.fixture()
def flat(spark):
    """x varies, c does not, some c are null."""
    return spark.createDataFrame([(i, i % 2, float(i), 0.1, None if i == 2 else 0.3) for i in range(6)], "id long, month int, x double, c double, n double")


def test_correlation_of_a_constant(flat):
    got = flat.agg(metrics.correlation("x", "c").alias("a"), metrics.correlation("c", "n").alias("b"), metrics.correlation("x", "x").alias("s"), metrics.centred("x", "c").alias("z"), metrics.centred("x", "n").alias("zn")).head()
    assert got.a is None and got.b is None and got.s == pytest.approx(1.0) and got.z == 0.0 and got.zn == 0.0


def test_correlation_like_builtin(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (4.0, 5.0), (None, 7.0), (5.0, None)], "x double, y double")
    got = df.agg(metrics.correlation("x", "y").alias("a"), F.corr("x", "y").alias("b")).head()
    assert got.a == pytest.approx(got.b)
    assert df.where("x > 9").agg(metrics.correlation("x", "y").alias("a")).head().a is None


def test_users_of_correlations(flat):
    assert metrics.spearman(flat, "x", "c", ["month"]).where("spearman is null").count() == 2
    assert prep.correlated(flat, ["c", "x"], "x", 0.5).head() == (False, True)
    kept = {r.name: r.kept for r in prep.select_features(flat, ["c", "x"], "x", 0.1, 0.9).collect()}
    assert kept == {"c": False, "x": True}
    assert audit.correlation_pairs(flat, ["x", "c"]).head().corr is None
    assert diagnostics.prediction_report(flat, "c", "x", "month").where("reference_corr = 0").count() == 2
    assert diagnostics.associations(flat, "c", "x", ["month"]).where("pearson is null and spearman is null").count() == 2
    assert {r["round"]: r.r2 for r in diagnostics.permutation_null(flat, "c", "x", "id", "month", 1).collect()} == {0: None, 1: None}
    assert diagnostics.drift_report(flat, "c", F.col("month") == 1).count() == 2
    assert audit.magnitude_buckets(flat, "c", "x").count() >= 1
    months = spark_months(flat)
    assert audit.monthly_mean_diagnostics(months, lags=(1,)).head().acf_1 is None
    assert audit.orthogonal_residual(flat, "c", "x", "month").count() == 2


def spark_months(df):
    return df.sparkSession.createDataFrame([(m, 0.5, 0.1) for m in range(5)], "month int, mean double, se double")


QUOTE = "sample_id long, seq long, seconds_before_predict double, bid_price_1 double, ask_price_1 double, bid_price_2 double, ask_price_2 double, bid_volume_1 double, ask_volume_1 double, bid_volume_2 double, ask_volume_2 double, transaction_volume double"


def quotes(spark, *seconds):
    return spark.createDataFrame([(1, i, float(s), 1.0, 1.2, 0.9, 1.3, 5.0, 6.0, 7.0, 8.0, 1.0) for i, s in enumerate(seconds)], QUOTE), spark.createDataFrame([(1, 3, 0.5), (2, 3, 0.1)], "sample_id long, month int, target double")


def test_one_covered_second(spark):
    """The newest quote at 0.5 s covers second 0 only: no pair of seconds in any window."""
    got = {r.sample_id: r for r in asof.geometry_temporal(*quotes(spark, 0.5)).collect()}
    assert got[1]["geom_t5_coverage"] == pytest.approx(1 / 6) and got[1]["geom_t5_corr_0_2"] == 0.0 and got[1]["geom_t60_leadlag_4_5"] == 0.0
    assert got[2]["geom_t5_coverage"] in (0.0, None)


def test_mid_that_does_not_move(spark):
    m, label = quotes(spark, 50, 40, 30, 20, 10, 5)
    got = {r.sample_id: r for r in micro.long_context(m, label).collect()}
    assert got[1]["seg_0_60_acf"] in (None, 0.0) and got[1]["seg_0_60_step"] == 0.0
