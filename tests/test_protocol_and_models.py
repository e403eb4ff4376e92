"""Operators without SQL against brute force, and the rules that no later row may touch an earlier result."""
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tickframe.operators import checks, diagnostics, linear, models, oof, prep, retrieval, sequences
from tickframe.plans import protocol
from tickframe.sources import artifacts
from tickframe.sources.adapter import frame


@pytest.fixture(scope="module")
def preds(spark):
    return frame(spark, SF, "prd").withColumns({"squashed": F.tanh("pred_b"), "noise": ((F.col("sample_id") * 7919) % 101) / 100.0}).cache()


def test_split_tables_are_checked(spark):
    with pytest.raises(ValueError):
        protocol.splits(spark, [("X", "train", 0, 10), ("X", "score", 10, 20)])
    with pytest.raises(ValueError):
        protocol.splits(spark, [("X", "inner_train", 5, 3)])
    with pytest.raises(KeyError):
        protocol.visible_end("NONE")
    assert protocol.visible_end("H2") == 40 and len(protocol.ROLLING) == 20
    for rows in (protocol.OUTER, protocol.NESTED, protocol.ROLLING, protocol.CUTS, protocol.MATRIX, protocol.CONTEXT):
        assert protocol.splits(spark, rows).count() == len(rows)


def test_later_months_do_not_touch_earlier_blocks(preds):
    rows = lambda d: {(r.sample_id, round(r.baseline_oof, 12)) for r in oof.rolling_blocks(d, "pred_a", "pred_b", 0.37).where("month <= 50").collect()}
    changed = preds.withColumn("pred_a", F.when(F.col("month") > 50, F.col("pred_a") * 100).otherwise(F.col("pred_a")))
    assert rows(preds) == rows(changed)


def test_oof_checks_find_faults(preds):
    good = oof.rolling_blocks(preds, "pred_a", "pred_b", 0.37)
    assert all(r.violations == 0 for r in oof.oof_checks(good).collect())
    bad = good.where("month != 30").withColumn("source_train_end", F.lit(40)).unionByName(good.limit(1))
    found = {r["check"]: r.violations for r in oof.oof_checks(bad).collect()}
    assert found["leak"] > 0 and found["repeated"] == 1 and found["month_missing"] == 1


def test_outer_targets_do_not_touch_the_protocol(preds):
    run = lambda d: {r.sample_id: (r.alpha, round(r.blend, 9)) for r in models.residual_protocol(d, "T4", "pred_a", ["pred_b", "squashed"], "target", models.linear(), [0.0, 0.1, 0.2]).collect()}
    turned = preds.withColumn("target", F.when(F.col("month") > 60, -F.col("target")).otherwise(F.col("target")))
    assert run(preds) == run(turned)


def test_gate_and_evaluator(spark, preds):
    rows = spark.createDataFrame([("A", 0.001), ("B", 0.002)], "split string, delta double")
    assert models.outer_gate(rows).head().passed and not models.outer_gate(rows.unionByName(spark.createDataFrame([("C", -0.1)], rows.schema))).head().passed
    e = models.CosineEvaluator("pred_a", "target")
    assert e.isLargerBetter() and -1 <= e.evaluate(preds) <= 1


def test_neighbours_come_from_earlier_months(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(300, 6)).round(3)
    rows = [(i, i % 12, z[i].tolist()) for i in range(300)]
    bank = spark.createDataFrame(rows, "b long, month int, z array<double>")
    query = bank.toDF("q", "month", "z")
    for metric in ("euclidean", "cosine"):
        got = {}
        for r in retrieval.knn(query, bank, 4, block=16, metric=metric).collect():
            got.setdefault(r.q, {})[r["rank"]] = r.b
        x = z / np.linalg.norm(z, axis=1, keepdims=True) if metric == "cosine" else z
        for i in range(300):
            d = np.sqrt(((x - x[i]) ** 2).sum(1)).round(9)
            want = sorted((d[j], j) for j in range(300) if j % 12 < i % 12)[:4]
            assert [got.get(i, {}).get(k + 1) for k in range(len(want))] == [j for _, j in want]


def test_centres_are_k_means(spark):
    rng = np.random.default_rng(2)
    z = np.concatenate([rng.normal(m, 0.1, (60, 2)) for m in (0, 5, 10)])
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(z)], "key long, month int, z array<double>")
    start = {r.key: r.h for r in df.select("key", F.xxhash64("key").alias("h")).collect()}
    got = {m: sorted(tuple(np.round(r.z, 6)) for r in retrieval.centres(df, 3, 2, "month").where(F.col("month") == m).collect()) for m in (0, 1)}
    for m in (0, 1):
        mine = [i for i in range(180) if i % 2 == m]
        c = z[sorted(mine, key=lambda i: (start[i], i))[:3]]
        for _ in range(5):
            of = ((z[mine][:, None] - c) ** 2).sum(2).round(9).argmin(1)
            c = np.array([z[mine][of == k].mean(0) for k in range(3) if (of == k).any()])
        assert np.array(got[m]) == pytest.approx(np.array(sorted(tuple(np.round(v, 6)) for v in c)), abs=1e-5)


def test_prototypes_and_experts(spark):
    rows = [(i, i % 5, [float(i % 5), float(i % 7)], float(i % 7)) for i in range(140)]
    df = spark.createDataFrame(rows, "key long, month int, z array<double>, v double")
    p = retrieval.prototypes(df, 7, 2)
    assert p.count() <= 35 and p.agg(F.min("v"), F.max("v")).head()[0] >= 0
    pairs = retrieval.knn(df.select(F.col("key").alias("q"), "month", "z"), p.select("b", "month", "z"), 3)
    assert pairs.join(p.select("b", F.col("month").alias("pm")), "b").join(df.select(F.col("key").alias("q"), "month"), "q").where("pm >= month").count() == 0
    line = df.withColumns({"x1": F.col("z")[0], "y": 3 * F.col("z")[0]})
    est = retrieval.expert_mixture(line, line.withColumnRenamed("key", "q"), 2, 2, ["x1"], "y", 1e-9, 1.0).join(line.withColumnRenamed("key", "q"), "q")
    assert est.agg(F.max(F.abs(F.col("estimate") - F.col("y")))).head()[0] < 1e-6


def test_residual_codes_halve_the_rest(preds):
    out = prep.residual_codes(preds, "pred_a", 2, 4).agg(F.var_pop("pred_a").alias("all"), F.var_pop("left_over").alias("rest"), F.max("code_0"), F.max("code_1")).head()
    assert out["rest"] < 0.05 * out["all"] and out[2] <= 3 and out[3] <= 3


def test_fold_ridge_against_numpy(preds):
    rows = preds.where("month <= 40").withColumn("block", protocol.block_fold(F.col("month"))).select("block", "pred_a", "pred_b", "target").toPandas()
    got = {r.fold: r for r in linear.fold_ridge(preds.where("month <= 40").withColumn("block", protocol.block_fold(F.col("month"))), ["pred_a", "pred_b"], "target", "block", 10.0).collect()}
    for fold in (-1, 0, 3):
        t = rows[rows.block != fold]
        x = t[["pred_a", "pred_b"]].to_numpy()
        mu, sd = x.mean(0), x.std(0) + 1e-9
        s = (x - mu) / sd
        beta = np.linalg.solve(s.T @ s + 10 * np.eye(2), s.T @ t.target.to_numpy()) / sd
        assert [got[fold].pred_a, got[fold].pred_b, got[fold].intercept] == pytest.approx([*beta, -beta @ mu], abs=1e-9)


def test_phases_keep_the_energy(spark):
    seq = sequences.sequence(frame(spark, SF, "mkt"), 50, 3.0)
    a = sequences.phase_randomised(seq, ["imb1"]).groupBy("sample_id").agg(F.sum(F.col("imb1") * F.col("imb1")).alias("a"))
    b = seq.groupBy("sample_id").agg(F.sum(F.col("imb1") * F.col("imb1")).alias("b"))
    assert all(r.a == pytest.approx(r.b, rel=1e-6) for r in a.join(b, "sample_id").collect())


def test_staged_columns(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0)], "sample_id long, ofi_event_rate_5 double, quote_ofi_l1_rate_5 double, ofi_event_rate_acceleration double, order_trade_gap_15 double")
    assert sequences.staged(df, "A").columns == ["sample_id", "ofi_event_rate_5"] and len(sequences.staged(df, "F").columns) == 5
    with pytest.raises(ValueError):
        sequences.staged(df, "Z")


def test_submissions_and_artifacts(spark, tmp_path, preds):
    with pytest.raises(ValueError):
        artifacts.write_submission(preds.unionByName(preds.limit(1)), str(tmp_path / "a"), "pred_a")
    pair = artifacts.load_pair(preds.select("sample_id", "target"), preds.select("sample_id", "pred_a"))
    assert pair.count() == preds.count()
    with pytest.raises(ValueError):
        artifacts.load_pair(preds.select("sample_id", "target"), preds.select("sample_id").where("month > 3"))
    assert '"rows": ' in artifacts.summary_json(artifacts.run_summary(preds.select("sample_id", "month", "target")))


def test_arrow_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.ipc as ipc

    table = pa.table({"a": list(range(100)), "b": [f"t{i}" for i in range(100)], "c": [0.5] * 100})
    path = str(tmp_path / "x.feather")
    with ipc.new_file(path, table.schema) as f:
        for batch in table.to_batches(30):
            f.write_batch(batch)
    df = artifacts.read_arrow(spark, path)
    assert df.columns == ["a", "b", "c"] and df.agg(F.sum("a")).head()[0] == 4950
    part = artifacts.read_arrow(spark, path, "a long, c double")
    assert part.columns == ["a", "c"] and part.rdd.getNumPartitions() == 4


def test_names_are_replayed():
    h = checks.name_hash(["a", "b"])
    checks.require_names(["a", "b"], h)
    with pytest.raises(ValueError):
        checks.require_names(["b", "a"], h)


def test_disagreement_of_scaled_copies_is_zero(preds):
    out = diagnostics.unit_disagreement(preds.withColumn("twice", 2 * F.col("pred_a")), "pred_a", "twice")
    assert out.agg(F.max(F.abs("disagreement"))).head()[0] < 1e-12


def test_required_columns(preds):
    assert checks.required_columns(preds, ["month", "target"]) == [] and checks.required_columns(preds, ["month", "none", "also"]) == ["also", "none"]
