"""Learners in the month protocol as queries.  Their fits are iterative, so there is no SQL; tests check them against their parts."""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import asof, context as C, families as E, metrics as I, micro, models as M, sequences as Q
from ..plans import protocol as H
from ..session import scratch_path, stored
from ..sources.adapter import frame, read_tables
from .production import ALPHAS

QUERIES: dict = {}
ORACLES: dict = {}
GROUPS = {"members": ["pred_b", "squashed"], "products": ["product"], "noise": ["noise"]}
FEATURES = [f for fs in GROUPS.values() for f in fs]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _rows(spark, d):
    p = frame(spark, d, "prd")
    return p.withColumns({"squashed": F.tanh("pred_b"), "product": F.col("pred_a") * F.col("pred_b"), "noise": ((F.col("sample_id") * 7919) % 101) / 100.0})


def _stored_rows(spark, d):
    """The rows as a narrow table, which linear fits read many times.  Boosted trees find their bins on a sample that goes by partitions, so theirs stay as they are."""
    return stored(_rows(spark, d))


@query
def residual_protocol(spark, d):
    """Boosted residual learner, stopped on the tune months and refitted with as many trees, over all four outer splits: alpha, trees, cosines and gain."""
    p, fits = _rows(spark, d), {}
    return M.outer_summary({k: M.residual_protocol(p, k, "pred_a", FEATURES, "target", M.Stopped(12), ALPHAS, fits=fits) for k in H.NESTED_MONTHS}, "pred_a", "target")


def _frames(t):
    """Feature frames of the samples: geometry, its path, signature, interactions with flows, normalised windows and their context part."""
    geometry, flow, windows = E.lob_geometry(t.market), E.event_flow(t.order, t.trade, t.label), micro.normalised_windows(t.market, t.order, t.trade, t.label)
    context = windows.select("sample_id", *[c for c in windows.columns if re.match(Q.CONTEXT, c)])
    return {"geometry": E.onto_spine(t.label, geometry), "temporal": asof.geometry_temporal(t.market, t.label), "signature": asof.path_signature(t.market, t.trade, t.label), "interactions": E.interactions(geometry, flow), "windows": windows, "context": context}


@query
def frame_candidates(spark, d):
    """Residual protocol with a linear learner over six frames of order-book features and the last two outer splits: a run table with feature hashes."""
    t = read_tables(spark, d)
    rows = t.label.join(frame(spark, d, "prd").select("sample_id", "pred_a"), "sample_id")
    frames = _frames(t)
    frames["windows"] = stored(frames["windows"])  # the context is a part of it
    frames["context"] = frames["windows"].select(*frames["context"].columns)
    return M.run_candidates(rows, frames, "pred_a", "target", M.linear(0.1), ALPHAS, ("T3", "T4"))


@query
def feature_count_curve(spark, d):
    """Gain of the protocol on the first features by importance, and on those with any importance."""
    p = _rows(spark, d)
    ranked = M.importances(p.where(F.col("month") <= H.NESTED_MONTHS["T4"][0][1]), ["pred_a", *FEATURES], "target")
    return M.count_curve(lambda f: M.residual_protocol(p, "T4", "pred_a", f, "target", M.linear(), ALPHAS), ranked, (1, 2, 3, 5), "pred_a", "target")


@query
def residual_candidates(spark, d):
    """The same protocol with a linear learner over several feature frames, and the gate over the outer splits of each."""
    p, out, fits = _stored_rows(spark, d), None, {}
    for name, features in GROUPS.items():
        runs = {k: M.residual_protocol(p, k, "pred_a", features, "target", M.linear(), ALPHAS, fits=fits) for k in ("T3", "T4")}
        one = M.outer_gate(M.outer_summary(runs, "pred_a", "target")).withColumn("frame", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query
def domain_shift(spark, d):
    """How well early and late months can be told apart, and which feature groups tell."""
    score, shares = M.domain_check(_rows(spark, d), FEATURES, F.col("month") > 50, H.random_fold("sample_id", 3) == 0, GROUPS)
    return shares.join(F.broadcast(score))


@query
def feature_screen(spark, d):
    """Per feature group its gain in the protocol against how much it tells the months apart."""
    p, out = _stored_rows(spark, d), None
    for name, features in GROUPS.items():
        gain = M.outer_summary({name: M.residual_protocol(p, "T4", "pred_a", features, "target", M.linear(), ALPHAS)}, "pred_a", "target")
        shift, _ = M.domain_check(p, features, F.col("month") > 50, H.random_fold("sample_id", 3) == 0, {name: features})
        one = gain.select(F.col("split").alias("name"), "delta").join(shift)
        out = one if out is None else out.unionByName(one)
    return out


@query
def group_ablation(spark, d):
    """The protocol without each feature group."""
    p = _stored_rows(spark, d)
    return M.ablations(lambda f: M.residual_protocol(p, "T4", "pred_a", f, "target", M.linear(), ALPHAS), GROUPS, "pred_a", "target")


@query
def table_ensemble(spark, d):
    """Boosted trees, as many as the tune months' cosine asks for, and two linear learners, blended 0.2 / 0.5 / 0.3 and refitted, over all four outer splits: cosine of each a month, and the trees."""
    p, out = _rows(spark, d), []
    members = {"trees": (0.2, M.Stopped(8, by="cosine")), "ridge": (0.5, M.linear()), "plain": (0.3, M.linear(0.0))}
    for k in H.NESTED_MONTHS:
        rows, found = M.ensemble_protocol(p, k, ["pred_a", *FEATURES], "target", members)
        out.append(rows.groupBy("month").agg(*[I.cosine(c, "target").alias(c) for c in (*members, "blend")]).select(F.lit(k).alias("split"), "*", F.lit(found["trees"]).alias("n_trees")))
    return reduce(DataFrame.unionByName, out)


@query
def size_gate(spark, d):
    """A prediction gated by a learnt size of the target: cosine before and after, per month."""
    p = _stored_rows(spark, d)
    out = M.size_gate(p.where("month <= 50"), p.where("month > 50"), "pred_a", FEATURES, "target", M.linear())
    return out.groupBy("month").agg(I.cosine("pred_a", "target").alias("plain"), I.cosine("gated", "target").alias("gated"))


def _context(spark, d):
    """Score rows of the context diagnostic, and the written table that they come from."""
    t = read_tables(spark, d)
    rows = _frames(t)["context"].join(t.label, "sample_id").join(frame(spark, d, "prd").select("sample_id", "pred_a"), "sample_id")
    features = [c for c in rows.columns if re.match(Q.CONTEXT, c)]

    def written(df):
        path = scratch_path(spark)
        df.write.parquet(path)
        return spark.read.parquet(path)

    rows = written(rows)
    return rows, features, written(C.forward_models(rows, H.CONTEXT, features, "pred_a", "target", M.boosted(8, 3)))


@query
def context_models(spark, d):
    """Ridge and boosted trees of the context on forward splits: scores by split and pooled."""
    return C.forward_scores(_context(spark, d)[2])


@query
def context_gate(spark, d):
    """Whether the trees pass the diagnostic's gate."""
    return C.forward_gate(_context(spark, d)[2])


@query
def context_bias(spark, d):
    """What the trees miss by quartile of each context column."""
    rows, features, scored = _context(spark, d)
    return C.context_bias(rows, scored, H.CONTEXT, features)
