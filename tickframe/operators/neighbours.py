"""Exact nearest neighbours of earlier months.  Pivots and the triangle inequality rule out most of the bank: a query meets only the bins that may hold a nearer row."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import stored

#: Rings that distances to a pivot are cut into, and the most cells (month, pivot, ring) whose bounds the tasks are given.
RINGS, CELLS = 16, 200_000


def vectors(z: pd.Series, metric: str) -> np.ndarray:
    """Rows as a matrix of doubles, of unit length for cosine."""
    x = np.stack(z).astype(float)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12) if metric == "cosine" else x


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x and y, good to about 1e-7 of the greatest norm."""
    d2 = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T
    return np.sqrt(np.maximum(d2, 0))


def pivots(bank: DataFrame, most: int, metric: str) -> np.ndarray:
    """At most `most` rows of the bank, those with the least hash of their id, along their principal direction so that neighbours in the list lie near each other."""
    got = bank.orderBy(F.xxhash64("b"), "b").limit(most).select("z").toPandas()
    if not len(got):
        return np.zeros((0, 0))
    at = vectors(got["z"], metric)
    c = at - at.mean(0)
    return at[np.argsort(c @ np.linalg.svd(c, full_matrices=False)[2][0], kind="stable")]


def placed(df: DataFrame, at: np.ndarray, metric: str) -> DataFrame:
    """Rows with their nearest pivot p and the distance r to it, as a table."""
    middle = at.mean(0)

    def place(batches):
        for t in batches:
            if len(t):
                d = distances(vectors(t["z"], metric) - middle, at - middle)
                p = d.argmin(1)
                yield t.assign(p=p.astype("int32"), r=d[np.arange(len(p)), p])

    return stored(df.mapInPandas(place, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), "p int", "r double"])))


def packed(cells: pd.DataFrame, block: int) -> pd.DataFrame:
    """Cells, sorted, with their first bin and number of bins: small cells of a month share a bin of `block` rows, greater ones are dealt over several."""
    cells = cells.sort_values(["month", "p", "ring"], ignore_index=True)
    first, parts, bins, room, month = [], [], 0, 0, None
    for m, n in zip(cells["month"], cells["n"], strict=True):
        if m != month or n > room:
            first.append(bins)
            parts.append(-(-n // block))
            bins += parts[-1]
            room = block - n if n < block else 0
        else:
            first.append(bins - 1)
            parts.append(1)
            room -= n
        month = m
    return cells.assign(first=np.array(first, "int32"), parts=np.array(parts, "int32"))


def routes(query: DataFrame, cells: pd.DataFrame, at: np.ndarray, k: int, metric: str) -> DataFrame:
    """query(q, month, z, block[, tau]) -> q, z, block, bin: the bins of earlier months that the query must meet.  Without tau, the cells with the least lower bound that hold k rows
    together; with it, every cell that may hold a row within tau (null: no bound)."""
    first_round = "tau" not in query.columns
    middle = at.mean(0)
    months, pivot, n = cells["month"].to_numpy(), cells["p"].to_numpy(), cells["n"].to_numpy()
    lo, hi, first, parts = (cells[c].to_numpy() for c in ("lo", "hi", "first", "parts"))
    reach = 1 + hi.max() + np.sqrt(((at - middle) ** 2).sum(1)).max()
    step = int(max(1, min(256, 4_000_000 // len(cells))))

    def route(batches):
        for t in batches:
            for m, part in t.groupby("month"):
                upto = int(np.searchsorted(months, m))  # cells are sorted by month: these are earlier
                for i in range(0, len(part) if upto else 0, step):
                    some = part.iloc[i : i + step]
                    x = vectors(some["z"], metric) - middle
                    d = distances(x, at - middle)[:, pivot[:upto]]
                    bound = np.maximum(np.maximum(d - hi[:upto], lo[:upto] - d), 0)
                    if first_round:
                        o = np.argsort(bound, axis=1, kind="stable")
                        held = n[:upto][o]
                        keep = np.zeros(bound.shape, bool)
                        np.put_along_axis(keep, o, np.cumsum(held, 1) - held < k, 1)
                    else:  # the products are inexact: the margin is far above their error, so that nothing is lost
                        margin = 1e-6 * (reach + np.sqrt((x * x).sum(1)))
                        keep = bound <= (some["tau"].fillna(np.inf).to_numpy() + margin)[:, None]
                    row, cell = np.nonzero(keep)
                    times = parts[cell]
                    bins = np.repeat(first[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    met = pd.DataFrame({"row": np.repeat(row, times), "bin": bins}).drop_duplicates()
                    at_row = some.iloc[met["row"].to_numpy()]
                    yield pd.DataFrame({"q": at_row["q"].to_numpy(), "z": at_row["z"].to_numpy(), "block": at_row["block"].to_numpy(), "bin": met["bin"].to_numpy().astype("int32")})

    kind = {f.name: f.dataType.simpleString() for f in query.schema}
    return query.mapInPandas(route, f"q {kind['q']}, z {kind['z']}, block int, bin int")


def met(visits: DataFrame, bank: DataFrame, k: int, metric: str) -> DataFrame:
    """visits(q, z, block, bin), bank(b, z, bin) -> q, b, dist: the k nearest rows of each bin that a query visits.  A bin is copied to those query blocks alone that visit it."""
    kinds = dict(visits.dtypes)["q"], dict(bank.dtypes)["b"]
    none = pd.DataFrame({"q": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "dist": pd.Series(dtype="float64")})

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return none
        x, y, ids = vectors(left["z"], metric), vectors(right["z"], metric), right["b"].to_numpy()
        middle = y.mean(0)
        u = y - middle
        uu = (u * u).sum(1)
        rows, near = [], min(k, len(y)) - 1
        for lo in range(0, len(x), 256):
            part = x[lo : lo + 256]
            v = part - middle
            vv = (v * v).sum(1)
            d2 = vv[:, None] + uu - 2 * v @ u.T
            # the product is inexact: all within a margin of the k-th are measured again
            margin = np.partition(d2, near, 1)[:, near] + 1e-9 * (1 + uu.max() + vv)
            i, j = np.nonzero(d2 <= margin[:, None])
            d = np.sqrt(((y[j] - part[i]) ** 2).sum(1)).round(9)
            o = np.lexsort((ids[j], d, i))
            i, j, d = i[o], j[o], d[o]
            keep = np.arange(len(i)) - np.searchsorted(i, np.arange(len(part)))[i] < k
            rows.append(pd.DataFrame({"q": left["q"].to_numpy()[lo + i[keep]], "b": ids[j[keep]], "dist": d[keep]}))
        return pd.concat(rows)

    copies = bank.join(visits.select(F.col("block").alias("to"), "bin").distinct(), "bin")
    return visits.groupBy("block", "bin").cogroup(copies.groupBy("to", "bin")).applyInPandas(nearest, f"q {kinds[0]}, b {kinds[1]}, dist double")


def knn(query: DataFrame, bank: DataFrame, k: int, block: int = 2048, metric: str = "euclidean", most: int = 256) -> DataFrame:
    """query(q, month, z) and bank(b, month, z) -> q, b, dist, rank: the k nearest of strictly earlier months (ties by b); cosine is the Euclidean distance of unit vectors.

    At most `most` rows of the bank are pivots; a cell is a month's rows nearest to one pivot and in one ring of distance to it, and cells are packed into bins of about `block` rows.
    First every query meets the cells that lie nearest and hold k rows; the k-th distance found bounds what may still be nearer, and a second round meets every cell that the triangle
    inequality does not rule out.  Exact whatever the pivots: without structure in the data all bins are met, once.  Pivots and cells are bounded (`most`, CELLS) and go to the tasks; a bin's
    rows are copied to the query blocks that visit it, which hold queries near the same pivots.  Rows without month or vector are no neighbours and have none; a query with fewer than k
    earlier rows gets all of them."""
    spark = query.sparkSession
    asked = query.select("q", "month", "z").dropna()
    bank = bank.select("b", "month", "z").dropna()
    nothing = spark.createDataFrame([], f"q {dict(asked.dtypes)['q']}, b {dict(bank.dtypes)['b']}, dist double, rank int")
    rows, months = bank.agg(F.count("*"), F.count_distinct("month")).head()
    if not rows:
        return nothing
    # about four cells a bin are enough to prune by
    at = pivots(bank, int(min(most, max(1, CELLS // (RINGS * months)), max(1, 4 * rows // (RINGS * months * block)))), metric)
    bank, asked = placed(bank, at, metric), placed(asked, at, metric)
    width = (bank.agg(F.max("r")).head()[0] or 1.0) / RINGS
    ring = F.least(F.floor(F.col("r") / width), F.lit(RINGS - 1)).cast("int")
    cells = packed(bank.groupBy("month", "p", ring.alias("ring")).agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).toPandas(), block)
    held = asked.groupBy("p").agg(F.count("*").alias("n")).toPandas()
    if not len(held):
        return nothing
    deal = spark.createDataFrame(cells[["month", "p", "ring", "first", "parts"]], f"month {dict(bank.dtypes)['month']}, p int, ring int, first int, parts int")
    blocks = spark.createDataFrame(packed(held.assign(month=0, ring=0), block)[["p", "first", "parts"]], "p int, first int, parts int")
    within = lambda key: (F.col("first") + F.pmod(F.xxhash64(key), F.col("parts"))).cast("int")
    bank = bank.withColumn("ring", ring).join(F.broadcast(deal), ["month", "p", "ring"]).select("b", "z", within("b").alias("bin"))
    asked = asked.join(F.broadcast(blocks), "p").select("q", "month", "z", within("q").alias("block"))
    if cells["parts"].sum() == len(cells) and cells["first"].nunique() <= months:  # one bin a month: a first round would cost as much as it could save
        asked = asked.withColumn("tau", F.lit(None).cast("double"))
    else:
        close = met(routes(asked, cells, at, k, metric), bank, k, metric)
        tau = close.groupBy("q").agg(F.get(F.array_sort(F.collect_list("dist")), F.lit(k - 1)).alias("tau"))  # a few bins' k a query
        asked = asked.join(stored(tau), "q", "left")
    near = met(routes(asked, cells, at, k, metric), bank, k, metric)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("dist", "b"))).where(F.col("rank") <= k)
