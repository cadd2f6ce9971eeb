"""Nearest vectors by low-dimensional stable projections indexed by a kd-tree.

Unit vectors are projected to DIMS Gaussian coordinates. A kd-tree grown on a bounded sample cuts the projected space in
cells; every vector is stored in its cell. A query takes the vectors of a cell in the order of their projected distance
and verifies them on the original vectors. If s is the distance of the k-th nearest one found so far, a nearer vector's
squared projected distance over s * s is below a chi-square variable with DIMS degrees, so the query stops as soon as
the projected distance is so large that this has probability 1 - SURE. The first round searches the query's own cell;
the second one the cells that the test leaves open, from the bound of the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripledger.llm.common import held, tidied

DIMS = 12
SURE = 0.98
#: Rows of the sample on which the tree is grown, rows aimed at per cell, and cells at most (the tree is broadcast).
SAMPLE_ROWS = 20_000
CELL_ROWS = 4096
MOST_CELLS = 1024
#: Vectors of a block of a cell, queries that meet a block together, vectors verified between two tests.
BLOCK_ROWS = 4096
QUERY_ROWS = 2048
STEP = 128
#: Squared distances below this are rounding.
ROUNDING = 1e-9


def chi_square(p: float, degrees: int) -> float:
    """Quantile by the cube approximation of Wilson and Hilferty."""
    a = 2 / (9 * degrees)
    return degrees * (1 - a + NormalDist().inv_cdf(p) * a**0.5) ** 3


def grow(points: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """A tree as nodes (axis, cut, low child, high child); a leaf has axis -1 and its cell number as low child."""
    nodes: list[tuple[int, float, int, int]] = []
    leaves = 0

    def add(rows: np.ndarray, share: int) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append((-1, 0.0, 0, 0))
        if share > 1 and len(rows) > 1:
            axis = int(np.argmax(points[rows].max(0) - points[rows].min(0)))
            values = points[rows, axis]
            cut = float(np.median(values))
            low = values <= cut
            if low.all():
                low = values < cut
                cut = float(values[low].max()) if low.any() else cut
            if low.any() and not low.all():
                a = add(rows[low], share // 2)
                b = add(rows[~low], share - share // 2)
                nodes[at] = (axis, cut, a, b)
                return at
        nodes[at] = (-1, 0.0, leaves, 0)
        leaves += 1
        return at

    add(np.arange(len(points)), cells)
    return nodes


def cells_of(nodes: list[tuple[int, float, int, int]], points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        axis, cut, a, b = nodes[at]
        if axis < 0:
            out[rows] = a
            continue
        low = points[rows, axis] <= cut
        todo += [(a, rows[low]), (b, rows[~low])]
    return out


def _search(vectors: np.ndarray, ids: np.ndarray, units: np.ndarray, near: np.ndarray, query: np.ndarray, own: int, bound: float, k: int, limit: float) -> list[tuple[int, float]]:
    """(id, cosine) of up to k vectors of a block, found in projected order until the chi-square test holds."""
    best: list[tuple[float, int]] = []
    order = np.argsort(near, kind="stable")
    size = np.sqrt((query * query).sum())
    for lo in range(0, len(order), STEP):
        if near[order[lo]] > limit * (bound + ROUNDING):
            break
        part = order[lo:lo + STEP]
        part = part[ids[part] != own]
        cosine = (vectors[part] * query).sum(1) / (units[part] * size)
        best += [(-c, i) for c, i in zip(cosine.tolist(), ids[part].tolist(), strict=True)]
        best = sorted(best)[:k]
        if len(best) == k:
            bound = min(bound, max(0.0, 2 + 2 * best[-1][0]))
    return [(i, -c) for c, i in best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found by cosine, ties to the smaller id.

    ``queries`` has the same columns as ``vectors``; a query is no neighbour of its own id. Vectors that are null,
    zero, hold null or non-finite components or have another length than most take no part. Of equal vectors only the
    k + 1 smallest ids can be among the nearest, so only they are searched; repeated rows of an id and vector count
    once. Fewer candidates give fewer rows; empty tables give none. Other columns are not read.
    """
    spark, parts = vectors.sparkSession, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sound(df: DataFrame) -> DataFrame:
        values = F.col(embedding).cast("array<double>")
        good = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
        return df.where(F.col(vec_id).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), values.alias("v"))

    lengths = sound(vectors).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    width = lengths[0]["n"] if lengths else 0
    plane = np.random.default_rng(11).normal(size=(width, DIMS))
    limit = chi_square(SURE, DIMS)

    @F.pandas_udf("array<double>")
    def projected(v: pd.Series) -> pd.Series:
        rows = np.stack(v.to_numpy()) if len(v) else np.zeros((0, width))
        return pd.Series(list((rows / np.sqrt((rows * rows).sum(1, keepdims=True))) @ plane))

    same = Window.partitionBy("v").orderBy("vec_id")
    index = sound(vectors).where(F.size("v") == width).distinct().withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy")
    index = held(index.withColumn("p", projected("v")))
    asked = held(sound(queries).where(F.size("v") == width).dropDuplicates(["vec_id"]).withColumn("p", projected("v")))

    share = min(1.0, SAMPLE_ROWS / max(1, index.count()))
    sample = index.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("p").limit(SAMPLE_ROWS).collect()
    points = np.array([r["p"] for r in sample]).reshape(-1, DIMS)
    cells = 1
    while cells < min(MOST_CELLS, index.count() / CELL_ROWS):
        cells *= 2
    nodes = grow(points, cells)

    @F.pandas_udf("long")
    def cell(p: pd.Series) -> pd.Series:
        return pd.Series(cells_of(nodes, np.stack(p.to_numpy()))) if len(p) else pd.Series([], dtype="int64")

    stored = index.withColumn("cell", cell("p"))
    edges = [f(F.get("p", F.lit(i))).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(DIMS)]
    boxes = stored.groupBy("cell").agg(F.count("*").alias("n"), *edges).collect()  # at most MOST_CELLS rows
    names = np.array([b["cell"] for b in boxes], np.int64)
    low, high = (np.array([[b[f"{n}{i}"] for i in range(DIMS)] for b in boxes]).reshape(-1, DIMS) for n in ("lo", "hi"))
    blocks = {int(b["cell"]): -(-b["n"] // BLOCK_ROWS) for b in boxes}

    def route(home: bool):
        @tidied
        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch) or not len(names):
                    continue
                p = np.stack(batch["p"].to_numpy())
                own = names[np.argmin([[((np.maximum(low - x, 0) + np.maximum(x - high, 0)) ** 2).sum(1)] for x in p], axis=2)[:, 0]]
                for i, x in enumerate(p):
                    away = ((np.maximum(low - x, 0) + np.maximum(x - high, 0)) ** 2).sum(1)
                    bound = batch["bound"].iloc[i]
                    to = [own[i]] if home else names[(away <= limit * (bound + ROUNDING)) & (names != own[i])]
                    to = [(c, b) for c in to for b in range(blocks[int(c)])]
                    if to:
                        yield pd.DataFrame({"cell": [c for c, _ in to], "block": [b for _, b in to], "vec_id": batch["vec_id"].iloc[i],
                                            "v": [batch["v"].iloc[i]] * len(to), "p": [x] * len(to), "bound": bound})
        return rows

    def meet(asked_rows: DataFrame, home: bool) -> DataFrame:
        sent = held(asked_rows.mapInPandas(route(home), "cell long, block long, vec_id long, v array<double>, p array<double>, bound double"))
        chunks = {r["cell"]: -(-r["n"] // QUERY_ROWS) for r in sent.groupBy("cell", "block").count().groupBy("cell").agg(F.max("count").alias("n")).collect()}
        if not chunks:
            return spark.createDataFrame([], "query_id long, vec_id long, score double")
        many = F.create_map(*[F.lit(x) for kv in chunks.items() for x in kv])
        split = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])
        left = stored.where(F.col("cell").isin(list(chunks))).select(
            "cell", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.element_at(split, F.col("cell"))).alias("block"),
            F.explode(F.sequence(F.lit(0), F.element_at(many, F.col("cell")) - 1)).alias("chunk"), "vec_id", "v", "p")
        right = sent.select("cell", "block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.element_at(many, F.col("cell"))).cast("int").alias("chunk"), "vec_id", "v", "p", "bound")
        keys = ["cell", "block", "chunk"]

        def join(key: tuple, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(rows) and len(asks):
                v, p, ids = np.stack(rows["v"].to_numpy()), np.stack(rows["p"].to_numpy()), rows["vec_id"].to_numpy()
                units = np.sqrt((v * v).sum(1))
                for own, query, x, bound in zip(asks["vec_id"], asks["v"], asks["p"], asks["bound"], strict=True):
                    near = ((p - x) ** 2).sum(1)
                    found += [(own, i, c) for i, c in _search(v, ids, units, near, np.asarray(query), own, bound, k, limit) if 2 - 2 * c <= bound + ROUNDING]
            return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

        return left.repartition(parts, *keys).groupBy(*keys).cogroup(right.repartition(parts, *keys).groupBy(*keys)).applyInPandas(
            join, "query_id long, vec_id long, score double")

    def top(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = held(top(meet(asked.withColumn("bound", F.lit(4.0)), True)).drop("rank"))
    reached = first.groupBy("query_id").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    bounds = asked.join(reached.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn(
        "bound", F.when(F.col("n") == k, F.greatest(F.lit(0.0), 2 - 2 * F.col("worst"))).otherwise(F.lit(4.0)))
    second = meet(bounds.select("vec_id", "v", "p", "bound"), False)
    return top(first.union(second)).select("query_id", "rank", "vec_id", "score")
