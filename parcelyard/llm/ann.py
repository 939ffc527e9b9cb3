"""Approximate nearest neighbours: a vantage-point tree a shard, with relaxed pruning.

Nearness is the largest inner product. A vector x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm, and a query a zero:
then the distance of query and vector, sqrt(|q|^2 + M^2 - 2 q.x), falls as the product grows, and the triangle inequality holds.

Vectors are dealt in shards by hash, and every shard is one tree. A node splits its vectors at the median distance from its vantage
point. Queries walk a tree together: at each node those nearer the inside go there first, then the others, then each the other side,
unless the boundary lies farther off than the query's k-th distance so far divided by ``relax``. Factor 1 prunes only what the inequality
excludes, so the search is exact; larger factors prune more. Equal vectors are one point of the tree with all their ids.

Found distances are turned back into inner products of the original vectors in double precision, and ties go to the smaller id.

A shard's tree is built once, whatever the number of query blocks that search it, and travels as one row of some MB.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; of rows with one id each is a
candidate, and each a query with neighbours of its own if the id asks (its rows then share query_id, and ranks repeat); rows without id
take no part; only vectors of one length have an inner product, so each length is searched by itself; a query's own id is not its
neighbour; fewer than k candidates are all returned; other columns don't matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


class VantageTree:
    """Points (rows, all different) in nodes: (vantage row, radius, inside, outside), or an array of rows at a leaf."""

    def __init__(self, points: np.ndarray, leaf: int = 48, seed: int = 11):
        self.points, self.leaf, self.squares = points, leaf, (points**2).sum(1)
        self.random = np.random.RandomState(seed)
        self.root = self._split(np.arange(len(points)))

    def distances(self, to: np.ndarray, rows) -> np.ndarray:
        """From each of ``to`` to each of ``rows``."""
        d = (to**2).sum(1)[:, None] + self.squares[rows][None, :] - 2 * (to @ self.points[rows].T)
        return np.sqrt(np.maximum(d, 0.0))

    def _split(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        # Of a few vantage points, the one whose distances spread most.
        tries = self.random.choice(rows, 5, replace=False)
        d = self.distances(self.points[tries], rows)
        best = int(np.argmax(d.std(1)))
        order = np.argsort(d[best], kind="stable")
        half = len(rows) // 2
        return int(tries[best]), float(d[best][order[half]]), self._split(rows[order[:half]]), self._split(rows[order[half:]])

    def search(self, queries: np.ndarray, k: int, relax: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(distances, rows) of the k nearest found, not in order; rows is -1 where there are fewer."""
        far = np.full((len(queries), k), np.inf)
        near = np.full((len(queries), k), -1)

        def visit(node, who: np.ndarray) -> None:
            if not len(who):
                return
            if isinstance(node, np.ndarray):
                d = np.concatenate([far[who], self.distances(queries[who], node)], 1)
                r = np.concatenate([near[who], np.broadcast_to(node, (len(who), len(node)))], 1)
                if d.shape[1] > k:
                    first = np.argpartition(d, k - 1, axis=1)[:, :k]
                    d, r = np.take_along_axis(d, first, 1), np.take_along_axis(r, first, 1)
                far[who], near[who] = d[:, :k], r[:, :k]
                return
            vantage, radius, inside, outside = node
            d = self.distances(queries[who], [vantage])[:, 0]
            inner = d < radius
            visit(inside, who[inner])
            visit(outside, who[~inner])
            # What lies beyond the boundary is at least |d - radius| away; the small term makes up for rounding.
            beyond = np.abs(d - radius) * relax <= far[who].max(1) + 1e-6
            visit(outside, who[inner & beyond])
            visit(inside, who[~inner & beyond])

        visit(self.root, np.arange(len(queries)))
        return far, near


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v, length): rows that take part."""
    v = F.col(vector).cast("array<double>")
    sound = v.isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(sound)


def nearest(
    vectors: DataFrame,
    is_query: Callable,
    k: int = 20,
    relax: float = 1.6,
    shard_rows: int = 6000,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` nearest. ``is_query``: of the id's column.

    Every query meets every shard of its length, in one task a shard and block of queries; only each block's best ``k`` of a shard go on,
    so what is ranked at last is k rows a query and shard.
    """
    rows = usable(vectors, vec_id, vector)
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("length"), is_query(F.col("vec_id")).alias("asks")))
    lengths = rows.groupBy("length").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most"), F.count_if("asks").alias("queries")).where("queries > 0")
    lengths = lengths.select("length", "most", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"), F.ceil(F.col("queries") / 4096).cast("int").alias("blocks"))
    sized = rows.join(lengths, "length")

    def build(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values(["vec_id", "row"], kind="stable")
        own, ids = np.stack(points["v"].to_list()), points["vec_id"].to_numpy()
        distinct, of = np.unique(own, axis=0, return_inverse=True)
        of = of.reshape(-1)
        order = np.argsort(of, kind="stable")  # ids of each distinct vector, ascending
        begins = np.searchsorted(of[order], np.arange(len(distinct) + 1))
        lifted = np.concatenate([distinct, np.sqrt(np.maximum(points["most"].iloc[0] - (distinct**2).sum(1, keepdims=True), 0.0))], 1)
        first = points.iloc[0]
        return pd.DataFrame({"length": [first["length"]], "shard": [first["shard"]], "blocks": [first["blocks"]], "tree": [pickle.dumps((VantageTree(lifted), ids[order], begins), protocol=5)]})

    shard = F.pmod(F.xxhash64("row", F.lit(5)), F.col("shards")).cast("int")
    trees = sized.select("row", "vec_id", "v", "length", "most", "blocks", shard.alias("shard")).groupBy("length", "shard").applyInPandas(build, "length int, shard int, blocks int, tree binary")
    trees = cut(trees).select("length", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "tree")
    asked = sized.where("asks").select("length", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), "row", "vec_id", "v")

    def search(tree: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out_r, out_q, out_v, out_s = [], [], [], []
        if len(tree) and len(queries):
            points, ids, begins = pickle.loads(tree["tree"].iloc[0])
            q = np.stack(queries["v"].to_list())
            rows, q_ids = queries["row"].to_numpy(), queries["vec_id"].to_numpy()
            found = points.search(np.concatenate([q, np.zeros((len(q), 1))], 1), k + 1, relax)[1]
            for j in range(len(q)):
                best: list[tuple[float, int]] = []
                for r in found[j][found[j] >= 0].tolist():
                    score = float(np.dot(q[j], points.points[r, :-1]))
                    some = ids[begins[r] : begins[r + 1]]
                    best += [(-score, int(i)) for i in some[some != q_ids[j]][:k]]  # in order of id, so no more than k can count
                best.sort()
                for s, i in best[:k]:
                    out_r.append(int(rows[j]))
                    out_q.append(int(q_ids[j]))
                    out_v.append(i)
                    out_s.append(-s)
        return pd.DataFrame({"row": np.array(out_r, np.int64), "query_id": np.array(out_q, np.int64), "vec_id": np.array(out_v, np.int64), "score": np.array(out_s, np.float64)})

    place = ["length", "shard", "block"]
    part = trees.groupBy(*place).cogroup(asked.groupBy(*place)).applyInPandas(search, "row bigint, query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
