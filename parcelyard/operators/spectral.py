"""Leading eigenvectors of a graph's normalised adjacency, and the diffusion layout made from them.

Vectors are rows (node, y): a node's value in each of a few vectors, as an array. What comes to the driver are inner products of the
vectors, a few hundred numbers whatever the graph's size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.rng import PRIME, keyed


def normalised(edges: DataFrame) -> DataFrame:
    """(src, dst, a), both ways: 1 / sqrt(degree degree) for every two nodes that a positive link joins in either direction; no self loops."""
    links = edges.where("w > 0 and src <> dst").select("src", "dst")
    both = cut(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    degree = both.groupBy(F.col("src").alias("node")).agg(F.count("*").cast("double").alias("_d"))
    a, b = (degree.select(F.col("node").alias(end), F.col("_d").alias(f"_{end}")) for end in ("src", "dst"))
    return cut(both.join(a, "src").join(b, "dst").select("src", "dst", (1 / F.sqrt(F.col("_src") * F.col("_dst"))).alias("a")))


def _times(links: DataFrame, rows: DataFrame, width: int, column: str) -> DataFrame:
    """(node, ay): the matrix times the vectors."""
    walked = links.join(rows.select(F.col("node").alias("dst"), F.col(column).alias("_y")), "dst")
    return walked.groupBy(F.col("src").alias("node")).agg(F.array(*(F.sum(F.col("a") * F.col("_y")[k]) for k in range(width))).alias("ay"))


def _mixed(y: str, matrix: np.ndarray) -> Column:
    """The array ``y`` times a small matrix."""
    return F.array(*(sum((F.col(y)[i] * float(matrix[i, j]) for i in range(1, matrix.shape[0])), F.col(y)[0] * float(matrix[0, j])) for j in range(matrix.shape[1])))


def eigenvectors(links: DataFrame, k: int, tolerance: float = 1e-8, spare: int = 6, degree: int = 8, rounds: int = 200) -> tuple[np.ndarray, DataFrame]:
    """(values, (node, y)): the ``k`` largest eigenvalues, descending, and orthonormal vectors of a symmetric matrix with spectrum in [-1, 1].

    Subspace iteration of k + ``spare`` vectors: a round applies a Chebyshev polynomial of ``degree`` that is small from -1 to the least value
    found and grows beyond, then turns the vectors into the best within their span. It ends when |A y - value y| of all k is under
    ``tolerance``; if ``rounds`` don't reach it that is an error. A small graph gives as many values as it has nodes.
    """
    nodes = cut(links.select(F.col("src").alias("node")).distinct())
    n = nodes.count()
    width, k = min(k + spare, n), min(k, n)
    if not n:
        return np.zeros(0), nodes.withColumn("y", F.array().cast("array<double>"))
    block = nodes.withColumn("y", F.array(*(keyed(F.lit(j + 1), F.xxhash64("node") % 1_000_003 + 1_000_003) / float(PRIME) - 0.5 for j in range(width))))
    low = 0.0
    for done in range(rounds):
        if done:  # three-term recurrence on (x - centre) / half
            centre, half = (low - 1) / 2, (low + 1) / 2
            before, rows = None, block
            for _ in range(degree):
                step = rows.join(_times(links, rows, width, "y"), "node")
                scale = (2 if before is not None else 1) / half
                new = F.transform(F.arrays_zip("y", "ay"), lambda z: scale * (z["ay"] - centre * z["y"]))  # noqa: B023
                step = step.select("node", new.alias("_new"), "y", *([] if before is None else ["b"]))
                if before is not None:
                    step = step.withColumn("_new", F.zip_with("_new", "b", lambda x, b: x - b))
                rows = before = cut(step.select("node", F.col("_new").alias("y"), F.col("y").alias("b")))  # else the plan doubles with each step
            block = rows.select("node", "y")
        both = cut(block.join(_times(links, block, width, "y"), "node"))
        pairs = [(i, j) for i in range(width) for j in range(i, width)]
        sums = both.agg(*(F.sum(F.col("y")[i] * F.col(c)[j]) for c in ("y", "ay") for i, j in pairs)).first()
        gram, form = np.zeros((width, width)), np.zeros((width, width))
        for at, (i, j) in enumerate(pairs):
            gram[i, j] = gram[j, i] = sums[at]
            form[i, j] = form[j, i] = sums[at + len(pairs)]
        size = 1 / np.sqrt(np.diag(gram))
        s, u = np.linalg.eigh(gram * size[:, None] * size)
        whiten = size[:, None] * u[:, s > 1e-14 * s[-1]] / np.sqrt(s[s > 1e-14 * s[-1]])
        values, turn = np.linalg.eigh(whiten.T @ form @ whiten)
        values, turn = values[::-1], (whiten @ turn)[:, ::-1]
        width, low = len(values), float(min(max(values[-1], -0.9), 0.9))
        turned = cut(both.select("node", _mixed("y", turn).alias("y"), _mixed("ay", turn).alias("ay")))
        left = turned.agg(*(F.sqrt(F.sum(F.pow(F.col("ay")[j] - float(values[j]) * F.col("y")[j], 2))) for j in range(min(k, width)))).first()
        block = turned.select("node", "y")
        if width >= k and max(left) < tolerance:
            return values[:k], block.select("node", F.slice("y", 1, k).alias("y"))
    raise ValueError(f"the vectors' residual is {max(left):.2g} after {rounds} rounds")


def diffusion_positions(edges: DataFrame, nodes: DataFrame | None = None, components: tuple[int, ...] = (2, 3), scaled: bool = True, tolerance: float = 1e-8) -> DataFrame:
    """(node, p1, p2, ..): a node's place on the given components (1 is the first) of the graph's diffusion spectrum.

    Links count as present or not. A vector is multiplied by its eigenvalue if ``scaled``, turned so that its largest entry (ties to the least
    node) is positive, less its mean, and divided by its span. ``nodes``: (node) that the result is to have; those without links have 0 before
    centring. Vectors of equal eigenvalues, as of a graph in several parts, are any basis of their space. An empty graph gives no rows or zeros.
    """
    links = normalised(edges)
    values, vectors = eigenvectors(links, max(components), tolerance)
    rows = vectors if nodes is None else nodes.select("node").distinct().join(vectors, "node", "left")
    wanted = [c for c in components if c <= len(values)]
    rows = cut(rows.select("node", *(F.coalesce(F.col("y")[c - 1] * float(values[c - 1] if scaled else 1.0), F.lit(0.0)).alias(f"_{c}") for c in wanted)))
    facts = []
    for c in wanted:
        pivot = F.max_by(F.signum(f"_{c}"), F.struct(F.round(F.abs(f"_{c}"), 9), -F.col("node")))
        facts += [pivot.alias(f"_s{c}"), F.avg(f"_{c}").alias(f"_m{c}"), (F.max(f"_{c}") - F.min(f"_{c}")).alias(f"_r{c}")]
    out = rows.crossJoin(F.broadcast(rows.agg(*facts))) if facts else rows  # one row is broadcast
    sign = lambda c: F.when(F.col(f"_s{c}") < 0, -1.0).otherwise(1.0)
    place = {c: F.when(F.col(f"_r{c}") > 1e-12, sign(c) * (F.col(f"_{c}") - F.col(f"_m{c}")) / F.col(f"_r{c}")).otherwise(sign(c) * F.col(f"_{c}")) for c in wanted}
    return out.select("node", *((place[c] if c in place else F.lit(0.0)).alias(f"p{k}") for k, c in enumerate(components, 1)))
