"""Connected components of an edge table by alternating star operations.

Only edges and labels move through shuffles; nothing is collected but one count and one
checksum a round.  Each round is checkpointed in the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) other than the roots; a root is the
    least node of its component."""
    state = None
    edges = checkpointed(edges.filter("u != v").select("u", "v"))
    for _ in range(max_rounds):
        edges = checkpointed(_small_star(_large_star(edges)))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError("the components did not settle")


class Forest:
    """Disjoint sets over the rows of one task; a set is named by its least row."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        top = self.up[at]
        while True:
            more = self.up[top]
            if (more == top).all():
                return top
            top = more

    def join(self, link: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
        """Join the members of a matrix of links: labels spread over it until they settle."""
        r, c, big = self.roots(rows), self.roots(cols), len(self.up)
        new_r, new_c = r.copy(), c.copy()
        while True:
            after_r = np.minimum(new_r, np.where(link, new_c[None, :], big).min(axis=1))
            after_c = np.minimum(new_c, np.where(link, after_r[:, None], big).min(axis=0))
            if (after_r == new_r).all() and (after_c == new_c).all():
                break
            new_r, new_c = after_r, after_c
        for old, new in {*zip(r.tolist(), new_r.tolist()), *zip(c.tolist(), new_c.tolist())}:
            a, b = int(self.roots(np.array([old]))[0]), int(self.roots(np.array([new]))[0])
            self.up[max(a, b)] = min(a, b)
