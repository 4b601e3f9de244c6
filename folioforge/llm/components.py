"""Connected components: in one task over arrays, and over tables of any size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes by the edges a-b."""
    root = np.arange(n)
    while len(a):
        # only roots are hooked, so what is joined stays joined
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b) whose smallest reachable node
    is another; long ids.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each
    written to the shared folder.  The joins on a hub's id are plain sort-merge
    joins, which adaptive execution splits.
    """

    def sums(df: DataFrame) -> tuple:
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    # a: larger end, b: smaller end
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = C.stored(now, "edges")
    seen = sums(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.join(low, both.a == low.k).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = C.stored(large, "edges")
        C.forget(now)
        low = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        joined = large.join(low, large.a == low.k)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        now = C.stored(small, "edges")
        C.forget(large)
        got = sums(now)
        if got == seen:
            break
        seen = got
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
