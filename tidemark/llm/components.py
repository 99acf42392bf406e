"""Connected components of a graph that only Spark holds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, small, written

#: Links that a task writes: rounds never have more links than there were, so that their number bounds that of the tasks.
LINKS = 100_000


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the smallest node reachable) for each node of links (a, b; any order, repeats allowed).

    Every round links each node's larger neighbours to its smallest one and then its smaller
    neighbours, so that paths shorten by about half; it ends when each component is a star, that is when
    a node with a smaller neighbour has no other. Each step takes minima by node, as a table of their own,
    and joins them back, so that Spark can split the links of a node with very many; every round is
    written to the shared folder. Few links are written by few tasks, and few minima are broadcast.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), name)
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, math.ceil(edges.count() / LINKS))
    while True:
        # a > b: towards the smallest neighbour of both sides.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"), F.count_if(F.col("b") < F.col("a")).alias("smaller"), F.count("*").alias("n"))
        least = written(least.coalesce(tasks), name)
        if least.where("smaller > 0 and n > 1").isEmpty():
            dropped(least)
            break
        large = both.where("b > a").join(small(least.select("a", "least")), "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = written(large.where("a > b").distinct().coalesce(tasks), name)
        low = written(large.groupBy("a").agg(F.min("b").alias("least")).coalesce(tasks), name)
        nearer = large.join(small(low), "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a > b").unionByName(low.select("a", F.col("least").alias("b")))
        nearer = written(nearer.distinct().coalesce(tasks), name)
        dropped(edges, large, least, low)
        edges = nearer
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
