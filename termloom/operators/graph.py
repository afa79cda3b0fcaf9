"""Matrix and graph kernels: co-occurrence, cosine distance, PageRank."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.sources.shared import table


def cooccurrence(patterns: DataFrame) -> DataFrame:
    """(a, b, weight), a <> b: summed support of the patterns that hold both; no diagonal."""
    each = patterns.select("support", "items", F.explode("items").alias("a"))
    pairs = each.select("a", F.explode("items").alias("b"), "support").where("a <> b")
    return pairs.groupBy("a", "b").agg(F.sum("support").alias("weight"))


def pattern_terms(patterns: DataFrame) -> DataFrame:
    """(term, items, weight): the pattern-term matrix in long form, weighted by support."""
    return patterns.select(F.explode("items").alias("term"), F.concat_ws(" ", "items").alias("items"), F.col("support").alias("weight"))


def cosine_distance(v: Column, w: Column) -> Column:
    """1 - cosine of two arrays of numbers; 0 for two zero vectors, 1 for one."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    dot = total(F.zip_with(v, w, lambda a, b: F.coalesce(a.cast("double"), F.lit(0.0)) * F.coalesce(b.cast("double"), F.lit(0.0))))
    square = lambda x: total(F.transform(x, lambda a: a.cast("double") * a.cast("double")))
    vv, ww = square(v), square(w)
    return F.when((vv == 0) & (ww == 0), 0.0).when((vv == 0) | (ww == 0), 1.0).otherwise(1 - dot / F.sqrt(vv * ww))


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, rounds: int = 20, delta: float | None = 1e-3) -> DataFrame:
    """(node, rank) of a graph of edges (src, dst): all start at 1, r' = (1 - d) + d * sum(r / out), and what dangling
    nodes lose is spread evenly, so ranks sum to the number of nodes. Each round ends in the shared folder.

    Stops after `rounds`, or when no rank grows by more than delta.
    """
    edges = table(edges.select("src", "dst").distinct())
    nodes = table((nodes.select("node") if nodes is not None else edges.select(F.col("src").alias("node")).union(edges.select("dst"))).distinct())
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = table(edges.join(out, "src"))
    n, ranks = nodes.count(), nodes.withColumn("rank", F.lit(1.0))
    for _ in range(rounds if n else 0):
        sent = links.join(ranks, links["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        new = ranks.join(sent, ranks["node"] == sent["dst"], "left").select("node", F.col("rank").alias("old"), (F.lit(1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        new = table(new)
        total, grown = new.agg(F.sum("rank"), F.max(F.col("rank") - F.col("old"))).first()
        lost = (n - total) / n
        ranks = new.select("node", (F.col("rank") + lost).alias("rank"))
        if delta is not None and grown + lost < delta:
            break
    return ranks


def pagerank_dense(link: np.ndarray, damping: float = 0.85, rounds: int = 20, delta: float = 1e-3) -> np.ndarray:
    """The same on a small boolean matrix link[src, dst], for one query's graph."""
    n, out = len(link), np.maximum(1, link.sum(1))
    rank = np.ones(n)
    for _ in range(rounds):
        new = (1 - damping) + damping * (link.T @ (rank / out))
        new += (n - new.sum()) / n
        done = (new - rank).max() < delta
        rank = new
        if done:
            break
    return rank
