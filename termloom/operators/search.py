"""Boolean and BM25 retrieval over token postings, rank fusion, related itemsets."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.functions import words
from termloom.functions.text import tokens
from termloom.sources.shared import sized, table

K1, B, AVERAGE_LENGTH, RESULTS = 0.0, 0.2, 9.63676, 1000


def query_terms(queries: DataFrame, qid: str, text: str, first: int | None = None, padding: tuple[str, ...] = ()) -> DataFrame:
    """(qid, term, qw): terms of the first tokens of each query, weighted by how often they stand there. Stored.

    `padding` words are added with weight 1 where a query lacks them.
    """
    t = tokens(F.col(text))
    t = F.slice(t, 1, first) if first else t
    if padding:
        t = F.concat(t, F.array_except(F.array(*map(F.lit, padding)), t))
    return table(queries.select(F.col(qid).alias("qid"), F.explode(t).alias("term")).groupBy("qid", "term").agg(F.count("*").cast("double").alias("qw")))


def postings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(doc_id, len, term, tf); with `only`, of these terms. Counted row by row: only ids that stand twice are added up."""
    rows = words.flat(docs, id_col, text)
    if only is not None:
        rows = rows.join(sized(table(only.select("term").distinct())), "term", "left_semi").select("doc_id", "len", "term", "tf")
    return rows if words.unique_ids(docs, id_col) else rows.groupBy("doc_id", "len", "term").agg(F.sum("tf").alias("tf"))


def clarity_idf(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5))


def idf_table(posted: DataFrame, n: int) -> DataFrame:
    """(term, df, idf, idf_plain) over postings of n documents."""
    return with_idf(posted.groupBy("term").agg(F.count("*").alias("df")), n)


def with_idf(counts: DataFrame, n: int) -> DataFrame:
    return counts.select("term", "df", clarity_idf(F.col("df"), F.lit(n)).alias("idf"), F.log(F.lit(n) / F.col("df")).alias("idf_plain"))


def matches(posted: DataFrame, terms: DataFrame, mode: str = "or", absent: str | None = None) -> DataFrame:
    """Postings of the documents that a query matches, with the query's weights: (qid, doc_id, len, term, tf, qw).

    `or` and `powerset` need one term of the query, `and` all of them; a document with the term `absent` never matches.
    """
    met = posted.join(sized(terms), "term")
    if absent is not None:
        met = met.join(posted.where(F.col("term") == absent).select("doc_id").distinct(), "doc_id", "left_anti")
    if mode == "and":
        need = terms.groupBy("qid").agg(F.count("*").alias("need"))
        whole = met.groupBy("qid", "doc_id").agg(F.count("*").alias("have")).join(sized(table(need)), "qid").where("have = need").select("qid", "doc_id")
        met = met.join(whole, ["qid", "doc_id"], "left_semi")
    return met


def bm25(met: DataFrame, idf: DataFrame, k1: float = K1, b: float = B, average: float = AVERAGE_LENGTH, binary: bool = True, powerset: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, score): sum of qw * wt * idf / (k1 + wt), wt = tf / ((1 - b) + b * len / average).

    With k1 = 0 lengths and counts cancel. `powerset` (the query terms) boosts a document by the share of the query's
    subsets of terms that it holds: m of n terms make 2^m - 1 of 2^n - 1 subsets.
    """
    tf = F.lit(1.0) if binary else F.col("tf").cast("double")
    wt = tf / ((1 - b) + b * F.col("len") / average)
    each = F.col("qw") * wt * F.col("idf") / (k1 + wt)
    scored = met.join(sized(table(idf.select("term", "idf"))), "term").groupBy("qid", "doc_id").agg(F.sum(each).alias("score"), F.count("*").cast("double").alias("m"))
    if powerset is not None:
        size = powerset.groupBy("qid").agg(F.count("*").cast("double").alias("n"))
        subsets = lambda x: F.pow(F.lit(2.0), x) - 1
        scored = scored.join(sized(table(size)), "qid").withColumn("score", F.col("score") * subsets(F.col("m")) / subsets(F.col("n")))
    return scored.select("qid", "doc_id", F.round("score", 6).alias("score"))


def subset_boosted(met: DataFrame, idf: DataFrame, terms: DataFrame, by: str = "idf") -> DataFrame:
    """(qid, doc_id, score): every subset of the query's terms that a document holds counts with its share of the query.

    A subset S scores the sum of qw * idf of its terms, boosted by w(S) / w(query), w being qw * idf or, by `length`, qw;
    scores are divided by the number of subsets of the query. For m terms held with weights w and scores s the sum over
    all subsets is 2^(m-2) * (sum(w * s) + sum(w) * sum(s)), so no subset is enumerated.
    """
    s = F.col("qw") * F.col("idf")
    w = s if by == "idf" else F.col("qw")
    weighed = sized(table(idf.select("term", "idf")))
    whole = terms.join(weighed, "term").groupBy("qid").agg(F.sum(w).alias("all"), F.count("*").cast("double").alias("n"))
    held = met.join(weighed, "term").groupBy("qid", "doc_id").agg(F.sum(s * w).alias("sw"), F.sum(s).alias("s"), F.sum(w).alias("w"), F.count("*").cast("double").alias("m"))
    score = F.pow(F.lit(2.0), F.col("m") - 2) * (F.col("sw") + F.col("w") * F.col("s")) / F.col("all") / (F.pow(F.lit(2.0), F.col("n")) - 1)
    return held.join(sized(table(whole)), "qid").select("qid", "doc_id", F.round(score, 6).alias("score"))


def stemmed(posted: DataFrame, stems: DataFrame) -> DataFrame:
    """Postings with terms as their stems (token, stem), counts of one stem added up."""
    rows = posted.join(sized(stems.select(F.col("token").alias("term"), "stem")), "term")
    return rows.groupBy("doc_id", "len", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def stemmed_terms(terms: DataFrame, stems: DataFrame) -> DataFrame:
    """Query terms as their stems, weights of one stem added up; a term that no document has keeps its form. Stored."""
    rows = terms.join(sized(stems.select(F.col("token").alias("term"), "stem")), "term", "left")
    return table(rows.groupBy("qid", F.coalesce("stem", "term").alias("term")).agg(F.sum("qw").alias("qw")))


def of_language(run: DataFrame, languages: DataFrame, language: str) -> DataFrame:
    """Rows of a run whose document (doc_id, lang) is of this language, ranked anew."""
    held = run.join(languages.where(F.col("lang") == language).select("doc_id"), "doc_id", "left_semi")
    return held.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))


def closed_hits(hits: DataFrame) -> DataFrame:
    """The hits of a query that no other hit of it contains: the leaves of the tree of its hits.

    Hits meet on one item of the smaller; a query has at most RESULTS of them.
    """
    parts = hits.withColumn("parts", F.split("items", " "))
    small = parts.select("qid", "items", "parts", F.element_at("parts", 1).alias("item"))
    big = parts.select("qid", F.col("parts").alias("more"), F.explode("parts").alias("item"))
    inside = small.join(big, ["qid", "item"]).where((F.size("more") > F.size("parts")) & (F.size(F.array_except("parts", "more")) == 0))
    return hits.join(inside.select("qid", "items").distinct(), ["qid", "items"], "left_anti")


def bm25_grid(met: DataFrame, idf: DataFrame, bs: list[float], k1s: list[float], average: float, n: int = RESULTS) -> DataFrame:
    """(b, k1, qid, doc_id, score) of every parameter pair in one pass over the matches; tf and length count here.

    The matches of a document come together, so its sums for all pairs are one matrix product; of each batch of a
    query's documents only those that can be among its n best for a pair are handed on to top().
    """
    b, k1 = (np.array(x) for x in zip(*[(b, k1) for b in bs for k1 in k1s]))
    rows = met.join(sized(table(idf.select("term", "idf"))), "term").select("qid", "doc_id", F.col("tf").cast("double").alias("tf"), F.col("len").cast("double").alias("len"), (F.col("qw") * F.col("idf")).alias("w"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            whole = rest if batch is None else batch if rest is None else pd.concat((rest, batch))
            if whole is None or not len(whole):
                continue
            rest = None
            if batch is not None:  # the last document may go on in the next batch
                last = (whole["qid"] == whole["qid"].iloc[-1]) & (whole["doc_id"] == whole["doc_id"].iloc[-1])
                whole, rest = whole[~last], whole[last]
                if not len(whole):
                    continue
            q, d = whole["qid"].to_numpy(), whole["doc_id"].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (d[1:] != d[:-1]))))
            wt = whole["tf"].to_numpy()[:, None] / ((1 - b) + b * whole["len"].to_numpy()[:, None] / average)
            scores = np.round(np.add.reduceat(whole["w"].to_numpy()[:, None] * wt / (k1 + wt), starts, axis=0), 6)
            q, d = q[starts], d[starts]
            edges = np.concatenate(([0], np.flatnonzero(q[1:] != q[:-1]) + 1, [len(q)]))
            for low, high in zip(edges, edges[1:]):
                best = high - 1 - np.argsort(-scores[low:high][::-1], axis=0, kind="stable")[:n]  # ties by descending id
                pair = np.broadcast_to(np.arange(len(b)), best.shape).ravel()
                at = best.ravel()
                yield pd.DataFrame({"b": b[pair], "k1": k1[pair], "qid": q[at], "doc_id": d[at], "score": scores[at, pair]})

    kinds = {c: met.schema[c].dataType.simpleString() for c in ("qid", "doc_id")}
    ready = rows.repartition("qid", "doc_id").sortWithinPartitions("qid", "doc_id")
    return ready.mapInPandas(run, f"b double, k1 double, qid {kinds['qid']}, doc_id {kinds['doc_id']}, score double")


def top(scored: DataFrame, n: int = RESULTS, by: tuple[str, ...] = ("qid",), tie: str = "doc_id") -> DataFrame:
    """The n best of each query with their rank; ties by descending id. The limit is also applied before the shuffle."""
    best = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc(tie))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def fuse(runs: DataFrame, k: int = 60, key: str = "doc_id") -> DataFrame:
    """(qid, key, score): reciprocal-rank fusion of all ranks that a query's runs give an entry."""
    return runs.groupBy("qid", key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))


def related_itemsets(patterns: DataFrame, terms: DataFrame, n: int = RESULTS, k: int = 60) -> DataFrame:
    """(qid, items, support, rank, score, fused) of the itemsets that share a term with a query. Stored.

    Scored by the sum of the shared terms' weights; ties by support, then text; fused is 1 / (k + rank).
    """
    index = table(patterns.select(F.concat_ws(" ", "items").alias("items"), "support", F.col("items").alias("parts")))
    n_sets = index.count()
    each = index.select("items", "support", F.explode("parts").alias("term"))
    df = each.join(sized(table(terms.select("term").distinct())), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weights = table(terms.join(df, "term").select("qid", "term", (F.col("qw") * clarity_idf(F.col("df"), F.lit(n_sets))).alias("w")))
    hits = each.join(sized(weights), "term").groupBy("qid", "items", "support").agg(F.round(F.sum("w"), 6).alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("support"), F.desc("items"))
    return table(hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).withColumn("fused", F.round(1.0 / (k + F.col("rank")), 9)))


def fuzzy(vocabulary: DataFrame, word: str, similarity: float = 0.85, prefix: int = 1, limit: int = 7) -> DataFrame:
    """The tokens most like a word: same first characters, and 1 - edits / shorter length above the similarity."""
    edits = F.levenshtein(F.col("token"), F.lit(word))
    alike = 1 - edits / F.least(F.length("token"), F.lit(len(word)))
    near = vocabulary.where(F.col("token").startswith(word[:prefix]) & (F.abs(F.length("token") - len(word)) <= math.ceil(len(word) * (1 - similarity)) + 1))
    return near.select("token", F.round(alike, 6).alias("similarity")).where(F.col("similarity") >= similarity).orderBy(F.desc("similarity"), "token").limit(limit)
