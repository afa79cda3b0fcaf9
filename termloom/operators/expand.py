"""Query expansion: weights for the terms of the itemsets related to a query, and the expanded query itself.

Hits are rows (qid, items, support, rank, ...) of search.related_itemsets, terms are (qid, term, qw). Sums are
DataFrame aggregations; models that are matrices or greedy loops over one query's hits (at most a thousand sets) run
as one Arrow group for each query.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.operators.graph import pagerank_dense
from termloom.sources.shared import sized, table

LAMBDA, SMOOTHER, MIN_SIZE = 0.33, 10_000.0, 2


def members(hits: DataFrame, terms: DataFrame, first: int | None = None) -> DataFrame:
    """(qid, items, support, rank, term): terms of the related sets of two or more items, without the query's own."""
    rows = hits.withColumn("parts", F.split("items", " ")).where(F.size("parts") >= MIN_SIZE)
    rows = rows.where(F.col("rank") <= first) if first else rows
    return rows.select("qid", "items", "support", "rank", F.explode("parts").alias("term")).join(sized(terms.select("qid", "term")), ["qid", "term"], "left_anti")


def top_patterns(hits: DataFrame, terms: DataFrame) -> DataFrame:
    return members(hits, terms).groupBy("qid", "term").agg(F.sum("support").cast("double").alias("score"))


def frequency(hits: DataFrame, terms: DataFrame, first: int = 100, count: bool = False) -> DataFrame:
    return members(hits, terms, first).groupBy("qid", "term").agg((F.count("*") if count else F.sum("support")).cast("double").alias("score"))


def divergence(hits: DataFrame, terms: DataFrame, df: DataFrame, corpus_length: float, first: int = 100) -> DataFrame:
    """P' ln(P' / P): P' is a term's share of support in the hits, P its share df / corpus_length in the corpus."""
    found = frequency(hits, terms, first)
    share = F.col("score") / F.sum("score").over(Window.partitionBy("qid"))
    return found.join(df.select("term", "df"), "term").select("qid", "term", share.alias("p"), "df").select("qid", "term", F.round(F.col("p") * F.log(F.col("p") / (F.col("df") / F.lit(corpus_length))), 9).alias("score"))


def idf_increase(top_docs: DataFrame, posted: DataFrame, terms: DataFrame, df: DataFrame, n_docs: int, first: int = 10) -> DataFrame:
    """ln((share of the first hits with the term) / (share of all documents with it)), for terms outside the query."""
    hits = top_docs.where(F.col("rank") <= first)
    each = posted.join(sized(hits.select("qid", "doc_id")), "doc_id").select("qid", "doc_id", "term").distinct()
    wide = each.groupBy("qid", "doc_id").agg(F.count("*").alias("k")).where("k >= 2").select("qid", "doc_id")
    each = each.join(wide, ["qid", "doc_id"], "left_semi")
    size = wide.groupBy("qid").agg(F.count("*").alias("n"))
    tf = each.groupBy("qid", "term").agg(F.count("*").alias("tf")).join(sized(terms.select("qid", "term")), ["qid", "term"], "left_anti")
    scored = tf.join(sized(table(size)), "qid").join(df.select("term", "df"), "term")
    return scored.select("qid", "term", F.round(F.log((F.col("tf") / F.col("n")) / (F.col("df") / F.lit(n_docs))), 6).alias("score"))


# -- one query at a time -------------------------------------------------------------------------------------------


class Hits:
    """One query's related sets as matrices: member[w, d], supports, document frequencies."""

    def __init__(self, rows: pd.DataFrame, corpus: float) -> None:
        rows = rows.sort_values("rank")
        self.query = dict(zip(rows["q_terms"].iloc[0], rows["q_weights"].iloc[0]))
        self.sets = [tuple(t) for t in rows["terms"]]
        self.supp, self.corpus = rows["support"].to_numpy(float), corpus
        df = {t: d for ts, ds in zip(rows["terms"], rows["dfs"]) for t, d in zip(ts, ds)}
        self.words = sorted(df)
        at = {w: i for i, w in enumerate(self.words)}
        self.df = np.array([df[w] for w in self.words], float)
        self.member = np.zeros((len(self.words), len(self.sets)), bool)
        for d, s in enumerate(self.sets):
            self.member[[at[w] for w in s], d] = True
        self.share = self.member @ self.supp

    def scores(self, values: np.ndarray) -> list[tuple[str, float]]:
        return [(w, float(v)) for w, v in zip(self.words, values) if w not in self.query]

    def smoothed(self) -> np.ndarray:
        return (SMOOTHER + self.df) / (SMOOTHER + self.corpus)

    def weighted(self, inverse: bool) -> np.ndarray:
        """Term-pattern weights: smoothed df times the log of support share over corpus share, or of its inverse."""
        ratio = (self.share / self.share.sum()) / np.maximum(1e-12, self.df / self.corpus)
        value = np.where(self.df > 0, self.smoothed() * np.log(1 / ratio if inverse else ratio), 0.0)
        return self.member * value[:, None]

    def together(self) -> np.ndarray:
        m = (self.member * self.supp) @ self.member.T.astype(float)
        np.fill_diagonal(m, 0.0)
        return m


def per_query(hits: DataFrame, terms: DataFrame, df: DataFrame, corpus: float, model: Callable[[Hits], list[tuple]], columns: str = "term string, score double", first: int = 100, together: int = 256) -> DataFrame:
    """Rows (qid, columns) that `model` makes of each query's first hits; scores are rounded to 6 places.

    A set is known by its query and rank, so its text isn't copied to each of its terms. About `together` queries make
    one Arrow group, as most queries have a few small sets.
    """
    rows = hits.withColumn("parts", F.split("items", " ")).where((F.size("parts") >= MIN_SIZE) & (F.col("rank") <= first))
    each = rows.select("qid", "support", "rank", F.explode("parts").alias("term")).join(df.select("term", "df"), "term", "left")
    sets = each.groupBy("qid", "support", "rank").agg(F.sort_array(F.collect_list(F.struct("term", F.coalesce(F.col("df").cast("double"), F.lit(0.0)).alias("df")))).alias("t"))
    return modelled(sets, terms, corpus, model, columns, together)


def modelled(sets: DataFrame, terms: DataFrame, corpus: float, model: Callable[[Hits], list[tuple]], columns: str, together: int) -> DataFrame:
    """per_query of sets (qid, support, rank, t), t the sorted (term, df) of each."""
    asked = table(terms.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", "qw"))).alias("q")))
    groups = -(-max(1, asked.count()) // together)
    ready = sets.join(sized(asked), "qid").select("qid", "support", "rank", F.col("t.term").alias("terms"), F.col("t.df").alias("dfs"), F.col("q.term").alias("q_terms"), F.col("q.qw").alias("q_weights"))
    names = [c.split()[0] for c in columns.split(", ")]
    kind = sets.schema["qid"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("qid", kind="stable")
        q = group["qid"].to_numpy()
        edges = [0, *(np.flatnonzero(q[1:] != q[:-1]) + 1), len(q)]
        found = [(q[low], *row) for low, high in zip(edges, edges[1:]) for row in model(Hits(group.iloc[low:high], corpus))]
        made = pd.DataFrame(found, columns=["qid", *names])
        made["score"] = np.nan_to_num(made["score"].astype(float), nan=1e-6, posinf=1e-6, neginf=1e-6).round(6)
        return made

    key = F.col("qid") if together == 1 else F.pmod(F.xxhash64("qid"), F.lit(groups))
    return ready.groupBy(key.alias("_group")).applyInPandas(run, f"qid {kind}, {columns}")


def conditional(h: Hits) -> list[tuple[str, float]]:
    """P(term | subset of the query), chained from small subsets to those that hold them, times smoothed frequency."""
    held: dict[frozenset, float] = {}
    total = 0.0
    add = lambda k, x: held.__setitem__(k, held.get(k, 0.0) + x)
    for s, x in zip(h.sets, h.supp):
        asked = sorted(set(s) & set(h.query))
        subsets = [frozenset(c) for n in range(1, len(asked) + 1) for c in combinations(asked, n)]
        for q in subsets:
            add(q, x)
        for t in set(s) - set(h.query):
            total += x
            add(frozenset([t]), x)
            for q in subsets:
                add(q | {t}, x)
    out = []
    for w, df in zip(h.words, h.df):
        own = frozenset([w])
        if w in h.query or df == 0 or not total or own not in held:
            continue
        left = sorted((k for k in held if w in k and len(k) > 1), key=lambda k: (len(k), sorted(k)))

        def chain(base: frozenset, value: float) -> float:
            key = next((k for k in left if k >= base), None)  # noqa: B023
            if key is None:
                return 0.0
            left.remove(key)  # noqa: B023
            value *= held[key] / held[key - own]  # noqa: B023
            return value + chain(key, value)

        asked = sum(weight * chain(own | {q}, held[own] / total) for q, weight in sorted(h.query.items()))
        blend = LAMBDA * (SMOOTHER + df) / h.corpus + (1 - LAMBDA) * held[own] / total
        out.append((w, blend * min(asked, 1 - 1e-6)))
    return out


def markov(h: Hits) -> list[tuple[str, float]]:
    """Two steps of a walk between terms and patterns, then query likelihood of the patterns."""
    size = h.member.sum(0)
    a = h.member * (size * h.supp)[None, :] / np.maximum(1, h.df)[:, None] / size.mean()
    a = a / np.maximum(1e-12, a.sum(1, keepdims=True))
    b = (h.member / size).T
    c = a @ b
    walk = (np.eye(len(c)) + 0.5 * c + 0.25 * c @ c) * (1 - 0.25)
    at = {w: i for i, w in enumerate(h.words)}
    likelihood = np.zeros(len(h.sets))
    for d, s in enumerate(h.sets):
        factors = [x for x in (walk[:, at[q]] @ b[d] for q in s if q in h.query) if x > 0]
        likelihood[d] = math.prod(factors) if factors else 0.0
    return h.scores((a @ likelihood) * h.smoothed())


def _leading(m: np.ndarray, rank: int) -> np.ndarray:
    """Length of each row in the space of the leading singular vectors."""
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    return np.sqrt(((u[:, :rank] * s[:rank]) ** 2).sum(1))


def svd_patterns(h: Hits, rank: int = 3) -> list[tuple[str, float]]:
    m = h.weighted(False)
    return h.scores(_leading(m - m.mean(0), rank))


def svd_terms(h: Hits, rank: int = 3) -> list[tuple[str, float]]:
    m = h.together()
    return h.scores(_leading(m - m.mean(0), rank))


def entropy(h: Hits, n_terms: int = 10, information: bool = False) -> list[tuple[str, float]]:
    """Greedy choice of the patterns with most entropy or mutual information, less what chosen ones share with them."""
    tot = h.share.sum()
    p = h.share / tot
    alone = np.where(p > 0, p * np.log2(1 / np.maximum(p, 1e-300)), 0.0)
    pair = h.together() / tot
    with np.errstate(divide="ignore", invalid="ignore"):
        joint = np.where(pair > 0, pair * np.log2(pair / np.outer(p, p)), 0.0)
    own = lambda s: float(joint[np.ix_(s, s)].sum() * information + alone[s].sum())
    parts = [np.flatnonzero(h.member[:, d]) for d in range(len(h.sets))]
    score = [own(s) for s in parts]
    left, out, seen = list(range(len(parts))), [], set(h.query)
    while left and len(out) < n_terms:
        best = max(left, key=lambda d: (score[d], -d))
        left.remove(best)
        for w in (h.words[i] for i in parts[best]):
            if w not in seen and len(out) < n_terms:
                seen.add(w)
                out.append((w, score[best]))
        for d in left:
            score[d] -= float(joint[np.ix_(parts[best], parts[d])].sum() * information + alone[np.intersect1d(parts[best], parts[d])].sum())
    return out


def pagerank_terms(h: Hits) -> list[tuple[str, float]]:
    return h.scores(pagerank_dense(h.together() > 0))


def pagerank_patterns(h: Hits) -> list[tuple[str, float]]:
    """Each term gets the ranks of its patterns in the graph of patterns that share a term."""
    link = h.member.T.astype(int) @ h.member.astype(int) > 0
    np.fill_diagonal(link, False)
    return h.scores(h.member @ pagerank_dense(link))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(1e-12, np.linalg.norm(m, axis=1, keepdims=True))


def cosine_means(rows: np.ndarray, least: int = 2, most: int = 4, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(cluster of each row, unit centroids): k-means by cosine, started from far rows; k by mean silhouette."""
    x = _unit(rows)
    best = (-2.0, np.zeros(len(x), int), _unit(x.mean(0, keepdims=True)))
    far = 1 - x @ x.T
    for k in range(least, min(most, len(x) - 1) + 1):
        seeds = [int(np.argmax(np.linalg.norm(rows, axis=1)))]
        while len(seeds) < k:
            seeds.append(int(np.argmax(far[:, seeds].min(1))))
        centre = x[seeds]
        for _ in range(rounds):
            own = np.argmax(np.round(x @ centre.T, 9), 1)
            new = _unit(np.stack([x[own == c].mean(0) if (own == c).any() else centre[c] for c in range(k)]))
            if np.allclose(new, centre):
                break
            centre = new
        mean = np.stack([far[:, own == c].mean(1) if (own == c).any() else np.full(len(x), np.inf) for c in range(k)], 1)
        size = np.bincount(own, minlength=k)[own]
        inner = mean[np.arange(len(x)), own] * size / np.maximum(1, size - 1)
        mean[np.arange(len(x)), own] = np.inf
        outer = mean.min(1)
        width = np.where((size > 1) & np.isfinite(outer), (outer - inner) / np.maximum(1e-12, np.maximum(outer, inner)), 0.0).mean()
        if width > best[0] + 1e-9:
            best = (width, own, centre)
    return best[1], best[2]


def cluster_patterns(h: Hits, scale: bool = True) -> list[tuple[int, str, float]]:
    """(cluster, term, score): patterns clustered by cosine, terms weighted by their patterns' similarity to the centroid."""
    m = h.weighted(True)
    m = m - m.mean(0)
    if scale and len(m) > 1:
        m = m / np.maximum(1e-12, m.std(0, ddof=1))
    own, centre = cosine_means(m.T)
    near = _unit(m.T) @ centre.T
    out = []
    for c in range(len(centre)):
        held = h.member[:, own == c]
        out += [(c, w, float(s)) for w, s, there in zip(h.words, held @ near[own == c, c], held.any(1)) if there and w not in h.query]
    return out


def cluster_terms(h: Hits) -> list[tuple[int, str, float]]:
    """(cluster, term, score): terms clustered by their co-occurrence, weighted by similarity to the centroid."""
    m = h.together()
    own, centre = cosine_means(m)
    return [(int(own[i]), w, float(_unit(m[i : i + 1])[0] @ centre[own[i]])) for i, w in enumerate(h.words) if w not in h.query]


# -- the expanded query --------------------------------------------------------------------------------------------


def choose_terms(clustered: DataFrame, terms: DataFrame, per_query_term: int = 10) -> DataFrame:
    """(qid, term, weight): best unused term of each cluster in turn; a #tag and its word are one term.

    A query of n terms gets n * per_query_term of them, each weighted n / (n * per_query_term).
    """
    turn = F.row_number().over(Window.partitionBy("qid", "cluster").orderBy(F.desc("score"), "term"))
    bare = F.regexp_replace("term", "^#", "")
    once = clustered.withColumn("turn", turn).withColumn("n", F.row_number().over(Window.partitionBy("qid", bare).orderBy("turn", "cluster", "term"))).where("n = 1")
    size = terms.groupBy("qid").agg(F.sum("qw").alias("len"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("turn", "cluster", "term"))
    chosen = once.withColumn("place", place).join(sized(size), "qid").where(F.col("place") <= F.col("len") * per_query_term)
    return chosen.select("qid", "term", F.round(F.col("len") / (F.col("len") * per_query_term), 6).alias("weight"))


def expanded(terms: DataFrame, chosen: DataFrame) -> DataFrame:
    """(qid, term, qw) of the query with its chosen terms."""
    return terms.select("qid", "term", "qw").unionByName(chosen.select("qid", "term", F.col("weight").alias("qw"))).groupBy("qid", "term").agg(F.sum("qw").alias("qw"))


def keep_matching(scored: DataFrame, original: DataFrame) -> DataFrame:
    """Filtering mode: of an expanded run, the documents that match the original query as well."""
    return scored.join(original.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi")


def filtered_scores(own: DataFrame, more: DataFrame, idf: DataFrame) -> DataFrame:
    """(qid, doc_id, score) of the mode in which a term added to a query counts beside each of the query's own terms.

    own and more are the matches of the query's terms and of the added ones. A document must hold a term of the query;
    every pair of a query term and an added term that it holds is one more clause, which scores both.
    """
    weighed = sized(table(idf.select("term", "idf")))
    side = lambda met, s, n: met.join(weighed, "term").groupBy("qid", "doc_id").agg(F.sum(F.col("qw") * F.col("idf")).alias(s), F.count("*").alias(n))
    met = side(own, "s", "n").join(side(more, "t", "m"), ["qid", "doc_id"], "left").na.fill(0, ["t", "m"])
    return met.select("qid", "doc_id", F.round(F.col("s") * (1 + F.col("m")) + F.col("n") * F.col("t"), 6).alias("score"))
