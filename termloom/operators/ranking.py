"""Scores of all documents for all queries as sparse products, a block of documents at a time.

search.matches makes a row of every (query, document, term); their number is documents times queries times shared terms.
Here a task adds them up in arrays and hands on only its best documents of each query. It needs documents of unique
integer ids and queries that fit into a task; index() gives None otherwise, and the joins of search do the same job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from termloom.functions import words
from termloom.operators.search import clarity_idf
from termloom.sources.shared import table

#: What a task holds: (query, term) pairs, queries, and cells of a block of documents by queries.
PAIRS, QUERIES, CELLS = 1_000_000, 20_000, 2_000_000


class Best:
    """The n best (score, id) of each group so far; ties by descending id."""

    def __init__(self, groups: int, n: int) -> None:
        self.n, self.least = n, np.full(groups, -np.inf)
        self.parts, self.pending, self.limit = [], 0, max(1_000_000, 2 * groups * min(n, 100))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((group, score, ids))
        self.pending += len(group)
        if self.pending > self.limit:
            self.parts = [self.rows()]
            group, score, _ = self.parts[0]
            last = np.flatnonzero(np.concatenate((group[1:] != group[:-1], [True]))[: len(group)])
            full = np.diff(np.concatenate(([-1], last))) >= self.n
            self.least[group[last[full]]] = score[last[full]]
            self.pending, self.limit = 0, max(1_000_000, len(group))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, score, ids = (np.concatenate(x) if self.parts else np.zeros(0, int) for x in (zip(*self.parts) if self.parts else ((), (), ())))
        order = np.lexsort((-ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        first = np.concatenate(([True], group[1:] != group[:-1]))[: len(group)]
        place = np.arange(len(group)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(group) else group
        kept = place < self.n
        return group[kept], score[kept], ids[kept]


class Block:
    """A block of documents: the query terms that each holds, and their sums by query."""

    def __init__(self, asked: Asked, size: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> None:
        doc = np.repeat(np.arange(len(size)), size)
        per = asked.ends[term + 1] - asked.ends[term]
        self.shape = (len(size), len(asked.qids))
        self.at = np.repeat(asked.ends[term] - np.cumsum(per) + per, per) + np.arange(per.sum())
        self.posting = np.repeat(np.arange(len(term)), per)
        self.cell = doc[self.posting] * self.shape[1] + asked.query[self.at]
        self.doc, self.tf, self.length = doc, tf.astype(float), length.astype(float)

    def sum(self, weights: np.ndarray, factor: np.ndarray | None = None) -> np.ndarray:
        """(documents, queries): sums of the weights (of each query and term) times the factor of each posting."""
        w = weights[self.at] if factor is None else weights[self.at] * factor[self.posting]
        return np.bincount(self.cell, w, self.shape[0] * self.shape[1]).reshape(self.shape)


class Asked:
    """Queries by term: for term i the entries ends[i] to ends[i + 1] of query and of each array of weights."""

    def __init__(self, terms: DataFrame, idf: dict[str, float], names: list[str], qids: list, columns: tuple[str, ...] = ("qw",)) -> None:
        number, place = {w: i for i, w in enumerate(names)}, {q: i for i, q in enumerate(qids)}
        rows = sorted(((number[r["term"]], place[r["qid"]], r) for r in terms.collect() if r["term"] in idf), key=lambda x: x[:2])
        self.qids, self.query = qids, np.array([q for _, q, _ in rows], int)
        term = np.array([t for t, _, _ in rows], int)
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(names)))))
        self.idf = np.array([idf[r["term"]] for _, _, r in rows], float)
        self.weights = {c: np.array([r[c] for _, _, r in rows], float) for c in columns}
        self.each = np.bincount(self.query, minlength=len(qids)).astype(float)


class Index:
    """Documents by the words that any query asks for."""

    def __init__(self, docs: DataFrame, names: list[str], n_docs: int, forms: list[tuple[str, str]] | None = None) -> None:
        self.names = names
        if forms is None:
            self.held = table(words.held(docs, names))
        else:
            number = {w: i for i, w in enumerate(names)}
            forms = [(form, w) for form, w in forms if w in number]
            self.held = table(words.held(docs, [form for form, _ in forms], [number[w] for _, w in forms]))
        counts = self.held.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("df")).select("t", "df", clarity_idf(F.col("df"), F.lit(n_docs)).alias("idf")).collect()
        self.idf = {names[r["t"]]: r["idf"] for r in counts}

    def best(self, qids: list, score: Callable[[Block], np.ndarray], asked: Asked, n: int) -> DataFrame:
        """(qid, doc_id, score) of the n best documents of each query in each task; score() gives -inf to no match."""

        def run(best: Best, block: Block, ids: np.ndarray) -> None:
            s = np.round(score(block), 6)
            doc, q = np.nonzero((s > -np.inf) & (s >= best.least))
            best.add(q, s[doc, q], ids[doc])

        found = self._tasks(asked, len(qids), n, run)
        named = self._named(qids)
        return found.join(F.broadcast(named), "_group").select("qid", "doc_id", "score")

    def grid(self, qids: list, asked: Asked, bs: list[float], k1s: list[float], average: float, n: int) -> DataFrame:
        """(b, k1, qid, doc_id, score): best() of every parameter pair.

        A posting's share depends on its document but for its count, so weights are summed for each count of a document
        first, and its scores for all pairs are one small product. Only scores that can be among the best are looked at.
        """
        b, k1 = (np.array(x) for x in zip(*[(b, k1) for b in bs for k1 in k1s]))
        w = asked.weights["qw"] * asked.idf

        def run(best: Best, block: Block, ids: np.ndarray) -> None:
            size = block.shape[1]
            key, slot = np.unique(block.doc * (1 << 40) + block.tf.astype(np.int64), return_inverse=True)
            query = block.cell % size
            sums = np.bincount(slot[block.posting] * size + query, w[block.at], len(key) * size).reshape(len(key), size)
            met = np.bincount(block.cell, minlength=block.shape[0] * size).reshape(block.shape) > 0
            edges = np.searchsorted(key >> 40, np.arange(block.shape[0] + 1))
            for d, (low, high) in enumerate(zip(edges, edges[1:])):
                v = (key[low:high] & ((1 << 40) - 1)).astype(float)
                own = np.flatnonzero(met[d])
                share = v / (v + (k1 * ((1 - b) + b * block.length[d] / average))[:, None])
                s = share @ sums[low:high][:, own]
                pair, at = np.nonzero(s >= best.least.reshape(len(b), size)[:, own] - 1e-6)
                best.add(pair * size + own[at], np.round(s[pair, at], 6), np.full(len(at), ids[d]))

        found = self._tasks(asked, len(b) * len(qids), n, run)
        spark = self.held.sparkSession
        pairs = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(b, k1))], "_pair long, b double, k1 double")
        found = found.select(F.floor(F.col("_group") / len(qids)).alias("_pair"), (F.col("_group") % len(qids)).alias("_group"), "doc_id", "score")
        return found.join(F.broadcast(pairs), "_pair").join(F.broadcast(self._named(qids)), "_group").select("b", "k1", "qid", "doc_id", "score")

    def _named(self, qids: list) -> DataFrame:
        return self.held.sparkSession.createDataFrame(list(enumerate(qids)), f"_group long, qid {self.kind}")

    def _tasks(self, asked: Asked, groups: int, n: int, add: Callable[[Best, Block, np.ndarray], None]) -> DataFrame:
        rows = self.held.coalesce(2 * self.held.sparkSession.sparkContext.defaultParallelism)
        kind = rows.schema["doc_id"].dataType.simpleString()
        step = max(1, min(512, CELLS // max(1, len(asked.qids))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(groups, n)
            for batch in batches:
                for low in range(0, len(batch), step):
                    part = batch.slice(low, step)
                    ids, length = part.column(0).to_numpy(), part.column(1).to_numpy()
                    size = np.diff(part.column(2).offsets.to_numpy())
                    term, tf = (part.column(i).flatten().to_numpy() for i in (2, 3))
                    add(best, Block(asked, size, term, tf, length), ids)
            group, score, ids = best.rows()
            for low in range(0, len(group), 1 << 18):
                at = slice(low, low + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(group[at], pa.int64()), pa.array(ids[at]), pa.array(score[at], pa.float64())], ["_group", "doc_id", "score"])

        return rows.mapInArrow(run, f"_group long, doc_id {kind}, score double")


def index(docs: DataFrame, terms: DataFrame, stems: DataFrame | None = None) -> Index | None:
    """The documents by the terms of the queries (qid, term, ...), None where the joins of search must do.

    With `stems` (token, stem), of the tokens that have one of the queries' stems, terms are stems.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType) or not words.unique_ids(docs):
        return None
    n_pairs, n_queries = terms.agg(F.count("*"), F.count_distinct("qid")).first()
    if not n_pairs or n_pairs > PAIRS or n_queries > QUERIES:
        return None
    if stems is not None and stems.count() > PAIRS:
        return None
    forms = None if stems is None else sorted((r["token"], r["stem"]) for r in stems.collect())
    found = Index(docs, sorted(r["term"] for r in terms.select("term").distinct().collect()), docs.count(), forms)
    found.kind = terms.schema["qid"].dataType.simpleString()
    return found


def _or_nothing(score: np.ndarray, met: np.ndarray) -> np.ndarray:
    return np.where(met, score, -np.inf)


def bm25(found: Index, terms: DataFrame, n: int, mode: str = "or", k1: float = 0.0, b: float = 0.2, average: float = 9.63676, binary: bool = True) -> DataFrame:
    """search.bm25 of search.matches, each task's n best."""
    asked = _asked(found, terms)
    w = asked.weights["qw"] * asked.idf
    whole = _sizes(terms, asked.qids)

    def score(block: Block) -> np.ndarray:
        wt = (1.0 if binary else block.tf) / ((1 - b) + b * block.length[block.doc] / average)
        s = block.sum(w, wt / (k1 + wt))
        m = block.sum(np.ones(len(w)))
        if mode == "powerset":
            s = s * (2.0**m - 1) / (2.0**whole - 1)
        return _or_nothing(s, m == whole if mode == "and" else m > 0)

    return found.best(asked.qids, score, asked, n)


def subset_boosted(found: Index, terms: DataFrame, n: int, by: str = "idf") -> DataFrame:
    """search.subset_boosted, each task's n best."""
    asked = _asked(found, terms)
    s = asked.weights["qw"] * asked.idf
    w = s if by == "idf" else asked.weights["qw"]
    total, size = np.bincount(asked.query, w, len(asked.qids)), asked.each

    def score(block: Block) -> np.ndarray:
        m = block.sum(np.ones(len(s)))
        with np.errstate(divide="ignore", invalid="ignore"):
            value = 2.0 ** (m - 2) * (block.sum(s * w) + block.sum(w) * block.sum(s)) / total / (2.0**size - 1)
        return _or_nothing(value, m > 0)

    return found.best(asked.qids, score, asked, n)


def grid(found: Index, terms: DataFrame, bs: list[float], k1s: list[float], average: float, n: int) -> DataFrame:
    """search.bm25_grid of search.matches."""
    asked = _asked(found, terms)
    return found.grid(asked.qids, asked, bs, k1s, average, n)


def expanded(found: Index, own: DataFrame, wide: DataFrame, n: int) -> DataFrame:
    """The expanded queries `wide`, for the documents that match the queries themselves."""
    both = wide.join(own.select("qid", "term", F.lit(1.0).alias("own")), ["qid", "term"], "left").na.fill(0.0, ["own"])
    asked = _asked(found, both, ("qw", "own"))
    w, first = asked.weights["qw"] * asked.idf, asked.weights["own"]
    return found.best(asked.qids, lambda block: _or_nothing(block.sum(w), block.sum(first) > 0), asked, n)


def filtered(found: Index, own: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """expand.filtered_scores of the matches of the queries' terms and of the chosen ones (qid, term, qw)."""
    both = own.select("qid", "term", "qw", F.lit(1.0).alias("own"), F.lit(0.0).alias("more")).unionByName(chosen.select("qid", "term", "qw", F.lit(0.0).alias("own"), F.lit(1.0).alias("more")))
    asked = _asked(found, both, ("qw", "own", "more"))
    w, first, more = asked.weights["qw"] * asked.idf, asked.weights["own"], asked.weights["more"]

    def score(block: Block) -> np.ndarray:
        held = block.sum(first)
        return _or_nothing(block.sum(w * first) * (1 + block.sum(more)) + held * block.sum(w * more), held > 0)

    return found.best(asked.qids, score, asked, n)


def _asked(found: Index, terms: DataFrame, columns: tuple[str, ...] = ("qw",)) -> Asked:
    return Asked(terms, found.idf, found.names, sorted(r["qid"] for r in terms.select("qid").distinct().collect()), columns)


def _sizes(terms: DataFrame, qids: list) -> np.ndarray:
    """The number of terms of each query, with those that no document has."""
    size = {r["qid"]: r["count"] for r in terms.groupBy("qid").count().collect()}
    return np.array([size[q] for q in qids], float)
