"""N-gram Jaccard self-join by partition-and-enumerate signatures, and near-duplicate classes from it.

Sets of word n-grams fall into size bands [l, l/t). Two sets with Jaccard >= t lie in the same or in
neighbouring bands, and their symmetric difference is at most k = (1-t)/(1+t) * (sum of the largest sizes).
For each band the hashed feature domain is cut into n1 parts of n2 subparts. k differences leave some part
with at most k2 = k // n1 of them, so the two sets agree on one of the enumerated subsets of n2-k2
subparts there: that subset's hash is the signature which they share. Sets beyond `target` features are
first restricted to a hash-defined part of the domain (the same for both sides of a pair), with k scaled
alike, so signatures a document do not grow with its length.

Documents of equal feature sets are one node, named by a hash of the set. Signatures find which nodes are
connected; inside each connected class all nodes are then compared, in blocks, so that no link is missing there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from termloom.llm.common import BROADCAST_ROWS, dropped, free_name, join_ids, mix, quoted, stored, token_hashes

NGRAM, THRESHOLD, TARGET = 2, 0.75, 96
#: Features that a signature must stand for: sets of at least SOLID_FROM need two, so that one common n-gram alone
#: brings no candidates together; smaller ones need one.
SOLID_FROM = 24
#: Hash buckets of a sketch, two in a byte: the number of features in each, up to 15. The distance of two sketches is
#: never more than the difference of their sets, so it rules pairs out at a tenth of the features' size.
SKETCH = 512
#: Nodes of a block of a signature bucket, and features in a block of a class: two blocks meet in one task.
BLOCK_NODES, BLOCK_FEATURES = 256, 1 << 18
#: Sets that a task remembers in order to sign copies once; beyond that many it starts anew.
SEEN = 1 << 20


def shingles(texts: list[str | None], n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word n-grams of each text, sorted within the text, end to end; and how many each has.

    A text of fewer than n words has one feature, all its words in order; a text without words has none.
    """
    words, counts = token_hashes(texts)
    doc = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        salted = [words * np.uint64(2 * j + 3) + np.uint64(j) for j in range(n)]
        grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for j in range(n):
            grams = mix(grams + salted[j][j : j + len(grams)])
        whole = np.flatnonzero(doc[n - 1 :] == doc[: len(grams)]) if len(grams) else np.zeros(0, np.int64)
        ids, feats = doc[whole], grams[whole]
        short = np.flatnonzero((counts > 0) & (counts < n))
        starts = np.concatenate(([0], np.cumsum(counts)))
        if len(short):
            own = np.zeros(len(short), np.uint64)
            for j in range(n - 1):
                has = counts[short] > j
                own[has] = mix(own[has] + salted[j][starts[short[has]] + j])
            ids, feats = np.concatenate((ids, short)), np.concatenate((feats, mix(own + np.uint64(77))))
    order = np.lexsort((feats, ids))
    ids, feats = ids[order], feats[order]
    first = np.ones(len(ids), bool)
    first[1:] = (ids[1:] != ids[:-1]) | (feats[1:] != feats[:-1])
    return feats[first], np.bincount(ids[first], minlength=len(counts))


@lru_cache(None)
def bands(threshold: float) -> tuple[int, ...]:
    """Lower size of each band; a set and any set at least `threshold` similar are at most one band apart."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(math.floor(low[-1] / threshold) + 1)
    return tuple(low)


@lru_cache(None)
def scheme(band: int, threshold: float, target: int) -> tuple[float, int, int, int]:
    """(share of the domain, n1, n2, k2) for signatures between sets of `band` and of `band` or the band below."""
    top = bands(threshold)[band + 1] - 1
    share = min(1.0, target / top)
    k = math.floor((1 - threshold) / (1 + threshold) * 2 * top * share + 1e-9)
    if k <= 3:
        return share, 1, k + 2 if k else 1, k
    return share, (k + 2) // 2, 3, 1


def signatures(feats: np.ndarray, counts: np.ndarray, threshold: float = THRESHOLD, target: int = TARGET) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, signature) pairs of all sets; empty subsets of the domain make no signature."""
    lows = np.array(bands(threshold))
    starts = np.concatenate(([0], np.cumsum(counts)))
    own = np.searchsorted(lows, counts, side="right") - 1
    owners, sigs = [], []
    with np.errstate(over="ignore"):
        spread = mix(feats ^ np.uint64(0x51ED270B5F3A1C77))
        for band in np.unique(own[counts > 0]):
            sets = np.flatnonzero(own == band)
            pick = np.concatenate([np.arange(starts[s], starts[s + 1]) for s in sets])
            rank = np.repeat(np.arange(len(sets)), counts[sets])
            for instance in (int(band), int(band) + 1):
                share, n1, n2, k2 = scheme(instance, threshold, target)
                use = slice(None) if share >= 1 else np.flatnonzero(feats[pick] < np.uint64(int(share * 2.0**63) * 2))
                h, r, f = spread[pick][use], rank[use], feats[pick][use]
                part = ((h >> np.uint64(40)) % np.uint64(n1)).astype(np.int64)
                sub = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(n2)).astype(np.int64)
                cell = (r * n1 + part) * n2 + sub
                total = np.zeros(len(sets) * n1 * n2, np.uint64)
                np.add.at(total, cell, mix(f + np.uint64(instance)))
                held = np.bincount(cell, minlength=len(total)).reshape(-1, n2)
                total = total.reshape(-1, n2)
                which = np.tile(np.arange(n1), len(sets))
                solid = np.repeat(np.where(counts[sets] < SOLID_FROM, 1, 2), n1)
                for number, subset in enumerate(combinations(range(n2), n2 - k2)):
                    keep = np.flatnonzero(held[:, subset].sum(1) >= solid)
                    salt = ((instance * 4096 + number) * 65536 + which[keep]).astype(np.uint64)
                    sigs.append(mix(total[keep][:, subset].sum(1, dtype=np.uint64) + mix(salt + np.uint64(1))))
                    owners.append(sets[keep // n1])
    if not sigs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(sigs).view(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _keys(feats: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each whole set: what documents of equal features have in common."""
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        held = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(feats + np.uint64(5)), dtype=np.uint64)))
        return mix(held[ends] - held[ends - counts] + counts.astype(np.uint64)).view(np.int64)


def _sign(n: int, threshold: float, target: int):
    """(id, key, n, sigs) of each text with words; of copies that a task meets the first alone has its signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in _batches(batches):
            feats, counts = shingles(b.column(1).to_pylist(), n)
            keys = _keys(feats, counts)
            new = np.zeros(len(counts), bool)
            for i in np.flatnonzero(counts):
                if keys[i] not in seen:
                    new[i] = True
                    seen.add(keys[i])
            if len(seen) > SEEN:
                seen.clear()
            own = np.flatnonzero(new)
            who, sigs = signatures(feats[np.repeat(new, counts)], counts[own], threshold, target)
            order = np.argsort(who, kind="stable")
            sizes = np.zeros(len(counts), np.int64)
            sizes[own] = np.bincount(who, minlength=len(own))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(sigs[order]))
            whole = pa.RecordBatch.from_arrays([b.column(0), pa.array(keys), pa.array(counts.astype(np.int64)), lists], names=["id", "key", "n", "sigs"])
            yield whole.filter(pa.array(counts > 0))

    return run


def _features(n: int):
    """(key, n, sketch, feats) of the texts whose set has the key that is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in _batches(batches):
            feats, counts = shingles(b.column(1).to_pylist(), n)
            keys, ends = _keys(feats, counts), np.cumsum(counts)
            held = np.bincount(np.repeat(np.arange(len(counts)), counts) * SKETCH + (feats >> np.uint64(55)).astype(np.int64), minlength=len(counts) * SKETCH)
            held = np.minimum(held, 15).astype(np.uint8).reshape(len(counts), SKETCH)
            sketch = held[:, 0::2] | held[:, 1::2] << 4
            own = [i for i in np.flatnonzero(keys == b.column(2).to_numpy()) if keys[i] not in seen and not seen.add(keys[i])]
            raw = [feats[ends[i] - counts[i] : ends[i]].tobytes() for i in own]
            yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array(counts[own].astype(np.int64)), pa.array([sketch[i].tobytes() for i in own], pa.binary()), pa.array(raw, pa.binary())], names=["key", "n", "sketch", "feats"])

    return run


def _unpacked(sketches: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, SKETCH // 2)
    return np.concatenate((raw & 15, raw >> 4), 1).view(np.int8)


def _fits(threshold: float, n: np.ndarray, m: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether sets of n and m features with sketches p and q can be similar."""
    fit = np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9
    fit[fit] = np.abs(p[fit] - q[fit]).sum(1) <= (1 - threshold) / (1 + threshold) * (n[fit] + m[fit]) + 1e-6
    return fit


def _screen(threshold: float):
    """(a, b) of the rows (a, b, n, m, sketch, sketch) that can be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, 4096):
            fit = _fits(threshold, b.column(2).to_numpy(), b.column(3).to_numpy(), _unpacked(b.column(4)), _unpacked(b.column(5)))
            yield b.select([0, 1]).filter(pa.array(fit))

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sims = np.empty(b.num_rows)
        last_raw, last = None, None
        for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
            if last_raw is None or not x.equals(last_raw):
                last_raw, last = x, np.frombuffer(x.as_py(), np.uint64)
            other = np.frombuffer(y.as_py(), np.uint64)
            small, big = (last, other) if len(last) < len(other) else (other, last)
            at = np.searchsorted(big, small)
            common = int((big[np.minimum(at, len(big) - 1)] == small).sum()) if len(big) else 0
            sims[i] = common / max(1, len(small) + len(big) - common)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sims)], names=["a", "b", "jaccard"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches regrouped so that rows with one value in column 0 come together."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cell = b.column(0).to_numpy()
        cut = int(np.searchsorted(cell, cell[-1], "left"))
        if cut or (rest and rest[-1].column(0)[0].as_py() != cell[0]):
            yield pa.Table.from_batches([*rest, b.slice(0, cut)]).combine_chunks().to_batches(1 << 40)[0] if rest or cut else b
            rest = []
        rest.append(b.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches(1 << 40)[0]


def _candidates(threshold: float):
    """(a, b) of the nodes of a cell that may be similar: of different groups, of fitting sizes and sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cells(batches):
            cell, side, key, root, lead, n = (b.column(i).to_numpy() for i in range(6))
            sketch = _unpacked(b.column(6))
            at, step, found = np.arange(len(cell)), 0, []
            while len(at):
                step += 1
                at = at[: np.searchsorted(at, len(cell) - step)]
                at = at[cell[at] == cell[at + step]]
                x, y = at, at + step
                meet = (root[x] != root[y]) & ((side[x] != side[y]) | (side[x] == 2)) & (key[x] != lead[x]) & (key[y] != lead[y])
                x, y = x[meet], y[meet]
                for part in range(0, len(x), 4096):
                    p, q = x[part : part + 4096], y[part : part + 4096]
                    fit = _fits(threshold, n[p], n[q], sketch[p], sketch[q])
                    found.append(np.stack((np.minimum(key[p], key[q])[fit], np.maximum(key[p], key[q])[fit])))
            pairs = np.unique(np.concatenate(found, 1), axis=1) if found else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return run


def common_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Number of common features of each pair of sets, by products of 0-1 matrices over the features that two of them have."""
    feats, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, often = np.unique(feats, return_inverse=True, return_counts=True)
    keep = often[column] > 1
    owner, column = owner[keep], (np.cumsum(often > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        held = np.zeros((len(sets), min(width, int(column[-1]) + 1 - low)), np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        common += held @ held.T
    return common.astype(np.int64)


def _links(threshold: float, count: bool):
    """Of the cells (cell, side, key, feats, docs): (a, b, jaccard) of all similar nodes, or (key, links), documents linked to each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cells(batches):
            cell, side, key, docs = (b.column(i).to_numpy() for i in (0, 1, 2, 4))
            edges = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]))
            found = []
            for at, stop in zip(edges, edges[1:]):
                sets = [np.frombuffer(f.as_buffer(), np.uint64) for f in b.column(3).slice(at, stop - at)]
                size, own, keys = np.array([len(s) for s in sets]), side[at:stop], key[at:stop]
                common = common_counts(sets)
                like = common >= (threshold - 1e-9) * (size[:, None] + size[None, :] - common)
                like &= (own[:, None] != own[None, :]) | (own[:, None] == 2)
                np.fill_diagonal(like, False)
                if count:
                    found.append((keys, like.astype(np.int64) @ docs[at:stop]))
                else:
                    x, y = np.nonzero(np.triu(like))
                    found.append((np.minimum(keys[x], keys[y]), np.maximum(keys[x], keys[y]), common[x, y] / (size[x] + size[y] - common[x, y])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["key", "links"] if count else ["a", "b", "jaccard"])

    return run


def _in_blocks(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """rows (group, key, ...) with the cells of pairs of blocks in which they meet: (cell, side, ...), in order of the cell.

    A group of B blocks makes B * (B + 1) / 2 cells; side is 2 where a block meets itself, else tells the blocks apart.
    """
    own = F.pmod(F.hash("key"), F.col("_blocks"))
    rows = rows.withColumn("_blocks", blocks.cast("int")).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    side = F.when(F.col("_own") == F.col("_other"), 2).otherwise((F.col("_own") > F.col("_other")).cast("int"))
    cell = F.xxhash64(group, F.least("_own", "_other"), F.greatest("_own", "_other"))
    rest = [c for c in rows.columns if c not in ("_blocks", "_own", "_other", group)]
    return rows.select(cell.alias("cell"), side.alias("side"), *rest).repartition("cell").sortWithinPartitions("cell")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root) of the nodes of all edges (a, b) of the batches: roots hook onto smaller ones, then paths are cut short."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    a, b = (np.concatenate(c) for c in zip(*held))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(root, short := root[root]):
            root = short
    for low in range(0, len(nodes), 1 << 18):
        part = slice(low, low + (1 << 18))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[root[part]])], names=["id", "root"])


def components(edges: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(id, root) of every node of the edges (a, b), root being the smallest id of its connected component.

    Up to `limit` edges of integers are joined in one task. More of them, or ids of another type, alternate large-star
    and small-star contraction; each round is written to the shared folder.
    """
    flip = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(edges.select("a", "b").where("a <> b").distinct())
    kind = edges.schema["a"].dataType
    if isinstance(kind, IntegralType) and edges.schema["b"].dataType == kind and edges.count() <= limit:
        return edges.coalesce(1).mapInArrow(_joined, f"id {kind.simpleString()}, root {kind.simpleString()}")
    state = None
    while True:
        both = flip(edges)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a")
        last, edges = edges, stored(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        dropped(last)
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(20,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    leaves = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("id"), "root")).distinct()


class Near:
    """The near-duplicate structure of docs, in stored tables.

    docs: (id, key) of each document with words, key naming its node. feats: (key, n, sketch, feats) of the nodes that
    share a signature with another. groups: (key, root) of the nodes that are connected to another.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, target: int = TARGET) -> None:
        self.threshold = threshold
        kind = docs.schema[id_col].dataType.simpleString()
        rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("t")).where("id is not null and t is not null")
        signed = stored(rows.mapInArrow(_sign(n, threshold, target), f"id {kind}, key long, n long, sigs array<long>"))
        self.docs = stored(signed.select("id", "key").distinct())
        each = signed.select("key", F.explode("sigs").alias("sig"))
        # the smallest node of every signature that several have: partial minima are made before anything is shuffled
        leads = stored(each.groupBy("sig").agg(F.min("key").alias("lead"), F.max("key").alias("last")).where("lead < last").select("sig", "lead"))
        side = F.broadcast(leads) if leads.count() <= BROADCAST_ROWS else leads.hint("merge")
        buckets = stored(each.join(side, "sig").distinct())
        dropped(signed)
        members = stored(buckets.select("key").distinct())
        asked = stored(join_ids(self.docs, members, "key", "left_semi").groupBy("key").agg(F.min("id").alias("id")))
        held = join_ids(rows, asked, "id", "inner").select("id", "t", "key").mapInArrow(_features(n), "key long, n long, sketch binary, feats binary")
        held = stored(held.withColumn("at", F.monotonically_increasing_id()))
        once = stored(held.groupBy("key").agg(F.min("at").alias("at"), F.count("*").alias("rows")))
        repeated = not once.where("rows > 1").isEmpty()  # a set that several rows of one id have
        self.feats = (stored(join_ids(held, once.select("at"), "at", "left_semi")) if repeated else held).drop("at")
        stars = buckets.where("lead < key").select(F.col("lead").alias("a"), F.col("key").alias("b")).distinct()
        edges = self._verified(self._met(stored(stars), "n", "sketch").mapInArrow(_screen(threshold), "a long, b long")).select("a", "b")
        twice = stored(self.docs.groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("id", "a"))
        if not twice.isEmpty():  # rows with one id and several texts are one document
            edges = edges.unionByName(self.docs.join(twice, "id").where("a < key").select("a", F.col("key").alias("b")))
        first = stored(components(edges))
        second = self._verified(self._apart(buckets, first))
        self.groups = stored(components(first.select(F.col("root").alias("a"), F.col("id").alias("b")).unionByName(second.select("a", "b"))).withColumnRenamed("id", "key"))

    def _met(self, pairs: DataFrame, *what: str) -> DataFrame:
        """(a, b, what of a and what of b, in turn) of stored pairs (a, b) of nodes: what belongs to b goes to where that of a is."""
        small = pairs.count() <= BROADCAST_ROWS
        sent = lambda e: F.broadcast(e) if small else e.hint("merge")
        of = lambda c: self.feats.select(F.col("key").alias(c), *[F.col(x).alias(x + c) for x in what])
        left = of("a").join(sent(pairs.select("a").distinct()), "a", "left_semi")
        both = of("b").join(sent(pairs), "b").join(left.hint("merge"), "a")
        return both.select("a", "b", *[x + c for x in what for c in "ab"])

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes that are similar enough."""
        found = self._met(stored(pairs), "feats").mapInArrow(_verify, "a long, b long, jaccard double")
        return stored(found.where(F.col("jaccard") >= self.threshold - 1e-9))

    def _apart(self, buckets: DataFrame, groups: DataFrame) -> DataFrame:
        """Pairs of nodes that share a signature, are in different groups so far and neither the bucket's smallest.

        Buckets are cut into blocks, so that a large one is many tasks, and pairs that sizes or sketches rule out are
        not sent anywhere. Pairs inside one group can't change the groups.
        """
        placed = buckets.join(groups.withColumnRenamed("id", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        several = placed.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("nodes")).where("lo < hi and nodes > 2")
        mixed = placed.join(several.select("sig", "nodes"), "sig").join(self.feats.select("key", "n", "sketch"), "key")
        cells = _in_blocks(mixed.select("sig", "key", "root", "lead", "n", "sketch", "nodes"), "sig", F.ceil(F.col("nodes") / BLOCK_NODES)).drop("nodes")
        return cells.mapInArrow(_candidates(self.threshold), "a long, b long").distinct()

    def links(self, count: bool = False) -> DataFrame:
        """(a, b, jaccard) of all similar pairs of nodes, or with `count` (key, links): the documents that each node is linked to.

        Every node of a class is compared with every other. A class of many features is cut into blocks, which meet
        pair by pair, each meeting in a task.
        """
        own = self.feats.select("key", "n", "feats").join(self.groups, "key").join(self.nodes.select("key", "docs"), "key")
        size = own.groupBy("root").agg(F.sum("n").alias("size"), F.count("*").alias("nodes")).where("nodes > 1")
        rows = own.join(size, "root").select("root", "key", "feats", "docs", "size")
        cells = _in_blocks(rows, "root", F.ceil(F.col("size") / BLOCK_FEATURES)).drop("size")
        found = cells.mapInArrow(_links(self.threshold, count), "key long, links long" if count else "a long, b long, jaccard double")
        return found.groupBy("key").agg(F.sum("links").alias("links")) if count else found

    @property
    def nodes(self) -> DataFrame:
        """(key, docs, first, last): of each node its number of documents and their smallest and greatest id."""
        return self.docs.groupBy("key").agg(F.count("*").alias("docs"), F.min("id").alias("first"), F.max("id").alias("last"))

    def classes(self) -> DataFrame:
        """(key, class_id, docs) of the nodes whose class has several documents; the class is named by its smallest id. Stored."""
        placed = self.nodes.join(self.groups, "key", "left").where("docs > 1 or root is not null").withColumn("root", F.coalesce("root", "key"))
        own = placed.groupBy("root").agg(F.min("first").alias("class_id"), F.max("last").alias("last")).where("class_id <> last").select("root", "class_id")
        return stored(placed.join(own, "root").select("key", "class_id", "docs"))


def near_classes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, n_links) of every document that has a near copy.

    The class is the connected component of the pairs at or above the threshold, named by its smallest id; n_links is
    the number of documents that the document is itself similar to, copies counted one by one. Ids are of any type
    that can be ordered. Rows with one id are one document, with the links of all its texts. Null ids, null texts and
    texts without words are in no class; very long texts are compared whole. Extra columns are ignored; an empty table
    gives no row.
    """
    near = Near(docs, **options)
    placed = near.classes()
    rows = placed.join(near.links(count=True), "key", "left").select("key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("links"))
    rows = join_ids(near.docs, stored(rows), "key", "inner")
    return rows.groupBy(F.col("id").alias("doc_id")).agg(F.min("class_id").alias("class_id"), F.sum("links").alias("n_links"))


def similar_pairs(docs: DataFrame, **options) -> DataFrame:
    """(a, b, jaccard): the similar pairs of documents, one of each node, and (a, copy, 1.0) for every further one of a node.

    A node is named by its smallest id and its documents share its pairs, so n copies take n rows. For null ids, null
    texts, repeated ids and empty tables see near_classes().
    """
    near = Near(docs, **options)
    named = stored(near.nodes.select("key", "first"))
    of = lambda c: named.select(F.col("key").alias(c), F.col("first").alias("id_" + c))
    pairs = near.links().join(of("a"), "a").join(of("b"), "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "jaccard")
    copies = near.docs.join(named, "key").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    return pairs.unionByName(copies)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each near-duplicate class: the one with the smallest id.

    Rows that repeat an id are one document; of them the row with the smallest text stays. Rows with a null
    id, a null text or no words are in no class and stay; very long texts are compared whole. All columns, whatever
    their names, pass through unchanged; an empty table stays empty.
    """
    near = Near(docs, id_col, text_col, **options)
    gone = join_ids(near.docs, near.classes().select("key", "class_id"), "key", "inner").where("id <> class_id")
    gone = stored(gone.select(F.col("id").alias(id_col)).distinct())
    twice = docs.where(quoted(id_col).isNotNull()).groupBy(quoted(id_col)).count().where("count > 1")
    kept = join_ids(docs, gone, id_col, "left_anti")
    if twice.isEmpty():
        return kept
    order = Window.partitionBy(quoted(id_col)).orderBy(quoted(text_col).asc_nulls_last())
    nth = free_name(docs, "nth")
    return kept.withColumn(nth, F.row_number().over(order)).where(quoted(id_col).isNull() | (quoted(nth) == 1)).drop(nth)
