"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Items and training texts are compared as sequences of lower-cased words. The automaton of all items is
streamed over a text once: after each word it holds the longest item substring that ends there. A word is
removed when it lies in a range of the text that is a substring of an item and has at least `max_words` words,
or at least `max_coverage` of the words of the shortest item that holds it, and no fewer than `min_words`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from termloom.llm.common import WORD, free_name, mix, quoted, token_hashes

MAX_WORDS, MAX_COVERAGE, MIN_WORDS = 13, 0.8, 5
#: Words of the items whose automata are on the driver and sent to the executors at once (some 500 bytes a word);
#: more items are taken in several passes over the texts.
AUTOMATON_WORDS = 200_000


class SuffixAutomaton:
    """Accepts every substring of the added word sequences; a state also knows the shortest item it occurs in."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.item_words = [-1], [0], [0]

    def add(self, words: list[str]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)
        last, size = 0, len(words)
        for w in words:  # marks the states of all substrings of this item, suffix links of each prefix
            last = state = self.next[last][w]
            while state > 0 and not 0 < self.item_words[state] <= size:
                self.item_words[state] = size
                state = self.link[state]

    def _clone(self, p: int, q: int, w: str) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.item_words.append(self.item_words[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, p: int, w: str) -> int:
        if w in self.next[p]:
            q = self.next[p][w]
            return q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[p] + 1)
        self.item_words.append(0)
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return new

    def finish(self, max_words: int, max_coverage: float, min_words: int) -> None:
        """For each state: how long a match must be, and the longest proper suffix that is long enough anyway."""
        n = len(self.next)
        self.need, self.suffix, self.low = [1 << 60] * n, [0] * n, [1 << 60] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            self.need[v] = min(max_words, max(min_words, math.ceil(max_coverage * self.item_words[v] - 1e-9)))
            p = self.link[v]
            self.suffix[v] = self.length[p] if p > 0 and self.length[p] >= self.need[p] else self.suffix[p]
            self.low[v] = 0 if self.suffix[v] else self.need[v]

    def spans(self, words: list[str]) -> list[tuple[int, int]]:
        """[from, to) word ranges, unmerged: for each end, the longest match that is over a limit."""
        step, link, length, low = self.next, self.link, self.length, self.low
        state = size = 0
        moves = step[0]
        found: list[tuple[int, int]] = []
        for i, w in enumerate(words, 1):
            if w in moves:
                state = moves[w]
                size += 1
            elif state:
                while state and w not in moves:
                    state = link[state]
                    moves = step[state]
                if w in moves:
                    size = length[state] + 1
                    state = moves[w]
                else:
                    size = 0
            else:
                continue
            moves = step[state]
            if size >= low[state]:
                found.append((i - (size if size >= self.need[state] else self.suffix[state]), i))
        return found


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of the ranges; those that touch become one."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def normalise(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def build(texts: list[str | None], max_words: int = MAX_WORDS, max_coverage: float = MAX_COVERAGE, min_words: int = MIN_WORDS) -> SuffixAutomaton:
    """The automaton of all items. Blank and repeated items add nothing."""
    machine = SuffixAutomaton()
    for words in sorted({tuple(normalise(t)) for t in texts} - {()}):
        machine.add(list(words))
    machine.finish(max_words, max_coverage, min_words)
    return machine


def runs(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, hash) of every run of n words."""
    words, counts = token_hashes(texts)
    doc = np.repeat(np.arange(len(counts)), counts)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            grams = (grams ^ words[j : j + len(grams)]) * np.uint64(0x9E3779B97F4A7C15)
        grams = mix(grams)
    whole = doc[n - 1 :] == doc[: len(grams)] if len(grams) else np.zeros(0, bool)
    return doc[: len(grams)][whole], grams[whole]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    return known[np.minimum(at, len(known) - 1)] == values


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Character ranges of the words of text, one for each word of its lower-cased form."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in WORD.finditer(low)]
    back = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]  # a character may lower to several
    return [(back[m.start()], back[m.end() - 1] + 1) for m in WORD.finditer(low)]


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without these word ranges; the blanks left on both sides of a cut become one."""
    at = word_offsets(text)
    parts, start = [], 0
    for a, b in spans:
        parts.append(text[start : at[a][0]])
        start = at[b - 1][1]
    parts.append(text[start:])
    out = parts[0]
    for part in parts[1:]:
        gap = re.match(r"\s*", part).end()
        if out and out[-1].isspace():
            part = part[gap:]
        out += part
    return out


SPANS = "array<struct<start:int,words:int>>"


def _pass(machine, shortest: int, text_at: int, spans_at: int | None, last: bool):
    """Adds the ranges of one automaton to those found before; after the last one they are merged and cut out."""
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, automaton = machine.value
        for b in (x.slice(at, 512) for x in batches for at in range(0, x.num_rows, 512)):
            texts, columns = b.column(text_at).to_pylist(), b.columns
            found: dict[int, list[tuple[int, int]]] = {}
            if spans_at is not None:
                found = {i: [(s["start"], s["start"] + s["words"]) for s in own] for i, own in enumerate(columns.pop(spans_at).to_pylist()) if own}
            doc, grams = runs(texts, shortest)
            for i in np.unique(doc[_among(grams, known)]).tolist():
                found[i] = merge(found.get(i, []) + automaton.spans(normalise(texts[i])))
            spans: list[list[dict]] = [[] for _ in texts]
            for i, own in found.items():
                spans[i] = [{"start": a, "words": z - a} for a, z in own]
                texts[i] = cut(texts[i], own) if last and own else texts[i]
            columns[text_at] = pa.array(texts, b.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, spans_type)], names=[*b.schema.names[: len(columns)], "spans"])

    return run


def scan(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "text", max_words: int = MAX_WORDS, max_coverage: float = MAX_COVERAGE, min_words: int = MIN_WORDS, automaton_words: int = AUTOMATON_WORDS) -> tuple[DataFrame, str]:
    """docs with the cleaned text in text_col and the removed word ranges in an added column, whose name is returned.

    Null and empty texts have no ranges and stay as they are; so do all texts when there is no item. Items of fewer
    than `min_words` words are never matched, whatever their coverage. Very long texts are scanned whole, repeated
    rows alike; nulls elsewhere and extra columns, whatever their names, pass through (the added column is called
    `removed`, with underscores where that is taken). The items are counted first; each pass over the texts holds
    about `automaton_words` words of them.
    """
    wanted = items.select(F.col(item_col).cast("string").alias("t")).where("t is not null").distinct()
    words = wanted.agg(F.sum(F.size(F.split(F.lower("t"), "[^0-9a-z\u00c0-\U0010ffff]+")))).first()[0] or 0
    passes = max(1, -(-words // automaton_words))
    shortest = min(max_words, min_words)  # no range of fewer words is removed, so a text without any item's run of these has none
    name, where, found = free_name(docs, "removed"), docs.columns.index(text_col), docs
    kept = StructType([*docs.schema.fields, StructField(name, _parse_datatype_string(SPANS))])
    for n in range(passes):
        texts = [r["t"] for r in wanted.where(F.pmod(F.xxhash64("t"), F.lit(passes)) == n).collect()]
        machine = docs.sparkSession.sparkContext.broadcast((np.unique(runs(texts, shortest)[1]), build(texts, max_words, max_coverage, min_words)))
        found = found.mapInArrow(_pass(machine, shortest, where, len(docs.columns) if n else None, n == passes - 1), kept)
    return found, name


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **limits) -> DataFrame:
    """docs with benchmark passages cut out of the texts, columns as before; length_col follows the new text.

    A document of which nothing but blanks and punctuation is left is dropped. See scan() for nulls, long texts,
    repeated rows, clashing names and empty tables.
    """
    found, name = scan(docs, items, text_col, **limits)
    hit = F.size(quoted(name)) > 0
    out = found.where(~hit | quoted(text_col).rlike(r"[\p{L}\p{N}]"))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(hit, F.length(quoted(text_col)).cast(docs.schema[length_col].dataType)).otherwise(quoted(length_col)))
    return out.drop(name)


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row for each contaminated document: (doc_id, n_spans, n_words, longest, removed, clean_text).

    A null id stays null, repeated rows give repeated rows, extra columns are left out; see scan() for the rest.
    """
    found, name = scan(docs.select(id_col, text_col), items, text_col, **limits)
    spans = quoted(name)
    return found.where(F.size(spans) > 0).select(
        F.col(id_col).alias("doc_id"), F.size(spans).alias("n_spans"), F.aggregate(spans, F.lit(0), lambda a, x: a + x["words"]).alias("n_words"),
        F.array_max(F.transform(spans, lambda x: x["words"])).alias("longest"), spans.alias("removed"), F.col(text_col).alias("clean_text"),
    )
