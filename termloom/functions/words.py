"""Tokens and their counts of whole Arrow batches: the same tokens as text.tokens, without a row for each of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_IN = np.zeros(256, bool)
_IN[[*b"abcdefghijklmnopqrstuvwxyz0123456789#@"]] = True
#: Bytes of text that are split at once where words are looked up.
PIECE = 1 << 23


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, token) of all tokens of lower-cased texts, in order. A byte of another character separates like any sign."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _IN.take(data)
    start = inside.copy()
    start[1:] = inside[1:] > inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[firsts] = inside[firsts]
    end = inside.copy()
    end[:-1] = inside[:-1] > (inside[1:] > start[1:])
    at = np.flatnonzero(start)
    ends = np.concatenate(([0], np.cumsum(np.flatnonzero(end) - at + 1))).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
    return np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, offsets))), found


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows that end in the same PIECE bytes of its texts."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy().astype(np.int64)) // PIECE
    edges = [0, *(np.flatnonzero(ends[1:] != ends[:-1]) + 1).tolist(), len(batch)]
    return (batch.slice(low, high - low) for low, high in zip(edges, edges[1:]) if low < high)


def known_words(texts: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in `known`) of the tokens that are known, in order, and the length of each row."""
    row, token = split_words(texts)
    place = pc.index_in(token, value_set=known).fill_null(-1).to_numpy()
    held = np.flatnonzero(place >= 0)
    return row[held], place[held], np.bincount(row, minlength=len(texts))


def word_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(row, code, tf) of the distinct tokens of each row, the vocabulary of the codes, and the length of each row."""
    row, token = split_words(texts)
    coded = token.dictionary_encode()
    size = max(1, len(coded.dictionary))
    key, tf = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
    return key // size, key % size, tf, coded.dictionary, np.bincount(row, minlength=len(texts))


def _lowered(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("doc_id"), F.lower(text).alias("text"))


def unique_ids(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether no id is null or stands twice."""
    n, ids = docs.agg(F.count("*"), F.count_distinct(id_col)).first()
    return n == ids


def flat(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, len, term, tf) of each row."""
    rows = _lowered(docs, id_col, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code, tf, vocabulary, size = word_counts(batch.column(1))
            for low in range(0, len(row), 1 << 18):
                r = row[low : low + (1 << 18)]
                terms = vocabulary.take(pa.array(code[low : low + (1 << 18)])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), pa.array(size[r]), terms, pa.array(tf[low : low + (1 << 18)])], ["doc_id", "len", "term", "tf"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, len long, term string, tf long")


def stats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, len, distinct_terms, max_tf) of each row with a text; max_tf is null where no token is."""
    rows = _lowered(docs, id_col, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, tf, _, size = word_counts(batch.column(1))
            most = np.zeros(len(batch), np.int64)
            np.maximum.at(most, row, tf)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(np.bincount(row, minlength=len(batch))), pa.array(most, mask=most == 0)], ["doc_id", "len", "distinct_terms", "max_tf"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, len long, distinct_terms long, max_tf long")


def doc_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, freq): in how many rows of a batch each token stands; the sums over all batches are the caller's."""
    rows = docs.where(F.col(text).isNotNull()).select(F.lower(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, code, _, vocabulary, _ = word_counts(batch.column(0))
            yield pa.RecordBatch.from_arrays([vocabulary.cast(pa.string()), pa.array(np.bincount(code, minlength=len(vocabulary)))], ["token", "freq"])

    return rows.mapInArrow(run, "token string, freq long")


def held(docs: DataFrame, words: list[str], numbers: list[int] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, len, t, f) of the rows that hold any of the words: their numbers and how often each stands.

    A word's number is its place in `words`, or that in `numbers`; counts of words of one number are added up.
    """
    rows = _lowered(docs, id_col, text)
    sent = rows.sparkSession.sparkContext.broadcast(words)
    number = np.arange(len(words)) if numbers is None else np.array(numbers, np.int64)
    many = int(number.max(initial=0)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.large_string())
        for batch in batches:
            for part in pieces(batch, 1):
                row, place, size = known_words(part.column(1), known)
                key, tf = np.unique(row * many + number[place], return_counts=True)
                n = np.bincount(key // many, minlength=len(part))
                kept = np.flatnonzero(n)
                ends = pa.array(np.concatenate(([0], np.cumsum(n[kept]))), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (key % many, tf)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept)), pa.array(size[kept]), *lists], ["doc_id", "len", "t", "f"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, len long, t array<int>, f array<int>")
