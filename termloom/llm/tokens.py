"""Token ids as ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are range-partitioned and sorted by id before they are written, so stripe and row-group statistics
are tight: a lookup by id or range of ids reads the stripes that can hold it, and stripes are read in parallel.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import quoted, shared_dir

#: Vocabulary file of the tokenizer (base64 piece and rank on each line), and how it cuts texts into pieces.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STRIPE_BYTES, INDEX_ROWS = 16 << 20, 1000


@lru_cache(2)
def tokenizer(vocabulary: str = VOCABULARY):
    import tiktoken

    lines = Path(vocabulary).read_bytes().splitlines()
    ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A cut before a space is safe where no white space precedes it: then it begins a run of white space, and no piece of
#: the pattern goes on into one. Texts with a space after white space are encoded one by one.
RUN = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}] "
END = r"^$|[\s\x0B\x1C-\x1F\x{85}\p{Z}]$"
#: Bytes of text that are encoded at once; a longer text is encoded alone.
BATCH_BYTES = 12 << 20


class Encoder:
    """Token ids of many texts at once: words are cut in bulk, and the distinct ones are encoded as one text."""

    def __init__(self, vocabulary: str) -> None:
        self.own = tokenizer(vocabulary)
        self.bytes = np.array([len(self.own.decode_single_token_bytes(t)) for t in range(self.own.n_vocab)])

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.own.encode_ordinary(text), np.int32)

    def _words(self, words: pa.StringArray) -> tuple[list[np.ndarray], np.ndarray]:
        """(ids in pieces, number of ids of each) of every word with a space before it; token and word ends meet at the same bytes.

        Words that are empty or end in white space would run into the next one, and are encoded one by one.
        """
        apart = pc.match_substring_regex(words, END).to_numpy(False)
        whole = words.filter(pa.array(~apart))
        counts = np.zeros(len(words), np.int64)
        parts = [np.zeros(0, np.int32)]
        if len(whole):
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole), " ")[0].as_py()
            parts = [self._one(" " + text)]
            ends = np.cumsum(pc.binary_length(whole).to_numpy().astype(np.int64) + 1)
            counts[~apart] = np.diff(np.searchsorted(np.cumsum(self.bytes[parts[0]]), ends, "right"), prepend=0)
        if apart.any():
            starts = (np.cumsum(counts) - counts)[apart]
            own = [self._one(" " + w) for w in words.filter(pa.array(apart)).to_pylist()]
            counts[apart] = [len(x) for x in own]
            parts = [x for pair in zip(np.split(parts[0], starts), [*own, np.zeros(0, np.int32)]) for x in pair]
        return parts, counts

    def ids(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts end to end, number of ids of each); null texts have none."""
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(texts, " ")
        words, stops = lists.flatten(), lists.offsets.to_numpy()
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy().copy()
        parts, counts = self._words(coded.dictionary)
        firsts = [self._one(w) for w in words.take(pa.array(stops[:-1])).to_pylist()]  # no space before these
        which[stops[:-1]] = len(counts) + np.arange(len(firsts))
        counts, raw = np.concatenate((counts, [len(x) for x in firsts])).astype(np.int64), np.concatenate([*parts, *firsts])
        own = counts[which]
        ends = np.cumsum(own)
        ids = raw[np.repeat((np.cumsum(counts) - counts)[which] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)]
        ends = np.concatenate(([0], ends))[stops]
        sizes = np.diff(ends)
        odd = np.flatnonzero(pc.match_substring_regex(texts, RUN).to_numpy(False))
        if len(odd):
            parts = np.split(ids, ends[1:-1])
            for i in odd:
                parts[i] = self._one(texts[i].as_py())
                sizes[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, sizes


@lru_cache(2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(vocabulary)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of each row; a null text has null tokens, an empty one an empty list.

    The vocabulary file is read on the driver and sent along, so the workers need not have it.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary)
    name = Path(vocabulary).name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(SparkFiles.get(name))
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().astype(np.int64))
            at = 0
            while at < b.num_rows:
                size = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, "right")) - at)
                part = b.slice(at, size)
                at += size
                texts = part.column(1)
                ids, counts = own.ids(texts)
                none = texts.is_null()
                stops = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                sizes = pc.if_else(none, pa.scalar(None, pa.int32()), pa.array(counts.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.ListArray.from_arrays(stops, pa.array(ids), mask=none)], names=["doc_id", "n_tokens", "token_ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(quoted(id_col), quoted(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, n_tokens int, token_ids array<int>")


def write_orc(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> None:
    """Token ids of docs as ORC files in order of the document id; rows with one id stand in any order, null ids first."""
    ordered = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    options = {
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": INDEX_ROWS,
        "orc.stripe.size": STRIPE_BYTES, "orc.compress": "ZSTD", "orc.encoding.strategy": "COMPRESSION", "orc.write.format": "0.12",
    }
    encode(ordered, vocabulary=vocabulary).write.options(**options).orc(path)


def read_orc(spark: SparkSession, path: str, ids: list | None = None, kind: str = "long") -> DataFrame:
    """The stored rows; with ids, only these, by predicates that the ORC reader checks against its metadata."""
    rows = spark.read.schema(f"doc_id {kind}, n_tokens int, token_ids array<int>").orc(path)
    return rows if ids is None else rows.where(F.col("doc_id").isin(list(ids)))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of docs, written as ORC into the shared folder and read from there.

    Null ids and null texts stay null, empty texts have no tokens, very long texts are encoded whole, repeated
    rows are stored as often as they come, extra columns are left out, an empty table gives no row.
    """
    path = shared_dir(docs.sparkSession)
    write_orc(docs, path, id_col, text_col, vocabulary)
    return read_orc(docs.sparkSession, path, kind=docs.schema[id_col].dataType.simpleString())
