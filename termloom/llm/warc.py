"""WARC files: writer, and a split reader that verifies record boundaries by chains.

A file is read in chunks. Each task lists the places in its chunk that look like a record and, from the
Content-Length there, where the next record would begin. Payloads may hold the same magic, so a candidate counts
only if the chain of successors from the start of the file reaches it. Within a chunk the chain is followed by
the task itself; across chunks pointers are doubled, so the number of rounds grows with the logarithm of the
number of chunks in a file. A second pass then parses each chunk from its verified entry on.

Files whose records are gzip members of their own (*.warc.gz) are read alike: there a candidate is a place that
decompresses, and its successor is where that member ends.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import quoted, shared_dir, stored

MAGIC, VERSIONS = b"WARC/1.", (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
MEMBER = b"\x1f\x8b\x08"
#: Bytes of a chunk, and those read beyond it at once for headers that pass its end.
CHUNK, HEADER = 8 << 20, 1 << 16
LENGTH = re.compile(rb"(?mi)^content-length:[ \t]*(\d+)[ \t]*\r?$")


def _record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    head = [b"WARC-Type: response", b"Content-Type: text/html; charset=utf-8"]
    if page_id is not None:
        head.append(b"WARC-Record-ID: <urn:page:%d>" % page_id)
    if url is not None:
        plain = "".join(f"%{ord(c):02X}" if c in "\r\n%" else c for c in url)
        head.append(b"WARC-Target-URI: " + plain.encode("utf-8", "surrogatepass"))
    if html is None:
        head.append(b"X-Payload: null")
    return VERSIONS[0] + b"\r\n".join([*head, b"Content-Length: %d" % len(payload)]) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One file for each partition of pages, in its order. A retried task writes the same file anew and renames it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        name = f"{root}/part-{task.partitionId():06d}.warc"
        draft = f"{name}.{task.taskAttemptId()}.tmp"
        size = 0
        with fs.open_output_stream(draft) as out:
            for b in batches:
                for row in zip(*(b.column(i).to_pylist() for i in range(3))):
                    size += out.write(_record(*row))
        if size:
            fs.move(draft, name)
        else:
            fs.delete_file(draft)
        yield pa.RecordBatch.from_arrays([pa.array([size])], names=["bytes"])

    rows = pages.select(quoted(id_col).cast("long"), quoted(url_col).cast("string"), quoted(html_col).cast("string"))
    rows.mapInArrow(run, "bytes long").agg(F.sum("bytes")).collect()


def _read(uri: str, start: int, size: int) -> bytes:
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        f.seek(start)
        return f.read(size)


class _Heads:
    """Headers of the records that seem to begin in one piece of a file, which is read on where a header passes its end.

    Headers are asked for in ascending order; what lies between two places is searched once.
    """

    #: More bytes than a Content-Length line has.
    LINE = 256

    def __init__(self, uri: str, base: int, size: int) -> None:
        self.uri, self.base, self.buf = uri, base, _read(uri, base, size)
        self.blank, self.length, self.ended = -1, None, False

    def at(self, at: int) -> tuple[int, int] | None:
        """(start of the payload, its length) of the record that seems to begin at byte `at` of the piece, None if its header is bad."""
        if self.blank < at:
            self.blank, self.length = self.buf.find(b"\r\n\r\n", at), None
            if self.blank < 0:
                self._beyond(at)
            else:
                self._length(at)
        elif self.length and self.length[0] < at:
            self._length(at)
        return (self.blank + 4, self.length[1]) if self.length and not self.ended else None

    def _length(self, at: int) -> None:
        found = LENGTH.search(self.buf, at, self.blank + 2)
        self.length = (found.start(), int(found[1])) if found else None
        if not found and self.blank >= len(self.buf) - 3:
            self._beyond(at)

    def _beyond(self, at: int) -> None:
        """Reads on until the blank line, holding one part at a time; self.ended if there is none."""
        self.length = None
        start, part = at, self.buf[at:]
        while True:
            end = part.find(b"\r\n\r\n")
            found = None if self.length else LENGTH.search(part, start > at, len(part) if end < 0 else end + 2)
            if found and (end >= 0 or found.end() < len(part) - 1):
                self.length = (start + found.start(), int(found[1]))
            if end >= 0:
                self.blank = start + end
                return
            more = _read(self.uri, self.base + start + len(part), 16 * HEADER)
            if not more:
                self.blank, self.ended = 1 << 62, True
                return
            kept = part[-self.LINE :]
            start, part = start + len(part) - len(kept), kept + more


class _Members:
    """Records that seem to be compressed from given bytes of a file on, each a gzip member."""

    def __init__(self, uri: str, base: int, size: int) -> None:
        self.uri, self.base, self.buf = uri, base, _read(uri, base, size)

    def at(self, at: int) -> tuple[bytes, int] | None:
        """(the record, the byte after its member) of the member that seems to begin at byte `at`, None if it is no record."""
        machine, parts, place, part = zlib.decompressobj(31), [], at, self.buf[at : at + HEADER]
        try:
            while part and not machine.eof:
                parts.append(machine.decompress(part))
                if not b"".join(parts[:2])[: len(MAGIC)] == MAGIC[: sum(map(len, parts[:2]))]:
                    return None
                place += len(part)
                part = self.buf[place : place + HEADER] if place < len(self.buf) else _read(self.uri, self.base + place, 16 * HEADER)
        except zlib.error:
            return None
        return (b"".join(parts), place - len(machine.unused_data)) if machine.eof else None


def _starts(buf: bytes, magic: bytes, end: int) -> Iterator[int]:
    at = buf.find(magic)
    while 0 <= at < end:
        if magic != MAGIC or buf.startswith(VERSIONS, at):
            yield at
        at = buf.find(magic, at + 1)


def _packed(uri: str) -> bool:
    return uri.endswith(".gz")


def _scan(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, length, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                base, offsets, leaves = n * chunk, [], {}
                if _packed(uri):
                    members = _Members(uri, base, chunk + HEADER)
                    offsets = [(base + at, base + found[1]) for at in _starts(members.buf, MEMBER, chunk) if (found := members.at(at))]
                else:
                    heads = _Heads(uri, base, chunk + HEADER)
                    found = ((at, heads.at(at)) for at in _starts(heads.buf, MAGIC, chunk))
                    # a successor beyond the end of the file is no record's; the last record may lack its closing line ends
                    offsets = [(base + at, base + f[0] + f[1] + 4) for at, f in found if f and base + f[0] + f[1] <= length]
                for start, after in reversed(offsets):  # the place outside this chunk to which a candidate leads
                    leaves[start] = leaves.get(after, after)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(offsets), pa.string()), pa.array([o for o, _ in offsets], pa.int64()), pa.array([leaves[o] for o, _ in offsets], pa.int64())], names=["file", "at", "to"])

    return run


def entries(spark: SparkSession, folder: str, chunk: int = CHUNK) -> DataFrame:
    """(file, length, at): of every chunk that a chain from a file's start touches, the first record that begins in it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(folder).select("path", "length")
    chunks = files.select(F.col("path").alias("file"), "length", F.explode(F.sequence(F.lit(0), F.expr(f"int(greatest(length - 1, 0) div {chunk})"))).alias("n"))
    chunks = stored(chunks)
    tasks = max(1, min(chunks.count(), 10_000))
    jumps = stored(chunks.select("file", "length", "n").repartition(tasks).mapInArrow(_scan(chunk), "file string, at long, to long"))
    heads = jumps.where("at = 0").select("file", "at")
    # only places that another chunk's candidate leads to (and file starts) can be entries
    aims = jumps.select("file", F.col("to").alias("at")).distinct()
    jumps = stored(jumps.join(aims, ["file", "at"], "left_semi").unionByName(jumps.where("at = 0")).distinct())
    reached, count = stored(heads), -1
    while (now := reached.count()) != count:
        count = now
        on = jumps.select("file", "at", "to")
        further = reached.join(on, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = stored(reached.unionByName(further).distinct().join(jumps.select("file", "at"), ["file", "at"], "left_semi"))
        twice = jumps.select("file", F.col("to").alias("mid"), "at").join(jumps.select("file", F.col("at").alias("mid"), F.col("to")), ["file", "mid"], "left")
        jumps = stored(twice.select("file", "at", F.coalesce("to", "mid").alias("to")))
    return reached.distinct().join(chunks.select("file", "length").distinct(), "file")


def _fields(head: bytes) -> dict[str, str]:
    """Header names in small letters and their values; a header that isn't UTF-8 is taken as Latin-1."""
    try:
        text = head.decode("utf-8")
    except UnicodeDecodeError:
        text = head.decode("latin-1")
    return {name.lower(): value for name, value in re.findall(r"(?m)^([\w-]+):[ \t]*(.*?)\r?$", text)}


def _row(uri: str, at: int, head: bytes, payload: bytes) -> tuple:
    fields = _fields(head)
    own = re.fullmatch(r"<urn:page:(-?\d{1,18})>", fields.get("warc-record-id", ""))
    url = fields.get("warc-target-uri")
    url = url and re.sub("%(0D|0A|25)", lambda m: chr(int(m[1], 16)), url)
    html = None if fields.get("x-payload") == "null" else payload.decode("utf-8", "replace")
    return uri.rsplit("/", 1)[-1], at, int(own[1]) if own else None, url, html, len(payload)


def _plain_records(uri: str, length: int, at: int, stop: int) -> Iterator[tuple]:
    base, heads = at, _Heads(uri, at, stop - at + HEADER)
    buf = heads.buf
    while at < stop and buf.startswith(VERSIONS, at - base) and (found := heads.at(at - base)):
        start, size = found
        if base + start + size > length:
            return
        payload = buf[start : start + size] if start + size <= len(buf) else _read(uri, base + start, size)
        yield _row(uri, at, buf[at - base : start] if start <= len(buf) else _read(uri, at, start - (at - base)), payload)
        at = base + start + size + 4


def _packed_records(uri: str, at: int, stop: int) -> Iterator[tuple]:
    base, members = at, _Members(uri, at, stop - at + HEADER)
    while at < stop and (found := members.at(at - base)):
        record, end = found
        blank = record.find(b"\r\n\r\n")
        size = LENGTH.search(record, 0, blank + 2) if blank >= 0 else None
        if not record.startswith(VERSIONS) or not size or int(size[1]) > len(record) - blank - 4:
            return
        yield _row(uri, at, record[:blank], record[blank + 4 : blank + 4 + int(size[1])])
        at = base + end


def _parse(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, length, at in zip(*(b.column(i).to_pylist() for i in range(3))):
                stop, rows = (at // chunk + 1) * chunk, []
                for row in _packed_records(uri, at, stop) if _packed(uri) else _plain_records(uri, length, at, stop):
                    rows.append(row)
                    if len(rows) == 256:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    return run


KINDS = [("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("payload_bytes", pa.int64())]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, KINDS)], names=[n for n, _ in KINDS])


def read_warc(spark: SparkSession, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Records (file, offset, page_id, url, html, payload_bytes) of the *.warc and *.warc.gz files in folder.

    Versions 1.0 and 1.1. Only records on the chain from a file's start are returned. A damaged header, a wrong length
    or one that points beyond the file ends the chain: what follows in that file is left out. A last record that is cut
    short is left out too. Payloads and headers of any length and repeated records are read. Header names are matched
    without case; a header that isn't UTF-8 is read as Latin-1, a payload that isn't has replacement characters. Of a
    record that is marked as truncated the payload that is there is returned. Without a page id or url these are null;
    html is null where write_warc() was given a null. An empty folder or file gives no record.
    """
    start = entries(spark, folder, chunk)
    tasks = max(1, min(start.count(), 10_000))
    return start.select("file", "length", "at").repartition(tasks).mapInArrow(_parse(chunk), "file string, offset long, page_id long, url string, html string, payload_bytes long")


def round_trip(pages: DataFrame, chunk: int = CHUNK, **columns) -> DataFrame:
    """pages written as WARC files into the shared folder and read from there: (page_id, url, html, payload_bytes)."""
    folder = shared_dir(pages.sparkSession)
    write_warc(pages, folder, **columns)
    return read_warc(pages.sparkSession, folder, chunk).select("page_id", "url", "html", "payload_bytes")


def oracle_sql(table: str = "pages") -> str:
    return f"SELECT page_id, url, html, coalesce(strlen(html), 0)::BIGINT AS payload_bytes FROM {table}"
