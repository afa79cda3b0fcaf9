"""Main text of web pages by differencing each page with the nearest page of its host.

Pages of a host stand in the order of their URL paths; the nearest page of each is the neighbour in that order
with which it has the longest common path prefix. The text lines of both are aligned by a longest common
subsequence and the lines that they share (menus, banners, footers) are deleted. The order is found by range
partitioning on (host, path), so a host of any size is spread over many tasks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.llm.common import quoted, stored

OPEN = re.compile(r"(?i)<(?:(!--)|(!doctype)|(script|style|noscript|template|svg|head)\b)")
CLOSE = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "noscript", "template", "svg", "head")}
BREAK = re.compile(r"(?i)</?(?:address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|legend|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>")
TAG = re.compile(r"<[/a-zA-Z!?][^>]*>")
#: Bits of alignment table held at once; larger alignments are halved first.
TABLE_BITS = 1 << 28


def shown(page: str) -> str:
    """The page without comments, document types and elements that aren't displayed, a line end for each.

    What is opened and never closed is shown. Each search goes on from the last, so a page of any length with any
    number of unclosed tags is read once for each kind.
    """
    parts, start, open_for_good = [], 0, set()
    at = OPEN.search(page)
    while at:
        kind = at[1] or at[2] or at[3]
        kind = kind.lower()
        end = -1
        if kind not in open_for_good:
            if kind == "!--":
                end = page.find("-->", at.end())
                end = end + 3 if end >= 0 else -1
            else:
                end = page.find(">", at.end()) + 1 or -1
                if end >= 0 and kind != "!doctype":
                    closed = CLOSE[kind].search(page, end)
                    end = closed.end() if closed else -1
            if end < 0:
                open_for_good.add(kind)
        if end >= 0:
            parts.append(page[start : at.start()])
            start = end
        at = OPEN.search(page, end if end >= 0 else at.end())
    return "\n".join([*parts, page[start:]])


def text_lines(page: str | None) -> list[str]:
    """Visible text of a page, a line for each block, blanks joined; blank lines are left out."""
    text = shown(page or "")
    last = text.rfind(">") + 1  # behind it no tag ends
    text = TAG.sub("", BREAK.sub("\n", text[:last])) + text[last:]
    lines = (" ".join(html.unescape(x).split()) for x in text.split("\n"))
    return [x for x in lines if x]


def _rows(a: list, places: dict, full: int) -> Iterator[int]:
    """Bit-parallel rows of the alignment: bit j is 0 where b[:j+1] gains one on b[:j]."""
    row = full
    for x in a:
        if found := places.get(x):
            gain = row & found
            row = ((row + gain) | (row - gain)) & full
        yield row


def _places(b: list) -> dict:
    by: dict = {}
    for j, y in enumerate(b):
        by[y] = by.get(y, 0) | 1 << j
    return by


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of a longest common subsequence of a and every prefix of b."""
    row = full = (1 << len(b)) - 1
    for row in _rows(a, _places(b), full):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common(a: list, b: list, table_bits: int = TABLE_BITS) -> list[int]:
    """Indices into a of one longest common subsequence of a and b, the same at every call."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    held: list[int] = []
    if x and y:
        if len(x) * len(y) > table_bits and len(x) > 1:
            mid = len(x) // 2
            before, after = _lengths(x[:mid], y), _lengths(x[mid:][::-1], y[::-1])[::-1]
            cut = int(np.argmax(before + after))
            held = common(x[:mid], y[:cut], table_bits) + [mid + i for i in common(x[mid:], y[cut:], table_bits)]
        else:
            rows = list(_rows(x, _places(y), (1 << len(y)) - 1))
            j = len(y) - 1
            for i in range(len(x) - 1, -1, -1):
                while j >= 0 and rows[i] >> j & 1:  # y[j] gains nothing on y[:j]
                    j -= 1
                if j >= 0 and x[i] == y[j]:
                    held.append(i)
                    j -= 1
            held.reverse()
    return [*range(head), *(head + i for i in held), *range(len(a) - tail, len(a))]


def _marks(lines: list[str]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in lines]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x.slice(at, 128) for x in batches for at in range(0, x.num_rows, 128)):
        signs = [_marks(text_lines(t)) for t in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(signs, pa.list_(pa.int64()))], names=["row", "page_id", "url", "signs"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each page, compressed for their way to the lines of the page that they are aligned with."""
    codec = pa.Codec("zstd", 3)
    for b in (x.slice(at, 128) for x in batches for at in range(0, x.num_rows, 128)):
        raw = [None if t is None else "\n".join(text_lines(t)).encode("utf-8", "surrogatepass") for t in b.column(3).to_pylist()]
        packed = [None if r is None else codec.compress(r, asbytes=True) for r in raw]
        sizes = pa.array([None if r is None else len(r) for r in raw], pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], sizes, pa.array(packed, pa.binary())], names=["row", "page_id", "url", "size", "packed"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", 3)
    for b in (x.slice(at, 128) for x in batches for at in range(0, x.num_rows, 128)):
        count, shared, texts = [], [], []
        for size, packed, other in zip(*(b.column(i).to_pylist() for i in (3, 4, 5))):
            text = codec.decompress(packed, size, asbytes=True).decode("utf-8", "surrogatepass") if size else ""
            lines = text.split("\n") if text else []
            gone = common(_marks(lines), other) if lines and other else []
            if len(gone) == len(lines):  # a copy of the other page: nothing tells its template from its text
                gone = []
            held = set(gone)
            count.append(len(lines))
            shared.append(len(gone))
            texts.append(None if size is None else "\n".join(x for i, x in enumerate(lines) if i not in held))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(count, pa.int32()), pa.array(shared, pa.int32()), pa.array(texts, pa.string())], names=["page_id", "url", "nearest_id", "n_lines", "n_shared", "text"])


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1))


def _path(url: Column) -> Column:
    """Path and query without fragment, tracking parameters, file ending and last slash: one name for one page."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""), "#.*$", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"(?i)([?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "$1"), r"[?&]+$|(?<=[?&])&+", "")
    return F.regexp_replace(rest, r"(?i)(?:/index)?(?:\.html?|\.php)?/?(?=$|\?)", "")


def nearest(urls: DataFrame) -> DataFrame:
    """(host, path, nearest): for the pages (row, host, path) of each host, the row of the page nearest by path.

    Rows of one host and path are one page, named by their smallest row. Of two neighbours that are equally near
    the earlier counts. A host of one page has no row here.
    """
    pages = urls.groupBy("host", "path").agg(F.min("row").alias("row"))
    pages = pages.withColumn("parts", F.split("path", "/"))  # part by part, pages of one folder stand together
    placed = stored(pages.repartitionByRange("host", "parts").sortWithinPartitions("host", "parts").withColumn("part", F.spark_partition_id()))
    whole = F.struct("host", "parts", "path", "row")
    within = Window.partitionBy("part").orderBy("host", "parts")
    edges = placed.groupBy("part").agg(F.min(whole).alias("first"), F.max(whole).alias("last"))  # one row for each task
    along = Window.partitionBy(F.lit(0)).orderBy("part")
    edges = edges.select("part", F.lag("last").over(along).alias("before"), F.lead("first").over(along).alias("after"))
    near = placed.withColumn("up", F.lag(whole).over(within)).withColumn("down", F.lead(whole).over(within)).join(F.broadcast(edges), "part")
    near = near.select("host", "path", "parts", F.coalesce("up", "before").alias("up"), F.coalesce("down", "after").alias("down"))
    both = lambda side: F.when(F.col(side)["host"] == F.col("host"), F.col(side))
    near = near.withColumn("up", both("up")).withColumn("down", both("down"))

    def alike(side: str) -> Column:  # whole path parts in common, then characters
        first_apart = lambda x, y: F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), F.lit(False))
        return F.struct(first_apart(F.col("parts"), F.col(side)["parts"]), first_apart(F.split("path", ""), F.split(F.col(side)["path"], "")))

    chosen = F.when(F.col("up").isNull(), F.col("down")).when(F.col("down").isNull() | (alike("up") >= alike("down")), F.col("up")).otherwise(F.col("down"))
    return near.select("host", "path", chosen["row"].alias("nearest")).where("nearest is not null")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, nearest_id, n_lines, n_shared, text) of each row of pages.

    A page alone on its host, or without a host, keeps all its lines (nearest_id null). URLs that differ in
    scheme, fragment, tracking parameters, file ending or last slash name one page, which is never paired with
    itself. A page all of whose lines are shared is a copy of the other and keeps them. A null html gives a null
    text, an empty one an empty text; pages of any length are aligned whole. Repeated rows and ids give a row
    each; of rows with one path the one with the smallest hash is aligned with. Extra columns are ignored; an
    empty table gives no row.
    """
    url = quoted(url_col).cast("string")
    rows = pages.select(F.xxhash64(quoted(id_col), url, quoted(html_col).cast("string")).alias("row"), quoted(id_col).alias("page_id"), url.alias("url"), quoted(html_col).cast("string").alias("html"))
    kind = pages.schema[id_col].dataType.simpleString()
    lines = stored(rows.mapInArrow(_signed, f"row long, page_id {kind}, url string, signs array<long>"))
    placed = lines.select("row", "page_id", "url", _host(F.col("url")).alias("host"), _path(F.col("url")).alias("path"))
    pairs = nearest(placed.where("host <> ''").select("row", "host", "path"))
    own = placed.join(pairs, ["host", "path"]).select("row", "nearest").distinct()
    others = lines.select(F.col("row").alias("nearest"), F.col("page_id").alias("nearest_id"), F.col("signs").alias("other")).dropDuplicates(["nearest"])
    met = stored(own.join(others, "nearest").drop("nearest"))
    packed = rows.mapInArrow(_packed, f"row long, page_id {kind}, url string, size long, packed binary")
    return packed.join(met, "row", "left").select("page_id", "url", "nearest_id", "size", "packed", "other").mapInArrow(_keep, f"page_id {kind}, url string, nearest_id {kind}, n_lines int, n_shared int, text string")
