"""Messages that need not fit a row: bodies come and go as chunks.

``of_files`` reads files and ``of_pieces`` rows of consecutive bytes; both give a row a chunk of each leaf, as it is found, and hold
a chunk and what may yet be a boundary line, whatever the message's size. The cutting is a generator inside ``mapInArrow``, so that a
task sends a chunk off before it reads the next; headers and transfer encodings are read by built-in expressions behind it,
since a chunk is cut where it can be decoded alone. A message is read in order by one task; messages are what is spread.

Parts are those of ``mime.nodes`` with ``partial``: what has been sent can't be taken back, so a fault is beside its part.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import grammar
from ..functions import codec, ctype, fields
from ..functions.tree import NO_BOUNDARY, NO_LINE, NO_PART

#: Bytes of a body that a row holds.
SIZE = 1 << 20
#: Bytes and rows of a batch that is sent to Spark.
_BATCH_BYTES, _BATCH_ROWS = 4 << 20, 2000
_SCHEMA = "path array<int>, kind string, head binary, n int, data binary, last boolean, error string"
_NAMES = ("path", "kind", "head", "n", "data", "last", "error")
_COLUMNS = ("path", "kind", "ty", "subty", "encoding", "header", "n", "body", "last", "has_body", "error", "head", "data", "type")
_BLANKS = re.compile(rb"[ \t]*")
_CRLF, _WHITE = b"\r\n", b"\r\n\t "


def _base64_cut(data: bytes) -> int:
    """The greatest place with whole groups of four before it."""
    over, at = len(data.translate(None, _WHITE)) % 4, len(data)
    while over:
        at -= 1
        over -= data[at] not in _WHITE
    return at


def _quoted_cut(data: bytes) -> int:
    """After the last line or, in a line without an end, behind text that no escape, soft break or blank ends; 0 if there is neither."""
    at = data.rfind(_CRLF) + 2
    if at > 1:
        return at
    return next((i for i in range(len(data) - 1, 0, -1) if data[i - 1] not in b"= \t\r" and data[i - 2 : i - 1] != b"="), 0)


_CUTS = {"base64": _base64_cut, "quoted-printable": _quoted_cut}


class _Piece:
    """A part that is being read: its header first, then a leaf's body, a multipart's preamble, or what isn't kept."""

    def __init__(self, path: list[int], state: str = "head") -> None:
        self.path, self.state, self.data, self.n, self.wait = path, state, bytearray(), 0, 0
        self.head, self.error, self.encoding, self.mark, self.seen = b"", None, "7bit", b"", False


class _Splitter:
    """Bytes of one message in, rows of ``_SCHEMA`` out."""

    def __init__(self, size: int) -> None:
        # the part that is being read, and the multiparts around it, outermost first
        self.size, self.now, self.open = size, _Piece([]), []

    def rows(self, reads: Iterable[bytes]) -> Iterator[tuple]:
        buf = b""
        for more in reads:
            buf = yield from self._take(buf + more, False)
        yield from self._take(buf, True)
        yield from self._ended()
        yield from self._closed(0)

    def _take(self, buf: bytes, whole: bool) -> Iterator[tuple]:
        """Reads as far as boundary lines can be told; the generator's value is what is left."""
        at = 0
        while True:
            found, length, level = self._boundary(buf, at)
            # what may begin a boundary stays where more is to come
            longest = max((len(p.mark) for p in self.open), default=0)
            stop = found if found >= 0 else len(buf) if whole else max(len(buf) - 3 - longest, at)
            if self.now.state == "head" and (skip := self._header_ends(buf[at:stop])) is not None:
                at += skip
                yield from self._started()
                continue
            yield from self._feed(buf[at:stop])
            if found < 0:
                return buf[stop:]
            after = _BLANKS.match(buf, found + length).end()
            if not whole and len(buf) < after + 4 + longest:
                return buf[found:]
            yield from self._ended()
            yield from self._closed(level + 1)
            around = self.open[level]
            if not around.seen:
                around.seen = True
                yield self._node(around)
            if buf.startswith(_CRLF, after) and self._boundary(buf, after)[0] != after:
                self.now, around.n, at = _Piece([*around.path, around.n]), around.n + 1, after + 2
            else:
                # the list ends, and what is behind it is nobody's
                del self.open[level]
                self.now, at = _Piece(around.path, "gone"), found + length

    def _boundary(self, buf: bytes, at: int) -> tuple[int, int, int]:
        """(place, length, level) of the next boundary, the outermost where several fit; place -1 for none.

        A list's first boundary may be anywhere in a line, the others begin one.
        """
        first = buf.find(b"--" + self.now.mark, at) if self.now.state == "preamble" else -1
        to = len(buf) if first < 0 else first + 2
        place = buf.find(b"\r\n--", at, to)
        while place >= 0:
            for level, p in enumerate(self.open):
                if p.seen and buf.startswith(p.mark, place + 4):
                    return place, 4 + len(p.mark), level
            place = buf.find(b"\r\n--", place + 4, to)
        return first, 2 + len(self.now.mark), len(self.open) - 1

    def _header_ends(self, text: bytes) -> int | None:
        """How much of a text belongs to the header and its empty line; null, and the text kept by ``_feed``, if it goes on."""
        p = self.now
        have, start = len(p.data), max(len(p.data) - 3, 0)
        near = bytes(p.data[start:]) + text
        if have + len(text) >= 2 and (bytes(p.data[:2]) + text[:2])[:2] == _CRLF:
            p.head = b""
            return 2 - have
        end = near.find(b"\r\n\r\n")
        if end < 0:
            return None
        p.data += text[: max(start + end + 2 - have, 0)]
        p.head = bytes(p.data[: start + end + 2])
        return start + end + 4 - have

    def _started(self) -> Iterator[tuple]:
        """What a part is, once its header is whole."""
        p = self.now
        found, at = grammar.header(p.head, 0)
        p.data = bytearray()
        if at < len(p.head):
            p.head, p.error, found = b"", NO_LINE, []
        ty, _, params = grammar._last(found, "content-type", grammar.content_type) or ("text", "plain", [])
        p.encoding = grammar._last(found, "content-transfer-encoding", grammar.encoding_of) or "7bit"
        p.state = "body"
        if ty == "message":
            yield self._node(p, ty)
            self.now = _Piece([*p.path, 0])
        elif ty == "multipart":
            own = next((v for k, v in params if k == "boundary"), None)
            if own is None:
                p.state, p.error = "gone", NO_BOUNDARY
                yield self._node(p)
            else:
                p.state, p.mark = "preamble", own.encode()
                self.open.append(p)

    def _feed(self, text: bytes) -> Iterator[tuple]:
        p = self.now
        if p.state in ("head", "body"):
            p.data += text
        while p.state == "body" and len(p.data) >= max(self.size, p.wait):
            cut_at = _CUTS.get(p.encoding, len)
            cut = cut_at(p.data[: self.size]) or cut_at(p.data)
            if cut == 0:
                # a run that mustn't be cut: looked at again when it has doubled
                p.wait = 2 * len(p.data)
                return
            yield self._chunk(bytes(p.data[:cut]), False)
            del p.data[:cut]
            p.wait = 0

    def _ended(self) -> Iterator[tuple]:
        """The part that is being read has no more."""
        p = self.now
        if p.state == "body":
            yield self._chunk(bytes(p.data), True)
        elif p.state == "head":
            text = bytes(p.data)
            good = grammar.header(text, 0)[1] == len(text)
            yield (p.path, "leaf", text if good else b"", 0, None, True, None if good and p.path else NO_LINE)

    def _closed(self, level: int) -> Iterator[tuple]:
        """Multiparts from a level on have no more."""
        for p in self.open[level:]:
            if not p.seen:
                p.error = NO_PART
                yield self._node(p)
        del self.open[level:]

    def _node(self, p: _Piece, kind: str = "multipart") -> tuple:
        return (p.path, kind, p.head, 0, None, True, p.error)

    def _chunk(self, data: bytes, last: bool) -> tuple:
        p = self.now
        p.n += 1
        return (p.path, "leaf", p.head, p.n - 1, data, last, p.error if p.n == 1 else None)


def _batches(messages: Iterable[tuple], size: int, key: str, type) -> Iterator:  # noqa: ANN001, A002
    """Record batches of the chunks of (key, reads) pairs, each sent as soon as it is full."""
    import pyarrow as pa

    types = (pa.list_(pa.int32()), pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.bool_(), pa.string())
    schema = pa.schema([(key, type), *zip(_NAMES, types, strict=True)])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows, held = [], 0
    for k, reads in messages:
        for r in _Splitter(size).rows(reads):
            rows.append((k, *r))
            held += len(r[2]) + len(r[4] or b"")
            if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                yield batch(rows)
                rows, held = [], 0
    if rows:
        yield batch(rows)


def _typed(found: DataFrame, key: str, transfer: bool) -> DataFrame:
    """Headers and transfer encodings of chunks, by built-in expressions."""
    head = F.when(F.length("head") > 0, fields.decode(F.concat("head", F.lit(b"\r\n")))["fields"])
    rows = found.withColumn("header", F.coalesce(head, fields.empty()))
    encoding = F.when(F.col("data").isNotNull(), ctype.encoding_of_header(F.col("header")))
    rows = rows.withColumn("encoding", F.coalesce(encoding, F.lit("7bit"))).withColumn("type", ctype.of_header(F.col("header")))
    broken = (F.col("encoding") == "base64") & F.col("data").isNotNull()
    body = codec.decode_body(F.col("data"), F.col("encoding")) if transfer else F.col("data")
    # padding ends a body, so a chunk before others has none
    body = F.when(broken & ~F.col("last") & (F.instr(codec.latin(F.col("data")), "=") > 0), None).otherwise(body) if transfer else body
    rows = rows.withColumn("body", body)
    fault = F.when(F.col("data").isNotNull() & F.col("body").isNull(), "not base64")
    bodyless = F.col("data").isNull() & (F.col("kind") == "leaf")
    return rows.select(
        key, "path", "kind", F.when(~bodyless, F.col("type")["ty"]).alias("ty"), F.when(~bodyless, F.col("type")["subty"]).alias("subty"), "encoding",
        F.when(F.col("n") == 0, F.col("header")).alias("header"), "n", "body", "last", F.col("data").isNotNull().alias("has_body"), F.coalesce("error", fault).alias("error"),
    )


def of_pieces(pieces: DataFrame, key: str = "mail_id", order: str = "n", data: str = "data", size: int = SIZE, transfer: bool = True) -> DataFrame:
    """A row a chunk of the messages whose bytes are the ``data`` of a key's rows in their order; null pieces are empty.

    (key, path, kind, ty, subty, encoding, header, n, body, last, has_body, error): a leaf's chunks are numbered by n from 0, its
    header is on the first. Other parts are one row. Pieces meet by a shuffle on the key and are sorted on disk if need be.
    """
    if key in _COLUMNS:
        raise ValueError(f"a key named {key} clashes with a column of the result")
    kind = pieces.schema[key].dataType
    rows = pieces.select(F.col(key), F.col(order).alias("_n"), F.col(data).cast("binary").alias("_data")).repartition(F.col(key)).sortWithinPartitions(key, "_n").select(key, "_data")

    def cut(batches: Iterable) -> Iterator:
        from pyspark.sql.pandas.types import to_arrow_type

        each = ((k.as_py(), d.as_py() or b"") for b in batches for k, d in zip(b.column(0), b.column(1), strict=True))
        yield from _batches(((k, (d for _, d in g)) for k, g in groupby(each, lambda x: x[0])), size, key, to_arrow_type(kind))

    return _typed(rows.mapInArrow(cut, T.StructType([pieces.schema[key], *T._parse_datatype_string(_SCHEMA).fields])), key, transfer)


def of_files(files: DataFrame, path: str = "path", size: int = SIZE, transfer: bool = True) -> DataFrame:
    """The same for files named by a column, in batch or stream, with ``file`` as key: a file is read as its chunks are sent, and none is a row."""

    def reads(uri: str) -> Iterator[bytes]:
        from pyarrow import fs

        # Spark writes file:/a where others write file:///a
        system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
        with system.open_input_stream(name) as f:
            while data := f.read(size):
                yield data

    def cut(batches: Iterable) -> Iterator:
        import pyarrow as pa

        names = (x.as_py() for b in batches for x in b.column(0))
        yield from _batches(((x, reads(x)) for x in names if x is not None), size, "file", pa.string())

    return _typed(files.select(path).mapInArrow(cut, f"file string, {_SCHEMA}"), "file", transfer)


def listed(spark: SparkSession, folder: str, pattern: str = "*.eml", stream: bool = False) -> DataFrame:
    """(path, length) of the files below a folder, or of those that come to be there, without a byte of them."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    return reader.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")
