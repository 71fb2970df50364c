"""WARC archives: written by Spark tasks, read back sequentially with every digest checked.

*Writing.*  Every row becomes one record, and every record one gzip member.  Of rows
with equal payloads of ``min_revisit`` bytes or more, the one with the largest id is a
``response``, the others are ``revisit`` records that refer to it; the largest ids come
from an aggregation by SHA-256 and are joined back (broadcast only if their measured
size is small).  A task writes archives of its own under names nobody else uses and
returns them as rows; those rows, committed by Spark, are the list of archives.  What a
lost or repeated task has left behind is in no list and is never read.

*Reading.*  A task reads an archive from front to back in blocks: zlib inflates a member
piece by piece, the record's head is parsed, its content length frames the block, and
the digests of block and payload are verified as the bytes go by.  Memory is bounded by
a block and a record's head, unless payloads are asked for.

Archives are WARC/1.1 and lie in the shared folder, reached through pyarrow's file
systems (local paths, hdfs, s3, gs, abfs).

Defined cases: a null payload is empty; a null id is smaller than any other and comes
back as null; rows that repeat the largest id of a payload are all responses; a null
address leaves the header out, control characters in it come back percent-encoded; an
empty table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.plans.scratch import broadcast_if_small, materialize, shared_dir

#: Compressed bytes after which a task begins another archive; bytes read or inflated at once; most bytes of a head.
ARCHIVE_BYTES, BLOCK, HEAD = 256 << 20, 1 << 16, 1 << 20
VERSION, HTTP = b"WARC/1.1", "application/http;msgtype=response"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Schemes of Hadoop that pyarrow knows by another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}
_ID, _NO_ID = "urn:row:", "urn:null"
_ARCHIVES = "path string, n_records long, n_bytes long"
_RECORDS = "archive string, offset long, length long, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, problem string"


def file_system(uri: str):
    """pyarrow's file system of a path or URI, and the path in it."""
    from pyarrow import fs

    scheme, mark, rest = uri.partition(":")
    if mark and scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(_SCHEMES.get(scheme, scheme) + mark + rest)


# --- records -------------------------------------------------------------------


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(row_id: str | None) -> str:
    return f"<{_NO_ID}>" if row_id is None else f"<{_ID}{quote(row_id, safe='')}>"


def _row_id(urn: str | None) -> str | None:
    urn = (urn or "").strip("<>")
    return unquote(urn[len(_ID) :]) if urn.startswith(_ID) else None


def _plain(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def record(kind: str, fields: list[tuple[str, str]], block: bytes, date: str) -> bytes:
    """One record in WARC/1.1, not compressed."""
    rows = [("WARC-Type", kind), ("WARC-Date", date), *fields, ("WARC-Block-Digest", _digest(block)), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in rows).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def page_record(row_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool, date: str) -> bytes:
    """A response with its payload, or a revisit with the payload's length and digest only."""
    fields = [("WARC-Record-ID", _urn(row_id)), ("Content-Type", HTTP), ("WARC-Payload-Digest", _digest(payload))]
    if url is not None:
        fields.append(("WARC-Target-URI", _plain(url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record("revisit" if revisit else "response", fields, head if revisit else head + payload, date)


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# --- reading ---------------------------------------------------------------------


class Malformed(ValueError):
    """An archive breaks the format or a digest; what is left of it cannot be framed if ``lost``."""

    def __init__(self, what: str, lost: bool = True) -> None:
        super().__init__(what)
        self.lost = lost


class Members:
    """The gzip members of a stream, inflated piece by piece."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.ahead, self.read = stream, b"", 0

    def at(self) -> int:
        """Compressed bytes before the next member."""
        return self.read - len(self.ahead)

    def _fill(self) -> bool:
        if not self.ahead:
            self.ahead = self.stream.read(BLOCK)
            self.read += len(self.ahead)
        return bool(self.ahead)

    def pieces(self) -> Iterator[bytes] | None:
        """The next member in pieces of at most ``BLOCK`` bytes, or None at the end."""
        return self._inflate() if self._fill() else None

    def _inflate(self) -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        while not z.eof:
            if not self._fill():
                raise Malformed("the archive ends inside a member")
            try:
                piece = z.decompress(self.ahead, BLOCK)
            except zlib.error as e:
                raise Malformed(f"not a gzip member: {e}") from e
            self.ahead = z.unused_data if z.eof else z.unconsumed_tail
            if piece:
                yield piece


class Frame:
    """Takes heads and counted bytes from the pieces of one member."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held = pieces, b""

    def head(self) -> list[bytes]:
        """Lines up to the first empty one."""
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            more = next(self.pieces, None)
            if more is None or len(self.held) > HEAD:
                raise Malformed("a record's head does not end")
            self.held += more
        lines, self.held = self.held[:end].split(b"\r\n"), self.held[end + 4 :]
        return lines

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces."""
        while n:
            if not self.held:
                self.held = next(self.pieces, b"")
                if not self.held:
                    raise Malformed(f"a record lacks {n} bytes of its content length")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece

    def finish(self) -> None:
        """What follows the block: two line ends and the member's end."""
        rest = self.held
        for piece in self.pieces:
            rest = (rest + piece)[:5]
        if rest != b"\r\n\r\n":
            raise Malformed("a record is longer or shorter than its content length", lost=False)


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "surrogatepass").partition(":") for line in lines)
    return {k.strip().lower(): v.removeprefix(" ") for k, _, v in pairs}


def _length(fields: dict[str, str]) -> int:
    n = fields.get("content-length", "")
    if not (n.isascii() and n.isdigit()):
        raise Malformed("a record has no content length")
    return int(n)


def _same(stated: str | None, found: "hashlib._Hash", what: str) -> None:
    """Compare a stated SHA-1, in base 32 or hex; other algorithms are not checked."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower() == "sha1" and value.upper() not in (base64.b32encode(found.digest()).decode(), found.hexdigest().upper()):
        raise Malformed(f"the digest of a {what} is wrong", lost=False)


def _hex(stated: str | None) -> str | None:
    """A stated SHA-1 in lower-case hex."""
    value = (stated or "").partition(":")[2]
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower() or None


def read_record(pieces: Iterator[bytes], want_payload: bool) -> tuple:
    """(type, id, target, refers_to, payload bytes, payload digest, payload) of one member."""
    frame = Frame(pieces)
    first, *lines = frame.head()
    if not first.startswith(b"WARC/"):
        raise Malformed("a member does not begin with a WARC head")
    fields = _fields(lines)
    kind, block, whole = fields.get("warc-type"), hashlib.sha1(), hashlib.sha1()
    stated, size, kept, head = None, 0, [], b""
    is_http = fields.get("content-type", "").startswith("application/http")
    for piece in frame.take(_length(fields)):
        block.update(piece)
        if is_http and stated is None:  # still in the head of the HTTP message
            head += piece
            end = head.find(b"\r\n\r\n")
            if end < 0:
                continue
            stated, piece = _fields(head[:end].split(b"\r\n")[1:]), head[end + 4 :]
        whole.update(piece)
        size += len(piece)
        if want_payload:
            kept.append(piece)
    frame.finish()
    _same(fields.get("warc-block-digest"), block, "block")
    digest = fields.get("warc-payload-digest")
    if kind == "revisit":
        size, whole_hex, payload = _length(stated or {}), _hex(digest), None
    else:
        _same(digest, whole, "payload")
        whole_hex, payload = whole.hexdigest(), b"".join(kept) if want_payload else None
    refers = _row_id(fields.get("warc-refers-to"))
    return kind, _row_id(fields.get("warc-record-id")), fields.get("warc-target-uri"), refers, size, whole_hex, payload


def read_stream(stream: BinaryIO, want_payload: bool = False, strict: bool = True) -> Iterator[tuple]:
    """(offset, length, *read_record, problem) of every record of an archive.

    Strictly, a fault raises.  Otherwise it is the row's ``problem``: a record with a wrong
    digest or a wrong end is reported and the next one read; where the framing is lost, the
    archive's rest is given up.
    """
    members = Members(stream)
    while True:
        at = members.at()
        pieces = members.pieces()
        if pieces is None:
            return
        try:
            found, problem, lost = read_record(pieces, want_payload), None, False
        except Malformed as e:
            if strict:
                raise ValueError(f"at byte {at}: {e}") from e
            found, problem, lost = (None,) * 7, str(e), e.lost
        yield (at, members.at() - at, *found, problem)
        if lost:
            return


# --- in Spark ---------------------------------------------------------------------


def with_revisits(pages: DataFrame, id_col: str, url: str, payload: str, min_revisit: int) -> DataFrame:
    """(row_id, url, payload, refers_to, revisit) per row."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")
    named = pages.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("url"), body)
    keyed = named.withColumn("digest", F.when(F.octet_length("payload") >= min_revisit, F.unhex(F.sha2("payload", 256))))
    copies = keyed.where("digest IS NOT NULL").groupBy(F.col("digest").alias("d"))
    copies = copies.agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    largest = broadcast_if_small(materialize(copies.select("d", "largest"), "largest"))
    joined = keyed.join(largest, F.col("digest") == F.col("d"), "left")
    revisit = F.col("largest").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("largest")))
    return joined.select(F.col("id").cast("string").alias("row_id"), "url", "payload", F.col("largest").cast("string").alias("refers_to"), revisit.alias("revisit"))


def _writer(folder: str, date: str, archive_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = file_system(folder)
        path, out, n, size = "", None, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "n_records": [n], "n_bytes": [size]})

        for batch in batches:
            for cells in zip(*batch.columns, strict=True):
                if out is None:
                    path, n = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{where}/{path}", compression=None)
                    info = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Filename", path), ("Content-Type", "application/warc-fields")]
                    size = out.write(member(record("warcinfo", info, b"format: WARC File Format 1.1\r\n", date)))
                size += out.write(member(page_record(*[c.as_py() for c in cells], date)))
                n += 1
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = 1000,
    date: str = "2000-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, folder: str | None = None,
) -> DataFrame:
    """Write one record per row below ``folder``; (path, n_records, n_bytes) per archive."""
    spark = pages.sparkSession
    folder = folder or f"{_qualified(spark, shared_dir(spark))}/warc-{uuid.uuid4().hex}"
    store, where = file_system(folder)
    store.create_dir(where, recursive=True)
    rows = with_revisits(pages, id_col, url, payload, min_revisit)
    return materialize(rows.mapInArrow(_writer(folder, date, archive_bytes), _ARCHIVES), "archives")


def _qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme that Spark would read it by."""
    if ":" in folder:
        return folder
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()


def read_archives(archives: DataFrame, want_payload: bool = False, strict: bool = True) -> DataFrame:
    """Every record of the archives named in column ``path``, one task to an archive.

    Columns: archive, offset, length (of the gzip member), record_type, record_id, target_uri,
    refers_to, payload_bytes, payload_digest (hex), payload (null unless wanted), problem.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, where = file_system(path)
                with store.open_input_stream(where, compression=None) as stream:
                    try:
                        for found in read_stream(stream, want_payload, strict):
                            rows.append((path, *found))
                            held += len(found[8] or b"") + 300
                            if held >= 8 << 20:
                                yield flush()
                                rows, held = [], 0
                    except ValueError as e:
                        raise ValueError(f"{path} {e}") from e
        if rows:
            yield flush()

    text, long = pa.string(), pa.int64()
    names = [c.split()[0] for c in _RECORDS.split(", ")]
    kinds = [text, long, long, text, text, text, text, long, text, pa.binary(), text]
    paths = archives.select("path")
    return paths.repartitionByRange(max(1, paths.count()), "path").mapInArrow(run, _RECORDS)
