"""WARC archives: pages become records, and a reader gets back what is whole in a damaged file.

Every record is a gzip member of its own (or stands plain). The reader checks each one: the member's checksum, the version
line, the length and the digests. Where a check fails it looks for the next member or version line that begins a valid
record, goes on from there, and reports the bytes between as a gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Generator, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relrank.llm.common import stage_path, stored

LEAST_BYTES = 100  # shorter payloads are stored again and again
ARCHIVE_BYTES = 1 << 28  # an archive is closed beyond that
CHUNK = 1 << 16
BATCH_BYTES, BATCH_ROWS = 1 << 22, 2000
# Fixed values of the format.
VERSION, END = "WARC/1.1", b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MARK = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d")
MARK_BYTES = 8
HEADER_BYTES = 1 << 20  # a header that does not end within that is damaged

MANIFEST = "path string, bytes long, records long"
FOUND = pa.schema(
    [
        ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("problem", pa.string()), ("record_type", pa.string()),
        ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()), ("payload", pa.binary()),
    ]
)
FOUND_DDL = (
    "path string, start long, `end` long, problem string, record_type string, record_id string, target_uri string, refers_to string,"
    " payload_digest string, payload_bytes long, payload binary"
)


# Writing


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    head = "".join(f"{name}: {value}\r\n" for name, value in lines)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + END


def _page_id(number: int | None) -> str:
    return f"<urn:page:{'' if number is None else number}>"


def _line(value: str) -> str:
    """Line breaks would end the field."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _page_record(page_id, url, html: bytes, digest: str, first, date: str) -> bytes:
    """``first`` is the tuple of the page id that a revisit refers to, None for a response."""
    fields = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", _page_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _line(url)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if first:
        fields += [("WARC-Refers-To", _page_id(first[0])), ("WARC-Profile", REVISIT_PROFILE)]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    return _record(fields, head if first else head + html)


def _write(folder: str, date: str, compress: bool, most: int):
    pack = (lambda data: gzip.compress(data, 6, mtime=0)) if compress else (lambda data: data)
    columns = ("page_id", "url", "html", "digest", "revisit", "first")

    def write(batches):
        files, root = FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        out, name, size, records = None, None, 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "bytes": size, "records": records}])

        for batch in batches:
            for page_id, url, html, digest, revisit, first in zip(*(batch.column(c) for c in columns)):
                if out is None:
                    # A name of its own: what a lost or doubled task leaves is in no manifest.
                    name = f"{uuid.uuid4().hex}.warc{'.gz' if compress else ''}"
                    out, records = files.open_output_stream(f"{root}/{name}", compression=None), 1
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date)]
                    member = pack(_record([*info, ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    size = out.write(member)
                refers = (first.as_py(),) if revisit.as_py() else None
                size += out.write(pack(_page_record(page_id.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), refers, date)))
                records += 1
                if size >= most:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return write


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str | None = None,
    compress: bool = True,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per page to archives in ``folder``, which all executors must reach through ``pyarrow.fs``; returns
    the manifest (path, bytes, records), which alone says what belongs to the result.

    Of pages with equal payloads of LEAST_BYTES or more that with the smallest id is the response, and rows that repeat
    its id with it; the others are revisits of it without a payload. A null id is a response only where all of its group
    are. Null html is an empty payload, a null url is left out, line breaks in one are escaped. Without pages there are no
    archives.
    """
    text = F.coalesce(html_col, F.lit(""))
    narrow = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), text.alias("html"), F.sha2(text.cast("binary"), 256).alias("digest")
    )
    # Summed in the map tasks: a huge group of copies is one row of each.
    sizes = narrow.where(F.octet_length("html") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = stored(sizes.where("n > 1").select("digest", "first", F.lit(True).alias("again")))
    revisit = F.col("again").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = narrow.join(repeated, "digest", "left").select("page_id", "url", "html", "digest", revisit.alias("revisit"), "first")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return stored(rows.mapInArrow(_write(folder, date, compress, archive_bytes), MANIFEST))


# Reading


class Damaged(Exception):
    """What stands here is no whole record."""


class _File:
    """Bytes of a file by place, read in chunks."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self._from, self._held = file, file.size(), 0, b""

    def read(self, start: int, n: int) -> bytes:
        n = min(n, self.size - start)
        if n <= 0:
            return b""
        if not self._from <= start <= start + n <= self._from + len(self._held):
            self.file.seek(start)
            self._from, self._held = start, self.file.read(max(n, CHUNK))
        return self._held[start - self._from : start - self._from + n]

    def find(self, start: int) -> int:
        """The next place from ``start`` where a member or a version line may begin, or the end."""
        while start < self.size:
            data = self.read(start, CHUNK)
            hit = MARK.search(data)
            if hit:
                return start + hit.start()
            if start + len(data) >= self.size:
                break
            start += len(data) - MARK_BYTES
        return self.size


class _Plain:
    """A record that stands in the file as it is."""

    def __init__(self, file: _File, at: int):
        self.file, self.at = file, at

    def get(self, n: int, start: int = 0) -> bytes:
        return self.file.read(self.at + start, n)

    def skip(self, n: int) -> None:
        self.at += n


class _Member:
    """What a gzip member holds, unpacked as far as it is asked for."""

    def __init__(self, file: _File, at: int):
        self.file, self.at = file, at  # of the next packed byte
        self._unpack, self._held, self._packed = zlib.decompressobj(31), bytearray(), b""

    def get(self, n: int, start: int = 0) -> bytes:
        want = start + n
        while len(self._held) < want and not self._unpack.eof:
            if not self._packed:
                self._packed = self.file.read(self.at, CHUNK)
                self.at += len(self._packed)
                if not self._packed:
                    raise Damaged("member is cut short")
            try:
                self._held += self._unpack.decompress(self._packed, want - len(self._held))
            except zlib.error as error:
                raise Damaged("member fails its check") from error
            self._packed = self._unpack.unconsumed_tail
        return bytes(self._held[start:want])

    def skip(self, n: int) -> None:
        del self._held[:n]

    def end(self) -> int:
        return self.at - len(self._unpack.unused_data)


@dataclass
class _Record:
    fields: dict[str, str]
    payload: bytes
    payload_bytes: int | None
    payload_digest: str | None


def _hex(value: str) -> tuple[str, str]:
    """The algorithm of a labelled digest and its value as hex."""
    name, _, text = value.partition(":")
    name = name.strip().lower().replace("-", "")
    size = hashlib.new(name).digest_size if name in hashlib.algorithms_guaranteed and not name.startswith("shake") else 0
    if size and len(text) != 2 * size:
        try:
            return name, base64.b32decode(text.strip().upper()).hex()
        except ValueError:
            raise Damaged("digest cannot be read") from None
    return (name if size else ""), text.strip().lower()


def _check(fields: dict[str, str], name: str, data: bytes) -> str | None:
    """The digest of ``data`` as hex, checked; None if the record has none."""
    if name not in fields:
        return None
    algorithm, value = _hex(fields[name])
    if algorithm and hashlib.new(algorithm, data).hexdigest() != value:
        raise Damaged(f"{name.removeprefix('warc-')} differs")
    return value


def _next_record(stream: _Plain | _Member) -> _Record:
    size, stop = CHUNK // 8, -1
    while stop < 0:
        head = stream.get(size)
        stop = head.find(END)
        if stop < 0 and (len(head) < size or size > HEADER_BYTES):
            raise Damaged("header has no end")
        size *= 4
    version, *lines = head[:stop].split(b"\r\n")
    if not re.fullmatch(rb"WARC/\d\.\d", version):
        raise Damaged("no version line")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise Damaged("header line without name")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", length):
        raise Damaged("no length")
    begin, length = stop + len(END), int(length)
    if stream.get(len(END), begin + length) != END:  # asked first: a wrong length costs no reading
        raise Damaged("record does not end at its length")
    block = stream.get(length, begin)
    stream.skip(begin + length + len(END))

    _check(fields, "warc-block-digest", block)
    kind, payload, payload_bytes = fields.get("warc-type"), block, length
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(END)
        payload_bytes = len(payload)
        if kind == "revisit":
            told = re.search(rb"(?im)^content-length:\s*(\d{1,18})\s*$", http)
            payload_bytes = int(told[1]) if told else None
    if kind == "revisit":
        digest = _hex(fields["warc-payload-digest"])[1] if "warc-payload-digest" in fields else None
    else:
        digest = _check(fields, "warc-payload-digest", payload)
    return _Record(fields, payload, payload_bytes, digest)


def _records(file: _File, at: int) -> Generator[_Record, None, int]:
    """The records of the member or of the version line at this place; returns where it ends.

    A member's record counts once what follows it is known to be right, at its end the checksum."""
    if file.read(at, 3) != b"\x1f\x8b\x08":
        stream = _Plain(file, at)
        yield _next_record(stream)
        return stream.at
    stream, last = _Member(file, at), None
    while stream.get(1):
        found = _next_record(stream)
        if last is not None:
            yield last
        last = found
    if last is not None:
        yield last
    return stream.end()


def salvage(file: _File) -> Iterator[tuple[int, int, str | None, _Record | None]]:
    """(start, end, None, record) of every whole record of a file, and (start, end, problem, None) of every gap."""
    at, lost, problem = 0, None, None
    while at < file.size:
        found, held = _records(file, at), []
        try:
            while True:
                record = next(found)
                if lost is not None:
                    yield lost, at, problem, None
                    lost = None
                held.append(record)
                if len(held) > 1:
                    yield at, at, None, held.pop(0)
        except StopIteration as done:
            if held:
                yield at, done.value, None, held[0]
            at = done.value
        except Damaged as error:
            for record in held:
                yield at, at, None, record
            if lost is None:
                lost, problem = at, str(error)
            at = file.find(at + 1)
    if lost is not None:
        yield lost, file.size, problem, None


def _read(with_payload: bool):
    def bare(value):
        return value.strip("<>") if value is not None else None

    def read(batches):
        rows, size = [], 0
        for batch in batches:
            held = batch.column("content") if "content" in batch.schema.names else None
            for i, path in enumerate(batch.column("path").to_pylist()):
                if held is not None:
                    source = pa.BufferReader(held[i].as_buffer() or b"")
                else:
                    files, name = FileSystem.from_uri(path)
                    source = files.open_input_file(name)
                with source:
                    for start, end, problem, record in salvage(_File(source)):
                        row = {"path": path, "start": start, "end": end, "problem": problem}
                        if record is not None:
                            get = record.fields.get
                            row |= {
                                "record_type": get("warc-type"), "record_id": bare(get("warc-record-id")), "target_uri": bare(get("warc-target-uri")),
                                "refers_to": bare(get("warc-refers-to")), "payload_digest": record.payload_digest, "payload_bytes": record.payload_bytes,
                            }
                            if with_payload and row["record_type"] != "revisit":
                                row["payload"] = record.payload
                                size += len(record.payload)
                        rows.append(row)
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, FOUND)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, FOUND)

    return read


def read_archives(files: DataFrame, payload: bool = True) -> DataFrame:
    """What the archives of ``files`` hold: a row per whole record, and one with a ``problem`` per gap (start, end).

    ``files`` has a path per row, as a manifest or ``spark.read.format("binaryFile")`` do; where it has a ``content`` column,
    that is read instead, for stores that only Spark reaches. A file is one task's, since only from its start on it is
    certain what is a record and what stands inside one; of it a chunk and one record are held. Records of a member that
    holds several share its start; all but the last have it as their end too. A revisit's digest and size are those of the
    payload that it refers to; ``payload=False`` leaves the payloads out.
    """
    narrow = files.select("path", *[c for c in files.columns if c == "content"])
    if "content" not in narrow.columns:
        narrow = narrow.repartitionByRange(max(1, narrow.count()), "path")  # names alone: AQE would put all into one task
    return narrow.mapInArrow(_read(payload), FOUND_DDL)


def page_id(record_id: str) -> Column:
    """The id of the page in the name of a record of ``write_archives``."""
    return F.regexp_extract(record_id, r"^urn:page:(-?\d+)$", 1).try_cast("long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives among the stored stages and read them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to."""
    records = read_archives(write_archives(pages, stage_path(pages.sparkSession)), payload=False).where("problem is null and record_type <> 'warcinfo'")
    return records.select(
        page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id("refers_to").alias("refers_to")
    )
