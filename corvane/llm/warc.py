"""WARC: normalising monolithic gzip files to one member a record.

A WARC file that was compressed as one stream can't be read from the middle.
The normaliser inflates such a file once, as a stream and in pieces, writes
every record as a gzip member of its own and lists the members' offsets in a
sidecar index, through which any record is read with one seek. One task works
on one file; files are independent.

Defined results:

* a file of several members, or of some members with several records, is
  normalised the same way; an empty file gives an empty one;
* a record that the file ends in the midst of is not written; it is listed
  with length 0 and complete = false, as is the rest of a file from a damaged
  place on, or all of one that is no gzip; zeros after the last member are
  padding. Other files go on;
* pages: a null url, id or text is left out of the record's head or, for the
  text, noted there, so null and empty stay apart; control characters in urls
  are percent-encoded in the record and decoded again when it is read;
* repeated rows are repeated records; an empty table gives no file.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._common import col, cut, shared_dir
from corvane.llm._vector import column

PIECE = 1 << 20
_INDEX = "file string, record_no long, offset long, length long, inflated long, record_id string, type string, uri string, digest string, complete boolean"


def _inflated(src: BinaryIO) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in pieces."""
    engine = zlib.decompressobj(31)
    while raw := src.read(PIECE):
        while raw:
            if engine.eof:
                if not raw.strip(b"\0"):  # padding after the last member
                    break
                engine = zlib.decompressobj(31)
            out = engine.decompress(raw, PIECE)
            if out:
                yield out
            raw = engine.unconsumed_tail or engine.unused_data
    while not engine.eof:
        out = engine.decompress(engine.unconsumed_tail, PIECE) if engine.unconsumed_tail else engine.flush()
        if not out:
            break
        yield out


class _Stream:
    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def more(self) -> bool:
        piece = next(self.pieces, b"")
        self.held += piece
        return bool(piece)

    def until(self, mark: bytes) -> bytes | None:
        """All up to and with the mark, or None at the end of the stream."""
        begin = 0
        while (at := self.held.find(mark, begin)) < 0:
            begin = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                return None
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return out

    def some(self, most: int) -> bytes:
        """Up to ``most`` bytes, none only at the end of the stream."""
        if not self.held:
            self.more()
        out, self.held = self.held[:most], self.held[most:]
        return out

    def blank(self) -> bool:
        """Skip line ends; whether anything follows."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            if self.held or not self.more():
                return bool(self.held)


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


@dataclass
class Entry:
    record_no: int
    offset: int
    length: int
    inflated: int
    record_id: str | None
    type: str | None
    uri: str | None
    digest: str | None
    complete: bool


def normalise(src: BinaryIO, dst: BinaryIO, level: int = 6) -> Iterator[Entry]:
    """Rewrite ``src`` to ``dst``, a member a record, and list the members."""
    stream, offset, number = _Stream(_inflated(src)), 0, 0
    try:
        for e in _rewritten(stream, dst, level):
            yield e
            offset, number = e.offset + e.length, number + 1
    except zlib.error:  # no gzip, or damaged from here on
        yield Entry(number, offset, 0, 0, None, None, None, None, False)


def _rewritten(stream: _Stream, dst: BinaryIO, level: int) -> Iterator[Entry]:
    offset, number = 0, 0
    while stream.blank():
        head = stream.until(b"\r\n\r\n")
        have = headers(head) if head else {}
        known = (have.get("warc-record-id"), have.get("warc-type"), have.get("warc-target-uri"))
        size = have.get("content-length", "")
        if not head or not (size.isascii() and size.isdigit()):
            yield Entry(number, offset, 0, 0, *known, None, False)
            return
        pack, digest, left, parts = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.md5(), int(size), []
        parts.append(pack.compress(head))
        held = 0
        while left and (body := stream.some(min(left, PIECE))):
            digest.update(body)
            parts.append(pack.compress(body))
            left -= len(body)
            held += len(body)
        if left:
            yield Entry(number, offset, 0, held, *known, None, False)
            return
        parts.append(pack.compress(b"\r\n\r\n") + pack.flush())
        length = sum(map(len, parts))
        for p in parts:
            dst.write(p)
        yield Entry(number, offset, length, held, *known, digest.hexdigest(), True)
        offset, number = offset + length, number + 1


def read_member(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of the one record in a member."""
    engine = zlib.decompressobj(31)
    plain = engine.decompress(raw)
    if not engine.eof or engine.unused_data:
        raise ValueError("not exactly one gzip member")
    at = plain.index(b"\r\n\r\n") + 4
    head = headers(plain[:at])
    return head, plain[at : at + int(head["content-length"])]


def _escape(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)


def _unescape(url: str) -> str:
    return re.sub(r"%([01][0-9A-F]|20|7F|25)", lambda m: chr(int(m[1], 16)), url)


def page_record(page_id: int | None, url: str | None, text: str | None) -> bytes:
    body = (text or "").encode("utf-8", "surrogatepass")
    name = uuid.UUID(hashlib.md5(f"{page_id}\0{url}".encode("utf-8", "surrogatepass")).hexdigest())
    lines = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2020-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    lines += [f"WARC-Target-URI: {_escape(url)}"] if url is not None else []
    lines += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    lines += ["X-Null-Body: true"] if text is None else []
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_monolithic(pages: DataFrame, folder: str, ident: str = "page_id", url: str = "url", text: str = "html", level: int = 1) -> DataFrame:
    """Write each partition as one WARC file compressed as one stream; the
    table of the files. A repeated task writes another file and reports that."""

    def run(batches):
        where, path = fs.FileSystem.from_uri(folder)
        name, out, pack = f"{path}/{uuid.uuid4().hex}.warc.gz", None, zlib.compressobj(level, zlib.DEFLATED, 31)
        for batch in batches:
            for row in zip(*(column(batch, c).to_pylist() for c in ("i", "u", "t")), strict=True):
                if out is None:
                    where.create_dir(path, recursive=True)
                    out = where.open_output_stream(name, compression=None)  # already gzip
                out.write(pack.compress(page_record(*row)))
        if out is not None:
            out.write(pack.flush())
            out.close()
            yield pa.record_batch({"file": pa.array([name])})

    rows = pages.select(col(pages, ident).cast("long").alias("i"), col(pages, url).alias("u"), col(pages, text).alias("t"))
    return cut(rows.mapInArrow(run, "file string"))


def normalise_files(files: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Normalise each file of ``files`` (column file) into ``folder`` with its
    index beside it as JSON lines (.idx); the index of all."""

    def run(batches):
        where, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in column(batch, "file").to_pylist():
                where.create_dir(path, recursive=True)
                base = f"{path}/{uuid.uuid4().hex}"
                rows = []
                with where.open_input_stream(name, compression=None) as src, where.open_output_stream(f"{base}.warc.gz", compression=None) as dst, where.open_output_stream(f"{base}.idx") as idx:
                    for e in normalise(src, dst, level):
                        idx.write((json.dumps(e.__dict__, ensure_ascii=False) + "\n").encode("utf-8", "surrogatepass"))
                        rows.append((f"{base}.warc.gz", *e.__dict__.values()))
                if rows:
                    kinds = (pa.string(), *[pa.int64()] * 4, *[pa.string()] * 4, pa.bool_())
                    names = ["file", "record_no", "offset", "length", "inflated", "record_id", "type", "uri", "digest", "complete"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    n = max(1, files.count())
    return cut(files.repartition(n, "file").mapInArrow(run, _INDEX))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of an index, each read by one seek: page_id, url, html."""

    def run(batches):
        where, _ = fs.FileSystem.from_uri(folder)
        name, f = None, None
        for batch in batches:
            got = []
            for n, offset, length in zip(*(column(batch, c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if n != name:
                    name, f = n, where.open_input_file(n)
                f.seek(offset)
                head, body = read_member(f.read(length))
                got.append((int(head["x-page-id"]) if "x-page-id" in head else None, _unescape(head["warc-target-uri"]) if "warc-target-uri" in head else None, None if "x-null-body" in head else body.decode("utf-8", "surrogatepass")))
            if got:
                i, u, t = zip(*got, strict=True)
                yield pa.record_batch({"page_id": pa.array(i, pa.int64()), "url": pa.array(u, pa.string()), "html": pa.array(t, pa.string())})

    return index.where("complete").select("file", "offset", "length").mapInArrow(run, "page_id long, url string, html string")


def normalised_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages through a monolithic file, the normaliser and its index: page_id,
    url, payload bytes and MD5 as read by seeking to each listed offset."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = normalise_files(write_monolithic(pages, f"{folder}/raw"), f"{folder}/members")
    back = read_records(index, folder)
    return back.select("page_id", "url", F.octet_length("html").cast("long").alias("payload_bytes"), F.md5("html").alias("payload_md5"))
