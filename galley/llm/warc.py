"""WARC archives: written with revisits, read back sequentially and verified."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.words import chunks
from galley.operators.skew import balanced_lookup
from galley.session import new_path, stage

#: Payloads below this size are stored again rather than referred to.
REVISIT_BYTES = 1_000
#: An archive is closed once it is this large.
ARCHIVE_BYTES = 1 << 30
READ_BYTES = 1 << 16
# Fixed values of the WARC 1.1 standard.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_RESPONSE = "application/http;msgtype=response"
GZIP = zlib.MAX_WBITS | 16
PAGE = "urn:page:"


def base32_digest(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def hex_digest(labelled: str) -> str:
    return base64.b32decode(labelled.removeprefix("sha1:")).hex()


def record_bytes(fields: dict[str, str | None], block: bytes) -> bytes:
    """One record as one gzip member. Fields that are None are left out."""
    named = {**fields, "WARC-Block-Digest": base32_digest(hashlib.sha1(block).hexdigest()), "Content-Length": str(len(block))}
    head = "".join(f"{name}: {value}\r\n" for name, value in named.items() if value is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    parts = [f"{VERSION}\r\n{head}\r\n".encode(), block, b"\r\n\r\n"]
    return b"".join([*map(packer.compress, parts), packer.flush()])


def page_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """A response, or a revisit that holds the HTTP head only when ``refers_to`` names the response."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{PAGE}{page_id}>" if page_id is not None else f"<{uuid.uuid4().urn}>",
        "WARC-Date": date,
        "WARC-Target-URI": quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url is not None else None,
        "WARC-Payload-Digest": base32_digest(digest),
        "WARC-Profile": SAME_PAYLOAD if revisit else None,
        "WARC-Refers-To": f"<{PAGE}{refers_to}>" if revisit else None,
        "Content-Type": HTTP_RESPONSE,
    }
    return record_bytes(fields, head if revisit else head + payload)


class Archive:
    """An archive file in the work folder under a name no other attempt of the task uses."""

    def __init__(self, folder: str, date: str):
        from pyarrow import fs

        self._system, root = fs.FileSystem.from_uri(folder)
        self._system.create_dir(root, recursive=True)
        scheme = folder.split("://")[0] + "://" if "://" in folder else ""
        name = f"pages-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        self.path = f"{folder}/{name}" if scheme else f"{root}/{name}"
        self._stream = self._system.open_output_stream(f"{root}/{name}", compression=None)
        self.records = self.size = 0
        info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<{uuid.uuid4().urn}>", "WARC-Date": date,
                "Content-Type": "application/warc-fields"}
        self.write(record_bytes(info, b"format: WARC File Format 1.1\r\n"))

    def write(self, member: bytes) -> None:
        self._stream.write(member)
        self.records += 1
        self.size += len(member)

    def close(self) -> pa.RecordBatch:
        self._stream.close()
        return pa.RecordBatch.from_pydict({"path": [self.path], "records": [self.records], "size": [self.size]})


def write_archives(
    pages: DataFrame,
    date: str = "2024-01-01T00:00:00Z",
    work_folder: str | None = None,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per page; returns the manifest (path, records, size) of the archives.

    Of pages with equal payloads of at least 1,000 bytes, that with the largest page_id is stored as
    a response and the others as revisits of it. Payloads are equal if length, SHA-1 and a second
    hash are. The groups are found on digests alone, combined before the shuffle; a payload
    that a large share of all pages has reaches its pages by broadcast and their rows stay spread.

    A task writes its own archives under fresh names. The manifest lists those of the attempt that
    counted, so what a lost attempt left behind is never read.

    Null html is an empty payload, null urls have no target field. Rows without page_id are
    responses or revisits like others but never referred to while an id is there; rows that share
    the largest page_id are all responses. No rows give no archives.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    key = F.concat_ws(":", F.sha1(payload), F.octet_length(payload), F.hex(F.xxhash64(payload)))
    narrow = pages.select("page_id", F.when(F.octet_length(payload) >= REVISIT_BYTES, key).alias("_key"))
    groups = narrow.dropna(subset=["_key"]).groupBy("_key")
    groups = groups.agg(F.max("page_id").alias("_keeper"), F.count("*").alias("_copies"))
    groups = stage(groups.filter("_copies > 1"), "payloads", work_folder)
    rows = pages.select(
        "page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"),
        F.when(F.octet_length(payload) >= REVISIT_BYTES, key).alias("_key"),
        F.xxhash64("page_id", "url").alias("_spread_by"),
    )
    known = balanced_lookup(rows, groups, ["_key"], "_copies", "_spread_by", ["_keeper"])
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_keeper")), F.col("_keeper")).alias("refers_to")
    ready = known.select("page_id", "url", "payload", "digest", refers)
    folder = new_path(pages.sparkSession, "archives", work_folder)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in chunks(batches, 256):
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                archive = archive or Archive(folder, date)
                archive.write(page_record(*row, date))
                if archive.size >= archive_bytes:
                    yield archive.close()
                    archive = None
        if archive:
            yield archive.close()

    return stage(ready.mapInArrow(run, "path string, records long, size long"), "manifest", work_folder)


class RecordReader:
    """Reads an archive from front to back, one gzip member and so one record at a time.

    Members are inflated piece by piece. A record ends where its Content-Length says; what does not
    fit (a cut file, a member with more or less than a record, a wrong digest) is an error.
    """

    def __init__(self, stream):
        self._stream = stream
        self._left = b""

    def _member(self) -> Iterator[bytes]:
        inflate = zlib.decompressobj(GZIP)
        while not inflate.eof:
            data = self._left or self._stream.read(READ_BYTES)
            self._left = b""
            if not data:
                raise EOFError("the archive ends inside a member")
            if piece := inflate.decompress(data):
                yield piece
        self._left = inflate.unused_data

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            self._left = self._left or self._stream.read(READ_BYTES)
            if not self._left:
                return
            yield self._record(self._member())

    def _record(self, pieces: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
        head = b""
        while b"\r\n\r\n" not in head:
            head += next(pieces, b"") or self._broken("a member ends before its header does")
        head, _, rest = head.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if first != VERSION:
            self._broken(f"not a record: {first!r}")
        fields = dict(line.split(": ", 1) for line in lines)
        length = int(fields["Content-Length"])
        block = bytearray(rest)
        for piece in pieces:
            block += piece
        if bytes(block[length:]) != b"\r\n\r\n":
            self._broken("a member is not as long as its record says")
        del block[length:]
        if hashlib.sha1(block).hexdigest() != hex_digest(fields["WARC-Block-Digest"]):
            self._broken("the block does not have its digest")
        return fields, bytes(block)

    @staticmethod
    def _broken(why: str):
        raise ValueError(why)


def page_of(fields: dict[str, str], block: bytes) -> dict:
    """What a response or revisit says of its page; the payload of a response is checked."""
    head, _, payload = block.partition(b"\r\n\r\n")
    sizes = [line.split(b":")[1] for line in head.split(b"\r\n") if line.startswith(b"Content-Length:")]
    digest, revisit = hex_digest(fields["WARC-Payload-Digest"]), fields["WARC-Type"] == "revisit"
    if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(sizes[0])):
        raise ValueError("the payload does not have its digest and length")
    number = lambda name: fields.get(name, "")[1:-1].removeprefix(PAGE)
    own, other = number("WARC-Record-ID"), number("WARC-Refers-To")
    return {
        "page_id": None if own.startswith("urn:") else int(own),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": int(sizes[0]),
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": int(other) if other else None,
        "payload": None if revisit else payload,
    }


PAGES = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
)


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The pages of all archives of a manifest, every record verified.

    Archives are dealt out one by one and read in order; a task holds one record and a batch of rows.
    """
    archives = manifest.count()
    schema = PAGES if with_payload else PAGES.removesuffix(", payload binary")
    arrow = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if with_payload else []),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_stream(place, compression=None) as stream:
                    rows = []
                    for fields, block in RecordReader(stream):
                        if fields["WARC-Type"] in ("response", "revisit"):
                            row = page_of(fields, block)
                            rows.append({name: row[name] for name in arrow.names})
                        if len(rows) >= 256:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return manifest.select("path").repartition(max(1, archives)).mapInArrow(run, schema)
