"""Web archives: a writer with revisit records and a reader that salvages damaged archives.

Archives are gzip files with one member for each record. The reader checks every record (gzip CRC,
version line, lengths, block and payload digests). Where a check fails it looks for the next gzip
member or version line that begins a record which passes, goes on from there, and reports the bytes in
between as a gap. Of a broken gzip member the records before the damage stay if a digest proves them; its gap then
has the inner offset at which they end.

Null payloads count as empty, null URLs as an empty target. Of pages with equal payloads those with the
smallest id become responses and the others revisits; a page without an id is always a response.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import new_path

ARCHIVE_BYTES = 16_000_000
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
#: A header line may go on in the next one after a blank; lengths are plain ASCII digits.
_FOLDED, _LENGTH = re.compile(r"\r\n[ \t]+"), re.compile("[0-9]{1,18}")
_CHUNK = 16_384
_END = b"\r\n\r\n"

RECORD_SCHEMA = (
    "path string, offset long, length long, inner_offset long, reason string, warc_type string, record_id string, target_uri string, "
    "refers_to string, payload_digest string, payload_bytes long, payload binary"
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _matches(labelled: str, data: bytes) -> bool | None:
    """Whether a digest such as ``sha1:...`` in base32 or hex is that of ``data``; None if its kind isn't known."""
    kind, _, value = labelled.partition(":")
    if kind.lower() not in ("md5", "sha1", "sha256", "sha512"):
        return None
    found = hashlib.new(kind.lower(), data).digest()
    return value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=") or value.lower() == found.hex()


def with_first_page(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Columns page_id, url, payload (binary) and refers_to: the smallest page id with the same payload.

    ``refers_to`` is null for the first page itself and for payloads under ``least_bytes``. Only digests are
    grouped; the payloads move once, by page id, so copies of one payload don't meet in one task.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    digests = rows.where(F.length("payload") >= least_bytes).select("page_id", F.sha2("payload", 256).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    revisits = digests.join(first, "digest").where(F.col("page_id") > F.col("refers_to")).distinct()
    return rows.withColumn("digest", F.sha2("payload", 256)).join(revisits, ["page_id", "digest"], "left").drop("digest")


def record_bytes(warc_type: str, record_id: str, uri: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header of its payload but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if warc_type == "revisit" else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {warc_type}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', '', uri)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + _END + block + _END) + packer.flush()


def write_archives(pages: DataFrame, *, name: str = "warc", archive_bytes: int = ARCHIVE_BYTES) -> list[str]:
    """Write the rows of :func:`with_first_page` as archives in the shared folder and return their paths.

    Every task attempt writes files of its own, and only those of attempts that succeeded are returned (one
    path for each ``archive_bytes``).
    """
    spark = pages.sparkSession
    folder = new_path(spark, name)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        context = TaskContext.get()
        store, inner = fs.FileSystem.from_uri(folder)
        store.create_dir(inner, recursive=True)
        done, out, size = [], None, 0
        for pdf in batches:
            for page_id, url, payload, first in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["refers_to"], strict=True):
                if out is None:
                    file = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(done):04d}.warc.gz"
                    out, size = store.open_output_stream(f"{inner}/{file}", compression=None), 0
                    done.append(f"{folder}/{file}")
                known = not pd.isna(first)
                data = record_bytes("revisit" if known else "response", f"urn:page:{'' if pd.isna(page_id) else int(page_id)}", url or "", bytes(payload), f"urn:page:{int(first)}" if known else None)
                out.write(data)
                size += len(data)
                if size >= archive_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if done:
            yield pd.DataFrame({"path": done})

    ids = pages.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    return [r["path"] for r in ids.mapInPandas(write, "path string").collect()]


@dataclass
class Record:
    warc_type: str
    record_id: str
    target_uri: str
    refers_to: str | None
    payload_digest: str
    payload_bytes: int
    payload: bytes


class Damaged(Exception):
    """A check of a record failed. ``content`` is what a broken gzip member still gives, ``items`` what was salvaged from it."""

    def __init__(self, reason: str, content: bytes = b"", items: list | None = None):
        super().__init__(reason)
        self.content, self.items = content, items or []


def parse_record(data: bytes, pos: int, proven: bool = False) -> tuple[Record, int]:
    """The record at ``pos`` of uncompressed data and where it ends; Damaged if a check fails, or with ``proven`` if no digest is there to check."""
    version = _VERSION.match(data, pos)
    if not version:
        raise Damaged("no version line")
    head = data.find(_END, pos)
    if head < 0:
        raise Damaged("header without end")
    fields = {}
    header = _FOLDED.sub(" ", data[version.end() : head].decode("utf-8", "replace"))
    for line in header.split("\r\n"):
        key, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line without a colon")
        fields[key.strip().lower()] = value.strip()
    if not _LENGTH.fullmatch(fields.get("content-length", "")):
        raise Damaged("no content length")
    begin = head + len(_END)
    end = begin + int(fields["content-length"])
    if data[end : end + len(_END)] != _END:
        raise Damaged("content length and end of record differ")
    block = data[begin:end]
    block_matches, payload_matches = _matches(fields.get("warc-block-digest", ""), block), None
    if block_matches is False:
        raise Damaged("block digest differs")
    kind, digest = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    payload = block.partition(_END)[2] if "application/http" in fields.get("content-type", "") else block
    if kind == "response":
        payload_matches = _matches(fields.get("warc-payload-digest", ""), payload)
        if payload_matches is False:
            raise Damaged("payload digest differs")
        digest = sha1_base32(payload)
    if proven and not block_matches and not payload_matches:
        raise Damaged("no digest to check")
    strip = lambda x: x.strip("<>") if x is not None else None
    return Record(kind, strip(fields.get("warc-record-id", "")), fields.get("warc-target-uri", ""), strip(fields.get("warc-refers-to")), digest, len(payload), payload), end + len(_END)


def _readable(data: memoryview, pos: int, at: int) -> bytes:
    """What a gzip member gives before it breaks somewhere in the chunk from ``at``."""
    unpack = zlib.decompressobj(31)
    out = [unpack.decompress(data[pos:at])]
    try:
        for i in range(at, min(at + _CHUNK, len(data))):
            out.append(unpack.decompress(data[i : i + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def gunzip_member(data: bytes, pos: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``pos`` and where it ends; Damaged if it is broken."""
    unpack, out, at = zlib.decompressobj(31), [], pos
    view = memoryview(data)
    try:
        while not unpack.eof:
            if at >= len(data):
                raise Damaged("gzip member without end", b"".join(out))
            chunk = view[at : at + _CHUNK]
            out.append(unpack.decompress(chunk))
            at += len(chunk)
    except zlib.error as e:
        raise Damaged("gzip: " + str(e).partition(": ")[2], _readable(view, pos, at)) from None
    return b"".join(out), at - len(unpack.unused_data)


def _inside(content: bytes, proven: bool) -> list[tuple[int, Record | str, int]]:
    """Records and gaps of a member's content; Damaged without any record."""
    found = [(a, x, n) for a, n, items in salvage(content, proven) for _, x, _ in items]
    if all(isinstance(x, str) for _, x, _ in found):
        raise Damaged(found[0][1] if found else "no version line")
    return found


def _records_at(data: bytes, pos: int, proven: bool = False) -> tuple[list[tuple[int, Record | str, int]], int]:
    """What stands at ``pos``: (inner offset, record or reason, inner length) for each, and where it ends."""
    if not data.startswith(b"\x1f\x8b", pos):
        record, end = parse_record(data, pos, proven)
        return [(0, record, end - pos)], end
    try:
        content, end = gunzip_member(data, pos)
    except Damaged as broken:
        try:
            items = _inside(broken.content, True)
        except Damaged:
            raise broken from None
        # The end of what could be read is a gap for the reason that the member broke.
        at = items.pop()[0] if isinstance(items[-1][1], str) else len(broken.content)
        raise Damaged(str(broken), broken.content, [*items, (at, str(broken), len(broken.content) - at)]) from None
    return _inside(content, False), end


def _begins(data: bytes, at: int, proven: bool, seen: bytes) -> bool:
    """Whether a valid record begins at ``at`` that isn't part of ``seen``, the content that was salvaged already."""
    try:
        end = _records_at(data, at, proven)[1]
    except Damaged as e:
        if not e.items:
            return False
        end = at + 64
    return not seen or data[at:end] not in seen


def salvage(data: bytes, proven: bool = False) -> Iterator[tuple[int, int, list[tuple[int, Record | str, int]]]]:
    """(offset, length, items) in order; an item is (inner offset, record, length), or a reason for a gap.

    With ``proven`` only records with a digest count, as in the content of a gzip member whose CRC can't be checked.
    """
    pos = 0
    while pos < len(data):
        try:
            items, end = _records_at(data, pos, proven)
        except Damaged as e:
            candidates = (c.start() for c in _CANDIDATE.finditer(data, pos + 1))
            seen = e.content if e.items else b""
            end = next((at for at in candidates if _begins(data, at, proven, seen)), len(data))
            items = e.items or [(0, str(e), end - pos)]
        yield pos, end - pos, items
        pos = end


def read_archives(spark: SparkSession, paths: list[str] | str, *, payloads: bool = True) -> DataFrame:
    """Records and gaps of archives: a gap has a ``reason`` and no ``warc_type``, a record has no ``reason``.

    An archive is read by one task, so archives should be kept to some tens of MB as the writer does.
    """
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows, size = [], 0
                for offset, length, items in salvage(bytes(content)):
                    for inner, x, _ in items:
                        if isinstance(x, str):
                            rows.append((path, offset, length, inner, x, *[None] * 5, 0, None))
                        else:
                            rows.append((path, offset, length, inner, None, x.warc_type, x.record_id, x.target_uri, x.refers_to, x.payload_digest, x.payload_bytes, x.payload if payloads else None))
                            size += x.payload_bytes
                    if size > 32_000_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    if not paths:
        return spark.createDataFrame([], RECORD_SCHEMA)
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(parse, RECORD_SCHEMA)


def records(found: DataFrame) -> DataFrame:
    return found.where(F.col("reason").isNull()).drop("reason")


def gaps(found: DataFrame) -> DataFrame:
    """The quarantined byte ranges."""
    return found.where(F.col("reason").isNotNull()).select("path", "offset", "length", "inner_offset", "reason")
