r"""WARC archives: a writer that stores equal payloads once, and a splittable reader of any archive.

Where every record is a gzip member of its own, archives can be read from any record on. The reader cuts
files into byte ranges. A task looks for the bytes of a gzip header in its range, takes a candidate for
a record only if it inflates to a WARC header, and then follows the members one by one; a record belongs
to the range in which its member's first byte is. Compressed data can hold the magic bytes by chance; such
candidates fail to inflate or to show a header, and the search goes on behind them. Versions 1.0 and 1.1,
all types of records, binary blocks, folded header lines and members of several records are read; a
header may be of any length.

Files are reached by pyarrow's file systems, by the URI of the shared folder (local or mounted paths,
HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, written

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
START = b"WARC/"
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that a reader asks for at once, that it wants at hand before it inflates, and that are inflated at once.
CHUNK, AHEAD, PIECE = 1 << 20, 1 << 16, 1 << 14
#: Tasks of a reader at most; each takes several ranges if there are more.
MOST_TASKS = 50_000


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(number))}>"


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has no block, but the digest and length of its payload."""
    body = b"" if refers_to is not None else payload
    lines = [
        ("WARC-Type", RESPONSE if refers_to is None else REVISIT),
        ("WARC-Record-ID", _id(page_id)),
        ("WARC-Target-URI", " ".join((url or "about:blank").split())),
        ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Page-ID", str(page_id)),
        ("Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(refers_to)), ("Refers-To-Page-ID", str(refers_to))]
    lines += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(head + body + b"\r\n\r\n") + squeeze.flush()


def _write(folder: str, file_bytes: int):
    """(page_id, url, payload, refers_to) -> (path, bytes, records), a row for each file.

    A task that is run again writes files of other names; only those of the attempt that Spark keeps
    are in the table that comes back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(folder)
        out, path, size, n = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([posixpath.join(folder, path)]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "records"])

        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                if out is None:
                    path, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(posixpath.join(root, path), compression=None)  # the name would have it compress again
                member = record(page.as_py(), url.as_py(), (payload.as_py() or "").encode(), refers.as_py())
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = 64 << 20) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns path, bytes, records of each file.

    Of pages with equal payloads of at least min_bytes bytes that with the smallest page_id becomes a
    response and the others revisit it; all smaller payloads are responses. A null html is an empty
    payload. page_id is a key and not null; rows without one are an error. Payloads aren't shuffled
    for this if the table of revisits is small enough for Spark to broadcast.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), html.alias("payload"))
    keys = rows.select("page_id", F.sha2("payload", 256).alias("same"), (F.octet_length("payload") >= min_bytes).alias("shared")).where("shared")
    keys = written(keys.select("page_id", "same"), "warc-digests")
    first = written(keys.groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "warc-firsts")
    revisits = written(keys.join(first, "same").where("page_id > first").select("page_id", F.col("first").alias("refers_to")), "warc-revisits")
    rows = rows.join(revisits, "page_id", "left").select("page_id", "url", "payload", "refers_to")
    return written(rows.mapInArrow(_write(folder, file_bytes), "path string, bytes long, records long"), "warc-files")


def _inflated(data: memoryview, file, at: int) -> tuple[bytes, int] | None:
    """The gzip member at `at`, if it starts like a record, and the place behind it; else None. data: what was read from `at` on."""
    inflate, parts, size, used = zlib.decompressobj(31), [], 0, 0
    while True:
        if not len(data):
            return None  # the file ends within it
        for i in range(0, len(data), PIECE):
            piece = data[i : i + PIECE]
            try:
                parts.append(inflate.decompress(piece))
            except zlib.error:
                return None
            if size < len(START):
                head = b"".join(parts)[: len(START)]
                if not START.startswith(head):
                    return None
            size += len(parts[-1])
            used += len(piece)
            if inflate.eof:
                whole = b"".join(parts)
                return (whole, at + used - len(inflate.unused_data)) if whole.startswith(START) else None
        file.seek(at + used)
        data = memoryview(file.read(CHUNK))


def parsed(member: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a member; none if it has no whole one."""
    found, at = [], 0
    while member.startswith(START, at) and (end := member.find(b"\r\n\r\n", at)) >= 0:
        lines = re.sub(r"\r\n[ \t]+", " ", member[at:end].decode("utf-8", "replace")).split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = fields.get("content-length", "")
        if not length.isdigit() or end + 4 + int(length) > len(member):
            break
        at = end + 4 + int(length)
        found.append((fields, member[end + 4 : at]))
        while member.startswith(b"\r\n", at):
            at += 2
    return found


def records_in(file, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of the records in members whose first byte is in start..end-1; offset is the member's."""
    at, synced, window, base = start, False, b"", start
    while at < end:
        if not synced:  # look for the next candidate
            if not base <= at <= base + len(window) - len(MAGIC):
                file.seek(at)
                window, base = file.read(min(CHUNK, end - at + len(MAGIC) - 1)), at
                if len(window) < len(MAGIC):
                    return
            found = window.find(MAGIC, at - base)
            if found < 0:
                at = base + len(window) - len(MAGIC) + 1
                continue
            at = base + found
            if at >= end:
                return
        if not base <= at or base + len(window) - at < AHEAD:
            file.seek(at)
            window, base = file.read(CHUNK), at
        got = _inflated(memoryview(window)[at - base :], file, at)
        records = parsed(got[0]) if got else []
        if not records:
            at, synced = at + 1, False
            continue
        for fields, block in records:
            yield at, fields, block
        at, synced = got[1], True


def payload_of(fields: dict[str, str], block: bytes) -> bytes | None:
    """The payload that a record holds itself: what follows the HTTP header of an http block, else the block; None for a revisit."""
    if fields.get("warc-type", "").lower() == REVISIT:
        return None
    if fields.get("content-type", "").lower().startswith("application/http"):
        head, gap, body = block.partition(b"\r\n\r\n")
        return body if gap else b""
    return block


def _number(x: str | None) -> int | None:
    return int(x) if x and x.isascii() and x.removeprefix("-").isdigit() and len(x) < 19 else None


COLUMNS = "page_id long, record_type string, payload_bytes long, payload_digest string, digest_ok boolean, refers_to long, record_id string, url string, date string, content_type string, payload binary"


def _row(fields: dict[str, str], block: bytes) -> tuple:
    payload, stated = payload_of(fields, block), fields.get("warc-payload-digest", "")
    kind, _, value = stated.rpartition(":")
    own = digest(payload) if payload is not None else None
    checkable = own is not None and kind.lower() == "sha1" and len(value) == len(own)
    size = len(payload) if payload is not None else _number(fields.get("payload-length"))
    return (
        _number(fields.get("page-id")), fields.get("warc-type"), size, (value or own), (value.upper() == own) if checkable else None, _number(fields.get("refers-to-page-id")),
        fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("content-type"), payload,
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, end) -> a row for each record of that range."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    arrow = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds = [arrow[c.split()[1]] for c in COLUMNS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
            store, inner = _opened(path)
            rows, held = [], 0
            with store.open_input_file(inner) as file:
                for _, fields, block in records_in(file, start, end):
                    rows.append(_row(fields, block))
                    held += len(block)
                    if held > 4 * CHUNK:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_archives(files: DataFrame, range_bytes: int = 4 << 20) -> DataFrame:
    """COLUMNS of every record: those of the writer's own fields (page_id, refers_to, a revisit's payload_bytes) are null in other archives.

    files: path and bytes of each archive. Ranges of range_bytes are dealt evenly to tasks, one each up to
    MOST_TASKS; a record is read once, by the range that holds its member's first byte, however long it is.
    payload is that of responses and other records, without the header of an http block, and null for
    revisits. payload_digest is the stated one, else that of the payload; digest_ok says whether a stated
    SHA-1 in base32 is that of the payload (null where it can't be said). Bytes that are no record are passed over.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = files.where("bytes > 0").select("path", starts.alias("start"), "bytes")
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, F.col("bytes")).alias("end"))
    return ranges.repartition(max(1, min(ranges.count(), MOST_TASKS))).mapInArrow(_read, COLUMNS)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes archives of pages to the shared folder and reads them back."""
    return read_archives(write_archives(pages, new_path(spark, "warc"), min_bytes))
