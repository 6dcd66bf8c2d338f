"""WARC archives: written with revisits for repeated payloads, and read back record by record.

An archive is a file of gzip members, one a record.  Tasks write files of bounded size into a folder that
the session shares, each under a name of its own attempt; only files that a finished task has told of
are read, so what lost or repeated attempts leave is never read.

The reader goes through a file once: it inflates member after member in chunks, takes the header up to
the empty line, then as many bytes as ``Content-Length`` says, and compares the payload's SHA-1 with
``WARC-Payload-Digest``.  It never holds more than a chunk, a header and, where payloads are asked for,
one record.  A record that can't be inflated, framed or verified gets an ``error``; reading goes on at the
next member that begins with a WARC version.

Of records with equal payloads (SHA-1 and SHA-256 both) of ``REVISIT`` bytes or more, the one with the
largest id is a response and the others are revisits, which have no payload of their own and are resolved
by a join when read.  Null payloads are empty; null ids come before all others; rows with the same id
and payload are all responses if that id is the largest; null URLs give records without one, and control
characters in a URL are escaped.  Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tables import text_batches, written
from tidemark.sources.paths import scratch

REVISIT = 1000
CHUNK = 1 << 16
#: Compressed bytes after which a task begins a new file.
FILE = 256 << 20
MAX_HEADER = 1 << 20
#: Parts that the copies of a payload, and the revisits of a response, are dealt to.
SALTS = 64
VERSION = b"WARC/1.1"
# Fixed value: the profile of a revisit to an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "file string, offset long, record_id string, record_type string, refers_to string, uri string, date string, page_id long, "
    "payload_bytes long, payload_digest string, told_digest string, payload binary, error string"
)
_NAMES = [c.split()[0] for c in RECORD.split(", ")]
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in RECORD.split(", ")])


# writing


def base32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same id for the same page and payload, whatever the attempt."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def escaped(url: str) -> str:
    return "".join(c if c > "\x20" and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(payload: bytes, size: int, digest: str, url: str | None, page_id: int | None, refers_to: int | None, date: str) -> bytes:
    """One record; with ``refers_to`` a revisit of that page, without payload.  ``size`` and ``digest``
    are those of the full payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest if not revisit else f'{digest}:revisit')}", f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{base32(digest)}", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {escaped(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_warc(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", revisit: int = REVISIT, size: int = FILE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives into ``folder``; (file, records, bytes) of each.

    The largest id of a payload is found with map-side combining.  Pages are joined with those of
    payloads that repeat, in ``SALTS`` parts, so that no payload's copies meet in one task, and revisits
    leave their text behind before anything is written."""
    text_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    p = p.withColumns({"sha1": F.sha1("html"), "key": F.unhex(F.concat(F.sha1("html"), F.sha2("html", 256)))})
    large = F.octet_length("html") >= revisit
    most = p.where(large).groupBy("key").agg(F.max("page_id").alias("most"), F.count(F.lit(1)).alias("c")).where("c > 1")
    most = most.select("key", "most", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(most, ["key", "salt"], "left")
    refers = F.when(large & F.col("most").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("most"))), F.col("most"))
    p = p.withColumn("refers_to", refers)
    p = p.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).otherwise("").alias("html"), F.octet_length("html").alias("n"), "sha1", "refers_to")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)
        fs.create_dir(base, recursive=True)
        out, told = None, []

        def end() -> None:
            nonlocal out
            if out is not None:
                out.close()
                out = None

        for batch in batches:
            for page_id, url, text, n, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    told.append([f"part-{uuid.uuid4().hex}.warc.gz", 0, 0])
                    out = fs.open_output_stream(f"{base}/{told[-1][0]}", compression=None)
                data = member(record(text.encode("utf-8", "surrogatepass"), n, digest, url, page_id, refers_to, date))
                out.write(data)
                told[-1][1] += 1
                told[-1][2] += len(data)
                if told[-1][2] >= size:
                    end()
        end()
        if told:
            names, records, sizes = zip(*told, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in names]), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["file", "records", "bytes"])

    return written(p.mapInArrow(work, "file string, records long, bytes long"))


# reading


class Damaged(Exception):
    """A record that can't be read."""


class Members:
    """The gzip members of a stream, one after the other, inflated chunk by chunk."""

    def __init__(self, stream):
        self.stream, self.held, self.at, self.over = stream, b"", 0, False

    def _fill(self) -> bool:
        if not self.over and not self.held:
            self.held = self.stream.read(CHUNK)
            self.over = not self.held
        return bool(self.held)

    def begin(self) -> bool:
        """At the next member, if there is one."""
        if not self._fill():
            return False
        self.z = zlib.decompressobj(31)
        self.ready = b""
        return True

    def read(self, n: int) -> bytes:
        """Up to ``n`` inflated bytes; none at the member's end."""
        while not self.ready and not self.z.eof:
            more, before = self._fill(), len(self.held)
            try:
                self.ready = self.z.decompress(self.held, CHUNK)
            except zlib.error as e:
                raise Damaged(f"inflate: {e}") from None
            self.held = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.at += before - len(self.held)
            if not more and not self.ready and not self.z.eof:
                raise Damaged("truncated member")
        out, self.ready = self.ready[:n], self.ready[n:]
        return out

    def resync(self) -> bool:
        """At the next place where a member with a WARC version begins; the stream may be cut anywhere."""
        skip = 1
        while True:
            if len(self.held) < CHUNK and (more := self.stream.read(CHUNK)):
                self.held += more
                continue
            k = self.held.find(b"\x1f\x8b\x08", skip)
            if k < 0:
                drop = max(len(self.held) - 2, 0)
                if len(self.held) < CHUNK:  # the stream is over
                    self.at += len(self.held)
                    self.held, self.over = b"", True
                    return False
                self.at += drop
                self.held, skip = self.held[drop:] + self.stream.read(CHUNK), 0
                continue
            if len(self.held) - k < CHUNK and (more := self.stream.read(CHUNK)):
                self.held += more
                skip = k
                continue
            try:
                good = zlib.decompressobj(31).decompress(self.held[k : k + CHUNK], 8).startswith(b"WARC/")
            except zlib.error:
                good = False
            self.at, self.held, skip = self.at + k, self.held[k:], 1
            if good:
                return True


def _header(src: Members, first: bytes = b"") -> tuple[dict[str, str], str, bytes]:
    """(fields by lower-case name, first line, bytes read beyond) of a header up to its empty line."""
    data = first
    while (end := data.find(b"\r\n\r\n")) < 0:
        more = src.read(CHUNK)
        if not more:
            raise Damaged("header without end")
        data += more
        if len(data) > MAX_HEADER:
            raise Damaged("header too long")
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields, lines[0], data[end + 4 :]


def _one(src: Members, payload: bool) -> dict:
    """The record at which a member has begun, read to the member's end."""
    out: dict = {}
    try:
        fields, version, rest = _header(src)
        if not version.startswith("WARC/"):
            raise Damaged(f"no WARC record: {version[:40]!r}")
        told = fields.get("warc-payload-digest", "")
        out |= {
            "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "refers_to": fields.get("warc-refers-to"), "uri": fields.get("warc-target-uri"),
            "date": fields.get("warc-date"), "told_digest": told or None, "page_id": int(fields["x-page-id"]) if fields.get("x-page-id", "").lstrip("-").isdigit() else None,
        }
        if not fields.get("content-length", "").isdigit():
            raise Damaged("no content length")
        left = int(fields["content-length"])
        rest = _body(src, rest, left, fields, payload, out)
        tail = rest
        while more := src.read(CHUNK):
            tail = (tail + more)[:8]
        if tail != b"\r\n\r\n":
            raise Damaged("content length doesn't fit the record")
        if out["record_type"] != "revisit" and told.lower().startswith("sha1:") and told[5:].upper() != base32(out["payload_digest"]):
            raise Damaged("payload digest differs")
    except Damaged as e:
        out["error"] = str(e)
    return out


def _body(src: Members, rest: bytes, left: int, fields: dict, payload: bool, out: dict) -> bytes:
    """Digest and length of the payload into ``out``; returns what follows the block."""
    http = fields.get("content-type", "").replace(" ", "").startswith("application/http")
    digest, size, kept, head = hashlib.sha1(), 0, [], b"" if http else None
    while left:
        if not rest and not (rest := src.read(CHUNK)):
            raise Damaged("record shorter than its content length")
        part, rest = rest[:left], rest[left:]
        left -= len(part)
        if head is not None:  # the HTTP header comes before the payload
            head += part
            if (end := head.find(b"\r\n\r\n")) < 0:
                if len(head) > MAX_HEADER:
                    raise Damaged("HTTP header too long")
                continue
            part, head = head[end + 4 :], None
        digest.update(part)
        size += len(part)
        if payload:
            kept.append(part)
    if head:
        raise Damaged("HTTP header without end")
    if out["record_type"] != "revisit":
        out |= {"payload_bytes": size, "payload_digest": digest.hexdigest(), "payload": b"".join(kept) if payload else None}
    return rest


def records(stream, payload: bool = False) -> Iterator[dict]:
    """The records of an archive in order, damaged ones with an ``error``."""
    src = Members(stream)
    while src.begin():
        at = src.at
        found = _one(src, payload)
        yield found | {"offset": at}
        if "error" in found and not src.z.eof and not src.resync():
            return


def read_warc(spark: SparkSession, files: DataFrame, payload: bool = False) -> DataFrame:
    """The records of archives; ``files`` has their places in ``file``.  A file is read by one task."""
    text_batches(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.column(0).to_pylist():
                fs, path = pyarrow.fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (pyarrow.fs.LocalFileSystem(), place)
                with fs.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for r in records(stream, payload):
                        rows.append(r)
                        held += len(r.get("payload") or b"")
                        if len(rows) == 1000 or held > CHUNK * 64:
                            yield _batch(rows, place)
                            rows, held = [], 0
                    yield _batch(rows, place)

    return files.select("file").repartition(max(1, min(files.count(), 100_000))).mapInArrow(work, RECORD)


def _batch(rows: list[dict], place: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: [place if c == "file" else r.get(c) for r in rows] for c in _NAMES}, _ARROW)


def resolved(found: DataFrame) -> DataFrame:
    """Records with ``payload_bytes``, ``payload_digest`` and ``refers_to_page`` of revisits taken from the
    response that they refer to; a revisit without one, or with another digest, gets an ``error``."""
    response = found.where("record_type = 'response' and error is null").groupBy(F.col("record_id").alias("refers_to"))
    response = response.agg(F.max("page_id").alias("r_page"), F.max("payload_bytes").alias("r_bytes"), F.max("payload_digest").alias("r_digest"), F.max("told_digest").alias("r_told"))
    revisit = F.col("record_type") == "revisit"
    found = found.withColumn("salt", F.pmod(F.xxhash64("file", "offset"), F.lit(SALTS)))
    asked = found.where(revisit).select("refers_to", "salt").distinct()  # a response goes where its revisits are
    out = found.join(response.join(asked, "refers_to"), ["refers_to", "salt"], "left").drop("salt")
    lost = F.when(revisit & F.col("r_bytes").isNull(), "refers to no record").when(revisit & (F.col("r_told") != F.col("told_digest")), "payload digest differs")
    taken = {"payload_bytes": F.coalesce("payload_bytes", "r_bytes"), "payload_digest": F.coalesce("payload_digest", "r_digest"), "refers_to_page": F.col("r_page"), "error": F.coalesce("error", lost)}
    return out.withColumns(taken).drop("r_page", "r_bytes", "r_digest", "r_told")


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """``pages`` written as archives and read back, revisits resolved."""
    spark = pages.sparkSession
    files = write_warc(pages, folder or scratch(spark, "warc"))
    return resolved(written(read_warc(spark, files)))
