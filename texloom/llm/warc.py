"""Web archives: the legacy ARC format, its conversion to WARC, and reading WARC back.

An ARC file begins with a version block whose second line names version 1 or 2; after it every
record has one header line (5 fields in version 1, 10 in version 2, the last of both the
body's length in bytes) and a body of exactly that length, here an HTTP response. Conversion
parses header lines by the version found and bodies by their declared lengths, never by
separators, and synthesises what WARC needs and ARC lacks: record ids, ISO timestamps, record
types, SHA-256 digests. A version block becomes a warcinfo record, which the file's other records
name. Record ids are UUIDs of a record's ARC file and its place there, so rows of one page id, and
equal rows, have different ones; page ids stand in fields of their own. Of records with equal payloads of `MIN_REVISIT` bytes or more the one
of smallest page id stays a response; the others become revisits that refer to it and carry
no payload.

Files are written by Spark's text writer, one per task, gzip-compressed, into the shared
folder; its line separator is the format's record end. They are read by Spark's binaryFile
source and parsed as a stream, so a task holds one file's compressed bytes and one record.

Which payloads repeat is found on narrow rows (digest and id), counted before the shuffle; a
payload moves once, to the task that writes its record.

Defined cases: a null or empty html is an empty payload and always a response; a null URL is
`-`; blanks in a URL are percent-encoded; rows of one page id are written as they are, and
those with the smallest id share the response's role; revisits refer to one of these. A null page id
comes back as null, is never a revisit and never referred to. Ids are of any type that its own text
casts back to (whole numbers, strings, dates); the smallest is that type's. Other columns are ignored; a file that
breaks off or has a bad length raises an error that names it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.llm.store import new_path, written

MIN_REVISIT = 100
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
FIELDS = {1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"]}
FIELDS[2] = [*FIELDS[1][:4], "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"]
PAGE, REFERS_PAGE = "X-Page-Id", "X-Refers-To-Page-Id"  # fields of the HTTP block and of the WARC header


# ---------------------------------------------------------------- ARC


def write_arc(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "20240101000000") -> None:
    """One ARC record per row, version 1 in files of even partitions and version 2 in the others."""
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("binary").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        version = 1 + TaskContext.get().partitionId() % 2
        tail = "" if version == 1 else " 200 - - 0 -"
        about = f"{version} 0 texloom\n{' '.join(FIELDS[version])}\n"
        yield _lines([f"filedesc://pages.arc 0.0.0.0 {date} text/plain{tail} {len(about)}\n{about}".encode()])
        for batch in batches:
            rows = zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)
            for n, u, data in rows:
                data = data or b""
                name = f"{PAGE}: {_page_name(n)}"
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{name}\r\nContent-Length: {len(data)}\r\n\r\n".encode() + data
                head = f"{_one_field(u)} 0.0.0.0 {date} text/html{tail} {len(body)}\n"
                yield _lines([head.encode("utf-8", "surrogatepass") + body])

    source.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.options(lineSep="\n", **GZIP).text(path)


def _lines(values: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(values, pa.binary())], names=["value"])


def _page_name(page: object) -> str:
    """An id's text in printable ASCII; `-` is null."""
    if page is None:
        return "-"
    return "%2D" if page == "-" else quote(str(page), safe="")


def _one_field(url: str | None) -> str:
    out = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    return out or "-"


class _Stream:
    """A gzip-compressed or plain byte string, read forwards."""

    def __init__(self, data: bytes, name: str):
        self.data, self.name, self.at, self.buffer = memoryview(data), name, 0, bytearray()
        self.zip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        part = self.data[self.at : self.at + (1 << 20)]
        self.at += len(part)
        if self.zip is None:
            self.buffer += part
            return True
        part = bytes(part)
        while part:
            self.buffer += self.zip.decompress(part)
            part = self.zip.unused_data
            if part:  # another member
                self.zip = zlib.decompressobj(31)
        return True

    def until(self, end: bytes) -> bytes | None:
        """What comes before `end`, which is skipped; None at the end of the data."""
        start = 0
        while (k := self.buffer.find(end, start)) < 0:
            start = max(0, len(self.buffer) - len(end))
            if not self._more():
                if self.buffer.strip(b"\r\n"):
                    raise ValueError(f"{self.name}: the file breaks off in a header")
                return None
        out = bytes(self.buffer[:k])
        del self.buffer[: k + len(end)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError(f"{self.name}: the file breaks off in a record of {n} bytes")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def skip(self, chars: bytes) -> None:
        while self.buffer[:1] and self.buffer[0] in chars or (not self.buffer and self._more()):
            k = len(self.buffer) - len(self.buffer.lstrip(chars))
            del self.buffer[:k]


def _length(text: str, name: str) -> int:
    if not text.isdigit():
        raise ValueError(f"{name}: bad record length {text!r}")
    return int(text)


def parse_arc(data: bytes, name: str = "arc", block: bool = False) -> Iterator[tuple[dict, bytes]]:
    """Header fields and body of each record of an ARC file, by the version its first block names; that block first, if asked for."""
    stream = _Stream(data, name)
    head = stream.until(b"\n")
    if head is None:
        return
    about = stream.take(_length(head.decode("latin-1").split(" ")[-1], name)).decode("latin-1")
    version = 2 if about[:1] == "2" else 1
    fields = FIELDS[version]
    if block:
        url, _, date, *_ = [*head.decode("latin-1").split(" "), "", ""]
        yield {"URL": url, "Archive-date": date, "Version": str(version)}, about.encode("latin-1")
    while True:
        stream.skip(b"\r\n")
        head = stream.until(b"\n")
        if head is None:
            return
        values = head.decode("utf-8", "replace").rstrip("\r").rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"{name}: a header line of {len(values)} fields, not {len(fields)}")
        record = dict(zip(fields, values, strict=True))
        yield record, stream.take(_length(record["Archive-length"], name))


def _http(body: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """HTTP header block (with the blank line), its fields, and the payload."""
    k = body.find(b"\r\n\r\n")
    head, payload = (body[: k + 4], body[k + 4 :]) if k >= 0 else (b"", body)
    fields = dict(line.split(": ", 1) for line in head.decode("latin-1").split("\r\n")[1:] if ": " in line)
    return head, fields, payload


def _record_id(file: str, n: int) -> str:
    """A version 8 UUID of a record's file and its place in it."""
    h = hashlib.sha256(f"{file}#{n}".encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-8{h[13:16]}-{'89ab'[int(h[16], 16) % 4]}{h[17:20]}-{h[20:32]}"


def _info(file: str, version: str) -> bytes:
    """The fields of a warcinfo record."""
    return f"software: texloom\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC version {version}, {file}\r\n".encode()


_READ_ARC = "page string, record string, info string, url string, date string, mime string, http binary, payload_bytes long, payload_digest string, payload binary"
_READ_WARC = "page string, url string, record_type string, refers string, payload_bytes long, payload_digest string, payload binary, record_id string"
_KINDS = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}


def _to_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], _KINDS[kind]) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def read_arc(spark: SparkSession, path: str, payloads: bool = True, *, id_type: str = "long", blocks: bool = False) -> DataFrame:
    """page_id, page (its text), record and info (ids), url, date, mime, http, payload_bytes, payload_digest and, if asked for, payload of each record.

    With `blocks` each file's version block is a row too: record equals info, and http holds the fields of a warcinfo record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                file = name.rsplit("/", 1)[-1]
                info = _record_id(file, 0)
                for n, (record, body) in enumerate(parse_arc(data.as_py(), name, block=True)):
                    if n == 0:
                        if blocks:
                            rows.append((None, info, info, file, record["Archive-date"], "text/plain", _info(file, record["Version"]), 0, None, b""))
                        continue
                    head, fields, payload = _http(body)
                    digest = hashlib.sha256(payload).hexdigest()
                    own = _record_id(file, n)
                    rows.append((fields.get(PAGE, "-"), own, info, record["URL"], record["Archive-date"], record["Content-type"], head, len(payload), digest, payload if payloads else None))
                    held += len(payload) if payloads else 100
                    if held > 4 << 20:
                        yield _to_batch(rows, _READ_ARC)
                        rows, held = [], 0
                yield _to_batch(rows, _READ_ARC)

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _READ_ARC)
    return found.select(_typed("page", id_type).alias("page_id"), "*")


def _typed(name: str, id_type: str) -> Column:
    text = F.when(F.col(name) != "-", F.expr(f"url_decode(replace({name}, '+', '%2B'))"))
    return text.cast(id_type)


# ---------------------------------------------------------------- WARC


def roles(records: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, payload_digest, refers_page and refers_record: for each page that repeats an earlier payload, the response."""
    narrow = records.where(F.col("payload_bytes") >= min_revisit).select("page_id", "page", "record", "payload_digest")
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record", "page"))).alias("first")
    firsts = narrow.groupBy("payload_digest").agg(first, F.count("*").alias("n")).where("n > 1")
    joined = narrow.join(firsts.select("payload_digest", "first"), "payload_digest").where("page_id > first.page_id")
    return joined.select("page_id", "payload_digest", F.col("first.page").alias("refers_page"), F.col("first.record").alias("refers_record")).distinct()


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_revisit: int = MIN_REVISIT, *, id_type: str = "long") -> None:
    """WARC files with one record for each record of the ARC files, and a warcinfo record for each file."""
    narrow = read_arc(spark, arc_path, payloads=False, id_type=id_type).select("page_id", "page", "record", "payload_bytes", "payload_digest")
    revisits = written(roles(written(narrow, "warc-digests"), min_revisit), "warc-roles")
    full = read_arc(spark, arc_path, id_type=id_type, blocks=True).join(revisits, ["page_id", "payload_digest"], "left")
    again, about = F.col("refers_record").isNotNull(), F.col("record") == F.col("info")
    crlf = F.lit("\r\n")
    digits = lambda a, n: F.substring("date", a, n)
    when = F.concat(digits(1, 4), F.lit("-"), digits(5, 2), F.lit("-"), digits(7, 2), F.lit("T"), digits(9, 2), F.lit(":"), digits(11, 2), F.lit(":"), digits(13, 2), F.lit("Z"))
    block = F.when(again, F.col("http")).otherwise(F.concat("http", "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, crlf)
    urn = lambda name: F.concat(F.lit("<urn:uuid:"), F.col(name), F.lit(">"))
    target = F.concat(line("WARC-Target-URI", F.col("url")), line("WARC-Warcinfo-ID", urn("info")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))))
    refers = F.concat(
        line("WARC-Refers-To", urn("refers_record")), line(REFERS_PAGE, F.col("refers_page")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    )
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(about, F.lit("warcinfo")).when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn("record")),
        line("WARC-Date", when),
        F.when(about, line("WARC-Filename", F.col("url"))).otherwise(target),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block, 256))),
        F.when(again, refers).otherwise(F.lit("")),
        line("Content-Type", F.when(about, F.lit("application/warc-fields")).otherwise(F.lit("application/http;msgtype=response"))),
        line("Content-Length", F.octet_length(block).cast("string")),
        crlf,
    )
    value = F.concat(head.cast("binary"), block).cast("string").alias("value")  # bytes stay as they are
    full.select(value).write.options(lineSep="\r\n\r\n", **GZIP).text(warc_path)


def parse_warc(data: bytes, name: str = "warc") -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a WARC file, by declared lengths."""
    stream = _Stream(data, name)
    while True:
        stream.skip(b"\r\n")
        head = stream.until(b"\r\n\r\n")
        if head is None:
            return
        version, *rest = head.decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"{name}: a record that begins with {version[:20]!r}")
        fields = dict(x.split(": ", 1) for x in rest if ": " in x)
        yield fields, stream.take(_length(fields.get("Content-Length", ""), name))


def read_warc(spark: SparkSession, path: str, payloads: bool = True, *, id_type: str = "long") -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (if asked for; null for revisits), record_id.

    The digest of a response is computed from the payload read; that of a revisit is the record's.
    Other records than responses and revisits are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                for fields, block in parse_warc(data.as_py(), name):
                    if fields["WARC-Type"] not in ("response", "revisit"):
                        continue
                    _, http, payload = _http(block)
                    own, url, page = fields["WARC-Record-ID"].strip("<>"), fields["WARC-Target-URI"], http.get(PAGE, "-")
                    if fields["WARC-Type"] == "revisit":
                        stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        rows.append((page, url, "revisit", fields.get(REFERS_PAGE, "-"), int(http["Content-Length"]), stated, None, own))
                    else:
                        rows.append((page, url, "response", "-", len(payload), hashlib.sha256(payload).hexdigest(), payload if payloads else None, own))
                        held += len(payload) if payloads else 100
                    if held > 4 << 20:
                        yield _to_batch(rows, _READ_WARC)
                        rows, held = [], 0
                yield _to_batch(rows, _READ_WARC)

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _READ_WARC)
    return found.select(
        _typed("page", id_type).alias("page_id"), "url", "record_type", _typed("refers", id_type).alias("refers_to"), "payload_bytes", "payload_digest", "payload", "record_id"
    )


def archive_round_trip(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Pages to ARC files, these to WARC files, and those read back; all in the shared folder."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    id_type = pages.schema["page_id"].dataType.simpleString()
    write_arc(pages, arc)
    convert(spark, arc, warc, id_type=id_type)
    return read_warc(spark, warc, payloads, id_type=id_type)
