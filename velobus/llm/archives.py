"""Legacy ARC archives: written, read by declared lengths, converted to WARC, and read back.

Archives are gzip files of records one after the other. Spark's text reader and writer move the
bytes, with the records' separator as its line end; gzip files are not split, so a file's lines
come in order and a record is put together from them by its declared length, whatever its content.
"""

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velobus.llm.shared import shared_folder

CRLF2 = b"\r\n\r\n"
# The record lines of both versions of the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WRITTEN = "20240101000000"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _text_rows(values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["value"])


def _arc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An archive per task; even ones are of version 1, odd ones of version 2."""
    task = TaskContext.get().partitionId()
    version = 1 + task % 2
    name = f"pages-{task:06d}.arc"
    offset = 0
    for number, batch in enumerate(batches):
        out = []
        if not number:
            about = f"{version} 0 velobus\n{FIELDS[version]}\n".encode()
            tail = f"text/plain {len(about)}" if version == 1 else f"text/plain 200 - - 0 {name} {len(about)}"
            out.append(f"filedesc://{name} 0.0.0.0 {WRITTEN} {tail}\n".encode() + about)
            offset += len(out[0]) + 1
        for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            payload = (html or "").encode()
            known = "" if page is None else f"X-Page-Id: {page}\r\n"
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{known}\r\n"
            block = head.encode() + payload
            # A record line is divided by blanks and ends with its line.
            clean = "".join(f"%{b:02X}" if b <= 0x20 else chr(b) for b in (url or "-").encode()).encode("latin-1")
            tail = f"text/html {len(block)}" if version == 1 else f"text/html 200 {digest_of(payload)} - {offset} {name} {len(block)}"
            out.append(clean + f" 0.0.0.0 {WRITTEN} {tail}\n".encode() + block)
            offset += len(out[-1]) + 1
        yield _text_rows(out)


def _write(rows: DataFrame, end: str, path: str) -> None:
    text = rows.select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def write_arc(pages: DataFrame, path: str) -> None:
    """Pages as ARC archives, an HTTP response each: page_id (in a header), url, html."""
    _write(pages.select("page_id", "url", "html").mapInArrow(_arc_records, "value binary"), "\n", path)


def _lines(spark: SparkSession, path: str, end: str) -> DataFrame:
    lines = spark.read.option("lineSep", end).schema("value string").text(path)
    return lines.select(F.col("value").cast("binary").alias("value"), F.input_file_name().alias("file"))


def blocks(batches: Iterator[pa.RecordBatch], end: bytes, length: Callable[[bytes], int]) -> Iterator[tuple[bool, bytes, bytes, bool]]:
    """(first of its file, header, block, whole) of every record, from the lines of whole files.

    ``length`` reads a header's declared length. Empty lines between records are passed over; a
    block that its file ends too early is given as far as it goes, and is not whole.
    """
    file, opened, header, parts, have, due = None, False, None, [], 0, 0
    for batch in batches:
        for value, origin in zip(batch.column("value").to_pylist(), batch.column("file").to_pylist(), strict=True):
            if origin != file:
                if header is not None:
                    yield opened, header, end.join(parts), False
                file, opened, header = origin, True, None
            if header is not None:
                parts.append(value)
                have += len(value) + len(end)
                if have < due:
                    continue
                block = end.join(parts)
                yield opened, header, block[:due], True
                # A block may end in part of a separator; then the next header is in this line.
                opened, header, value = False, None, block[due:].removeprefix(end)
            if value:
                header, parts, have, due = value, [], -len(end), length(value)
                if not due:
                    yield opened, header, b"", True
                    opened, header = False, None
    if header is not None:
        yield opened, header, end.join(parts), False


def _arc_length(line: bytes) -> int:
    last = line.rsplit(b" ", 1)[-1]
    return int(last) if last.isdigit() else 0


def arc_fields(block: bytes) -> list[str]:
    """The names of a file's record lines: its own second line, else those of the version it states."""
    lines = block.split(b"\n")
    named = lines[1].decode("latin-1").split() if len(lines) > 1 else []
    if named[:1] == ["URL"] and named[-1] == "Archive-length" and "Archive-date" in named:
        return named
    version = lines[0].split(b" ")[0]
    return FIELDS[2 if version == b"2" else 1].split(" ")


def _record_line(header: bytes, fields: list[str]) -> dict[str, str] | None:
    """The fields of a record line, or None if it is none: too few, or no length or date of digits."""
    values = header.decode("latin-1").rsplit(" ", len(fields) - 1)
    line = dict(zip(fields, values, strict=False))
    at = line.get("Archive-date", "")
    fine = len(values) == len(fields) and line["Archive-length"].isdigit() and at.isdigit() and len(at) in (12, 14)
    return line if fine else None


def _http(block: bytes) -> tuple[bytes, bytes]:
    """Head and payload of a block that holds an HTTP response; else no head, and all is payload."""
    if block.startswith((b"HTTP/1", b"HTTP/0", b"HTTP/2")):
        for end in (CRLF2, b"\n\n"):
            head, found, payload = block.partition(end)
            if found:
                return head, payload
    return b"", block


def arc_documents(batches: Iterator[pa.RecordBatch], unread: bool = False) -> Iterator[dict]:
    """The documents of ARC files, their record lines read by the fields that each file declares.

    A line where a record should begin that is no record line is passed over, up to the next that
    is; with ``unread`` such lines come instead of the documents.
    """
    fields, name, number = FIELDS[1].split(" "), "", 0
    for opens, header, block, whole in blocks(batches, b"\n", _arc_length):
        if opens:
            fields, name, number = FIELDS[1].split(" "), "", 0
        if header.startswith(b"filedesc:"):
            fields, number = arc_fields(block), 0
            name = header.split(b" ", 1)[0].decode("latin-1").removeprefix("filedesc://")
            continue
        line = _record_line(header, fields)
        if line is None or unread:
            if line is None and unread:
                yield {"archive": name, "line": header.decode("latin-1"), "bytes": len(header)}
            continue
        http, payload = _http(block)
        number += 1
        at = line["Archive-date"].ljust(14, "0")
        page = _header(http.split(b"\r\n"), b"x-page-id")
        yield {
            "record": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{number}')}",
            "url": line["URL"],
            "ip": line.get("IP-address", "0.0.0.0"),
            "date": f"{at[:4]}-{at[4:6]}-{at[6:8]}T{at[8:10]}:{at[10:12]}:{at[12:14]}Z",
            "kind": line.get("Content-type", "application/octet-stream"),
            "page_id": int(page) if page and page.isdigit() else None,
            "http": http,
            "payload": payload,
            "bytes": len(payload),
            "digest": digest_of(payload),
            "whole": whole,
        }


def _header(lines: list[bytes], name: bytes) -> bytes | None:
    for line in lines:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name:
            return value.strip()
    return None


def _rows_of(documents: Callable, columns: dict[str, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for d in documents(batches):
            rows.append(d)
            size += d["bytes"] + 100
            if size > 4_000_000:
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in columns} for r in rows], pa.schema(columns))
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in columns} for r in rows], pa.schema(columns))

    return run


TEXT, LONG, BYTES = pa.string(), pa.int64(), pa.binary()
FULL = {"record": TEXT, "url": TEXT, "ip": TEXT, "date": TEXT, "kind": TEXT, "page_id": LONG, "http": BYTES, "payload": BYTES, "bytes": LONG, "digest": TEXT, "whole": pa.bool_()}
FULL_SCHEMA = "record string, url string, ip string, date string, kind string, page_id long, http binary, payload binary, bytes long, digest string, whole boolean"
SHORT = {c: FULL[c] for c in ("record", "page_id", "bytes", "digest")}


def _warc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    name = f"pages-{task:06d}.warc"
    for number, batch in enumerate(batches):
        out = []
        if not number:
            about = b"software: velobus\r\nformat: WARC File Format 1.0\r\n"
            own = uuid.uuid5(uuid.NAMESPACE_URL, name)
            out.append(_warc("warcinfo", f"urn:uuid:{own}", "2024-01-01T00:00:00Z", [f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], about))
        for r in batch.to_pylist():
            more = [f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}", f"WARC-Payload-Digest: sha1:{r['digest']}"]
            if not r["whole"]:
                more.append("WARC-Truncated: length")
            if r["refers"] is None:
                block = r["http"] + CRLF2 + r["payload"] if r["http"] else r["payload"]
            else:
                block = r["http"] + CRLF2
                more += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <{r['refers']}>"]
            kind = "revisit" if r["refers"] else "response" if r["http"] else "resource"
            content = "application/http; msgtype=response" if r["http"] else r["kind"]
            more += [f"WARC-Block-Digest: sha1:{digest_of(block)}", f"Content-Type: {content}"]
            out.append(_warc(kind, r["record"], r["date"], more, block))
        yield _text_rows(out)


def _warc(kind: str, record: str, date: str, more: list[str], block: bytes) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record}>", f"WARC-Date: {date}", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + CRLF2 + block


def convert(spark: SparkSession, arc: str, warc: str, least: int = 0) -> None:
    """ARC archives at one path as WARC archives at another.

    Of documents with equal payloads of at least ``least`` bytes, the one with the smallest page id
    (of several with that id, the first by record id) becomes a response, the others revisits that
    refer to it; smaller payloads and documents without a page id are all responses. Identifiers
    follow from the archive's name and the document's number in it, dates from the record line.
    A document that its file cuts short is marked as truncated, one that is no HTTP response (such as
    the answer of a name server) becomes a resource. What unread_lines() lists is left out.
    """
    lines = _lines(spark, arc, "\n")
    short = lines.mapInArrow(_rows_of(arc_documents, SHORT), "record string, page_id long, bytes long, digest string")
    known = short.where((F.col("page_id").isNotNull()) & (F.col("bytes") >= least))
    first = known.groupBy("digest", "bytes").agg(F.min(F.struct("page_id", "record")).alias("first"), F.count("*").alias("n")).where("n > 1")
    refers = known.join(first, ["digest", "bytes"]).where("record <> first.record").select("record", F.col("first.record").alias("refers"))
    full = lines.mapInArrow(_rows_of(arc_documents, FULL), FULL_SCHEMA)
    rows = full.join(refers, "record", "left")
    _write(rows.mapInArrow(_warc_records, "value binary"), "\r\n\r\n", warc)


def unread_lines(spark: SparkSession, arc: str) -> DataFrame:
    """(archive, line) of all lines of ARC archives that stand where a record should begin."""
    find = _rows_of(lambda batches: arc_documents(batches, unread=True), {"archive": TEXT, "line": TEXT})
    return _lines(spark, arc, "\n").mapInArrow(find, "archive string, line string")


def _warc_length(header: bytes) -> int:
    return int(_header(header.split(b"\r\n"), b"content-length") or 0)


def warc_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Responses, resources and revisits of WARC files; digests are taken anew where there is a payload.

    Only a block that is declared to be HTTP has a head before its payload.
    """
    for _, header, block, _ in blocks(batches, CRLF2, _warc_length):
        lines = header.split(b"\r\n")
        kind = (_header(lines, b"warc-type") or b"").decode("latin-1")
        if kind not in ("response", "resource", "revisit"):
            continue
        declared = (_header(lines, b"content-type") or b"").lower()
        http, _, payload = block.partition(CRLF2) if declared.startswith(b"application/http") else (b"", b"", block)
        page = _header(http.split(b"\r\n"), b"x-page-id")
        digest, size = digest_of(payload), len(payload)
        if kind == "revisit":
            digest = (_header(lines, b"warc-payload-digest") or b"").decode("latin-1").removeprefix("sha1:")
            size = int(_header(http.split(b"\r\n"), b"content-length") or 0)
        refers = _header(lines, b"warc-refers-to")
        yield {
            "record": (_header(lines, b"warc-record-id") or b"").decode("latin-1").strip("<>"),
            "refers": refers.decode("latin-1").strip("<>") if refers else None,
            "page_id": int(page) if page and page.isdigit() else None,
            "bytes": size,
            "digest": digest,
            "kind": kind,
        }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the archives' records."""
    columns = {"record": TEXT, "refers": TEXT, "page_id": LONG, "bytes": LONG, "digest": TEXT, "kind": TEXT}
    schema = "record string, refers string, page_id long, bytes long, digest string, kind string"
    rows = _lines(spark, path, "\r\n\r\n").mapInArrow(_rows_of(warc_documents, columns), schema)
    named = rows.where("kind = 'response'").select(F.col("record").alias("refers"), F.col("page_id").alias("refers_to"))
    out = rows.join(named, "refers", "left")
    return out.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """read_warc() of ``pages`` after their way through ARC archives and convert().

    Null html is an empty payload. Pages without an id are responses with a null page_id; of equal
    rows one is the response, the others refer to the same id. An empty table gives an empty
    result; other columns are ignored.
    """
    spark = pages.sparkSession
    arc, warc = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    write_arc(pages, arc)
    if not spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(arc).select("path").isEmpty():
        convert(spark, arc, warc, least)
        return read_warc(spark, warc)
    return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
