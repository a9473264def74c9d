"""Legacy web archives (ARC 1 and 2) to WARC 1.1, and WARC back to rows.

Archives are real files, written by Spark's text writer (one row a record, the
format's record separator as line separator, gzip) and read with its
``binaryFile`` source, so they can live on any store that Spark reaches.

ARC: a file opens with a version block, whose version fixes the fields of every
record's header line: version 1 has URL, IP-address, Archive-date, Content-type
and Archive-length; version 2 has Result-code, Checksum, Location, Offset and
Filename before the length.  The declared length alone says where a record
ends.  Fields are split from the right, as a URL may hold spaces.

WARC: record id, date, type and digests don't exist in ARC and are synthesised:
the id is a name-based UUID of (file, offset), the date is the 14-digit
Archive-date in ISO form, digests are SHA-256 of block and payload.  Of
records with equal payloads of at least ``least_bytes`` the first is a
``response`` and the others ``revisit`` it, without a payload of their own.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.session import cut_lineage, table_path

from .common import small_batches

FILE_BYTES = 16 << 20  # payload bytes an archive file is sized for
ARC_FIELDS = {b"1": 5, b"2": 10}  # fields of a record's header line, by version
_ARC_NAMES = {
    b"1": b"URL IP-address Archive-date Content-type Archive-length",
    b"2": b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _token(value: str | None) -> bytes:
    """A header value on one line; what would break the line is percent-encoded."""
    if not value:
        return b"-"
    return "".join(f"%{ord(c):02X}" if c in "\r\n\x00%" else c for c in value).encode()


def _untoken(value: bytes) -> str | None:
    if value == b"-":
        return None
    for code, c in ((b"%0D", b"\r"), (b"%0A", b"\n"), (b"%00", b"\x00"), (b"%25", b"%")):
        value = value.replace(code, c)
    return value.decode()


# --- writing ARC -----------------------------------------------------------

def arc_version_block(version: bytes, name: bytes) -> bytes:
    body = version + b" 0 archive\n" + _ARC_NAMES[version] + b"\n"
    middle = b" 0.0.0.0 20240101000000 text/plain " + (b"" if version == b"1" else b"200 - - 0 " + name + b" ")
    return b"filedesc://" + name + middle + str(len(body)).encode() + b"\n" + body


def arc_record(version: bytes, name: bytes, url: str | None, page_id: int | None, payload: bytes) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n"
    if page_id is not None:
        http += b"X-Page-Id: " + str(page_id).encode() + b"\r\n"
    block = http + b"\r\n" + payload
    second = (page_id or 0) % 86400
    date = b"20240101" + f"{second // 3600:02d}{second // 60 % 60:02d}{second % 60:02d}".encode()
    middle = b"" if version == b"1" else b" 200 - - 0 " + name
    return b" ".join([_token(url), b"0.0.0.0", date, b"text/html"]) + middle + b" " + str(len(block)).encode() + b"\n" + block


def _archive_of(opening, record, records: int):
    """Partition -> rows of archive files: an opening record before every ``records`` rows."""
    def run(batches):
        part, file, room = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not room:
                    file, room = file + 1, records
                    out.append(opening(part, file))
                out.append(record(part, file, row))
                room -= 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
    return run


def _write_archive(df: DataFrame, opening, record, records: int, path: str, separator: str) -> None:
    """Files of an opening record and ``records`` more: the writer begins a new file exactly where the next opening record comes."""
    rows = small_batches(df).mapInArrow(_archive_of(opening, record, records), "record binary")
    (rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", separator).option("maxRecordsPerFile", records + 1)
     .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").mode("overwrite").text(path))


def _records_per_file(rows: DataFrame, size: str) -> int:
    """So many that a file holds about FILE_BYTES, at the rows' mean size (an SQL expression)."""
    total, count = rows.agg(F.sum(F.expr(size)), F.count("*")).first()
    return max(1, min(100_000, int(FILE_BYTES * count / total) if total else 100_000))


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write ``pages`` as ARC files, in turn of version 1 and 2 (null html: empty payload).  The rows stay in their partitions."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").cast("binary").alias("payload"))

    def version(part: int, file: int) -> tuple[bytes, bytes]:
        return (b"1", b"2")[(part + file) % 2], b"part-%05d-%05d.arc" % (part, file)

    _write_archive(rows, lambda part, file: arc_version_block(*version(part, file)),
                   lambda part, file, r: arc_record(*version(part, file), r["url"], r["page_id"], r["payload"] or b""),
                   _records_per_file(rows, "octet_length(payload) + 256"), path, "\n")


# --- reading ARC -----------------------------------------------------------

def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of one ARC file: url, ip, date, mime, offset, block; fields by the file's own version."""
    at, version = 0, b""
    while at < len(data):
        if data[at] in b"\r\n":  # records are set apart by a newline
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].rstrip(b"\r")
        if not version:
            body = data[end + 1:end + 1 + int(line.rsplit(b" ", 1)[1])]
            version = body.split(b" ", 1)[0]
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version!r}")
            at = end + 1 + len(body)
            continue
        fields = line.rsplit(b" ", ARC_FIELDS[version] - 1)
        length = int(fields[-1])
        if len(data) < end + 1 + length:
            raise ValueError(f"ARC record at {at} declares {length} bytes, the file ends before")
        yield {"url": _untoken(fields[0]), "ip": fields[1].decode(), "date": fields[2].decode(), "mime": fields[3].decode(),
               "offset": at, "block": data[end + 1:end + 1 + length]}
        at = end + 1 + length


def split_http(block: bytes) -> tuple[bytes, bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    return head + b"\r\n\r\n", payload


def _header(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n"):
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip()
    return None


def _inflate(data: bytes) -> bytes:
    """All members of a gzip file, or the data as it is."""
    out = b""
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        out += one.decompress(data)
        data = one.unused_data
    return out or data


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _per_file(rows_of, names: list[str], kinds: list[pa.DataType]):
    """A batch per run of records of about 8 MB."""
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                held, size = [], 0
                for row in rows_of(path, _inflate(content.as_py())):
                    held.append(row)
                    size += sum(len(v) for v in row if isinstance(v, bytes))
                    if size > 8 << 20:
                        yield _batch(held, names, kinds)
                        held, size = [], 0
                if held:
                    yield _batch(held, names, kinds)
    return run


def _batch(rows, names, kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, date, digest, payload_bytes, record_id, head, payload of each record of the ARC files."""
    def rows_of(file, data):
        name = file.rsplit("/", 1)[-1]
        for r in parse_arc(data):
            head, payload = split_http(r["block"])
            page = _header(head, b"x-page-id")
            yield (int(page) if page else None, r["url"], r["date"], hashlib.sha256(payload).hexdigest(), len(payload),
                   f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{r["offset"]}')}", head, payload)
    names = ["page_id", "url", "date", "digest", "payload_bytes", "record_id", "head", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
    return _files(spark, path).mapInArrow(_per_file(rows_of, names, kinds), (
        "page_id long, url string, date string, digest string, payload_bytes long, record_id string, head binary, payload binary"))


# --- WARC ------------------------------------------------------------------

def _iso(date: str) -> bytes:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z".encode()


def warc_record(headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(k + b": " + v for k, v in headers), b"Content-Length: " + str(len(block)).encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block


def _warc_of(r: dict) -> bytes:
    revisit = r["refers_id"] is not None
    block = r["head"] if revisit else r["head"] + (r["payload"] or b"")
    headers = [(b"WARC-Type", b"revisit" if revisit else b"response"), (b"WARC-Record-ID", b"<" + r["record_id"].encode() + b">"),
               (b"WARC-Date", _iso(r["date"])), (b"Content-Type", b"application/http; msgtype=response"),
               (b"WARC-Payload-Digest", b"sha256:" + r["digest"].encode()),
               (b"WARC-Block-Digest", b"sha256:" + hashlib.sha256(block).hexdigest().encode())]
    if r["url"] is not None:
        headers.append((b"WARC-Target-URI", _token(r["url"])))
    if revisit:
        headers += [(b"WARC-Profile", _PROFILE), (b"WARC-Refers-To", b"<" + r["refers_id"].encode() + b">"),
                    (b"WARC-Refers-To-Date", _iso(r["refers_date"]))]
    return warc_record(headers, block)


def _warcinfo(part: int, file: int) -> bytes:
    fields = b"software: pathweave\r\nformat: WARC File Format 1.1\r\n"
    name = b"part-%05d-%05d.warc" % (part, file)
    return warc_record([(b"WARC-Type", b"warcinfo"), (b"WARC-Record-ID", b"<urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, name.decode())).encode() + b">"),
                        (b"WARC-Date", b"2024-01-01T00:00:00Z"), (b"WARC-Filename", name), (b"Content-Type", b"application/warc-fields")], fields)


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 100) -> None:
    """Write the records of the ARC files as WARC files, equal payloads once."""
    records = read_arc(spark, arc_path)
    # Types are decided on small rows; a digest that many records share moves no payloads.
    small = cut_lineage(records.select("page_id", "digest", "payload_bytes", "record_id", "date"), "arc_records")
    large = small.where(F.col("payload_bytes") >= least_bytes).where("page_id IS NOT NULL")
    first = large.groupBy("digest").agg(F.min(F.struct("page_id", "record_id", "date")).alias("first"))
    revisits = (large.join(first, "digest").where("page_id > first.page_id")
                .select("record_id", F.col("first.record_id").alias("refers_id"), F.col("first.date").alias("refers_date")))
    whole = records.join(revisits, "record_id", "left").withColumn("payload", F.expr("if(refers_id IS NULL, payload, NULL)"))
    _write_archive(whole, _warcinfo, lambda part, file, r: _warc_of(r), _records_per_file(small, "payload_bytes + 512"), warc_path, "\r\n\r\n")


def parse_warc(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(headers, block) of each record of one WARC file; the declared Content-Length says where a block ends."""
    at = 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\r\n\r\n", at)
        headers = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            key, _, value = line.partition(b":")
            headers[key.strip().lower()] = value.strip()
        length = int(headers[b"content-length"])
        block = data[end + 4:end + 4 + length]
        if len(block) < length:
            raise ValueError(f"WARC record at {at} declares {length} bytes, the file ends before")
        yield headers, block
        at = end + 4 + length


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, record_id, refers_id, payload_bytes, payload_digest, payload of each response and revisit.

    A response's size and digest are taken from its payload, and a digest that its
    header doesn't confirm is an error; a revisit has those of the payload it names.
    """
    def rows_of(file, data):
        for h, block in parse_warc(data):
            kind = h[b"warc-type"].decode()
            if kind not in ("response", "revisit"):
                continue
            head, payload = split_http(block)
            page, declared = _header(head, b"x-page-id"), h[b"warc-payload-digest"].rpartition(b":")[2].decode()
            size = len(payload)
            if kind == "revisit":
                size = int(_header(head, b"content-length") or 0)
            elif hashlib.sha256(payload).hexdigest() != declared:
                raise ValueError(f"{file}: payload digest of {h[b'warc-record-id']!r}")
            refers = h.get(b"warc-refers-to")
            url = h.get(b"warc-target-uri")
            yield (int(page) if page else None, _untoken(url) if url else None, kind, h[b"warc-record-id"].strip(b"<>").decode(),
                   refers.strip(b"<>").decode() if refers else None, size, declared, payload if kind == "response" else None)
    names = ["page_id", "url", "record_type", "record_id", "refers_id", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return _files(spark, path).mapInArrow(_per_file(rows_of, names, kinds), (
        "page_id long, url string, record_type string, record_id string, refers_id string, payload_bytes long, "
        "payload_digest string, payload binary"))


def arc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """Pages -> ARC files -> WARC files -> page_id, payload_bytes, payload_digest, record_type, refers_to, a row for each page.

    Defined cases: null html is an empty payload, a null url is written as "-" in
    ARC and left out in WARC; a null page_id is always a response that nothing refers to;
    rows that repeat a page_id and its payload are responses if no smaller id has
    the payload; an empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    arc, warc = (table_path(spark, f"{kind}/{uuid.uuid4().hex}") for kind in ("arc", "warc"))
    write_arc(pages, arc, id_col, url_col, html_col)
    convert_arc(spark, arc, warc, least_bytes)
    read = cut_lineage(read_warc(spark, warc).drop("payload", "url"), "warc_records")
    owners = read.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    return read.join(owners, "refers_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
