"""Legacy archive converter: ARC records parsed and re-issued as WARC records.

Pages become records of the legacy format first: a version block (version 1 with five header
fields a record, version 2 with ten), then for each page a header line and as many bytes as the
line declares.  The converter parses the line by the version's field list, takes the declared
length of bytes, and synthesises what WARC asks for: a record id derived from the archive's name and the
record's place in it, an ISO timestamp, the type, and payload and block digests.  Of records with equal
payloads one is a ``response`` and the others ``revisit`` it by digest.  The rows of a batch take the
legacy versions in turn, an archive a version.

Archives are written per task to the shared folder under a name of their own and renamed when
complete; the result is parsed from the archives.  Equal payloads are found by SHA-256 and length
in one map-side combined aggregate, so a payload that a third of all pages share costs one row a
task; the SHA-1 that WARC asks for, for which collisions are known, decides nothing.

Null html counts as empty.  Urls may be null or hold blanks (they are percent-encoded in header
lines).  A null page id is smaller than any other and has no header line; of equal payloads whose
ids are all null one row is the response.  Of repeated rows of the largest id one is the response, the others revisit
it by its id, which is their own; all get record ids of their own.  Ids may be of any type that a string holds.  An
empty table gives no archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.shared import shared_dir, written
from graphloom.llm.words import utf8

#: The header fields of both versions of the legacy format.
ARC_FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"],
}
DATE = "20200101000000"
FILE_BYTES = 128 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_head(version: int, name: str, length_of: bytes = b"") -> bytes:
    """The version block that opens an archive."""
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    body = f"{version} 0 graphloom\n{names}\n".encode()
    fields = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": DATE, "type": "text/plain", "status": "200", "checksum": "-", "location": "-", "offset": "0", "file": name, "length": str(len(body))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, payload: bytes, date: str = DATE, ip: str = "0.0.0.0") -> bytes:
    """A record of the legacy format: header line, payload, line end."""
    quoted = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    fields = {"url": quoted, "ip": ip, "date": date, "type": "text/html", "status": "200", "checksum": "-", "location": "-", "offset": "0", "file": "-", "length": str(len(payload))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + payload + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record after the version block, by that block's version."""
    end = data.index(b"\n")
    length = int(data[:end].rsplit(b" ", 1)[1])
    version = int(data[end + 1 : end + 1 + length].split(b" ", 1)[0])
    names, at = ARC_FIELDS[version], end + 1 + length
    while True:
        while data[at : at + 1] == b"\n":
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "replace").split(" ")
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"not a version-{version} header line: {values[:5]}")
        head = dict(zip(names, values, strict=True))
        at = end + 1 + int(head["length"])
        if at > len(data):
            raise ValueError("declared length passes the end")
        yield head, data[end + 1 : at]


def warc_record(head: dict[str, str], payload: bytes, page_id, revisit: bool, refers_to, truth: str, place: str) -> bytes:
    """The WARC record for a legacy record; a revisit carries no payload.  A null id has no header line.  place: the archive and number that no other record has."""
    kind = "revisit" if revisit else "response"
    d = head["date"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{place} {head["url"]}')}>",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-Target-URI: {head['url']}",
        f"WARC-IP-Address: {head['ip']}",
        f"WARC-Payload-Digest: sha1:{truth}",
        *([] if page_id is None else [f"WARC-Page-ID: {quote(str(page_id))}"]),
        f"WARC-Original-Length: {len(payload)}",
        f"Content-Type: {head['type']}",
    ]
    if revisit:
        lines += [*([] if refers_to is None else [f"WARC-Refers-To-Page-ID: {quote(str(refers_to))}"]), "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = b"" if revisit else payload
    lines += [f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        begin = end + 4
        at = begin + int(head["Content-Length"])
        yield head, data[begin:at]
        at += 4


def write_warc(pages: DataFrame, uri: str, least: int = 0, versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Writes archives of gzip members below uri; returns one row an archive: its name."""
    # The row's place tells repeated rows of one id apart: just one of them is the response.
    pages = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row"))
    light = pages.select("page_id", "row", F.sha2("html", 256).alias("sha"), F.octet_length("html").alias("size"))
    groups = light.where(F.col("size") >= least).groupBy("sha", "size").agg(F.max(F.struct("page_id", "row")).alias("keep"), F.count("*").alias("n")).where("n > 1")
    # Payloads move once, to their digest's group; a hot digest is on the left side, which AQE splits.
    paired = pages.withColumn("sha", F.sha2("html", 256)).withColumn("size", F.octet_length("html")).join(groups.drop("n"), ["sha", "size"], "left")
    revisit = F.coalesce(F.col("keep.row") != F.col("row"), F.lit(False))
    paired = paired.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("keep.page_id")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        own, sink, names, size, place = uuid.uuid4().hex, None, [], 0, 0

        def close() -> None:
            sink.close()
            names.append(f"{own}-{len(names):04d}.warc.gz")
            fs.move(f"{root}/.{own}", f"{root}/{names[-1]}")

        for batch, (k, version) in ((b, v) for b in batches for v in enumerate(versions)):  # the rows of a batch take the versions in turn
            rows = batch.take(pa.array(range(k, batch.num_rows, len(versions)), pa.int64()))
            urls = [x if x is not None else "" for x in rows["url"].to_pylist()]
            ids, revisits, refers, html = rows["page_id"].to_pylist(), rows["revisit"].to_pylist(), rows["refers_to"].to_pylist(), utf8(rows["html"])
            legacy = arc_head(version, own) + b"".join(arc_record(version, u, h) for u, h in zip(urls, html, strict=True))
            for (head, payload), page, again, to in zip(parse_arc(legacy), ids, revisits, refers, strict=True):
                if sink is None:
                    sink, size = fs.open_output_stream(f"{root}/.{own}", compression=None), 0
                pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                member = pack.compress(warc_record(head, payload, page, again, to, digest(payload), f"{own} {place}")) + pack.flush()
                sink.write(member)
                place += 1
                size += len(member)
                if size >= FILE_BYTES:
                    close()
                    sink = None
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["archive"])

    return written(paired.mapInArrow(write, "archive string"), f"{uri}/_archives")


def _members(source) -> Iterator[bytes]:
    """The gzip members of an archive, one at a time."""
    rest = b""
    while True:
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not rest:
                rest = source.read(1 << 20)
                if not rest:
                    return
            out.append(unpack.decompress(rest))
            rest = unpack.unused_data
        yield b"".join(out)


def read_warc(archives: DataFrame, uri: str, id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record; a response's digest is checked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(uri)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        rows: list[tuple] = []
        for batch in batches:
            for name in batch["archive"].to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for member in _members(source):
                        for head, block in parse_warc(member):
                            truth, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                            if kind == "response" and digest(block) != truth:
                                raise ValueError(f"{name}: payload differs from its digest")
                            named = lambda k, h=head: unquote(h[k]) if k in h else None
                            rows.append((named("WARC-Page-ID"), int(head["WARC-Original-Length"]), truth, kind, named("WARC-Refers-To-Page-ID")))
                            if len(rows) == 10_000:
                                yield packed(rows)
                                rows = []
        yield packed(rows)

    out = archives.mapInArrow(read, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
    return out.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def archive_pages(pages: DataFrame, least: int = 0, uri: str | None = None) -> DataFrame:
    """Write all pages as WARC, then read the archives back."""
    uri = uri or shared_dir(pages.sparkSession)
    return read_warc(write_warc(pages, uri, least), uri, pages.schema["page_id"].dataType.simpleString())
