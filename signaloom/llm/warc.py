"""WARC archives: a writer with revisit records and a splittable reader of gzip members.

Writer. Every task writes one archive of gzip members, a record each, under a name of its own in the shared folder; only the names that finished tasks return are read, so
an attempt that was lost leaves nothing that counts. Of records with equal payloads of at least LEAST bytes the first is a response, the others are revisits (profile identical-payload-digest) without the payload.

Reader. Archives are cut into byte ranges. A task looks for the gzip magic from the start of its range; a candidate counts when it decodes to a WARC header. From there members follow each other; the
task owns the records of members that start inside its range and reads past its end to finish the last. Bytes between members (padding) are passed over.

Defined results. Null html: an empty payload. Null ids are written as empty and read as null. Repeated ids and rows: the first by id, then by row, is the response. Several records in one member: each counts. A damaged or cut member: one row of type `damaged`, and the records after it are read. What is no record: nothing. Empty table: no archive, no rows. Other columns, of any name, are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, numbered, scratch, scratch_path

LEAST, LEVEL, SPLIT, CHUNK, RANGES = 100, 3, 8 << 20, 1 << 16, 16
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "path string, offset long, type string, record_id string, refers_to string, uri string, digest string, http string, payload binary"


def record(kind: str, record_id: str, uri: str, digest: str, size: int, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A record as bytes: WARC header, HTTP header, payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(path: str, date: str):
    def run(batches):
        from pyarrow import fs

        out, name, size, n = None, f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
        for b in batches:
            for kind, rid, uri, digest, length, html, refers in zip(*(b.column(c).to_pylist() for c in ("type", "record_id", "uri", "digest", "bytes", "html", "refers_to"))):
                if out is None:
                    store, folder = fs.FileSystem.from_uri(path)
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)  # a name in .gz would be packed again
                packed = member(record(kind, rid, " ".join((uri or "").split()), digest, length, b"" if kind == "revisit" else (html or "").encode(), refers, date))
                out.write(packed)
                size, n = size + len(packed), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{path}/{name}"], "size": [size], "records": [n]})

    return run


def write_warc(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages and returns a table of the archives: path, size, records."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("uri"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = numbered(rows.withColumn("bytes", F.octet_length("html")).withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)), "warc-rows")
    named = lambda page, rid: F.concat(F.lit("urn:signaloom:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), rid.cast("string"))
    facts, order = rows.select("rid", "page_id", "bytes", "digest"), F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "rid")
    firsts = facts.filter(F.col("bytes") >= LEAST).groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")
    # The groups are written before facts join them: both sides are then plain exchanges, whose hot partitions adaptive execution can split.
    again = facts.join(scratch(firsts, "warc-firsts"), ["digest", "bytes"]).filter(F.col("first.rid") != F.col("rid"))
    again = scratch(again.select("rid", named(F.col("first.page_id"), F.col("first.rid")).alias("refers_to")), "warc-again")
    full = rows.join(few(again), "rid", "left").withColumn("type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    full = full.select("type", named(F.col("page_id"), F.col("rid")).alias("record_id"), "uri", "digest", "bytes", F.when(F.col("type") == "response", F.col("html")).alias("html"), "refers_to")
    return scratch(full.mapInArrow(_writer(path, date), "path string, size long, records long"), "warc-archives")


class _Range:
    """Bytes of a file from a position on, read in chunks as they are asked for."""

    def __init__(self, file, size):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def bytes(self, start: int, n: int) -> bytes:
        if not self.at <= start or start + n > self.at + len(self.held):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(max(n, 4 * CHUNK))
        return self.held[start - self.at : start - self.at + n]


def _is_member(data: _Range, at: int) -> bool:
    """Whether a member whose content begins like a record starts here."""
    try:
        return zlib.decompressobj(31).decompress(data.bytes(at, 1024), 16).startswith(b"WARC/")
    except zlib.error:
        return False


def _decode(data: _Range, at: int, keep: bool = True) -> tuple[bytes, int]:
    """The content of the member at this position, and its length in the file."""
    unpack, parts, pos = zlib.decompressobj(31), [], at
    while not unpack.eof:
        chunk = data.bytes(pos, min(CHUNK, data.size - pos))
        if not chunk:
            raise zlib.error("the member is cut off")
        part = unpack.decompress(chunk)
        pos += len(chunk)
        if keep:
            parts.append(part)
    return b"".join(parts), pos - len(unpack.unused_data) - at


def _parse(block: bytes) -> tuple[dict, bytes]:
    """A record's fields, and what follows it in the member."""
    head, _, rest = block.partition(b"\r\n\r\n")
    lines = [x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]]
    fields = {k.strip().lower(): v.strip() for k, _, v in lines}
    size = fields.get("content-length", "")
    size = int(size) if size.isdecimal() else len(rest)
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    strip = lambda x: x.strip("<>") if x else None
    return {
        "type": fields.get("warc-type"), "record_id": strip(fields.get("warc-record-id")), "refers_to": strip(fields.get("warc-refers-to")), "uri": fields.get("warc-target-uri"),
        "digest": fields.get("warc-payload-digest"), "http": http.decode("utf-8", "replace") if gap else "", "payload": payload if gap else rest[:size],
    }, rest[size:].lstrip(b"\r\n")


DAMAGED = {"type": "damaged", "record_id": None, "refers_to": None, "uri": None, "digest": None, "http": "", "payload": b""}


def records_in(file, size: int, start: int, end: int):
    """(offset, fields) of the records whose members start in [start, end). A member that begins like a record and cannot be decoded to its end gives one of type `damaged`; the search for members goes on after its first byte."""
    data, at = _Range(file, size), start
    sure = start == 0
    while at < min(end, size):
        if not sure or data.bytes(at, 3) != MAGIC:
            held = data.bytes(at, min(4 * CHUNK, size - at))
            k = held.find(MAGIC)
            if k < 0:
                at += max(1, len(held) - 2)
                continue
            at += k
            if at >= end:
                return
            if not _is_member(data, at):
                at += 1
                sure = False
                continue
        try:
            block, length = _decode(data, at)
        except zlib.error:
            if _is_member(data, at):
                yield at, dict(DAMAGED)
            at += 1
            sure = False
            continue
        while block.startswith(b"WARC/"):
            fields, block = _parse(block)
            yield at, fields
        at += length
        sure = True


def _reader(batches):
    from pyarrow import fs

    names = ["path", "offset", "type", "record_id", "refers_to", "uri", "digest", "http", "payload"]
    schema = pa.schema([(n, pa.int64() if n == "offset" else pa.binary() if n == "payload" else pa.string()) for n in names])
    for b in batches:
        for path, size, start, end in zip(*(b.column(c).to_pylist() for c in ("path", "size", "start", "end"))):
            store, name = fs.FileSystem.from_uri(path)
            rows, held = [], 0
            with store.open_input_file(name) as file:
                for offset, fields in records_in(file, size, start, end):
                    rows.append({"path": path, "offset": offset} | fields)
                    held += len(fields["payload"])
                    if held > SPLIT or len(rows) >= 2_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_warc(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """The records of archives (path, size): path, offset, type, record_id, refers_to, uri, digest, http, payload.

    Tasks cut the archives into ranges; the driver holds their number only. A task reads several ranges where there are more than RANGES times as many as shuffle partitions.
    """
    n = archives.agg(F.sum(F.ceil(F.col("size") / split))).first()[0] or 0
    tasks = max(1, min(n, max(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // RANGES)))
    ranges = archives.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + split, "size"))
    return ranges.repartition(int(tasks), "path", "start").mapInArrow(_reader, RECORDS)


def round_trip(pages: DataFrame, split: int = SPLIT) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from the archives."""
    id_type = pages.schema["page_id"].dataType
    back = read_warc(write_warc(pages, scratch_path(pages.sparkSession, "warc")), split)
    page = lambda c: F.nullif(F.regexp_extract(c, r"page:(.*):\d+$", 1), F.lit("")).cast(id_type)
    whole = F.col("type") == "response"
    return back.select(
        page("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.regexp_extract("http", r"(?i)content-length: (\d+)", 1).try_cast("long")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.regexp_extract("digest", "sha256:(.*)", 1)).alias("payload_digest"),
        F.col("type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )


ORACLE_SQL = r"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from f
"""
