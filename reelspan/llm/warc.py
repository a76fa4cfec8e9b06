"""WARC archives: writing with deduplication and segments, reading with segment reassembly.

Writer: a page is a ``response`` record; of pages with equal payloads the one with the smallest page_id is, the
others are ``revisit`` records. A payload longer than a segment is chunk-framed and spread over the response record
and ``continuation`` records, which may lie in other archives. Every record is a gzip member of its own.

Reader: archives are parsed member by member. Whole records are decoded where they are read; segments are dealt by
their origin's record id, ordered by number, checked against the total length, and the chunk framing is decoded.
Only segments are shuffled, never whole records.

Nulls: a null html is the empty payload, a null url an absent one. Ties: rows with one page_id and equal payloads are all
responses. A null page_id is written as such and never the origin of a revisit unless all of its group are null.
An empty table gives no archives and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm import common

EOL = b"\r\n"
MANIFEST = "path string, n_records long, n_bytes long"
PARSED = "origin string, segment int, total long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, block binary"
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = 8192) -> bytes:
    """Chunked transfer framing."""
    out = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The inverse of ``chunked``; extensions and trailers are passed over, a body cut short is an error."""
    out, at = [], 0
    while True:
        end = body.index(EOL, at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != EOL:
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def http_block(payload: bytes, frame: bool) -> bytes:
    length = b"Transfer-Encoding: chunked" if frame else b"Content-Length: %d" % len(payload)
    return EOL.join((b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", length, b"", b"")) + (chunked(payload) if frame else payload)


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(EOL + EOL)
    framed = any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(EOL))
    return unchunked(body) if framed else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + block + EOL + EOL) + squeeze.flush()


def page_records(page_id: int | None, url: str | None, payload: bytes, origin: int | None, origin_url: str | None, revisit: bool, segment_bytes: int) -> Iterator[bytes]:
    """The records of a page, one after another."""
    ident, name = f"<urn:uuid:{uuid.uuid4()}>", digest(payload)
    kind = "revisit" if revisit else "response"
    target, other = (None if x is None else "".join(c for c in x if c not in "\r\n") for x in (url, origin_url))
    common_fields = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{name}"), ("X-Page-ID", page_id), ("X-Payload-Length", len(payload))]
    if revisit:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record([*common_fields, ("WARC-Profile", profile), ("WARC-Refers-To-Target-URI", other), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page", origin)], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = http_block(payload, len(payload) > segment_bytes)
    if len(block) <= segment_bytes:
        yield record([*common_fields, ("Content-Type", "application/http; msgtype=response")], block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield record([*common_fields, ("Content-Type", "application/http; msgtype=response"), ("WARC-Segment-Number", 1)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", ident), ("WARC-Segment-Number", k)]
        yield record([*own, ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)], part)


def write_archives(pages: DataFrame, folder: str, segment_bytes: int = 32_768, roll_bytes: int = 1 << 28, hot: int = 1000) -> DataFrame:
    """Write ``pages(page_id, url, html)``; returns the manifest, a row for each archive that counts."""
    spark = pages.sparkSession
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.text_of("html").alias("html"))
    keyed = own.withColumn("key", F.unhex(F.sha2("html", 256)))
    # Origins are found without the payloads, for payloads of two rows or more alone. Those of more than a thousandth of all rows
    # (fewer than 1000) are broadcast; the others' pages meet their origin by key, and then the payloads meet both by page and
    # key. A row of a frequent payload meets nothing there, so it is dealt by a number: none of the joins has a hot key.
    held = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = keyed.groupBy("key").agg(F.min(held).alias("o"), F.count("*").alias("copies")).where("copies > 1 AND o IS NOT NULL")
    first = common.staged(first.select("key", F.struct(F.col("o.page_id").alias("origin"), F.col("o.url").alias("origin_url")).alias("o"), "copies"), "warc-origins")
    many = F.col("copies") * hot > own.count()
    top = first.where(many).select("key", F.col("o").alias("top"))
    light = keyed.select("page_id", "key").join(F.broadcast(top), "key", "left_anti").join(first.where(~many).select("key", "o"), "key").distinct()
    light = light.select(F.col("page_id").alias("p"), F.col("key").alias("k"), "o")
    dealt = keyed.join(F.broadcast(top), "key", "left").withColumn("spread", F.when(F.col("top").isNotNull(), F.monotonically_increasing_id()).otherwise(F.col("page_id")))
    roles = dealt.join(light, (F.col("key") == F.col("k")) & F.col("spread").eqNullSafe(F.col("p")), "left")
    roles = roles.select("page_id", "url", F.col("html").cast("binary").alias("payload"), F.coalesce("top", "o").alias("o")).select("page_id", "url", "payload", "o.*")
    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = common.store(folder)
        out, name, n, size, done = None, "", 0, 0, []

        def shut():
            out.close()
            done.append((name, n, size))

        for b in common.sliced(batches):
            for page, url, payload, origin, other in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "origin", "origin_url")), strict=True):
                for raw in page_records(page, url, payload, origin, other, origin is not None and page != origin, segment_bytes):
                    if out is not None and size + len(raw) > roll_bytes:
                        shut()
                        out = None
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        name, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(name, compression=None)
                    out.write(raw)
                    n, size = n + 1, size + len(raw)
        if out is not None:
            shut()
        yield common.rows_batch(done, schema)

    return common.staged(roles.mapInArrow(write, MANIFEST), "warc-manifest")


def members(source, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a file, one after another, each as bytes; holds one member and a read."""
    raw, inflate, held = b"", zlib.decompressobj(31), []
    while True:
        if not raw:
            raw = source.read(step)
            if not raw:
                if held:
                    raise ValueError("an archive is cut short")
                return
        held.append(inflate.decompress(raw))
        raw = inflate.unused_data
        if inflate.eof:
            yield b"".join(held)
            inflate, held = zlib.decompressobj(31), []


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = member.partition(EOL + EOL)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("a record is cut short")
    return fields, rest[:n]


def _number(value: str | None) -> int | None:
    return None if value is None else int(value)


def _checked(fields_digest: str | None, payload: bytes) -> str:
    found = digest(payload)
    if fields_digest is not None and fields_digest != found:
        raise ValueError(f"payload digest {found} where the record names {fields_digest}")
    return found


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each page in the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = manifest.sparkSession
    count = manifest.count()
    paths = manifest.select("path").repartition(max(1, min(count, 10_000)))
    arrow = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, arrow[k]) for n, k in (x.split() for x in PARSED.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = common.store(folder)

        def rows() -> Iterator[tuple]:
            for b in common.sliced(batches):
                for path in b.column("path").to_pylist():
                    with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as source:
                        for member in members(source):
                            f, block = parse(member)
                            if f["warc-type"] not in ("response", "revisit", "continuation"):
                                continue  # warcinfo, requests and metadata are no pages
                            named = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                            kind, page = f["warc-type"], _number(f.get("x-page-id"))
                            segment = _number(f.get("warc-segment-number"))
                            if kind == "revisit":
                                yield None, None, None, page, kind, _number(f.get("x-refers-to-page")), _number(f.get("x-payload-length")), named, None
                            elif segment is None:
                                payload = http_payload(block)
                                yield None, None, None, page, kind, None, len(payload), _checked(named, payload), None
                            else:
                                yield f.get("warc-segment-origin-id", f["warc-record-id"]), segment, _number(f.get("warc-segment-total-length")), page, kind, None, None, named, block

        yield from common.in_slices(rows(), schema, 64)

    parsed = common.staged(paths.mapInArrow(read, PARSED), "warc-parsed")
    names = [x.split()[0] for x in PAGES.split(", ")]
    out = pa.schema([(n, arrow[k]) for n, k in (x.split() for x in PAGES.split(", "))])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments arrive by origin and number; one record is held at a time."""

        def rows() -> Iterator[tuple]:
            held: list[tuple] = []

            def whole() -> tuple:
                if [x[1] for x in held] != list(range(1, len(held) + 1)):
                    raise ValueError(f"segments {[x[1] for x in held]} of {held[0][0]}")
                block = b"".join(x[5] for x in held)
                if held[-1][2] != len(block):
                    raise ValueError(f"{len(block)} bytes of {held[0][0]}; its last segment names {held[-1][2]}")
                payload = http_payload(block)
                return held[0][3], len(payload), _checked(held[0][4], payload), "response", None

            for b in common.sliced(batches):
                for row in zip(*(b.column(c).to_pylist() for c in ("origin", "segment", "total", "page_id", "payload_digest", "block")), strict=True):
                    if held and held[0][0] != row[0]:
                        yield whole()
                        held = []
                    held.append(row)
            if held:
                yield whole()

        yield from common.in_slices(rows(), out)

    whole = parsed.where("origin is null").select(*names)
    segments = parsed.where("origin is not null").repartition(common.partitions(spark), "origin").sortWithinPartitions("origin", "segment")
    return whole.unionByName(segments.mapInArrow(join, PAGES))


def archive(pages: DataFrame, hot: int = 1000) -> DataFrame:
    """Write the archives of ``pages`` and read them back. A payload of more than 1/``hot`` of all rows is a frequent one."""
    folder = common.shared_dir(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, hot=hot), folder)
