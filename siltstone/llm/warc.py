"""WARC archives of pages in Zstandard, written and read through Spark.

An archive begins with a skippable frame that holds its dictionary; every record is one frame, compressed with it.  An
archive is one row of bytes that a task builds and Spark's own committer writes as one file, to any store: the text
sink writes bytes as they are, and its line separator is here an empty skippable frame, which every reader passes over.

Records whose payloads are equal and long enough are stored once: that of the largest id is a response, others are
revisits of it.  The reader takes archives as binary files, loads the dictionary, decodes frame by frame, and checks
each record's frame, headers, lengths and payload digest.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import durable, pick

#: Fixed values of the formats: frame magics, the skippable range, the dictionary frame.
_FRAME, _SKIP, _DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
_EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload in an archive; bytes and number of records that a dictionary is trained on.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 16 << 20, 1 << 20, 16 << 10
#: Bytes of a record at most, which is what a row of Spark can hold; bytes read from a frame at a time.
MOST_RECORD, _READ = 2**31 - 1, 4 << 20
_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def record_id(page_id: int | None) -> str:
    """A urn:uuid that holds the id."""
    h = f"{(page_id or 0) & (2**64 - 1):016x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-4{h[12:15]}-8{h[15]}00-{'f' * 12 if page_id is None else '0' * 12}>"


def page_id_of(urn: str) -> int | None:
    a, b, c, d, e = urn.removeprefix("<urn:uuid:").removesuffix(">").split("-")
    if e == "f" * 12:
        return None
    value = int(a + b + c[1:] + d[1], 16)
    return value - 2**64 if value >= 2**63 else value


def record(page_id, url, payload: bytes, size: int, digest: str, refers_to, date: str) -> bytes:
    """One record; a revisit, which has no payload, where refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=';/?:@&=+$,#~!*()[]')}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], level: int = 3) -> bytes:
    """The dictionary's frame, then a frame for each record."""
    some, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        some.append(r[: SAMPLE_BYTES // 8])
        size += len(some[-1])
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, some) if len(some) >= 16 else None
    except zstandard.ZstdError:  # samples too few or too alike to train on
        trained = None
    trained = trained or zstandard.ZstdCompressionDict(b"\0" + b"".join(some)[:DICTIONARY_BYTES], zstandard.DICT_TYPE_RAWCONTENT)
    held = trained.as_bytes()
    packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", _DICTIONARY, len(held)), held, *map(packer.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, from its header and block headers."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    pos = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
    while True:
        head = int.from_bytes(data[pos : pos + 3], "little")
        if pos + 3 > len(data) or head >> 1 & 3 == 3:
            raise ValueError(f"bad block header at byte {pos}")
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return pos + 4 * (flags >> 2 & 1)


def _decoded(reader: zstandard.ZstdDecompressor, frame: memoryview) -> bytes:
    """A frame's content, whether or not the frame states its size, up to MOST_RECORD bytes."""
    out, size = [], 0
    with reader.stream_reader(frame) as stream:
        while part := stream.read(_READ):
            out.append(part)
            size += len(part)
            if size > MOST_RECORD:
                raise ValueError(f"a record of more than {MOST_RECORD} bytes")
    return b"".join(out)


def frames(data: memoryview):
    """The decoded records of an archive, each with its place."""
    at, reader = 0, None
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError(f"cut off at byte {at}")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == _SKIP:
            if at == 0 and magic == _DICTIONARY:
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[8 : 8 + size])))
            at += 8 + size
            continue
        if magic != _FRAME:
            raise ValueError(f"no frame at byte {at}")
        reader = reader or zstandard.ZstdDecompressor()
        end = frame_end(data, at)
        if end > len(data):
            raise ValueError(f"cut off in the frame at byte {at}")
        yield at, _decoded(reader, data[at:end])
        at = end


def _headers(head: bytes, first: bytes) -> dict[str, str]:
    start, *lines = head.split(b"\r\n")
    if not start.startswith(first):
        raise ValueError(f"begins with {start[:20]!r}")
    pairs = [line.decode().partition(":") for line in lines]
    if not all(colon for _, colon, _ in pairs):
        raise ValueError("a header without a colon")
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def parse(data: bytes) -> tuple:
    """A record's row: checks headers, both lengths, the end, and the payload's digest."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    fields = _headers(head, b"WARC/1.")
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - fields.keys()
    if missing or not mark:
        raise ValueError(f"without {sorted(missing)}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"content length {size}, but {len(rest)} bytes follow")
    inner, _, payload = rest[:size].partition(b"\r\n\r\n")
    length = int(_headers(inner, b"HTTP/1.")["content-length"])
    kind, digest = fields["warc-type"], base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response":
        if len(payload) != length or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("the payload does not match its length or digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise ValueError(f"a bad {kind} record")
    url = fields.get("warc-target-uri")
    source = page_id_of(fields["warc-refers-to"]) if kind == "revisit" else None
    return page_id_of(fields["warc-record-id"]), None if url is None else unquote(url), kind, length, digest, source, payload if kind == "response" else None


def write_archives(pages: DataFrame, path: str, min_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for each row into archives under path.

    A null html is an empty payload; a null url has no target.  Equal payloads (in length, SHA-1 and SHA-256) of at least min_bytes: the largest id's
    record is the response (all rows that repeat that id), others revisit it; where all ids are null all are responses.
    """
    rows = pick(pages, id=id_col, url=url_col, html=html_col).select(
        F.col("id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    )
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256))
    again = rows.filter(F.col("size") >= min_bytes).groupBy("digest", "size", "same").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    again = durable(again.filter("n > 1 and keep is not null").select("digest", "size", "same", "keep"))
    revisit = F.col("keep").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep"))
    told = rows.join(again, ["digest", "size", "same"], "left").select(
        "id", "url", "size", "digest", F.when(revisit, F.col("keep")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload")
    )

    def build(batches):
        held, size = [], 0

        def done():
            return pa.record_batch([pa.array([archive(held)], pa.binary())], names=["archive"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                held.append(record(row["id"], row["url"], row["payload"] or b"", row["size"], row["digest"], row["refers_to"], date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    packed = told.mapInArrow(build, "archive binary").select(F.col("archive").cast("string").alias("value"))
    packed.write.option("lineSep", _EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under path; a malformed one raises, named by file and byte.

    page_id, url, record_type, payload_bytes, payload_digest (hexadecimal SHA-1; both of the full payload, of a revisit
    too), refers_to, payload (null for revisits, or if not asked for).
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                out, size = [], 0
                for at, data in frames(memoryview(content.as_buffer())):
                    try:
                        row = parse(data)
                    except ValueError as error:
                        raise ValueError(f"{name.as_py()}, byte {at}: {error}") from error
                    out.append(row if payloads else (*row[:-1], None))
                    size += len(data)
                    if size > 4 << 20:
                        yield _batch(out)
                        out, size = [], 0
                if out:
                    yield _batch(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, _RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in _RECORD.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
