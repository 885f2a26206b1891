"""WARC archives in Zstandard: one frame per record behind a leading dictionary frame.

An archive is a file of frames. The first is a skippable frame of the kind that the format keeps for dictionaries;
each record follows as a frame of its own, compressed with that dictionary, so a reader can start at any frame and
one damaged record costs no other. ``write_archives`` makes them from pages, ``read_archives`` turns a folder of them
back into a row per record.

*Writing.* A row's payload digest decides which rows are equal; of equal payloads of at least ``min_bytes`` bytes the
row with the smallest page_id is a response record, the others are revisit records that name it and hold headers
only. The digest join brings one row per repeated payload to the pages, and adaptive execution splits a digest that
a third of all pages have. Tasks fill archives of ``archive_bytes`` payload bytes, train a dictionary on the records of
each (``dictionary_bytes``; none, if the records are too few to train on) and hand it over as one value. Spark's text sink
writes a value per file: with an empty skippable frame for a line end the files stay valid archives, and the
folder may be in any store Spark can write to.

*Reading.* Spark reads the files as binary values. The reader loads the dictionary, walks the frames by their block
headers, decodes one at a time (at most ``RECORD_LIMIT`` bytes) and checks the version line, the mandatory headers,
that the block is as long as Content-Length, the two line ends behind it, the block digest, and for responses the
length and the digest of the payload. What fails is a row with its reason in ``problem``; a frame cut short ends its
archive with such a row. A frame of another length than it claims, and a record that does not stand alone in its frame, are
problems too. An archive whose dictionary cannot be loaded
is one row with a problem.

Defined cases: a null payload is empty; rows that share the smallest page_id of a payload are all responses; a null
page_id is never the smallest unless all are null, then all are responses; a null url gives a record without
WARC-Target-URI; control characters and blanks in a url are percent-encoded, since a header line cannot hold them; an empty table
writes no record; columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillworks.llm.common import staged
from quillworks.session import shared_folder

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
ZSTD_FRAME = 0xFD2FB528
VERSION = "WARC/1.1"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
#: An empty skippable frame; Spark writes it behind every archive.
LINE_END = "P*M\x18\x00\x00\x00\x00"

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 32 << 10
#: Bytes of each record, and of all of an archive's records, that a dictionary is trained on.
SAMPLE_BYTES, SAMPLES_BYTES = 16 << 10, 2 << 20
#: A record that unpacks to more is refused.
RECORD_LIMIT = (1 << 31) - 1

RECORDS = (
    "archive string, at long, record_id string, record_type string, target_uri string, page_id long,"
    " payload_bytes long, payload_digest string, refers_to long, payload binary, problem string"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)


def build_record(page_id, url, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response record, or a revisit of the record ``refers_to``: then the payload stays out."""
    size, digest = len(payload), payload_digest(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block += payload if refers_to is None else b""
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", date),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", _uri(url)))
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers_to)]
    headers += [
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("Content-Type", HTTP_TYPE),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{name}: {value}\r\n" for name, value in headers)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def trained_dictionary(records: list[bytes], size: int) -> bytes | None:
    """A dictionary from the beginnings of the records, or None where they are too few."""
    samples, total = [], 0
    for record in records:
        samples.append(record[:SAMPLE_BYTES])
        total += len(samples[-1])
        if total >= SAMPLES_BYTES:
            break
    if len(samples) < 8 or total < 8 * size:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8, level=3).as_bytes()
    except zstandard.ZstdError:  # nothing in common to learn
        return None


def build_archive(records: list[bytes], dictionary_bytes: int = DICTIONARY_BYTES) -> bytes:
    trained = trained_dictionary(records, dictionary_bytes)
    parts = []
    if trained is None:
        packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
    else:
        parts.append(struct.pack("<II", DICTIONARY_FRAME, len(trained)) + trained)
        packer = zstandard.ZstdCompressor(
            level=3, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(trained)
        )
    return b"".join([*parts, *(packer.compress(record) for record in records)])


def _archives(archive_bytes: int, dictionary_bytes: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def archive() -> pa.RecordBatch:
            whole = build_archive(records, dictionary_bytes)
            return pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], names=["archive"])

        records, size = [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "revisit", "refers_to")]
            payloads = batch.column("html").cast(pa.binary())
            for page_id, url, revisit, refers_to, payload in zip(*columns, payloads, strict=True):
                payload = payload.as_py() or b""
                records.append(build_record(page_id, url, payload, _record_id(refers_to) if revisit else None, date))
                size += len(payload) + 512
                if size >= archive_bytes:
                    yield archive()
                    records, size = [], 0
        if records:
            yield archive()

    return write


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, and whether the row revisits the page ``refers_to``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = rows.withColumn("digest", F.unhex(F.sha2(payload, 256)))
    long_enough = F.octet_length(payload) >= min_bytes
    # Partial counts first, so a payload of a third of all pages is one row per task.
    groups = rows.filter(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = staged(groups.filter("n > 1").select(F.col("digest").alias("same"), "first"), "warc-repeated-payloads")
    joined = rows.join(repeated, F.col("digest") == F.col("same"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", revisit.alias("revisit"), F.col("first").alias("refers_to"))


def write_archives(
    pages: DataFrame,
    folder: str,
    min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> None:
    """Write the pages (page_id, url, html) as archives into the new ``folder``. ``date`` is that of all records."""
    rows = with_revisits(pages, min_bytes)
    archives = rows.mapInArrow(_archives(archive_bytes, dictionary_bytes, date), "archive binary")
    # The bytes go out as they are: a cast from binary to string changes none.
    text = archives.select(F.col("archive").cast("string").alias("value"))
    text.write.option("lineSep", LINE_END).option("maxRecordsPerFile", 1).text(folder)


class Damaged(ValueError):
    """What is wrong with a frame or a record."""


def frame_end(data: memoryview, begin: int) -> int:
    """Where the frame at ``begin`` ends, told by its headers."""
    try:
        if int.from_bytes(data[begin : begin + 4], "little") in SKIPPABLE:
            end = begin + 8 + struct.unpack_from("<I", data, begin + 4)[0]
        else:
            if int.from_bytes(data[begin : begin + 4], "little") != ZSTD_FRAME:
                raise Damaged("no frame")
            flags = data[begin + 4]
            single = flags >> 5 & 1
            content = (single, 2, 4, 8)[flags >> 6]
            end = begin + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + content
            last = False
            while not last:
                header = int.from_bytes(data[end : end + 3], "little")
                if end + 3 > len(data):
                    raise Damaged("frame cut short")
                last, kind, size = header & 1, header >> 1 & 3, header >> 3
                end += 3 + (1 if kind == 1 else size)
            end += 4 * (flags >> 2 & 1)
    except (IndexError, struct.error):
        raise Damaged("frame cut short") from None
    if end > len(data):
        raise Damaged("frame cut short")
    return end


def leading_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of an archive and where its records begin."""
    if int.from_bytes(data[:4], "little") != DICTIONARY_FRAME:
        return None, 0
    end = frame_end(data, 0)
    content = bytes(data[8:end])
    if int.from_bytes(content[:4], "little") == ZSTD_FRAME:  # it may be compressed itself
        content = zstandard.ZstdDecompressor().decompress(content, max_output_size=1 << 27)
    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT), end


def _unpacked(unpacker: zstandard.ZstdDecompressor, frame: memoryview) -> bytes:
    size = zstandard.frame_content_size(frame)
    if size > RECORD_LIMIT:
        raise Damaged("record too long")
    try:
        if size >= 0:
            data = unpacker.decompress(frame)
        else:  # the frame does not tell; at most the limit and a byte is unpacked
            data = unpacker.stream_reader(frame).read(RECORD_LIMIT + 1)
            if len(data) > RECORD_LIMIT:
                raise Damaged("record too long")
    except zstandard.ZstdError as error:
        raise Damaged(f"frame does not decode: {error}") from None
    if size >= 0 and len(data) != size:
        raise Damaged("frame of another length than it claims")
    return data


def _headers(head: bytes) -> dict[str, str]:
    """Header fields in lower case; a line that begins with a blank carries on the one before."""
    found: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not re.fullmatch(r"[!-9;-~]+", name):
            raise Damaged("line without a header")
        if name in found and name != "warc-concurrent-to":
            raise Damaged(f"header {name} twice")
        found[name] = value.strip()
    return found


def _length(headers: dict[str, str]) -> int:
    value = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", value):
        raise Damaged("Content-Length is no number")
    return int(value)


def _check_digest(headers: dict[str, str], name: str, data: bytes) -> None:
    algorithm, _, value = headers.get(name.lower(), "").partition(":")
    if algorithm.lower() == "sha1" and value.upper() != payload_digest(data):
        raise Damaged(f"{name} does not match")


def parse_record(data: bytes) -> dict:
    """Fields of one record; raises ``Damaged`` with the reason where it breaks the format."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1") or not blank:
        raise Damaged("no WARC version line")
    headers = _headers(lines)
    for name in MANDATORY:
        if not headers.get(name.lower()):
            raise Damaged(f"header {name} missing")
    size = _length(headers)
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise Damaged("block of another length than Content-Length")
    block = rest[:size]
    _check_digest(headers, "WARC-Block-Digest", block)
    kind = headers["warc-type"].lower()
    found = {
        "record_id": headers["warc-record-id"],
        "record_type": kind,
        "target_uri": headers.get("warc-target-uri"),
        "page_id": _page_id(headers["warc-record-id"]),
        "payload_digest": headers.get("warc-payload-digest", "").rpartition(":")[2].upper() or None,
    }
    if kind not in ("response", "revisit"):
        return found
    lines, blank, payload = block.partition(b"\r\n\r\n")
    status, _, lines = lines.partition(b"\r\n")
    if not blank or not status.startswith(b"HTTP/"):
        raise Damaged("no HTTP header")
    found["payload_bytes"] = _length(_headers(lines))
    if kind == "response":
        if found["payload_bytes"] != len(payload):
            raise Damaged("payload of another length than its Content-Length")
        _check_digest(headers, "WARC-Payload-Digest", payload)
        found["payload"] = payload
    else:
        if payload:
            raise Damaged("revisit with a payload")
        if not headers.get("warc-refers-to"):
            raise Damaged("header WARC-Refers-To missing")
        found["refers_to"] = _page_id(headers["warc-refers-to"])
    return found


def parse_archive(data: bytes) -> Iterator[tuple[int, dict]]:
    """(place, fields) of every record; a record that cannot be read has the field ``problem``."""
    view = memoryview(data)
    try:
        dictionary, at = leading_dictionary(view)
        unpacker = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    except (Damaged, zstandard.ZstdError) as error:
        yield 0, {"problem": f"dictionary: {error}"}
        return
    while at < len(view):
        try:
            end = frame_end(view, at)
        except Damaged as error:  # where the next frame begins is unknown
            yield at, {"problem": str(error)}
            return
        if int.from_bytes(view[at : at + 4], "little") not in SKIPPABLE:
            try:
                fields = parse_record(_unpacked(unpacker, view[at:end]))
            except Damaged as error:
                fields = {"problem": str(error)}
            yield at, fields
        at = end


_COLUMNS = {
    "archive": pa.string(),
    "at": pa.int64(),
    "record_id": pa.string(),
    "record_type": pa.string(),
    "target_uri": pa.string(),
    "page_id": pa.int64(),
    "payload_bytes": pa.int64(),
    "payload_digest": pa.string(),
    "refers_to": pa.int64(),
    "payload": pa.binary(),
    "problem": pa.string(),
}


def _records(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            columns = [pa.array([row.get(name) for row in rows], kind) for name, kind in _COLUMNS.items()]
            return pa.RecordBatch.from_arrays(columns, names=[*_COLUMNS])

        rows, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for at, fields in parse_archive(content.as_py()):
                    if not with_payload:
                        fields.pop("payload", None)
                    rows.append({"archive": path, "at": at, **fields})
                    size += 512 + len(fields.get("payload", b""))
                    if size >= 8 << 20:
                        yield flush()
                        rows, size = [], 0
        if rows:
            yield flush()

    return read


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives in ``folder``, and per damaged record one with its ``problem``.

    Without ``with_payload`` payloads are checked all the same, but not returned.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(_records(with_payload), RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives of the pages, written to the shared folder and read back; a damaged record is an error."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write_archives(pages, folder, min_bytes)
    records = read_archives(spark, folder, with_payload=False)
    sound = F.coalesce(F.raise_error(F.concat(F.lit("damaged record: "), "problem")), F.col("record_type"))
    checked = F.when(F.col("problem").isNotNull(), sound).otherwise(F.col("record_type"))
    return records.select("page_id", "payload_bytes", "payload_digest", checked.alias("record_type"), "refers_to")
