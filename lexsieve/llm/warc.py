"""WARC archives in Zstandard: one frame for each record, with an optional dictionary in a leading skippable frame.

Reader: if an archive begins with a skippable frame of magic number 0x184D2A5D its content, itself a Zstandard frame or
plain, is the dictionary; other skippable frames are passed over.  Every further frame is decoded by itself and must
hold one record: a WARC/1.0 or WARC/1.1 line, header lines, an empty line, Content-Length bytes and two line ends.

A frame's length follows from its block headers, so that each frame is cut out and decoded by itself, and time is in
proportion to size.  Archives in files that workers can open are read frame by frame, of any size; those of other file
systems come whole, in one row, through the binaryFile source (2 GB at most).

A bad record does not end its archive: it is reported with `error` set and reading goes on at the next frame.  If block
headers don't make sense reading goes on at the next frame that begins like a record's; what lies before is one error.

Defined results: null or empty content gives no rows; an archive of only a dictionary gives none; records of any length
are decoded whole; repeated archives give repeated records; missing headers are null; null html is an empty body and a
null url a record without target; an empty table gives no archives; of a header that occurs twice the first counts;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table, written

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
RECORD = "path string, record int, offset bigint, length bigint, type string, record_id string, target_uri string, date string, content_length bigint, content binary, error string"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: An archive that the writer makes holds about this many bytes of records; its dictionary at most DICTIONARY_BYTES.
ARCHIVE_BYTES, DICTIONARY_BYTES = 8 << 20, 16 << 10


class _Bytes:
    """Ranges of an archive: of a buffer, or of an open file of which a window is held."""

    WINDOW = 4 << 20

    def __init__(self, source):
        self.file = source if hasattr(source, "seek") else None
        if self.file:
            self.size, self.at, self.held = self.file.seek(0, 2), 0, memoryview(b"")
        else:
            self.held = memoryview(source).cast("B")
            self.size, self.at = len(self.held), 0

    def get(self, start: int, end: int) -> memoryview:
        """Bytes start .. end, fewer at the archive's end."""
        end = min(end, self.size)
        if self.file and not (self.at <= start and end <= self.at + len(self.held)):
            self.file.seek(start)
            self.at, self.held = start, memoryview(self.file.read(max(end - start, self.WINDOW)))
        return self.held[start - self.at : max(end, start) - self.at]

    def number(self, start: int, size: int) -> int:
        raw = self.get(start, start + size)
        if len(raw) < size:
            raise ValueError("cut off")
        return int.from_bytes(raw, "little")

    def find(self, what: bytes, start: int) -> int:
        """Where `what` next occurs, the archive's end if nowhere."""
        while start < self.size:
            part = bytes(self.get(start, start + self.WINDOW))
            if (k := part.find(what)) >= 0:
                return start + k
            start += max(1, len(part) - len(what) + 1)
        return self.size


def _dictionary(data: _Bytes) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """(dictionary, offset of what follows)."""
    if data.size >= 8 and data.number(0, 4) == DICTIONARY_MAGIC:
        size = data.number(4, 4)
        if 8 + size > data.size:
            raise ValueError("the dictionary frame is cut off")
        raw = bytes(data.get(8, 8 + size))
        if raw[:4] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        return zstandard.ZstdCompressionDict(raw), 8 + size
    return None, 0


def frame_length(data: _Bytes, at: int) -> int:
    """Bytes of the frame at an offset, from its header and the headers of its blocks (RFC 8878, 3.1.1)."""
    if data.get(at, at + 4) != FRAME_MAGIC:
        raise ValueError("no frame")
    kind = data.number(at + 4, 1)
    single = kind >> 5 & 1
    end = at + 5 + (not single) + (0, 1, 2, 4)[kind & 3] + ((single, 2, 4, 8)[kind >> 6])
    while True:
        block = data.number(end, 3)
        if block >> 1 & 3 == 3:
            raise ValueError("a reserved block type")
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    end += 4 * (kind >> 2 & 1)
    if end > data.size:
        raise ValueError("cut off")
    return end - at


def _frames(source) -> Iterator[tuple[int, int, bytes | None, str | None]]:
    """(offset, length, content, error) of each frame of a buffer or open file."""
    data = _Bytes(source)
    try:
        dictionary, at = _dictionary(data)
    except (ValueError, zstandard.ZstdError) as e:
        yield 0, data.size, None, f"dictionary: {e}"
        return
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()

    def decoded(start: int, size: int) -> bytes:
        one = decoder.decompressobj()
        content = one.decompress(data.get(start, start + size))
        if not one.eof:
            raise ValueError("cut off")
        return content

    while at < data.size:
        if data.size - at >= 8 and data.number(at, 4) & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + data.number(at + 4, 4)
            if at > data.size:
                yield at, 0, None, "a skippable frame is cut off"
            continue
        try:
            size = frame_length(data, at)
            content = decoded(at, size)
        except (ValueError, zstandard.ZstdError) as e:
            resume = data.find(FRAME_MAGIC, at + 1)
            while resume < data.size:  # the next frame that holds a record
                try:
                    if decoded(resume, frame_length(data, resume)).startswith(b"WARC/"):
                        break
                except (ValueError, zstandard.ZstdError):
                    pass
                resume = data.find(FRAME_MAGIC, resume + 1)
            yield at, resume - at, None, f"frame: {e}"
            at = resume
            continue
        yield at, size, content, None
        at += size


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes | None, str | None]:
    """(headers by lower-case name, content, error) of one record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        return {}, None, "no end of the headers"
    lines = head.split(b"\r\n")
    if lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        return {}, None, "no WARC version line"
    headers: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and last:  # a continued line
            headers[last] += " " + line.strip().decode(errors="replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return headers, None, "a header line without a name"
        last = name.strip().lower().decode(errors="replace")
        headers.setdefault(last, value.strip().decode(errors="replace"))
    missing = [x for x in REQUIRED if x not in headers]
    if missing:
        return headers, None, f"no {missing[0]}"
    if not (headers["content-length"].isascii() and headers["content-length"].isdigit()):
        return headers, None, "content-length isn't a number"
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        return headers, None, f"content-length is {size}, the record has {len(rest) - 4}"
    content = rest[:size]
    digest = headers.get("warc-payload-digest" if headers["warc-type"] == "resource" else "warc-block-digest", "")
    if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(content).hexdigest():
        return headers, None, "the digest differs"
    return headers, content, None


_SCHEMA = pa.schema([("path", pa.string()), ("record", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), *((c, pa.string()) for c in ("type", "record_id", "target_uri", "date")), ("content_length", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
#: Content of the records that leave a worker at once.
BATCH_BYTES = 1 << 20


def _records(path: str | None, source) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for k, (at, length, raw, error) in enumerate(_frames(source)):
        h, body = {}, None
        if error is None:
            h, body, error = parse_record(raw)
        number = h.get("content-length", "")
        rows.append((path, k, at, length, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), int(number) if number.isascii() and number.isdigit() and len(number) < 19 else None, body, error))
        size += len(body or b"")
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0), b.column(1)):
            if content.is_valid:
                yield from _records(path.as_py(), content.as_buffer())


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column(0).to_pylist():
            with open(re.sub("^file:/+", "/", path), "rb") as f:
                yield from _records(path, f)


def read_archives(files: DataFrame) -> DataFrame:
    """files(path, content), as of the binaryFile source -> a row for each record, in RECORD's columns."""
    return files.select("path", "content").mapInArrow(_read, RECORD)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the .warc.zst files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", True).load(path)
    scheme = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme()
    return files.select("path").mapInArrow(_open, RECORD) if scheme == "file" else read_archives(files)


def frame_record(record_id: str, uri: str | None, date: str, content: bytes, kind: str = "resource") -> bytes:
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + record_id.encode(), b"WARC-Date: " + date.encode()]
    if uri is not None:
        head.append(b"WARC-Target-URI: " + uri.encode())
    head += [b"WARC-Payload-Digest: sha256:" + hashlib.sha256(content).hexdigest().encode(), b"Content-Type: text/html", b"Content-Length: %d" % len(content)]
    return b"\r\n".join(head) + b"\r\n\r\n" + content + b"\r\n\r\n"


def write_archive(records: list[bytes], level: int = 3) -> bytes:
    """An archive: a dictionary trained on about 200 of the records (where they suffice), then a frame for each."""
    out, dictionary = [], None
    sample = records[:: max(1, len(records) // 200)]
    size = min(DICTIONARY_BYTES, sum(map(len, sample)) // 10)
    if size >= 1024 and len(sample) >= 16:
        try:
            dictionary = zstandard.train_dictionary(size, sample)
        except zstandard.ZstdError:  # records that share too little
            dictionary = None
    if dictionary:
        raw = zstandard.ZstdCompressor(level).compress(dictionary.as_bytes())
        out.append(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
    encoder = zstandard.ZstdCompressor(level, dict_data=dictionary) if dictionary else zstandard.ZstdCompressor(level)
    out += [encoder.compress(r) for r in records]
    return b"".join(out)


def pages_to_archives(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> (path, content): archives of about ARCHIVE_BYTES.  Null html counts as empty."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for page, url, html in zip(b.column(0), b.column(1), b.column(2)):
                body = html.as_buffer().to_pybytes() if html.is_valid else b""
                rows.append(frame_record(f"<urn:page:{page.as_py()}>", url.as_py(), "2024-01-01T00:00:00Z", body))
                size += len(rows[-1])
                if size >= ARCHIVE_BYTES:
                    yield whole(rows)
                    rows, size = [], 0
        if rows:
            yield whole(rows)

    def whole(rows: list[bytes]) -> pa.RecordBatch:
        content = write_archive(rows)
        return pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha256(content).hexdigest()[:16]}.warc.zst"]), pa.array([content], pa.binary())], ["path", "content"])

    return pages.select("page_id", "url", "html").mapInArrow(pack, "path string, content binary")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as archives in the shared folder and read back; one row for each record."""
    archives = written(pages_to_archives(table(spark, sf_dir, "pages")), "archives")
    r = read_archives(archives)
    page = F.regexp_extract("record_id", "page:([0-9]+)", 1).cast("bigint").alias("page_id")
    return r.select(page, F.col("target_uri").alias("url"), F.col("type").alias("record_type"), "content_length", F.col("content").cast("string").alias("html"), "error")


ORACLE = "SELECT page_id, url, 'resource' AS record_type, strlen(html)::BIGINT AS content_length, html, NULL::VARCHAR AS error FROM pages"
