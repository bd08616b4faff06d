"""WARC archives in Zstandard with a shared dictionary: writing, and reading back with validation.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; every record is a frame of its own,
compressed with it, so one record can be read without the others. A payload that occurs again is a ``revisit`` record that
names the response it equals.

Equal payloads are found by SHA-256 in Spark before anything is written; a task then writes the records it has as one
archive, named after its attempt, and reports it in a manifest. Archives of lost attempts are never read. Payloads are
never shuffled by digest: only ids and digests are, and what they decide meets the pages by id and digest, so copies of
one page stay spread. The reader holds one record and some 8 MB of rows, the writer one Arrow batch of pages.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame

from stationweave.llm._common import prepare, scratch, uri_of, width, written

# Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

# Payloads from this size on are written once; the size of the dictionary and the payload bytes it is trained on at most.
LEAST_SHARED = 100
DICTIONARY_BYTES = 64 << 10
TRAINING_ROWS = 512
TRAINING_BYTES = 16 << 10
READ_BYTES = 1 << 20

MANIFEST = "file string, records long, bytes long"


def train_dictionary(pages: DataFrame, html_column: str = "html") -> bytes:
    """A dictionary from the heads of at most ``TRAINING_ROWS`` pages, chosen by a hash of the page.

    Only a dictionary may come from a sample; every page is archived whole. Too little text gives an empty dictionary.
    """
    heads = (pages.where(F.length(html_column) > 0).select(F.substring(html_column, 1, TRAINING_BYTES).alias("h"))
             .orderBy(F.xxhash64("h"), "h").limit(TRAINING_ROWS).toArrow().column("h").to_pylist())
    samples = [h.encode("utf-8", "surrogatepass") for h in heads]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def records(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``_id, _url, _payload, _bytes, _digest, _refers``: what each row is archived as.

    Of rows with equal payloads of at least ``LEAST_SHARED`` bytes the one with the smallest id is the response and the
    others revisit it. Rows that repeat that smallest id are all responses; rows without an id refer to it like others,
    and are responses where no row of the group has an id. Null html is an empty payload.
    """
    payload = F.encode(F.coalesce(F.col(html_column), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_column).alias("_id"), F.col(url_column).alias("_url"), payload.alias("_payload"))
    sized = rows.withColumns({"_bytes": F.octet_length("_payload").cast("long"), "_digest": F.sha2("_payload", 256)})
    first = (sized.where(F.col("_bytes") >= LEAST_SHARED).groupBy("_digest").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_times")).where("_times > 1").select("_digest", "_first"))
    narrow = sized.where(F.col("_bytes") >= LEAST_SHARED).select("_id", "_digest")
    revisits = written(narrow.join(first, "_digest").where(~F.col("_id").eqNullSafe(F.col("_first"))).distinct()
                       .select(F.col("_id").alias("_of"), F.col("_digest").alias("_same"), F.col("_first").alias("_refers")),
                       "warc-revisits")
    met = sized["_id"].eqNullSafe(revisits["_of"]) & (sized["_digest"] == revisits["_same"])
    return sized.join(revisits, met, "left").select("_id", "_url", "_payload", "_bytes", "_digest", "_refers")


def record_id(page: object) -> str:
    return f"<urn:page:{page}>" if page is not None else f"<urn:uuid:{uuid.uuid4()}>"


def record_bytes(page: object, url: str | None, payload: bytes, digest: str, refers: object) -> bytes:
    """One whole WARC record."""
    body = b"" if refers is not None else payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers is not None else 'response'}", f"WARC-Record-ID: {record_id(page)}",
             "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers is not None:
        lines += [f"WARC-Refers-To: {record_id(refers)}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(HTTP_HEAD) + len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + HTTP_HEAD + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and HTTP payload of a record; raises ValueError where the record is not well formed."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        raise ValueError("a record must start with its WARC version and end its headers with an empty line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"not a header: {line!r}")
        headers[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(headers)
    if missing:
        raise ValueError(f"missing headers: {sorted(missing)}")
    if not headers["content-length"].isdigit() or int(headers["content-length"]) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block is not as long as Content-Length says")
    http, mark, payload = rest[:-4].partition(b"\r\n\r\n")
    if not mark or not http.startswith(b"HTTP/"):
        raise ValueError("the block is not an HTTP response")
    if headers["warc-type"] == "response":
        if (length := headers.get("x-payload-length")) is not None and int(length) != len(payload):
            raise ValueError("the payload is not as long as its header says")
        if (digest := headers.get("warc-payload-digest", "")).startswith("sha256:") \
                and hashlib.sha256(payload).hexdigest() != digest[7:]:
            raise ValueError("the payload does not have the digest of its header")
    return headers, payload


class ArchiveWriter:
    """Writes one archive to a binary stream."""

    def __init__(self, stream, dictionary: bytes) -> None:
        self.stream, self.size = stream, 0
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=True)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.compressor.compress(record))


def read_archive(stream: io.RawIOBase) -> Iterator[bytes]:
    """The records of an archive in order, one frame each; raises ValueError where the file is cut off or damaged."""
    head = stream.read(8)
    if len(head) < 8:
        raise ValueError("the archive has no dictionary frame")
    magic, length = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    dictionary = stream.read(length)
    if len(dictionary) != length:
        raise ValueError("the dictionary is cut off")
    if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)  # the dictionary may itself be a frame
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    decompressor = zstandard.ZstdDecompressor(dict_data=known)
    pending = stream.read(READ_BYTES)
    while pending:
        frame, parts = decompressor.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(pending))
            except zstandard.ZstdError as error:
                raise ValueError(f"a frame is damaged: {error}") from error
            if frame.eof:
                pending = frame.unused_data or stream.read(READ_BYTES)
                break
            pending = stream.read(READ_BYTES)
            if not pending:
                raise ValueError("a frame is cut off")
        yield b"".join(parts)


def write_archives(pages: DataFrame, folder: str, dictionary: bytes | None = None, id_column: str = "page_id",
                   url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Archive every row of ``pages`` and return the manifest, one row per archive; an empty table gives none.

    ``folder`` is a URI that all executors reach. The manifest is a written table, so reading it again doesn't write the
    archives again. Columns other than the three are ignored.
    """
    prepare(pages.sparkSession)
    shared = train_dictionary(pages, html_column) if dictionary is None else dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, count, path = None, 0, ""
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    store, base = fs.FileSystem.from_uri(folder)
                    store.create_dir(base, recursive=True)
                    path = f"pages-{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(store.open_output_stream(f"{base}/{path}"), shared)
                writer.add(record_bytes(row["_id"], row["_url"], row["_payload"], row["_digest"], row["_refers"]))
                count += 1
        if writer is not None:
            writer.stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"]), pa.array([count], pa.int64()),
                                              pa.array([writer.size], pa.int64())], names=["file", "records", "bytes"])

    return written(records(pages, id_column, url_column, html_column).mapInArrow(run, MANIFEST), "warc-manifest")


def _page_of(urn: str | None) -> str | None:
    return urn[len("<urn:page:"):-1] if urn and urn.startswith("<urn:page:") else None


def read_archives(manifest: DataFrame) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload`` of every archived record.

    Ids come back as whole numbers; a record of a row without an id has none. A revisit has no payload of its own; its
    length and digest are those of the payload it stands for. A damaged or incomplete archive raises an error.
    """
    prepare(manifest.sparkSession)
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["file"])
                rows, held, seen = [], 0, 0
                with store.open_input_stream(path) as stream:
                    for data in read_archive(stream):
                        headers, payload = parse_record(data)
                        kind = headers["warc-type"]
                        page, refers = _page_of(headers["warc-record-id"]), _page_of(headers.get("warc-refers-to"))
                        rows.append((int(page) if page else None, headers.get("warc-target-uri"), kind,
                                     int(refers) if refers else None, int(headers["x-payload-length"]),
                                     headers["warc-payload-digest"][7:], payload if kind == "response" else None))
                        held, seen = held + len(payload), seen + 1
                        if held > 8 << 20 or len(rows) >= 1024:
                            yield _batch(rows, names)
                            rows, held = [], 0
                if seen != row["records"]:
                    raise ValueError(f"{row['file']} has {seen} records; {row['records']} were written")
                if rows:
                    yield _batch(rows, names)

    return manifest.select("file", "records").repartition(width(manifest)).mapInArrow(
        run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
             "payload binary")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def archive_table(pages: DataFrame, **options) -> DataFrame:
    """Archive ``pages`` in a fresh shared folder and read the archives back."""
    return read_archives(write_archives(pages, uri_of(scratch(pages.sparkSession, "warc")), **options))
