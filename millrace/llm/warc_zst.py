"""WARC archives in Zstandard frames with a dictionary.

Layout of an archive: a skippable frame (magic 0x184D2A5D) whose content is the dictionary, itself compressed as one
frame, then one frame for each record. The reader loads the dictionary from that leading frame, decodes frame by
frame, and checks each record: the version line, the headers, Content-Length against the block, the two line ends
after it, and the payload's digest where the record holds the payload.

Records with equal payloads (SHA-1 and length) of at least `min_revisit` bytes: the one with the smallest page_id is a
`response`, the others are `revisit` records that refer to it and hold no payload. Which is the smallest is an
aggregation by digest (partial sums first) and a join with the digests that occur more than once: a broadcast of up to
BROADCAST_DIGESTS of them, else a shuffle in which each digest's pages are dealt over SALTS tasks, so that a hot payload
does not gather its pages anywhere. Archives are removed when the driver ends.

Tasks write archives of at most `archive_bytes` into the shared folder under names of their own and return a manifest
row for each; only the archives in the manifest are read, so a task that is run again leaves no double records. The
manifest is distributed; one archive is read at a time, as a stream.

Defined results: a null html is an empty payload; a null url is written as an empty one, control characters are
percent-encoded; a null page_id is written as an empty field and read back as null (it never is the smallest); rows
that repeat the smallest page_id are all responses; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, delete_on_exit, shared_dir, stage_table

SKIPPABLE, MAGIC = 0x184D2A5D, zstandard.MAGIC_NUMBER
ARCHIVE_BYTES, DICTIONARY_BYTES, DICTIONARY_RECORDS, LEVEL = 64_000_000, 32_000, 200, 3
#: Digests (about 60 bytes each) up to which those that repeat are broadcast, and tasks that a digest's pages are dealt over beyond.
BROADCAST_DIGESTS, SALTS = 300_000, 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the first samples' bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    name = "" if page_id is None else str(page_id)
    safe = quote(url or "", safe="!#$%&'()*+,/:;=?@[]~-._")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {safe}",
        f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def arrow_uri(path: str) -> str:
    """The path as Arrow's file systems name it; Hadoop's names for the same stores differ."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return f"file://{path}"
    if scheme in ("file", "dbfs"):  # Hadoop writes file:/x as well; dbfs is mounted below /dbfs
        return "file://" + "/dbfs" * (scheme == "dbfs") + "/" + rest.lstrip("/")
    if scheme in ("s3a", "s3n"):
        return f"s3:{rest}"
    if scheme in ("wasb", "wasbs"):
        return scheme.replace("wasb", "abfs") + ":" + rest.replace(".blob.core.windows.net", ".dfs.core.windows.net", 1)
    return path


class Writer:
    """Writes archives to `folder`, a new one when `archive_bytes` are reached."""

    def __init__(self, folder: str, archive_bytes: int = ARCHIVE_BYTES):
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(arrow_uri(folder))
        self.archive_bytes, self.held, self.out, self.done = archive_bytes, [], None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.held.append(data)
            if len(self.held) >= DICTIONARY_RECORDS or sum(map(len, self.held)) > 8_000_000:
                self._open()
        else:
            self._write(data)

    def _open(self) -> None:
        dictionary = make_dictionary([x[:8192] for x in self.held])
        self.name = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
        self.out = self.fs.open_output_stream(self.name, compression=None)  # else the name's ending would have it compressed again
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
        self.out.write(SKIPPABLE.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed)
        self.size, self.records = 8 + len(packed), 0
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=True)
        held, self.held = self.held, []
        for data in held:
            self._write(data)

    def _write(self, data: bytes) -> None:
        if self.out is not None and self.records and self.size >= self.archive_bytes:
            self._close()
        if self.out is None:
            self.held.append(data)
            return
        frame = self.pack.compress(data)
        self.out.write(frame)
        self.size += len(frame)
        self.records += 1

    def _close(self) -> None:
        self.out.close()
        self.done.append((self.name, self.size, self.records))
        self.out = None

    def finish(self) -> list[tuple[str, int, int]]:
        while self.held or self.out is not None:
            if self.out is None:
                self._open()
            if not self.held and self.out is not None:
                self._close()
        return self.done


def read_frames(stream: io.BufferedIOBase, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The content of each record frame of an archive, in order."""
    buffer = stream.read(8)
    if len(buffer) < 8 or int.from_bytes(buffer[:4], "little") != SKIPPABLE:
        raise WarcError("no dictionary frame at the start")
    size = int.from_bytes(buffer[4:], "little")
    packed = stream.read(size)
    if len(packed) != size:
        raise WarcError("the dictionary frame is cut off")
    dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(packed) if packed[:4] == MAGIC_BYTES else packed
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    rest = b""
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        frame, parts = unpack.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := stream.read(chunk)):
                raise WarcError("the last frame is cut off")
            try:
                parts.append(frame.decompress(rest))
            except zstandard.ZstdError as e:
                raise WarcError(str(e)) from e
            rest = frame.unused_data
        yield b"".join(parts)


MAGIC_BYTES = MAGIC.to_bytes(4, "little")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (by lower-case name) and block of a record, validated."""
    head, split, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not split or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no record header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"not a header: {line!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the block is not of its stated length")
    return headers, rest[:-4]


def _page(name: str) -> int | None:
    if not (name.startswith("<urn:page:") and name.endswith(">")):
        raise WarcError(f"not a page's id: {name}")
    return int(name[10:-1]) if name[10:-1] else None


def page_row(data: bytes) -> tuple[int | None, str, int, str, str, int | None, bytes | None]:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) of a record."""
    headers, block = parse_record(data)
    http, split, payload = block.partition(b"\r\n\r\n")
    lengths = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not split or len(lengths) != 1:
        raise WarcError("no HTTP header")
    kind, size, stated = headers["warc-type"], int(lengths[0]), headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if len(payload) != size or digest(payload) != stated:
            raise WarcError("the payload is not the one described")
    elif kind != "revisit" or payload or "warc-refers-to" not in headers:
        raise WarcError(f"a record of kind {kind}")
    return _page(headers["warc-record-id"]), headers.get("warc-target-uri", ""), size, stated, kind, _page(headers["warc-refers-to"]) if kind == "revisit" else None, payload if kind == "response" else None


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, min_revisit: int = 0) -> DataFrame:
    """Writes a record for each row of `pages` (page_id, url, html) and returns the manifest: path, bytes, records."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    first = rows.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = cut(first.where((F.col("n") > 1) & (F.col("size") >= min_revisit) & F.col("first").isNotNull()).drop("n"))
    if first.count() <= BROADCAST_DIGESTS:
        rows = rows.join(F.broadcast(first), ["sha", "size"], "left")
    else:
        rows = rows.withColumn("salt", F.monotonically_increasing_id() % SALTS)
        rows = rows.join(first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["sha", "size", "salt"], "left")
    rows = rows.select("page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(folder, archive_bytes)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    payload = html.encode()
                    writer.add(record("response" if refers_to is None else "revisit", page_id, url, payload, digest(payload), refers_to))
        done = writer.finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*done, strict=True)], names=["path", "bytes", "records"])

    return stage_table(rows.mapInArrow(run, "path string, bytes long, records long"), "manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of every record of the manifest's archives
    (payload null for revisits; left out without `payloads`, though still validated)."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(arrow_uri(folder))
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, read = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for data in read_frames(stream):
                        rows.append(page_row(data)[: len(names)])
                        read += 1
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                if read != records:
                    raise WarcError(f"{path} has {read} records, not {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    n = max(1, min(manifest.count(), 100_000))
    return manifest.select("path", "records").repartition(n, "path").mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """The columns of query op10: written to archives in the shared folder and read back from them."""
    spark: SparkSession = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    fs, path = pyarrow.fs.FileSystem.from_uri(arrow_uri(folder))
    fs.create_dir(path)
    delete_on_exit(spark, folder)
    manifest = write_archives(pages, folder)
    return read_archives(manifest, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Query op10 in SQL: five hex digits of the SHA-1 make four base32 letters.
SQL = f"""
WITH page AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
coded AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first,
  array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda k:
    substr('{_LETTERS}', ((CAST('0x' || substr(hex, 1 + 5 * CAST(g AS INT), 5) AS BIGINT) >> (15 - 5 * CAST(k AS INT))) & 31) + 1, 1)), '')), '') AS payload_digest FROM page)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first OR first IS NULL THEN NULL ELSE first END AS refers_to
FROM coded
"""
