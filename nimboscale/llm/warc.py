"""WARC archives: written by Spark tasks, read back as a chunked record table.

Writing. Equal payloads are found by digest (computed by Spark, combined
map-side); the record of the largest id is the response, the others revisit it.
Every task appends its records to files of its own in the shared folder, a gzip
member a record, and reports them only when they are complete; the reports are
kept as a manifest table. What a lost task wrote is named in no manifest, so
retries cannot add records.

Reading. A task opens its stretch of a file and streams: headers are parsed
line by line, payloads pass in chunks of a fixed size. Each chunk is a row (file, record
number, chunk number, offset) with the digest of the record so far, so the last
chunk's row has the digest of the whole and no task ever holds a whole record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from nimboscale.session import local_path, new_shared_path, stored

CHUNK = 1 << 18
STRETCH = 64 << 20
#: Reading has a task for each stretch, up to so many tasks.
MOST_TASKS = 50_000
LEAST_REVISIT = 1000
SALTS = 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "path string, start long, length long, records long"
CHUNKS = (
    "path string, record_no long, record_id string, record_type string, target_uri string, refers_to string, "
    "stated_digest string, stated_length long, chunk_no long, offset long, n_bytes long, data binary, "
    "digest string, is_last boolean"
)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file in the shared store."""
    plain = local_path(uri)
    return (pafs.LocalFileSystem(), plain) if plain is not None else pafs.FileSystem.from_uri(uri)


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v) + "\r\n").encode("utf-8", "replace")


def _clean(value: str | None) -> str:
    """A header value: white space and control characters are percent-encoded."""
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "")


class _Writer:
    """Appends records as gzip members; starts a new stretch every STRETCH bytes."""

    def __init__(self, folder: str, level: int):
        self.fs, where = open_store(folder)
        self.fs.create_dir(where, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        self.uri, self.level = f"{folder}/{name}", level
        self.out = self.fs.open_output_stream(f"{where}/{name}", compression=None)
        self.at = self.start = self.records = 0
        self.done: list[tuple[str, int, int, int]] = []

    def put(self, fields: list[tuple[str, str]], http: bytes, payload: memoryview) -> None:
        pack = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        size = len(http) + len(payload)
        self._write(pack.compress(_header([*fields, ("Content-Length", str(size))]) + http))
        for i in range(0, len(payload), CHUNK):
            self._write(pack.compress(payload[i : i + CHUNK]))
        self._write(pack.compress(b"\r\n\r\n") + pack.flush())
        self.records += 1
        if self.at - self.start >= STRETCH:
            self.cut()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def cut(self) -> None:
        if self.records:
            self.done.append((self.uri, self.start, self.at - self.start, self.records))
        self.start, self.records = self.at, 0

    def close(self) -> list[tuple[str, int, int, int]]:
        self.cut()
        self.out.close()
        return self.done


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(id, url, payload, digest, refers_to): refers_to is the response's id for revisits, else null.

    A payload that a third of all pages share is one row a task in the digest
    aggregation; the join back is salted, so such a payload is met by ``SALTS``
    tasks at least, which adaptive execution splits further, and only repeated
    digests are in its small side.
    """
    payload = F.encode(F.coalesce(F.col(body_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    repeated = (
        rows.where(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.max("id").alias("_response"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 AND _response IS NOT NULL")
        .select(F.col("digest").alias("_digest"), "_response", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part"))
    )
    salt = F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")
    met = rows.withColumn("_salt", salt).join(repeated, (F.col("digest") == F.col("_digest")) & (F.col("_salt") == F.col("_part")), "left")
    other = F.col("id").isNull() | (F.col("id") != F.col("_response"))
    return met.select("id", "url", "payload", "digest", F.when(F.col("_response").isNotNull() & other, F.col("_response")).alias("refers_to"))


def write_warc(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Write rows of ``plan_records`` to ``folder``; returns the stored manifest (path, start, length, records).

    A stretch of a file starts at a record, so stretches are read on their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            if batch.num_rows and writer is None:
                writer = _Writer(folder, level)
            ids, urls, digests, refers = (batch.column(i) for i in (0, 1, 3, 4))
            bodies = batch.column(2)
            for i in range(batch.num_rows):
                body = memoryview(bodies[i].as_buffer())
                revisit = refers[i].is_valid
                digest = "sha1:" + base64.b32encode(bytes.fromhex(digests[i].as_py())).decode()
                fields = [
                    ("WARC-Type", "revisit" if revisit else "response"),
                    ("WARC-Record-ID", f"<urn:page:{ids[i].as_py() if ids[i].is_valid else ''}>"),
                    ("WARC-Date", date),
                    ("WARC-Target-URI", _clean(urls[i].as_py())),
                    ("WARC-Payload-Digest", digest),
                    ("Content-Type", "application/http; msgtype=response"),
                ]
                if revisit:
                    fields += [
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("WARC-Refers-To", f"<urn:page:{refers[i].as_py()}>"),
                        ("X-Payload-Length", str(len(body))),
                    ]
                writer.put(fields, HTTP, body[:0] if revisit else body)
        done = writer.close() if writer else []
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                ["path", "start", "length", "records"],
            )

    return stored(records.select("id", "url", "payload", "digest", "refers_to").mapInArrow(run, MANIFEST), "warc-manifest")


class _Stretch:
    """Streams the decompressed bytes of a stretch: lines for headers, bounded reads for blocks."""

    def __init__(self, uri: str, start: int, length: int):
        fs, where = open_store(uri)
        self.file = fs.open_input_file(where)
        self.file.seek(start)
        self.left, self.buffer, self.eof = length, b"", False
        self.unpack = zlib.decompressobj(31)
        self.raw = b""

    def _fill(self) -> bool:
        while True:
            if self.unpack.eof:
                # At a member's end unconsumed_tail may repeat what unused_data holds.
                self.raw = self.unpack.unused_data
                self.unpack = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.file.read(min(CHUNK, self.left))
                self.left -= len(self.raw)
            ended = not self.raw
            made = self.unpack.decompress(self.raw, CHUNK)
            self.raw = self.unpack.unconsumed_tail
            if made:
                self.buffer = self.buffer + made if self.buffer else made
                return True
            if ended:
                return False

    def line(self) -> bytes | None:
        while (at := self.buffer.find(b"\r\n")) < 0:
            if not self._fill():
                return None
        found, self.buffer = self.buffer[:at], self.buffer[at + 2 :]
        return found

    def read(self, most: int) -> bytes:
        if not self.buffer and not self._fill():
            return b""
        found, self.buffer = self.buffer[:most], self.buffer[most:]
        return found

    def headers(self) -> dict[str, str] | None:
        line = self.line()
        while line == b"":  # between records
            line = self.line()
        if line is None:
            return None
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        found = {}
        while line := self.line():
            name, _, value = line.partition(b":")
            found[name.decode().strip().lower()] = value.decode("utf-8", "replace").strip()
        return found


def _chunks(stretch: _Stretch, size: int) -> Iterator[tuple[dict[str, str], int, int, bytes, str, bool]]:
    """(headers, chunk number, offset, data, digest so far, last) of every record's payload."""
    while (head := stretch.headers()) is not None:
        left = int(head.get("content-length", 0))
        if head.get("content-type", "").startswith("application/http"):
            while left > 0 and (line := stretch.line()) is not None:
                left -= len(line) + 2
                if not line:
                    break
        digest, number, offset, pending = hashlib.sha1(), 0, 0, b""
        while left > 0:
            part = stretch.read(min(size - len(pending), left))
            if not part:
                raise ValueError(f"record {head.get('warc-record-id')} is cut off")
            left -= len(part)
            pending = pending + part if pending else part
            if len(pending) == size and left > 0:
                digest.update(pending)
                yield head, number, offset, pending, digest.hexdigest(), False
                number, offset, pending = number + 1, offset + len(pending), b""
        digest.update(pending)
        yield head, number, offset, pending, digest.hexdigest(), True


def _stated(head: dict[str, str]) -> str | None:
    value = head.get("warc-payload-digest", "")
    if not value.lower().startswith("sha1:"):
        return None
    value = value[5:]
    return value.lower() if len(value) == 40 else base64.b32decode(value).hex()


def read_chunks(manifest: DataFrame, chunk_size: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in ``manifest`` (path, start, length).

    One row a chunk: file, record number (from the stretch's start), header
    fields, chunk number, offset, bytes, SHA-1 of the record's payload so far,
    and whether it is the last. An empty payload is one empty chunk. A revisit's
    stated digest and length are those of the payload it refers to.
    ``with_data=False`` leaves ``data`` null where only digests are wanted.
    A broken or cut-off record raises.
    """
    names = [f.split()[0] for f in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, *[pa.int64()] * 4, pa.binary(), pa.string(), pa.bool_()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
            rows.clear()
            held = 0
            return made

        for batch in batches:
            for where in batch.to_pylist():
                stretch, record = _Stretch(where["path"], where["start"], where["length"]), -1
                for head, number, offset, data, digest, last in _chunks(stretch, chunk_size):
                    record += number == 0
                    length = head.get("x-payload-length")
                    rows.append(
                        (
                            where["path"], where["start"] + record, head.get("warc-record-id"), head.get("warc-type"),
                            head.get("warc-target-uri"), head.get("warc-refers-to"), _stated(head), int(length) if length else None,
                            number, offset, len(data), data if with_data else None, digest, last,
                        )
                    )
                    held += len(data) if with_data else 256
                    if held > 4 << 20:
                        yield flush()
                stretch.file.close()
        if rows:
            yield flush()

    # The manifest is small whatever the archives weigh: by number, or the stretches would meet in one task.
    where = manifest.select("path", "start", "length")
    return where.repartition(min(max(1, where.count()), MOST_TASKS)).mapInArrow(run, CHUNKS)


def read_records(manifest: DataFrame, chunk_size: int = CHUNK) -> DataFrame:
    """One row a record from the last chunk's running digest; ``digest_ok`` compares it with the stated one."""
    last = read_chunks(manifest, chunk_size, with_data=False).where("is_last")
    revisit = F.col("record_type") == "revisit"
    return last.select(
        "record_id",
        "record_type",
        "target_uri",
        "refers_to",
        F.when(revisit, F.col("stated_length")).otherwise(F.col("offset") + F.col("n_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        (revisit | (F.col("digest") == F.col("stated_digest"))).alias("digest_ok"),
    )


def assemble(chunks: DataFrame) -> DataFrame:
    """Whole payloads from a chunk table; for records that are known to fit a row."""
    return chunks.groupBy("path", "record_no", "record_id").agg(
        F.expr("aggregate(array_sort(collect_list(struct(chunk_no, data))), cast('' AS binary), (a, x) -> concat(a, x.data))").alias("payload")
    )


def page_id(urn):
    """The id in ``<urn:page:ID>``; null for records of pages without one."""
    return F.expr(f"try_cast(nullif(regexp_extract({urn}, '^<urn:page:(-?[0-9]*)>$', 1), '') AS bigint)")


def archive_pages(pages: DataFrame, spark: SparkSession, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write a record per page, read the archives back, and return what they say.

    Edge cases: a null body is an empty payload. Pages without an id are written
    under an id-less name and come back with a null id; they revisit a response
    that has one, and are responses among themselves. Pages that repeat the
    largest id of their payload are all responses. URLs are percent-encoded where
    a header needs it. Other columns are not archived. An empty table gives an
    empty table.
    """
    manifest = write_warc(plan_records(pages, id_col, url_col, body_col), new_shared_path(spark, "warc"))
    records = read_records(manifest)
    checked = F.when(~F.col("digest_ok"), F.raise_error(F.concat(F.lit("digest differs in "), F.col("record_id")))).otherwise(F.col("payload_digest"))
    return records.select(
        page_id("record_id").alias(id_col),
        "payload_bytes",
        checked.alias("payload_digest"),
        "record_type",
        page_id("refers_to").alias("refers_to"),
    )


def op1_warc_archive(spark, sf_dir: str) -> DataFrame:
    from nimboscale.session import table

    return archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), spark)


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
),
d AS (
  SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p
),
r AS (
  SELECT digest, max(page_id) AS response FROM d WHERE n >= 1000 GROUP BY digest HAVING count(*) > 1
)
SELECT d.page_id, d.n AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN r.response IS NOT NULL AND d.page_id <> r.response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN r.response IS NOT NULL AND d.page_id <> r.response THEN r.response END AS refers_to
FROM d LEFT JOIN r ON d.digest = r.digest
"""
