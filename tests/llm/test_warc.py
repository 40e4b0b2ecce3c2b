"""WARC archives: round trips, revisits, chunk digests."""

import gzip
import hashlib

from pyspark.sql import functions as F

from nimboscale.llm import warc
from nimboscale.session import new_shared_path, table


def test_round_trip(spark):
    big, small = "déjà " * 400, "tiny"
    rows = [(1, "http://a/ b\r\n", big), (2, None, big), (9, "http://c", big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", ""),
            (None, "u", big), (8, "u", "y" * 3_000_000), (11, "u", "z" * 1000), (11, "u", "z" * 1000), (None, "n", "q" * 2000), (None, "n", "q" * 2000)]
    df = spark.createDataFrame([(i, u, h, "d", 3) for i, u, h in rows], "page_id long, url string, html string, digest string, refers_to int")
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(df, spark).collect()], key=str)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = 9 if h == big and i != 9 else None
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to else "response", to))
    assert got == sorted(want, key=str)
    assert warc.archive_pages(df.limit(0), spark).count() == 0


def test_chunks_carry_running_digests(spark):
    body = "".join(f"line {i} é\n" for i in range(5000))
    df = spark.createDataFrame([(i, "http://x", body[i:]) for i in range(3)], "page_id long, url string, html string")
    manifest = warc.write_warc(warc.plan_records(df, least=10**9), new_shared_path(spark, "warc"))
    chunks = warc.read_chunks(manifest, chunk_size=1000).cache()
    assert chunks.agg(F.max("n_bytes")).first()[0] == 1000
    for i in range(3):
        data = body[i:].encode()
        rows = sorted((r.chunk_no, r.offset, bytes(r.data), r.digest, r.is_last) for r in chunks.where(F.col("record_id") == f"<urn:page:{i}>").collect())
        assert b"".join(r[2] for r in rows) == data
        for n, (number, offset, part, digest, last) in enumerate(rows):
            assert number == n and offset == 1000 * n and last == (n == len(rows) - 1)
            assert digest == hashlib.sha1(data[: offset + len(part)]).hexdigest()
    whole = {r.record_id: bytes(r.payload) for r in warc.assemble(chunks).collect()}
    assert whole["<urn:page:2>"] == body[2:].encode()
    for r in manifest.select("path").distinct().collect():  # plain gzip tools read the files
        _, where = warc.open_store(r.path)
        assert gzip.open(where).read(8) == b"WARC/1.1"


def test_stretches_cover_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "STRETCH", 2000)
    writer = warc._Writer(new_shared_path(spark, "warc"), 1)
    for i in range(50):
        writer.put([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{i}>")], b"", memoryview(bytes(range(256)) * 4))
    done = writer.close()
    assert len(done) > 3 and sum(d[3] for d in done) == 50
    found = [h["warc-record-id"] for uri, start, length, _ in done for h, *_ in warc._chunks(warc._Stretch(uri, start, length), 100) if _[-1]]
    assert found == [f"<urn:page:{i}>" for i in range(50)]


def test_stretches_are_read_by_many_tasks(spark):
    df = spark.range(0, 64, 1, 16).select(F.col("id").alias("page_id"), F.lit("http://x").alias("url"), F.col("id").cast("string").alias("html"))
    manifest = warc.write_warc(warc.plan_records(df).repartition(16), new_shared_path(spark, "warc"))
    assert manifest.count() == 16
    tasks = warc.read_chunks(manifest).select(F.spark_partition_id().alias("p")).distinct().count()
    assert warc.read_chunks(manifest).rdd.getNumPartitions() == 16 and tasks > 8
    assert warc.read_records(manifest).where("digest_ok").count() == 64


def test_pages_table(spark, sf):
    assert warc.op1_warc_archive(spark, sf).count() == table(spark, sf, "pages").count()
