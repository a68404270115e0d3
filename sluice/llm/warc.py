"""WARC archives with revisit records.

Headers only (page id, payload digest, length) are shuffled by payload digest; the
payload itself moves at most once, to its record. Archives are written by Spark's
text sink: a WARC record is a header block, an empty line, a content block and two
line ends, so two line ends are the sink's separator and every part file is one
gzip member. Headers are fresh: ids, the date of writing, block and payload digests.
The reader streams a part file record by record and checks payloads and blocks.

Defined results: a null payload is an empty one. A null page_id is written without
its id, as a response that nothing refers to. A null url has no target line; line
ends in it are percent-encoded. Rows that repeat page id and payload get the same
record id and type. An empty table gives empty archives and no records. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, scratch, table

END = "\r\n\r\n"
RECORDS = "page_id long, record_id string, record_type string, refers_to_record string, target_uri string, payload_digest string, payload_bytes long, payload binary"


def record_id(page_id: Column, digest: Column) -> Column:
    h = F.sha2(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("-")), digest), 256)
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def resolve_revisits(headers: DataFrame, min_payload: int = 100) -> DataFrame:
    """(page_id, digest, first): the pages whose payload another page with a smaller id holds.

    headers: page_id, digest, n_bytes. The digest shuffle carries no payload, and
    the smallest id is found with a map-side combine, so a digest that a third of
    all pages share costs one row for each task. The join back is a plain equi-join
    of narrow rows, which adaptive execution splits where a digest is hot.
    """
    large = headers.where((F.col("n_bytes") >= min_payload) & F.col("page_id").isNotNull()).select("page_id", "digest")
    shared = (
        large.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .where(F.col("first") < F.col("last")).select("digest", "first")
    )
    return large.join(shared, "digest").where(F.col("page_id") > F.col("first")).select("page_id", "digest", "first").distinct()


def write_archives(pages: DataFrame, path: str, min_payload: int = 100, date: str | None = None) -> None:
    """Write one record for each page (page_id, url, html) under path; date: of the records, by default now."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages = pages.select(
        F.col("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"),
        F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"),
        F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("n_bytes"),
    )
    revisits = resolve_revisits(pages.select("page_id", "digest", "n_bytes"), min_payload)
    r = revisits.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "first")
    rows = pages.join(r, (F.col("page_id") == F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left")
    again = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), F.sha2(block.cast("binary"), 256)),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("first"), F.col("digest")))),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    rows.select(F.concat(head, F.lit(END), block).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records_of(chunks: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content block) of each record.

    chunks: (file, bytes up to the next two line ends). Only Content-Length says
    where a block ends, so blocks may hold empty lines of their own.
    """
    end = END.encode()
    at, fields, need, parts, have = None, None, 0, [], 0

    def finish(last: bool) -> Iterator[tuple[dict[str, str], bytes]]:
        nonlocal fields, need, parts, have
        while fields is not None and have + len(end) * last >= need:
            stream = end.join(parts) + end * last
            yield fields, stream[:need]
            rest = stream[need:].lstrip(b"\r\n")
            fields, parts, have = None, [], 0
            if rest:
                fields = _fields(rest)
                need = int(fields["content-length"])
        if last and fields is not None:
            raise ValueError(f"truncated record in {at}")

    for file, chunk in chunks:
        if file != at:
            yield from finish(True)
            at, fields, parts, have = file, None, [], 0
        if fields is None:
            if head := chunk.lstrip(b"\r\n"):
                fields, parts, have = _fields(head), [], 0
                need = int(fields["content-length"])
            continue
        have += len(chunk) + len(end) * bool(parts)
        parts.append(chunk)
        yield from finish(False)
    yield from finish(True)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records under path, payloads checked against their digests.

    Compressed part files are not split, so each is read in order by one task; the
    writer's partitions bound their size, and only one record is held at a time.
    """
    raw = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    schema = pa.schema([("page_id", pa.int64()), *((k, pa.string()) for k in ("record_id", "record_type", "refers_to_record", "target_uri", "payload_digest")), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                files, values = batch.column("file"), batch.column("value")
                for k in range(batch.num_rows):
                    yield files[k].as_py(), values[k].as_py()

        out, size = [], 0
        for fields, block in records_of(chunks()):
            kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
            payload = block[block.index(END.encode()) + len(END) :] if kind == "response" else None
            if hashlib.sha256(block).hexdigest() != fields["warc-block-digest"].removeprefix("sha256:"):
                raise ValueError(f"block of {fields['warc-record-id']} does not fit its digest")
            if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload of {fields['warc-record-id']} does not fit its digest")
            out.append({
                "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None, "record_id": fields["warc-record-id"], "record_type": kind,
                "refers_to_record": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"), "payload_digest": digest,
                "payload_bytes": None if payload is None else len(payload), "payload": payload if with_payload else None,
            })
            size += len(payload or b"") * with_payload + 200
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return raw.mapInArrow(parse, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Join revisit records to the responses that they refer to."""
    own = records.where(F.col("record_type") != "revisit").withColumn("refers_to", F.lit(None).cast("long"))
    first = own.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("first_page"), F.col("payload_bytes").alias("first_bytes")).distinct()
    again = records.where(F.col("record_type") == "revisit").join(first, "refers_to_record", "left")
    again = again.withColumn("payload_bytes", F.col("first_bytes")).withColumn("refers_to", F.col("first_page"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    return own.select(*names).unionByName(again.select(*names))


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as archives, read them back and resolve the revisits."""
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = save(read_archives(spark, path, with_payload=False).drop("payload"), "records")
    return resolved(records).drop("target_uri")


OP1_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
     f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first < p.page_id AND p.payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < p.page_id AND p.payload_bytes >= 100 THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
