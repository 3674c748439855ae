"""WARC archives: a writer, a normaliser of monolithic gzip files, and a reader by sidecar index.

Crawls often come as one gzip stream over a whole file, in which no record can be found without inflating all before it.
The normaliser inflates such a stream once, writes every record as a gzip member of its own, and lays a sidecar beside the
archive: a line for each record with its offset and length. All files are written by Spark's text writer and read by its
binary-file and text readers, so any file system that Spark reaches will do. The writer ends each file with one zero byte,
which gzip readers take as padding.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemark.llm.common import _Cleaned, buckets_for, cut, drop_cut, exists, join_hot, remove, scratch, session, small_batches

#: Payloads below this many bytes are never written as revisits.
LEAST_REVISIT = 100
#: Bytes of records, not compressed, after which a new archive begins; a record is never split.
ARCHIVE_BYTES = 8 << 20
#: Bytes of normalised archives that one task reads.
READ_BYTES = 32 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n"


def record(kind: str, page_id, url, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit has the HTTP head alone, which still tells the payload's length."""
    http = END.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % size, b"", b""])
    block = http + (payload if kind == "response" else b"")
    head = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), b"WARC-Date: " + DATE.encode(), f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>".encode(), b"Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}".encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + " ".join(url.split()).encode())
    if kind == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>".encode()]
    return END.join([*head, b"Content-Length: %d" % len(block), b"", b""]) + block + END + END


def split_head(raw: bytes) -> tuple[dict[str, str], int]:
    """A record's header fields by lower-case name, and where its block begins."""
    end = raw.index(END + END)
    lines = raw[:end].decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def records_of(stream: bytes, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of a gzip file of one member or many, inflated once, front to back."""
    held, at = bytearray(), 0
    inflate = zlib.decompressobj(31)
    while at < len(stream) or held:
        if at < len(stream):
            piece, at = stream[at : at + chunk], at + chunk
            while piece:
                held += inflate.decompress(piece)
                piece = b""
                if inflate.eof:
                    piece = inflate.unused_data.lstrip(b"\0")
                    inflate = zlib.decompressobj(31)
        begin = 0
        while (end := held.find(END + END, begin)) >= 0:
            fields, block = split_head(bytes(held[begin : end + 4]))
            stop = begin + block + int(fields["content-length"]) + 4
            if stop > len(held):
                break
            yield bytes(held[begin:stop])
            begin = stop
        del held[:begin]
        if at >= len(stream) and held and not begin:
            raise ValueError(f"{len(held)} bytes of a record without its end")


def _monoliths(limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, deflate, held = [], None, 0
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if deflate is None:
                    deflate, out, held = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), [], 0
                refers = None if pd.isna(r.refers_to) else int(r.refers_to)
                raw = record("response" if refers is None else "revisit", None if pd.isna(r.page_id) else int(r.page_id), r.url, (r.html or "").encode("utf-8", "replace"), int(r.size), r.digest, refers)
                out.append(deflate.compress(raw))
                held += len(raw)
                if held >= limit:
                    yield pd.DataFrame({"data": [b"".join([*out, deflate.flush()])]})
                    deflate = None
        if deflate is not None:
            yield pd.DataFrame({"data": [b"".join([*out, deflate.flush()])]})

    return run


def _normalised(limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                name, part, members, index, offset = hashlib.sha256(path.rpartition("/")[2].encode()).hexdigest()[:24], 0, [], [], 0
                for raw in records_of(content):
                    fields, _ = split_head(raw)
                    member = gzip.compress(raw, LEVEL, mtime=0)
                    if offset and offset + len(member) > limit:
                        yield _files(f"{name}-{part}", members, index)
                        part, members, index, offset = part + 1, [], [], 0
                    index.append(json.dumps({"id": fields["warc-record-id"], "offset": offset, "length": len(member), "type": fields["warc-type"]}))
                    members.append(member)
                    offset += len(member)
                yield _files(f"{name}-{part}", members, index)

    return run


def _files(name: str, members: list[bytes], index: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"kind": ["warc", "index"], "archive": [name] * 2, "data": [b"".join(members), "\n".join(index).encode()]})


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for content, index in zip(pdf["content"], pdf["sidecar"]):
            for line in bytes(index).rstrip(b"\0").split(b"\n"):
                entry = json.loads(line)
                raw = gzip.decompress(content[entry["offset"] : entry["offset"] + entry["length"]])
                fields, at = split_head(raw)
                block = raw[at : at + int(fields["content-length"])]
                http, body = split_head(block)
                digest, page = fields["warc-payload-digest"].partition(":")[2], fields["warc-record-id"][10:-1]
                if fields["warc-type"] == "response" and (hashlib.sha256(block[body:]).hexdigest() != digest or len(block) - body != int(http["content-length"])):
                    raise ValueError(f"record {page} does not hold the payload that its digest names")
                rows.append((int(page) if page else None, int(http["content-length"]), digest, fields["warc-type"], int(fields["warc-refers-to"][10:-1]) if "warc-refers-to" in fields else None))
            out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
            rows = []


def _write(df: DataFrame, path: str, *by: str) -> None:
    """Each row's bytes as a file of its own (and the zero byte at its end)."""
    out = df.withColumn("data", F.col("data").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1)
    with _Cleaned(session(df)):
        (out.partitionBy(*by) if by else out).text(path)


def write_monoliths(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write pages (page_id, url, html) as WARC files of one gzip stream each.

    Of equal payloads of at least least_revisit bytes, rows with the smallest page_id are responses and others revisits of
    it; where no id of the group is set, all are responses. A null html is an empty payload, a null url leaves its header
    out, a null page_id an empty record id. Rows repeated with the smallest id are all responses.
    """
    small_batches(session(pages))
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.sha2(html.cast("binary"), 256).alias("digest"))
    firsts = rows.where(F.col("size") >= least_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = cut(firsts, "firsts")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    marked = join_hot(rows, firsts, "digest", "n", "left").select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "size", "digest", refers)
    _write(marked.mapInPandas(_monoliths(archive_bytes), "data binary"), path)
    drop_cut(firsts)


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(path)


def normalise(spark: SparkSession, monoliths: str, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Rewrite every gzip WARC under `monoliths` as kind=warc/archive=<name> (a member for each record) and kind=index.

    A monolith is inflated piece by piece, and a new archive begins after archive_bytes of members, so what a task holds
    is one monolith as it lies there (Spark reads a file as one value: 2 GB at most) and one archive.
    """
    found = _binary(spark, monoliths).where("length > 0").select("path", "content")
    _write(found.mapInPandas(_normalised(archive_bytes), "kind string, archive string, data binary"), path, "kind", "archive")


def read_archives(spark: SparkSession, path: str, read_bytes: int = READ_BYTES) -> DataFrame:
    """One row per record, found by the sidecars: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Archives meet their sidecars in as many partitions as read_bytes of them make; a folder without archives has no rows.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if not exists(spark, f"{path}/kind=warc"):
        return spark.createDataFrame([], schema)
    named = lambda kind: _binary(spark, f"{path}/kind={kind}").withColumn("archive", F.regexp_extract("path", "archive=([^/]+)/", 1))
    warc, index = named("warc"), named("index").select("archive", F.col("content").alias("sidecar"))
    parts = buckets_for(warc.agg(F.sum("length")).first()[0] or 0, read_bytes)
    both = warc.select("archive", "content").repartition(parts, "archive").join(index.repartition(parts, "archive"), "archive")
    return both.select("content", "sidecar").mapInPandas(_read, schema)


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages to monolithic archives, normalise those, and read the result back: one row per page.

    Payloads of any length come back whole; of rows with one page_id each is a record. An empty table gives an empty one;
    columns other than page_id, url and html are not looked at.
    """
    spark = session(pages)
    one, many = scratch(spark, "monoliths"), scratch(spark, "archives")
    write_monoliths(pages, one, archive_bytes=archive_bytes)
    normalise(spark, one, many, archive_bytes)
    remove(spark, one)
    return read_archives(spark, many)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP7_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN f.first IS NULL OR f.first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first IS NULL OR f.first = page_id THEN NULL ELSE f.first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
