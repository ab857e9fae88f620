"""WARC archives in which a payload is written once and its repeats are revisit records."""

from __future__ import annotations

import hashlib
import zlib
from base64 import b32encode
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm.tables import join_counted, new_path, stored

_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32, _RADIX32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RECORDS = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 as 32 base32 digits: 5 hex digits at a time are 4 digits of radix 32, whose letters are then exchanged."""
    digest = F.sha1(payload)
    fours = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fours), _RADIX32, _BASE32)


def _urn(page: Column, nth: Column) -> Column:
    """A record's name: no other has its page, payload and number among the rows that repeat both."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), F.col("payload_digest"), F.lit(":"), nth.cast("string"), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value. A value can't break the line."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit(_END)), F.lit(""))


def _meeting() -> Column:
    """One column for page and payload, never null, so that a join and a window over it share a shuffle."""
    return F.concat_ws("|", "payload_digest", F.col("page_id").cast("string")).alias("meeting")


def resolve(pages: DataFrame, min_bytes: int = 0, per_file: int = 128 << 20) -> DataFrame:
    """pages (page_id, url, payload) with payload_bytes, payload_digest, nth, revisit, refers_to and refers_to_url, which are
    null for responses. Only headers are shuffled by digest; payloads move once, by page and digest, to meet the decision,
    in as many partitions as hold about per_file bytes each."""
    sized = pages.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    headers = stored(sized.select("page_id", "url", "payload_digest", "payload_bytes"), "warc-headers")
    total = headers.agg(F.sum("payload_bytes")).first()[0] or 0
    parts = max(-(-total // per_file), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = headers.withColumn("key", F.concat_ws("|", "payload_digest", "payload_bytes"))
    ordered = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    first = keyed.where(F.col("payload_bytes") >= min_bytes).groupBy("key").agg(F.min(ordered).alias("first"), F.count(F.lit(1)).alias("n"))
    # only groups of two or more need to meet their original, once per page
    repeats = stored(first.where("n > 1").select("key", F.col("first.page_id").alias("origin"), F.col("first.url").alias("origin_url"), "n"), "warc-repeats")
    links = join_counted(keyed, repeats, "key").select(
        _meeting(), F.col("page_id").alias("page"), F.col("payload_digest").alias("digest"), "origin", "origin_url"
    ).distinct()
    joined = sized.withColumn("meeting", _meeting()).repartition(parts, "meeting").join(links, "meeting", "left")
    same = Window.partitionBy("meeting").orderBy("url")  # dealt as the join has dealt them
    twin = joined.withColumn("nth", F.row_number().over(same))
    first_one = F.col("page").eqNullSafe(F.col("origin")) & (F.col("nth") == 1)
    revisit = F.col("digest").isNotNull() & ~first_one
    return twin.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", "nth", revisit.alias("revisit"),
        F.when(revisit, F.col("origin")).alias("refers_to"), F.when(revisit, F.col("origin_url")).alias("refers_to_url"),
    )


def records(resolved: DataFrame, date: str | None = None) -> DataFrame:
    """Each row's record as bytes. date (by default the time of the call) is that of all records."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(_END + _END),
    )
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, "payload"))
    kind = F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))
    head = F.concat(
        F.lit("WARC/1.1" + _END),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", _urn(F.col("page_id"), F.col("nth"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(
            F.col("revisit"),
            F.concat(
                _field("WARC-Profile", F.lit(_PROFILE)),
                _field("WARC-Refers-To", _urn(F.col("refers_to"), F.lit(1))),
                _field("WARC-Refers-To-Target-URI", F.col("refers_to_url")),
                _field("WARC-Refers-To-Date", F.lit(date)),
            ),
        ).otherwise(F.lit("")),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_END),
    )
    return resolved.select(F.concat(head, block, F.lit(_END * 2)).cast("binary").alias("record"))


#: Of an empty gzip member, which any member may be followed by.
_EMPTY = zlib.compress(b"", wbits=31)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A gzip member for each record, without its last byte. That is the highest one of the record's length, so 0 below
    16 MB; a longer record is followed by an empty member, which ends with 0 too."""
    for batch in batches:
        for row in batch.column(0):
            member = zlib.compress(row.as_buffer(), wbits=31)
            member += b"" if member[-1] == 0 else _EMPTY
            yield pa.RecordBatch.from_arrays([pa.array([member[:-1]], pa.binary())], ["member"])


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 20_000, bytes_per_file: int = 128 << 20) -> None:
    """Writes one record per row of pages (page_id, url, payload string) under path, as WARC files of at most
    records_per_file records and about bytes_per_file payload bytes, each record a gzip member of its own, so that readers
    can seek to it."""
    members = records(resolve(pages, min_bytes, bytes_per_file)).mapInArrow(_members, "member binary")
    # the text writer takes any bytes for a string, and ends each row with lineSep, which is a member's last byte
    members.select(F.col("member").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path)


def _page(urn: bytes | None) -> int | None:
    digits = (urn or b"").removeprefix(b"<urn:page:").partition(b":")[0]
    return int(digits) if digits else None


def _unpacked(data: bytes) -> Iterator[bytes]:
    """The members of a gzip file, one at a time."""
    at = 0
    while at < len(data):
        step, out = 1 << 20, []
        member = zlib.decompressobj(wbits=31)
        while not member.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            out.append(member.decompress(data[at : at + step]))
            at += step
        at -= len(member.unused_data) + max(0, at - len(data))
        yield b"".join(out)


def _records_of(data: bytes) -> Iterator[tuple]:
    """Follows Content-Length from record to record, whatever a payload holds."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *fields = data[at:stop].split(b"\r\n")
        if not version.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at byte {at}: {version[:40]!r}")
        head = dict(f.split(b": ", 1) for f in fields)
        begin = stop + 4
        end = begin + int(head[b"Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} isn't closed at its Content-Length")
        body = data.index(b"\r\n\r\n", begin, end) + 4
        http = dict(f.split(b": ", 1) for f in data[begin : body - 4].split(b"\r\n")[1:])
        digest = head[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
        kind, size, payload = head[b"WARC-Type"].decode(), int(http[b"Content-Length"]), None
        if kind == "response":
            payload = data[body:end]
            if len(payload) != size or b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"the payload of {head[b'WARC-Record-ID']!r} doesn't match its digest")
        yield _page(head.get(b"WARC-Record-ID")), kind, size, digest, _page(head.get(b"WARC-Refers-To")), payload
        at = end + 4


def _parse(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [f.split()[0] for f in RECORDS.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                found, held = [], 0
                for row in (r for member in _unpacked(batch.column(0)[i].as_py()) for r in _records_of(member)):
                    found.append(row if with_payload else (*row[:5], None))
                    held += len(row[5] or b"") if with_payload else 0
                    if len(found) == 2000 or held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)
                        found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under path. A response's payload is checked against its digest. Each archive is read
    by one task, which unpacks a record at a time, so write_archives' bytes_per_file bounds a task's memory."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_parse(payloads), RECORDS)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and returns what their records say: page_id, payload_bytes,
    payload_digest, record_type, refers_to.

    A null html is an empty payload. Of records with equal payloads of at least min_bytes, that with the smallest id is
    the response and the rest revisit it; null ids come last. Of rows that repeat that id, one is the response. Other
    columns are ignored. An empty table gives no rows.
    """
    path = new_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(html_col), F.lit(""))
    write_archives(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")), path, min_bytes)
    return read_archives(pages.sparkSession, path, payloads=False).drop("payload")
