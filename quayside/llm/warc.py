"""WARC archives with revisit resolution.

Headers (digest, record id) are shuffled by payload digest, which names the first record of
each payload that repeats. That list comes to the records, every later copy of a payload
becomes a ``revisit`` record that refers to the first one, and archives are written with
fresh headers. Payloads stay where they are, unless the list is too long to be sent around. Spark's own text writer puts the archives on whatever
store the path names: a record ends with CRLF CRLF, which is the writer's line
separator, so what it writes are WARC/1.1 files (gzip members, one a file).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_path, stored

CRLF = "\r\n"
END = CRLF + CRLF
READ_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 (RFC 4648, no padding needed) of the SHA-1 of a binary column."""
    digest = F.sha1(payload)
    # 5 hexadecimal digits are 20 bits, 4 digits of base 32; conv() writes 0-9A-V.
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve_revisits(records: DataFrame, min_bytes: int = 0, most: int = 200_000) -> DataFrame:
    """Add ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``.

    ``records`` has ``record_id``, ``payload`` (string; null counts as empty) and any
    other columns but those four. Of records with equal payloads of at least
    ``min_bytes`` bytes, the one with the smallest id is ``response`` and the rest are
    ``revisit``; smaller payloads are all ``response``.

    Rows repeated with the smallest id are all ``response``. A null id never is the
    smallest; if all ids of a payload are null, its records are all ``response``. Up to
    ``most`` payloads that repeat are sent to the records; more are joined by digest.
    """
    body = F.coalesce(F.col("payload"), F.lit("")).cast("binary")
    rows = records.withColumns({"payload_bytes": F.octet_length(body).cast("long"), "payload_digest": base32_sha1(body)})
    # Headers alone are shuffled, one a payload and task, however often it is there.
    first = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("record_id").alias("_first"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1").drop("_copies")
    first = stored(first, "headers")
    first = F.broadcast(first) if first.count() <= most else first.hint("merge")
    is_revisit = (F.col("payload_bytes") >= min_bytes) & F.col("_first").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("_first"))
    return (
        rows.join(first, "payload_digest", "left")
        .withColumns({"record_type": F.when(is_revisit, "revisit").otherwise("response"), "refers_to": F.when(is_revisit, F.col("_first"))})
        .drop("_first")
    )


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _urn(identifier: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), identifier.cast("string"), F.lit(">"))


def warc_record(date: str = "2020-01-01T00:00:00Z") -> Column:
    """The WARC/1.1 record of a row of :func:`resolve_revisits`, without its end.

    A ``revisit`` has no block; ``WARC-Payload-Length`` keeps the length of the full
    payload for both kinds. Line ends in a URI become blanks.
    """
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, "").otherwise(F.coalesce(F.col("payload"), F.lit("")))
    uri = F.translate(F.col("target_uri"), "\r\n", "  ")
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        F.concat(F.lit("WARC-Type: "), F.col("record_type"), F.lit(CRLF)),
        _line("WARC-Record-ID", _urn(F.col("record_id"))),
        _line("WARC-Target-URI", uri),
        F.lit(f"WARC-Date: {date}{CRLF}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(CRLF)),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF)),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF), _line("WARC-Refers-To", _urn(F.col("refers_to"))))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8" + CRLF),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END)),
        block,
    )


def write_warc(resolved: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    """Write the records as gzip-compressed WARC files under ``path``. A reader takes a
    file's compressed bytes as a whole, so long payloads ask for fewer records a file."""
    resolved.select(warc_record().alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class _Inflated:
    """Bytes of a gzip file, in pieces, so that no archive is held inflated as a whole."""

    def __init__(self, raw: bytes, piece: int = 1 << 20):
        self.raw, self.at, self.piece = raw, 0, piece
        self.inflate, self.buffer = zlib.decompressobj(31), b""

    def _more(self) -> bool:
        if self.inflate.eof:
            if not self.inflate.unused_data and self.at >= len(self.raw):
                return False
            left, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
        else:
            left = b""
        if self.at >= len(self.raw) and not left:
            return False
        self.buffer += self.inflate.decompress(left + self.raw[self.at : self.at + self.piece])
        self.at += self.piece
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (found := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self._more():
                return None
        out, self.buffer = self.buffer[:found], self.buffer[found + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            self.buffer = b""
            if not self._more():
                raise ValueError("a WARC record is cut short")
            parts.append(self.buffer)
            have += len(self.buffer)
        whole = b"".join(parts)
        self.buffer = whole[n:]
        return whole[:n]


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of one gzip-compressed WARC file."""
    source, end = _Inflated(raw), END.encode()
    while (head := source.until(end)) is not None:
        version, *lines = head.decode("utf-8").split(CRLF)
        if version != "WARC/1.1":
            raise ValueError(f"not a WARC/1.1 record: {version[:40]!r}")
        headers = dict(line.split(": ", 1) for line in lines)
        block = source.take(int(headers["Content-Length"]))
        if source.take(len(end)) != end:
            raise ValueError("a WARC record has no end")
        yield headers, block


def _identifier(value: str | None) -> int | None:
    return int(value[len("<urn:record:") : -1]) if value else None


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of the archives under ``path``: ids, type, digest, full payload's length and,
    if asked for, the payload that the record itself carries (none in a revisit)."""
    schema = READ_SCHEMA if with_payload else T.StructType(READ_SCHEMA.fields[:-1])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(records: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*records, strict=True), kinds)], names=schema.names)

        for files in batches:
            for content in files.column(0):
                held, size = [], 0
                for h, block in parse_warc(content.as_py()):
                    row = (_identifier(h.get("WARC-Record-ID")), h.get("WARC-Target-URI"), int(h["WARC-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], _identifier(h.get("WARC-Refers-To")))
                    held.append((*row, block) if with_payload else row)
                    size += len(block)
                    if len(held) >= 4096 or size > 1 << 24:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, schema)


def records_for(longest: int, bytes_per_file: int = 1 << 29, most: int = 20_000) -> int:
    """Records a file so that even the longest payloads stay within a file's bytes, one at least."""
    return max(1, min(most, bytes_per_file // (longest + 4096)))


def archive_pages(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) under ``path`` and return what the archives
    say: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; an empty table gives no row.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    records = pages.select(F.col("page_id").cast("long").alias("record_id"), F.col("url").alias("target_uri"), F.col("html").alias("payload"))
    longest = records.agg(F.max(F.octet_length("payload"))).first()[0] or 0
    write_warc(resolve_revisits(records, min_bytes), path, records_for(longest))
    return read_warc(spark, path, with_payload=False).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
