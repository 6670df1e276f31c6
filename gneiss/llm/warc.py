"""WARC archives: writing, normalising to one gzip member a record, reading back."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.storage import materialise, new_path

END = b"\r\n\r\n"
CHUNK = 1 << 20
_HEX32, _RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8: 5 hex digits give 4 characters."""
    hexed = F.sha1(text.cast("binary"))
    quads = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), _HEX32, _RFC32)


def _record(payload: Column, page: Column, url: Column, digest: Column, refers: Column) -> Column:
    """One record as text, without the blank lines that end it."""
    response = refers.isNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n")
    )
    block = F.concat(http, F.when(response, payload).otherwise(F.lit("")))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda of: F.concat(F.lit("<urn:page:"), of.cast("string"), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(response, F.lit("response")).otherwise(F.lit("revisit")),
        F.lit("\r\n"),
        line("WARC-Record-ID", urn(page)),
        line("WARC-Target-URI", F.regexp_replace(url, "[\\x00-\\x20]", "%20")),
        line("WARC-Refers-To", urn(refers)),
        F.when(response, F.lit("")).otherwise(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
    )


def write_monolithic(pages: DataFrame, out_dir: str, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, records_per_file: int = 20_000) -> None:
    """Write every page as a WARC record, each file one gzip stream.

    Of pages with equal payloads of at least ``least_bytes`` the one with the
    largest id is a response and the others are revisits of it.  The files come
    from Spark's own text writer: the blank lines that end a record are its line
    separator.  A null html is an empty payload.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(page_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload"), base32_sha1(payload).alias("digest"))
    same = rows.where(F.octet_length("payload") >= least_bytes).groupBy(F.col("digest").alias("of")).agg(F.max("page").alias("latest"), F.count("*").alias("c"))
    same = materialise(same.where("c > 1").select("of", "latest"), "warc-same")
    refers = F.when(F.col("page") < F.col("latest"), F.col("latest"))
    joined = rows.join(same, F.col("digest") == F.col("of"), "left")
    records = joined.select(_record(F.col("payload"), F.col("page"), F.col("url"), F.col("digest"), refers).alias("value"))
    records.write.option("compression", "gzip").option("lineSep", END.decode()).option("maxRecordsPerFile", records_per_file).text(out_dir)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


class Inflated:
    """Bytes of a gzip stream of one or more members, inflated as they are asked for."""

    def __init__(self, stream):
        self.stream, self.buffer, self.at, self.left = stream, bytearray(), 0, b""
        self.inflater = zlib.decompressobj(31)

    def _more(self) -> bool:
        raw = self.left or self.stream.read(CHUNK)
        self.left = b""
        if not raw:
            return False
        if self.inflater.eof:
            self.inflater = zlib.decompressobj(31)
        del self.buffer[: self.at]
        self.at = 0
        self.buffer += self.inflater.decompress(raw, 8 * CHUNK)
        self.left = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        """Up to and with the mark; what is left where it does not come."""
        looked = self.at
        while (found := self.buffer.find(mark, looked)) < 0:
            back = max(len(self.buffer) - self.at - len(mark) + 1, 0)
            if not self._more():
                return self.take(len(self.buffer) - self.at)
            looked = self.at + back
        return self.take(found + len(mark) - self.at)

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n and self._more():
            pass
        part = bytes(self.buffer[self.at : self.at + n])
        self.at += len(part)
        return part


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records_in(source: Inflated) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and raw bytes (with the closing blank lines) of each record."""
    while True:
        head = source.until(END)
        while head.startswith(b"\r\n"):  # stray blank lines between records
            head = head[2:] + (source.until(END) if head == b"\r\n\r\n" else b"")
        if not head:
            return
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record starts at {head[:40]!r}")
        headers = headers_of(head)
        body = source.take(int(headers["content-length"]))
        if len(body) < int(headers["content-length"]):
            raise ValueError("the archive ends inside a record")
        source.take(len(END))
        yield headers, head + body + END


_INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string())])


def _normaliser(out_dir: str, level: int):
    def normalise(batches):
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                store, path = _open(uri)
                target, folder = _open(out_dir)
                target.create_dir(folder)
                name = path.rsplit("/", 1)[1].removesuffix(".gz").removesuffix(".txt")
                attempt, rows, offset = f"{folder}/.{name}-{uuid.uuid4().hex}", [], 0
                with store.open_input_stream(path, compression=None) as raw, target.open_output_stream(f"{attempt}.warc.gz", compression=None) as out:
                    for headers, record in records_in(Inflated(raw)):
                        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = packer.compress(record) + packer.flush()
                        out.write(member)
                        rows.append((f"{out_dir}/{name}.warc.gz", offset, len(member), headers.get("warc-record-id"), headers.get("warc-type"), headers.get("warc-target-uri")))
                        offset += len(member)
                with target.open_output_stream(f"{attempt}.idx", compression=None) as out:
                    out.write("".join(f"{o} {n} {kind} {rid or '-'} {u or '-'}\n" for _, o, n, rid, kind, u in rows).encode())
                # A second attempt of the task writes the same bytes and takes the same names.
                target.move(f"{attempt}.warc.gz", f"{folder}/{name}.warc.gz")
                target.move(f"{attempt}.idx", f"{folder}/{name}.idx")
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist([dict(zip(_INDEX.names, r, strict=True)) for r in rows[at : at + 10_000]], schema=_INDEX)

    return normalise


def normalise_archives(spark: SparkSession, archives: str, out_dir: str, level: int = 6) -> DataFrame:
    """Rewrite gzip archives so that every record is its own member.

    Each archive is inflated once, as a stream: a task holds a chunk and one
    record.  Beside each rewritten archive stands a sidecar index
    (``offset length type record-id uri`` a line); the same rows are returned:
    ``(archive, offset, length, record_id, record_type, uri)``.  Files appear
    under their final names only when whole, so a task can be run again.
    Empty archives give empty ones; a truncated archive raises.
    """
    files = spark.read.format("binaryFile").load(archives).select("path")
    return materialise(files.mapInArrow(_normaliser(out_dir, level), "archive string, offset long, length long, record_id string, record_type string, uri string"), "warc-index")


_READ = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string()), ("payload", pa.binary())]
)


def _page(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn else None


def _reader(with_payload: bool):
    def read(batches):
        for batch in batches:
            rows, opened = [], (None, None)
            for place in sorted(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True)):
                archive, offset, length = place
                if opened[0] != archive:
                    store, path = _open(archive)
                    opened = archive, store.open_input_file(path)
                opened[1].seek(offset)
                record = zlib.decompress(opened[1].read(length), 31)
                head, _, body = record.partition(END)
                headers = headers_of(head + END)
                http, _, payload = body[: int(headers["content-length"])].partition(END)
                kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{archive} at {offset}: the payload does not match its digest")
                rows.append(
                    (_page(headers.get("warc-record-id")), int(headers_of(http)["content-length"]), digest, kind, _page(headers.get("warc-refers-to")), headers.get("warc-target-uri"), payload if with_payload and kind == "response" else None)
                )
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_pylist([dict(zip(_READ.names, r, strict=True)) for r in rows], schema=_READ)
                    rows = []
            yield pa.RecordBatch.from_pylist([dict(zip(_READ.names, r, strict=True)) for r in rows], schema=_READ)

    return read


def read_archives(index: DataFrame, with_payload: bool = True, stretch: int = 4 << 20) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, uri, payload)`` of indexed records.

    The index is dealt out by stretches of about ``stretch`` bytes of an
    archive; each task reads its members by offset.  Size and digest are those
    of the full payload, for revisits too; responses are checked against their
    digest.  ``payload`` is null for revisits, which have none of their own.
    """
    spark = index.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, 2)
    dealt = index.select("archive", "offset", "length").repartition(4 * parts, "archive", F.floor(F.col("offset") / stretch))
    return dealt.mapInArrow(_reader(with_payload), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, payload binary")


def through_archives(pages: DataFrame, out_dir: str | None = None, with_payload: bool = False, **options) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise these, and read them back.

    Null ids are written without a record id, are responses, and come back
    null; repeated ids are several records.  An empty table gives no records.
    """
    spark = pages.sparkSession
    out_dir = out_dir or new_path(spark, "warc")
    write_monolithic(pages, f"{out_dir}/monolithic", **options)
    return read_archives(normalise_archives(spark, f"{out_dir}/monolithic", f"{out_dir}/records"), with_payload)
