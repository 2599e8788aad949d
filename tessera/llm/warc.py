"""WARC archives: a writer with payload revisits, and a splittable reader of gzip-per-record files.

The reader deals out byte ranges. A task scans its range for the gzip magic, inflates the start of
every candidate member and keeps those whose content opens as a WARC record; it owns the records
that start in its range and reads past the range's end to finish the last one. A validated member
is followed to its end, so magic bytes inside compressed data only count where a range begins, and
there the inflated header decides.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, session, stored
from .learn import MOST_BROADCAST, spread_join

RANGE, READ, FILE_BYTES = 8 << 20, 1 << 20, 64 << 20
MAGIC = b"\x1f\x8b\x08"
# Fixed values of the WARC format.
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"

RECORDS = (
    "file string, offset long, record_id string, record_type string, target_uri string, page_id long, payload_digest string, "
    "payload_bytes long, refers_to long, headers map<string,string>, payload binary"
)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def line(value) -> str:
    return " ".join(str(value).split())


def record(page_id, url, payload: bytes, refers) -> bytes:
    """One record as a gzip member. ``refers``: the page whose response holds the payload, or None."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        ("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", line(url)) if url else None, ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Page-ID", page_id) if page_id is not None else None, ("WARC-Payload-Length", len(payload)),
    ]
    if refers is None:
        body += payload
    else:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers)), ("WARC-Refers-To-Page-ID", refers)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(body))]
    text = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode("utf-8", "replace") for k, v in filter(None, head)) + b"\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(text + body + b"\r\n\r\n") + squeeze.flush()


@frugal
def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """A task's records go to files of its own name; only finished files get their final name."""
    fs, base = opened(folder)
    prefix = folder[: -len(base)] if folder.endswith(base) else ""
    out, path, size, n, done = None, "", 0, 0, []

    def close():
        out.close()
        fs.move(path, final := path.removesuffix(".open"))
        done.append((prefix + final, size, n))

    for b in batches:
        for page_id, url, html, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
            if out is None:
                path, size, n = f"{base}/{uuid.uuid4().hex}.warc.gz.open", 0, 0
                out = fs.open_output_stream(path)
            data = record(page_id, url, (html or "").encode("utf-8", "replace"), refers)
            out.write(data)
            size, n = size + len(data), n + 1
            if size >= FILE_BYTES:
                close()
                out = None
    if out is not None:
        close()
    columns = list(zip(*done)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["file", "length", "records"])


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html of ``pages`` with refers_to: the largest page_id of an equal payload, null on that one's own rows.

    What repeats is known from digests alone: up to MOST_BROADCAST repeated payloads are broadcast, more are joined as
    (page_id, digest) rows first, so that the pages themselves are never gathered by a payload that many share.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    own = own.withColumn("sha", F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary"))))
    first = own.groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1")
    first = stored(first, "repeated")
    refers = F.expr("if(top is not null and not (page_id <=> top), top, null)").alias("refers_to")
    if first.count() <= MOST_BROADCAST:
        return own.join(F.broadcast(first), "sha", "left").select("page_id", "url", "html", refers)
    digests = stored(own.select("page_id", "sha").distinct(), "digests")
    narrow = stored(spread_join(digests, first, ["sha"], "n").select("page_id", "sha", refers).where("refers_to is not null"), "revisits")
    narrow = narrow.toDF("page", "digest", "refers_to")
    return own.join(narrow, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("sha") == F.col("digest")), "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder``; return file, length, records of the archives.

    Of rows with equal payloads (null: empty) those with the largest page_id are responses, the others
    revisit it. Rows that share that largest id are responses each; a null id is smaller than any other. No rows, no files.
    The returned table, kept in the shared folder, is the list of archives: files that a lost or repeated task left
    behind are not in it and are never read.
    """
    spark = session(pages.sparkSession)
    fs, base = opened(folder)
    fs.create_dir(base, recursive=True)
    return stored(revisits(pages).mapInArrow(lambda it: _write(it, folder), "file string, length long, records long"), "archives")


def headers(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for raw in block.split(b"\r\n")[1:]:
        text = raw.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
        elif ":" in text:
            last, value = text.split(":", 1)
            out[last] = value.strip()
    return out


class Source:
    """Random access to a file through one growing and shrinking window."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.at, self.data = handle, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if at < self.at or at + n > self.at + len(self.data):
            self.handle.seek(at)
            self.at, self.data = at, self.handle.read(max(n, READ))
        return self.data[at - self.at : at - self.at + n]


def opens(source: Source, at: int) -> bool:
    """Whether a gzip member that starts here inflates to a WARC record."""
    try:
        return zlib.decompressobj(31).decompress(source.get(at, 512), 16).startswith(b"WARC/")
    except zlib.error:
        return False


def member(source: Source, at: int) -> tuple[bytes, int]:
    """The content of the member at ``at`` and where it ends; a truncated or damaged one is an error."""
    inflate, parts, p = zlib.decompressobj(31), [], at
    while not inflate.eof:
        piece = source.get(p, 1 << 16)
        if not piece:
            raise ValueError(f"truncated gzip member at byte {at}")
        parts.append(inflate.decompress(piece))
        p += len(piece)
    return b"".join(parts), p - len(inflate.unused_data)


def records(source: Source, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of the members that start in [start, end)."""
    p = start
    while p < end:
        window = source.get(p, min(READ, end - p) + len(MAGIC) - 1)
        hit = window.find(MAGIC)
        if hit < 0:
            p += max(1, len(window) - len(MAGIC) + 1)
            continue
        p += hit
        if p >= end:
            return
        if opens(source, p):
            content, after = member(source, p)
            yield p, content
            p = after
        else:
            p += 1


def parsed(file: str, offset: int, content: bytes) -> tuple:
    head, _, rest = content.partition(b"\r\n\r\n")
    h = headers(head)
    low = {k.lower(): v for k, v in h.items()}
    block = rest[: int(low.get("content-length", len(rest)))]
    kind = low.get("warc-type")
    payload = block.partition(b"\r\n\r\n")[2] if "application/http" in low.get("content-type", "") else block
    given = low.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        payload, sha, size = None, given, low.get("warc-payload-length")
    else:
        sha, size = digest(payload), len(payload)
        if given and given != sha:
            raise ValueError(f"payload digest differs in {file} at byte {offset}")
    number = lambda k: int(low[k]) if k in low else None
    return (file, offset, low.get("warc-record-id"), kind, low.get("warc-target-uri"), number("warc-page-id"), sha, int(size) if size is not None else None, number("warc-refers-to-page-id"), h, payload)


@frugal
def _read(batches: Iterator[pd.DataFrame], payloads: bool) -> Iterator[pd.DataFrame]:
    names = [c.strip().split(" ")[0] for c in RECORDS.replace("map<string,string>", "map").split(",")]
    frame = lambda rows: pd.DataFrame(rows, columns=names, dtype=object)
    for b in batches:
        for file, size, start, end in zip(b.file, b.length, b.start, b.end):
            fs, path = opened(file)
            with fs.open_input_file(path) as handle:
                rows, held = [], 0
                for at, content in records(Source(handle, int(size)), int(start), int(end)):
                    rows.append(parsed(file, at, content) if payloads else (*parsed(file, at, content)[:-1], None))
                    held += len(content)
                    if held > READ * 4 or len(rows) >= 1000:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)


def read_archives(spark: SparkSession, files: DataFrame | list[str], span: int = RANGE, payloads: bool = True) -> DataFrame:
    """The WARC records of gzip-per-record files, read in byte ranges of ``span``. Empty files hold none.

    ``files``: a table (file, length), or paths.
    """
    session(spark)
    if not isinstance(files, DataFrame):
        if not files:
            return spark.createDataFrame([], RECORDS)
        files = spark.read.format("binaryFile").load(files).select(F.col("path").alias("file"), "length")
    listed = files.select("file", "length").where("length > 0")
    ranges = listed.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(span).cast("long"))))
    ranges = ranges.withColumn("end", F.least(F.col("length"), F.col("start") + span))
    n = listed.agg(F.sum(F.ceil(F.col("length") / span))).first()[0] or 1
    spread = ranges.repartition(int(min(10_000, n)), "file", "start")
    return spread.mapInPandas(lambda it: _read(it, payloads), RECORDS)
