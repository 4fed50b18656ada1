"""WARC archives: a writer through Spark's own sinks, and a salvage reader.

Writing: equal payloads of at least `least` bytes are one response (the largest page_id) and revisits
that refer to it. A record is a gzip member (several for records over 8 MB). Rows go through the text
sink, so that any store works: a member's last byte is always zero (the size's high byte), and is
written as the line separator. The files are ordinary record-compressed WARC.

Reading: a file is walked member by member, or record by record where it is not compressed. Each
record is checked: version line, headers, length, end mark, payload digest. After a failed check the
reader searches for the next gzip member or version line that holds a valid record, goes on there,
and logs the bytes between as a gap; whole records after a damaged place are always recovered.

Defined cases: a null page is an empty payload; rows that repeat are written each (all rows with the
largest page_id of a payload are responses); null ids stay null and are responses only if all equal
pages have null ids; control characters in urls are escaped; an empty table gives no records; other
columns are ignored. Very long pages are written as members of 8 MB; ids must be integers.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, in_slices, new_folder, settle

MEMBER, MAGIC, VERSION, END = 8 << 20, b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, when: str = "2020-01-01T00:00:00Z") -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {when}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"X-Refers-To-Page-ID: {refers_to}"]
        payload = b""
    return "\r\n".join([*head, "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]).encode() + END + payload + END


def member(data: bytes, level: int = 1) -> bytes:
    """gzip members, each of less than 2**24 bytes, so that the last byte is zero."""
    return b"".join(gzip.compress(data[i : i + MEMBER], level, mtime=0) for i in range(0, len(data), MEMBER))


def parsed(buf: bytes, at: int) -> tuple[str, dict[str, str], bytes, int]:
    """The record at a place: "ok", "short" (more bytes may complete it) or the failed check; headers, payload, its end."""
    if not buf.startswith(VERSION, at):
        return "no version line", {}, b"", at
    stop = buf.find(END, at)
    if stop < 0:
        return "short", {}, b"", at
    try:
        lines = buf[at:stop].decode().split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        n = int(head["content-length"])
    except (ValueError, KeyError):
        return "bad headers", {}, b"", at
    start = stop + len(END)
    if n < 0:
        return "bad headers", {}, b"", at
    if start + n + len(END) > len(buf):
        return "short", {}, b"", at
    if buf[start + n : start + n + len(END)] != END:
        return "no end mark", {}, b"", at
    payload, digest = buf[start : start + n], head.get("warc-payload-digest", "")
    if head.get("warc-type") != "revisit" and digest.startswith("sha1:") and base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode() != digest[5:]:
        return "digest differs", {}, b"", at
    return "ok", head, payload, start + n + len(END)


def inflated(data: memoryview, at: int) -> tuple[bytes, int]:
    """The member at a place and its end; end is -1 if it is damaged."""
    work, out, pos = zlib.decompressobj(31), [], at
    try:
        while not work.eof and pos < len(data):
            out.append(work.decompress(data[pos : pos + (1 << 16)]))
            pos += 1 << 16
    except zlib.error:
        return b"", -1
    return (b"".join(out), min(pos, len(data)) - len(work.unused_data)) if work.eof else (b"", -1)


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """("record", start, end, headers, payload), or ("gap: <failed check>", start, end, {}, b"") for quarantined bytes."""
    view, pos, gap, why = memoryview(data), 0, -1, ""
    while pos < len(data):
        found: list[tuple[dict[str, str], bytes]] = []
        if data.startswith(MAGIC, pos):
            block, end = inflated(view, pos)
            state, at = ("member is damaged", 0) if end < 0 else ("ok", 0)
            while state == "ok" and at < len(block):
                state, head, payload, at = parsed(block, at)
                while state == "short" and data.startswith(MAGIC, end):  # a record over several members
                    more, stop = inflated(view, end)
                    if stop < 0 or more.startswith(VERSION):
                        break
                    block, end = block + more, stop
                    state, head, payload, at = parsed(block, at)
                if state == "ok":
                    found.append((head, payload))
        else:
            state, head, payload, end = parsed(data, pos)
            if state == "ok":
                found.append((head, payload))
        if found and gap >= 0:
            yield f"gap: {why}", gap, pos, {}, b""
            gap = -1
        for head, payload in found:
            yield "record", pos, end, head, payload
        if state == "ok":
            pos = end
            continue
        if gap < 0:
            gap, why = pos, state
        later = [p for p in (data.find(MAGIC, pos + 1), data.find(VERSION, pos + 1)) if p >= 0]
        pos = min(later, default=len(data))
    if gap >= 0:
        yield f"gap: {why}", gap, len(data), {}, b""


def write_archives(pages: DataFrame, folder: str, least: int = 1000, records_per_file: int = 1000, file_bytes: int | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Archives of all pages in the folder: at most records_per_file records a file; with file_bytes, which takes one more pass over the pages, at most so many bytes of payload too (or one record)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    per_file = records_per_file
    if file_bytes:  # a file is read as one row: payloads of the largest size must fit
        largest = rows.agg(F.max(F.octet_length("html"))).first()[0] or 0
        per_file = max(1, min(records_per_file, file_bytes // (largest + 4096)))
    large = rows.filter(F.octet_length("html") >= least).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("digest", "first")
    again = large.join(first, "digest").filter("page_id IS NULL OR page_id < first").distinct().select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "first")
    # Only revisits are joined: where they are few, pages need no shuffle.
    marked = rows.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left").select("page_id", "url", "html", "first")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, "html"):
            out = [member(record("response" if first is None else "revisit", i, url, html.encode(), first))[:-1] for i, url, html, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    arrow_rows(marked, work, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\x00").option("maxRecordsPerFile", per_file).text(folder)


def read_archives(pages_folder: DataFrame, with_payload: bool = True) -> DataFrame:
    """pages_folder: rows of Spark's binaryFile source (path, content). One row a record or gap, with its file and byte range; payloads are checked in any case, and handed on if asked for."""
    schema = "kind string, file string, start long, end long, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in schema.split(", ")]
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for b in batches:
            for i in range(b.num_rows):
                path, rows, size = b.column("path")[i].as_py(), [], 0
                for kind, start, end, head, payload in salvage(b.column("content")[i].as_py()):
                    number = lambda k, head=head: int(head[k]) if head.get(k, "").lstrip("-").isdigit() else None
                    if kind == "record":
                        visit = head.get("warc-type") == "revisit"
                        digest = base64.b32decode(head["warc-payload-digest"][5:]).hex() if visit else hashlib.sha1(payload, usedforsecurity=False).hexdigest()
                        rows.append((kind, path, start, end, number("x-page-id"), head.get("warc-target-uri"), payload if with_payload else None, number("x-payload-length") if visit else len(payload), digest, head.get("warc-type"), number("x-refers-to-page-id")))
                    else:
                        rows.append((kind, path, start, end, *[None] * 7))
                    size += len(payload)
                    if size > MEMBER or len(rows) >= 5000:
                        yield give(rows)
                        rows, size = [], 0
                if rows:
                    yield give(rows)

    return arrow_rows(pages_folder.select("path", "content"), work, schema)


def round_trip(pages: DataFrame, least: int = 1000, with_payload: bool = True) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archives(pages, folder, least)
    return read_archives(spark.read.format("binaryFile").load(folder), with_payload)


def quarantined(read: DataFrame) -> DataFrame:
    """(file, start, end, why): the log of byte gaps that failed a check."""
    return read.filter("kind <> 'record'").select("file", "start", "end", F.regexp_replace("kind", "^gap: ", "").alias("why"))


def salvaged(pages_folder: DataFrame, with_payload: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records of damaged archives, and the log of their gaps: both written to the shared folder, from one reading."""
    read = settle(read_archives(pages_folder, with_payload), "salvaged")
    return read.filter("kind = 'record'"), quarantined(read)


def page_digest(read: DataFrame) -> DataFrame:
    return read.filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
