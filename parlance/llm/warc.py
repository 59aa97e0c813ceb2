"""WARC archives: records in segments with chunked transfer framing, written and read back.

Writing: of pages with equal payloads (at least ``LEAST_REVISIT`` bytes) the smallest page_id is a
``response`` and the others are ``revisit`` records that refer to it.  A response's block is an
HTTP message whose body is chunked; a block above ``segment`` bytes is cut into a first record and
``continuation`` records that carry the origin's id and their segment number, the last one also the
total length.  Archives are plain WARC/1.1 files written by Spark's text sink (records end in two
line breaks, of which the sink writes the last), so any file system that Spark reaches will do; they are
compressed with gzip, a file at a time.

Reading: files are read whole (each is bounded by ``FILE_RECORDS`` records), parsed by
Content-Length, and records in more than one segment are grouped by origin and put in order of
segment number; numbers must run from one without a gap and lengths must add up to the stated
total.  Then the chunked framing is undone and the payload's digest verified.  Whole records skip
the shuffle.

Records carry the page's id in the field ``WARC-Page-ID`` and revisits the response's in
``WARC-Refers-To-Page``, beside the standard ``WARC-Refers-To`` with the response's record id.  A record
whose first segment is missing gives a row without a page that names the record.

Nulls: a null html is an empty payload, a null url an empty target; a null page_id is written as an
empty id, comes back as null, and never refers nor is referred to.  Repeated ids: each row gives a
record of its own.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import for_session, id_again, id_text, shared_path

LEAST_REVISIT = 100
SEGMENT = 32_768
CHUNK = 8_192
FILE_RECORDS = 2_000
CRLF = b"\r\n"
RESULT = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, n_segments int, problem string"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(payload[k : k + size]), payload[k : k + size]) for k in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk without its line break")
        if size == 0:
            return b"".join(out)
        out.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8") + CRLF + block + CRLF  # the sink adds the last line break


def record_id(page: str, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}:{copy}')}>"


def records(row, segment: int) -> Iterator[bytes]:
    """The records of one page."""
    page = row.page_id or ""
    url = (row.url or "").replace("\r", "%0D").replace("\n", "%0A")
    own = record_id(page, row.digest, row.copy)
    common = [("WARC-Record-ID", own), ("WARC-Target-URI", url), ("WARC-Page-ID", page), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{row.digest}")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if row.refers_to is not None:
        block = head + b"X-Payload-Length: %d\r\n\r\n" % row.n_bytes
        yield record([("WARC-Type", "revisit"), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *[("WARC-Refers-To", record_id(row.refers_to, row.digest, 0))] * bool(row.refers_known), ("WARC-Refers-To-Page", row.refers_to), ("Content-Type", "application/http;msgtype=response")], block)
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked((row.html or "").encode("utf-8"))
    pieces = [block[k : k + segment] for k in range(0, len(block), segment)]
    kind = [("Content-Type", "application/http;msgtype=response")]
    if len(pieces) == 1:
        yield record([("WARC-Type", "response"), *common, *kind], block)
        return
    for n, piece in enumerate(pieces, 1):
        total = [("WARC-Segment-Total-Length", str(len(block)))] * (n == len(pieces))
        if n == 1:
            yield record([("WARC-Type", "response"), *common, *kind, ("WARC-Segment-Number", "1")], piece)
        else:
            mine = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own}:{n}')}>"
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", mine), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n)), *total], piece)


def with_roles(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, n_bytes, digest, copy, refers_to`` (ids as text), ``refers_known``.

    Ids and digests alone are grouped; the texts join by both, so a frequent payload is spread over
    its pages.  Rows that repeat an id and payload are told apart by ``copy``; a revisit of such a page
    names it, but none of its equal records.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.when(payload != "", payload).alias("html"), F.octet_length(payload).cast("long").alias("n_bytes"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    per = sized.groupBy("digest", "page_id").agg(F.count("*").alias("c"), F.max("n_bytes").alias("n_bytes"))
    firsts = per.where((F.col("n_bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("page_id", "c")).alias("f"), F.sum("c").alias("n")).where("n > 1")
    notes = per.join(firsts, "digest", "left").where("c > 1 or f is not null").select(F.col("digest").alias("of"), F.col("page_id").alias("id"), "c", F.col("f.page_id").alias("first"), (F.col("f.c") == 1).alias("refers_known"))
    joined = sized.join(notes, (F.col("digest") == F.col("of")) & F.col("page_id").eqNullSafe(F.col("id")), "left").drop("of", "id")
    out = joined.withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first"))).withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))
    out = out.withColumn("copy", F.when(F.col("c") > 1, F.monotonically_increasing_id() + 1).otherwise(0)).drop("first", "c")
    return out.withColumn("page_id", id_text("page_id")).withColumn("refers_to", id_text("refers_to"))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, size = [], 0
            for row in pdf.itertuples(index=False):
                for data in records(row, segment):
                    out.append(data)
                    size += len(data)
                if size > 8_000_000:
                    yield pd.DataFrame({"record": out})
                    out, size = [], 0
            yield pd.DataFrame({"record": out})

    lines = with_roles(pages).mapInPandas(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(content):
        end = content.index(CRLF + CRLF, at)
        version, *lines = content[at:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)}
        start, size = end + 4, int(fields["content-length"])
        if content[start + size : start + size + 4] != CRLF + CRLF:
            raise ValueError("record without its end")
        yield fields, content[start : start + size]
        at = start + size + 4


def resolved(fields: dict[str, str], block: bytes, n_segments: int, problem: str | None) -> tuple:
    """A row of RESULT of a whole record."""
    page, digest = fields.get("warc-page-id") or None, fields["warc-payload-digest"].removeprefix("sha256:")
    kind, refers = fields["warc-type"], fields.get("warc-refers-to-page")
    n_bytes = None
    if problem is None:
        try:
            head, _, body = block.partition(CRLF + CRLF)
            if kind == "revisit":
                n_bytes = int(next(x for x in head.split(CRLF) if x.lower().startswith(b"x-payload-length:")).split(b":")[1])
            else:
                payload = unchunked(body)
                n_bytes, found = len(payload), hashlib.sha256(payload).hexdigest()
                if found != digest:
                    problem = "digest differs"
                digest = found
        except ValueError as error:
            problem = str(error)
    return (page, n_bytes, digest, kind, refers, fields.get("warc-target-uri"), n_segments, problem)


def framed(rows: list[tuple], more: str = "") -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in (RESULT + more).split(", ")])
    return out.astype({"payload_bytes": "Int64", "n_segments": "Int32"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of RESULT; ``problem`` says what is wrong with a record, null if nothing."""
    segment = ", origin string, number int, total long, head string, block binary"
    blank = (None,) * 8

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole records as rows of RESULT, segments as rows of their own columns."""
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for fields, block in parsed(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
                    number = int(fields.get("warc-segment-number", 0))
                    if number:
                        total = fields.get("warc-segment-total-length")
                        rows.append((*blank, fields.get("warc-segment-origin-id", fields["warc-record-id"]), number, total and int(total), json.dumps(fields), block))
                    else:
                        rows.append((*resolved(fields, block, 1, None), None, None, None, None, None))
                yield framed(rows, segment).astype({"number": "Int32", "total": "Int64"})

    def reassembled(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number")
        head = json.loads(pdf["head"].iloc[0])
        if head.get("warc-type") == "continuation":
            return framed([(None, None, None, "continuation", None, None, len(pdf), f"first segment missing: {pdf['origin'].iloc[0]}")])
        block, total = b"".join(pdf["block"]), pdf["total"].dropna()
        problem = None
        if pdf["number"].tolist() != list(range(1, len(pdf) + 1)):
            problem = "segment missing or repeated"
        elif len(total) != 1 or int(total.iloc[0]) != len(block):
            problem = "total length differs"
        return framed([resolved(head, block, len(pdf), problem)])

    names = [c.split()[0] for c in RESULT.split(", ")]
    read = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, RESULT + segment)
    parts = read.where("origin is not null").select("origin", "number", "total", "head", "block")
    out = read.where("origin is null").select(*names).unionByName(parts.groupBy("origin").applyInPandas(reassembled, RESULT))
    return id_again(id_again(out, "long", "page_id"), "long", "refers_to")


def archive_and_read(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages.select("page_id", "url", "html"), path, segment)
    for_session(pages.sparkSession, path)
    return read_archives(pages.sparkSession, path)
