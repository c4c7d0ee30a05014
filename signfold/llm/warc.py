"""WARC archives: writing with payload dedup, and reading by boundary-chain verification.

Writing: records are text-file rows that end in CR LF CR LF, so Spark's own writer lays them down on any file
system. Of records with equal payloads of at least `least` bytes the one with the smallest id is a response and
the others are revisits that refer to it; smaller payloads are always responses.

Reading: tasks look for the record magic in the files and emit candidates (file, offset, offset of the successor
that the candidate's Content-Length claims), magic inside payloads included. The candidates of a file meet in one
task, where pointer jumping from offset 0, in a number of rounds logarithmic in the file's records, keeps those that
can be reached; the others lay inside payloads. A chain that does not end exactly at the end of its file is an error.
Files compressed as a whole and files of one gzip member for each record read alike. Files are written with about
FILE_BYTES of records, so that a task can hold one; no pointer leaves its file, so what meets in a task is bounded by it.

Defined results: null payloads are empty; a page without an id is no response that others refer to, it revisits like
them; repeated ids give a record each, and a reference is met by id and digest; an empty
table gives empty archives; extra columns are ignored; control characters in header values are percent-encoded;
headers are read whole, however long a url is.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import NULL_ID, ident, release, restored, scratch, spread_join, written

MAGIC = b"WARC/1.1\r\n"
LEAST = 100
#: A file is closed once its records hold so many bytes, so that one task can hold a file.
FILE_BYTES = 32 << 20
#: What a header adds to a payload and its url.
HEADER_BYTES = 400


def planned(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str | None = "url", least: int = LEAST) -> DataFrame:
    """(key, url, payload, digest, record_type, refers_to) for each row."""
    rows = pages.select(ident(key).alias(key), (F.coalesce(F.col(url), F.lit("")) if url else F.lit("")).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    copied = rows.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min(F.nullif(F.col(key), F.lit(NULL_ID))).alias("response"), F.count("*").alias("copies")).filter("copies > 1")
    # Only rows of copied payloads move; those of a page with very many copies stay where they are.
    total = written(copied, "copied")
    n = total.agg(F.sum("copies")).first()[0] or 0
    again = F.col("response") != F.col(key)
    small = total.select("digest", "response", "copies")
    met = spread_join(rows.filter(F.col("payload_bytes") >= least), small, ["digest"], "copies", n, "left")
    met = met.select(*rows.columns, F.when(again, F.col("response")).alias("refers_to"))
    out = met.union(rows.filter(F.col("payload_bytes") < least).select(*rows.columns, F.lit(None).cast("bigint").alias("refers_to")))
    out = out.withColumn("record_type", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response"))
    out.spent = [total]
    return out


_PART = pa.int32()


def _filed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of (bytes, value) as (value, file): a file number that goes up once the records before it hold `most` bytes."""
    held = 0
    for batch in batches:
        ends = held + np.cumsum(batch.column(0).to_numpy())
        begins = ends - batch.column(0).to_numpy()
        held = int(ends[-1]) if len(ends) else held
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(begins // most, _PART)], names=["value", "file"])


def write_warc(plan: DataFrame, path: str, key: str = "page_id", compression: str = "gzip", file_bytes: int = FILE_BYTES) -> str:
    """Archive files under `path`, written by the tasks that hold the planned rows, without another shuffle. compression: "gzip" or "none".

    A task numbers its files by the bytes of the records before; a file is longer than file_bytes by one record at most.
    """
    body = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("payload"))
    safe = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")
    head = F.concat(
        F.lit(MAGIC.decode()), F.lit("WARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: <urn:page:"), F.col(key).cast("string"), F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), safe,
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    size = F.octet_length(body).cast("bigint") + F.octet_length("url") + HEADER_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _filed(batches, file_bytes)

    records = plan.select(size.alias("bytes"), F.concat(head, body).alias("value")).mapInArrow(run, "value string, file int")
    records.write.option("lineSep", "\r\n\r\n").option("compression", compression).partitionBy("file").text(path)
    return path


_FOUND = pa.schema([("file", pa.string()), ("size", pa.int64()), ("at", pa.int64()), ("next", pa.int64()), ("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("stated_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
FOUND = "file string, size bigint, at bigint, next bigint, id bigint, url string, record_type string, refers_to bigint, stated_digest string, payload_bytes bigint, payload_digest string, payload binary"
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d{1,15})\r\n", re.I)


def _header(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _urn(value: str | None) -> int | None:
    m = re.search(r":(-?\d+)>?$", value or "")
    return int(m[1]) if m else None


def candidate_rows(file: str, content: bytes, keep: bool) -> Iterator[tuple]:
    """Every magic with a complete header: offset, successor, header fields, and the payload's digest if some candidate or the end of the file lies at the successor (else the candidate can't be on the chain)."""
    heads = []
    at, end, found = content.find(MAGIC), -1, None
    while at >= 0:
        # Headers have no greatest length. The end and the length found for one candidate are those of the next ones before them, so no byte is searched twice.
        if end < at:
            end = content.find(b"\r\n\r\n", at)
            if end < 0:
                break
            found = _LENGTH.search(content, at, end + 2)
        elif found and found.start() < at:
            found = _LENGTH.search(content, at, end + 2)
        if found:
            heads.append((at, end, end + 8 + int(found[1])))
        at = content.find(MAGIC, at + 1)
    lands = {at for at, _, _ in heads} | {len(content)}
    for at, end, following in heads:
        h = _header(content[at:end])
        body = content[end + 4 : following - 4] if following in lands else None
        yield file, len(content), at, following, _urn(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"), _urn(h.get("warc-refers-to")), h.get("warc-payload-digest", "").removeprefix("sha256:"), following - end - 8, hashlib.sha256(body).hexdigest() if body is not None else None, body if keep else None


def whole(content: bytes) -> bytes:
    """The bytes of a file; of a compressed one, those of all its gzip members."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out += [member.decompress(content), member.flush()]
        if not member.eof:
            raise ValueError("a gzip member is cut short")
        # Padding between members is zeros.
        content = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def _scanner(keep: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(*(c.to_pylist() for c in batch.columns)):
                content = whole(content)
                if rows := list(candidate_rows(file, content, keep)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND.types)], schema=_FOUND)
                elif content:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((file, len(content), -1, -1, *[None] * 8), _FOUND.types)], schema=_FOUND)

    return scan


def candidates(spark, path: str, payloads: bool = False) -> DataFrame:
    """FOUND columns for every candidate record of every file (offset -1: a file without any)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    files = files.filter("length > 0").select(F.col("path").alias("file"), "content")
    return files.mapInArrow(_scanner(payloads), FOUND)


def chain(at: np.ndarray, following: np.ndarray, size: int) -> tuple[np.ndarray, bool]:
    """Which candidates pointer jumping from offset 0 reaches, and whether the chain ends at `size`.

    at: ascending offsets of a file's candidates; following: where each claims its successor. The end and, for pointers
    to no candidate, a dead end are nodes that point at themselves. Round k marks what lies 2**k hops behind the marks.
    """
    n = len(at)
    place = np.minimum(np.searchsorted(at, following), max(n - 1, 0))
    jump = np.where(following == size, n, np.where(at[place] == following, place, n + 1)) if n else np.zeros(0, np.int64)
    jump = np.append(jump, [n, n + 1])
    mark = np.zeros(n + 2, dtype=bool)
    mark[0 if n and at[0] == 0 else n + 1] = True
    while True:
        mark[jump[mark]] = True
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    return mark[:n], bool(mark[n]) and not mark[n + 1]


_POINTER = pa.schema([("file", pa.string()), ("at", pa.int64()), ("broken", pa.bool_())])


def _chained(table: pa.Table) -> pa.Table:
    """The offsets of one file that are on its chain, or one row that says that the chain is broken."""
    file = table.column("file")[0].as_py()
    at, following = table.column("at").to_numpy(), table.column("next").to_numpy()
    order = np.argsort(at)
    on, ended = chain(at[order], following[order], table.column("size")[0].as_py())
    if not ended:
        return pa.table({"file": [file], "at": [-1], "broken": [True]}, schema=_POINTER)
    kept = at[order][on]
    return pa.table({"file": [file] * len(kept), "at": kept, "broken": np.zeros(len(kept), bool)}, schema=_POINTER)


def reachable(found: DataFrame) -> DataFrame:
    """The candidates on the chain from offset 0 of their file. Pointers of a file meet in a task; neither headers nor payloads do."""
    pointers = found.select("file", "size", "at", "next").groupBy("file").applyInArrow(_chained, "file string, at bigint, broken boolean")
    pointers = written(pointers, "chain")
    broken = pointers.filter("broken").head(3)
    if broken:
        raise ValueError(f"the record chain does not end at the end of {[r.file for r in broken]}")
    out = found.join(pointers.select("file", "at").hint("merge"), ["file", "at"])
    out.spent = [pointers]
    return out


def read_warc(spark, path: str, payloads: bool = False) -> DataFrame:
    """Records: id, url, record_type, refers_to, stated_digest, payload_bytes, payload_digest, payload (null unless asked for)."""
    found = written(candidates(spark, path, payloads), "candidates")
    kept = reachable(found)
    out = kept.select("id", "url", "record_type", "refers_to", "stated_digest", "payload_bytes", "payload_digest", "payload")
    out.spent = [found, *kept.spent]
    return out


def page_digests(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Per record: key, payload_bytes and payload_digest of the full payload (a revisit's are those of the response it refers to), record_type, refers_to."""
    # A response may have very many revisits: one row for each, weighed by them. Ids can repeat, so the digest counts too.
    place = ["refers_to", "stated_digest"]
    asked = records.filter("record_type = 'revisit'").groupBy(*place).agg(F.count("*").alias("n"))
    of = records.filter("record_type = 'response'").select(F.col("id").alias("refers_to"), F.col("payload_digest").alias("stated_digest"), F.col("payload_bytes").alias("_bytes"))
    given = written(of.dropDuplicates(place).join(asked, place), "given")
    total = given.agg(F.sum("n")).first()[0] or 0
    again = spread_join(records.filter("record_type = 'revisit'").select("id", *place), given, place, "n", total, "left")
    out = records.filter("record_type <> 'revisit'").select(F.col("id").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to")
    out = out.union(again.select("id", "_bytes", F.when(F.col("_bytes").isNotNull(), F.col("stated_digest")), F.lit("revisit"), "refers_to"))
    out = restored(out, key, "refers_to")
    out.spent = [given, *getattr(records, "spent", [])]
    return out


def warc_round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str | None = "url", least: int = LEAST, path: str | None = None) -> DataFrame:
    spark = pages.sparkSession
    plan = planned(pages, key, payload, url, least)
    path = write_warc(plan, path or scratch(spark, "warc"), key)
    release(plan)
    records = read_warc(spark, path)
    return page_digests(records, key)
