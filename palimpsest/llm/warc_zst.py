"""Zstandard-compressed WARC archives: writer and validating reader.

An archive starts with a skippable frame that holds the zstd dictionary (itself
a zstd frame), then has one zstd frame for each record. The reader takes the
dictionary from that leading frame, decodes frame by frame, and checks each
record: the version line, the headers, the lengths of block and payload, the
closing blank lines, and both digests.

Archives are rows of a table, (archive, content), so that any Spark writer can
store them on any file system; ``export_archives`` has the tasks put them out as
``.warc.zst`` files, and ``read_files`` reads such files, whoever wrote them. Of
records with equal payloads one is written as the response, and the others are
revisits that refer to it. An archive is closed when it holds a bounded number
of bytes, so no task ever holds more than one.

Defined cases: a null payload counts as empty; a null record identifier is
smaller than any other; of rows that repeat payload and largest identifier one is
the response, by the least url, and the others are revisits to that identifier; a
record without a url has no target URI; a table without rows gives no archive, and
an archive may be without records; columns of the input beside these three are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.key_joins import join_by_digest, marked
from palimpsest.storage import materialize, table

SKIPPABLE_DICTIONARY = 0x184D2A5D
ARCHIVE_BYTES = 16 << 20
ARCHIVE_RECORDS = 20_000
#: Repetitions of one row that a task puts out at a time.
REPEATS_IN_PART = 1000
#: Bytes that a reader first looks at for a frame.
STEP = 4096
#: The dictionary is fitted on the heads of so many records at most, and has so many bytes at most. It changes sizes only.
DICTIONARY_SAMPLE, DICTIONARY_HEAD = 400, 16_384
DICTIONARY_BYTES = 32 << 10
DATE = "2024-01-01T00:00:00Z"
_STEM = "urn:x-record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(record_id: int | None) -> str:
    return f"<{_STEM}{'none' if record_id is None else int(record_id)}>"


def _id(name: str) -> int | None:
    found = re.fullmatch(rf"<{_STEM}(none|-?\d+)>", name)
    if not found:
        raise ValueError(f"not a record name: {name!r}")
    return None if found[1] == "none" else int(found[1])


def record(record_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit has the HTTP header of its response, which states the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(record_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"header without a colon: {line[:60]!r}")
        out[name.strip().lower().decode()] = value.strip().decode()
    return out


def parse(data: bytes) -> dict:
    """Validate one record and give its fields."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = _headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"header {name} is missing")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block's length is not Content-Length")
    block = rest[:length]
    if f"sha1:{digest_of(block)}" != fields.get("warc-block-digest"):
        raise ValueError("the block does not match its digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no HTTP header in the block")
    stated = int(_headers(http.split(b"\r\n")[1:])["content-length"])
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != stated or digest_of(payload) != digest):
        raise ValueError("the payload does not match its length and digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("a revisit has a payload, or refers to nothing")
    return {
        "record_id": _id(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": stated,
        "payload_digest": digest,
        "refers_to": _id(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def fit_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstd dictionary from sample records; their own bytes where there are too few to fit one."""
    samples = [s for s in samples if len(s) >= 8]
    if len(samples) >= 64 and sum(map(len, samples)) >= 10 * size:
        try:
            return zstandard.train_dictionary(size, samples, level=3).as_bytes()
        except zstandard.ZstdError:  # samples too alike
            pass
    return b"".join(samples)[-size:]


def _as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def opening_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=10).compress(dictionary)
    return struct.pack("<II", SKIPPABLE_DICTIONARY, len(packed)) + packed


def read_archive(content: bytes) -> Iterator[dict]:
    """All records of an archive, validated one by one."""
    magic, length = struct.unpack_from("<II", content)
    if magic != SKIPPABLE_DICTIONARY or len(content) < 8 + length:
        raise ValueError("the archive does not start with its dictionary")
    dictionary = zstandard.ZstdDecompressor().decompress(content[8 : 8 + length])
    reader = zstandard.ZstdDecompressor(dict_data=_as_dictionary(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    at, whole = 8 + length, memoryview(content)
    while at < len(whole):
        frame, data, step = reader.decompressobj(), [], STEP
        while not frame.eof:
            if at >= len(whole):
                raise ValueError("the last frame is cut off")
            some = whole[at : at + step]  # what a frame leaves of it is small
            data.append(frame.decompress(some))
            at += len(some) - len(frame.unused_data)
            step *= 2
        yield parse(b"".join(data))


def write_archives(records: DataFrame, dictionary: bytes) -> DataFrame:
    """(archive, content) from (record_id, url, payload, refers_to, revisit): one archive, or more, for each partition."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, held, number, n = opening_frame(dictionary), [], 0, 0
        packer = zstandard.ZstdCompressor(level=3, dict_data=_as_dictionary(dictionary), write_content_size=True)
        task = TaskContext.get().partitionId()
        row = lambda: pd.DataFrame({"archive": [f"{task:06d}-{number:05d}"], "content": [start + b"".join(held)]})
        for batch in batches:
            for r in batch.itertuples(index=False):
                page = None if pd.isna(r.record_id) else int(r.record_id)
                to = None if pd.isna(r.refers_to) else int(r.refers_to)
                held.append(packer.compress(record(page, r.url, bytes(r.payload), to, bool(r.revisit))))
                n += len(held[-1])
                if n >= ARCHIVE_BYTES or len(held) >= ARCHIVE_RECORDS:
                    yield row()
                    held, n, number = [], 0, number + 1
        if held:
            yield row()

    return records.mapInPandas(pack, "archive string, content binary")


READ_SCHEMA = (
    "record_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def read_archives(archives: DataFrame) -> DataFrame:
    """All records of a table of archives; a faulty record fails the job."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                held: list[dict] = []
                for one in read_archive(bytes(content)):
                    held.append(one)
                    if len(held) == 1000:
                        yield _frame(held)
                        held = []
                if held:
                    yield _frame(held)

    return archives.mapInPandas(unpack, READ_SCHEMA)


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    return out.astype({"record_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def export_archives(archives: DataFrame, folder: str) -> int:
    """Have the tasks write the archives as ``.warc.zst`` files to a folder that all machines reach; how many there are.

    A file appears whole or not at all, so a task that runs again puts the same file in its place.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, content in zip(batch["archive"], batch["content"], strict=True):
                part = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
                Path(part).write_bytes(content)
                os.replace(part, f"{folder}/{name}.warc.zst")
            yield pd.DataFrame({"n": [len(batch)]})

    return archives.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """All records of the ``.warc.zst`` files at a path of any file system that Spark reads."""
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content"))


def archive_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """The table of archives of all pages: equal payloads once, at the largest identifier.

    Payloads of which there is one copy stay where they are read.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("record_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    each = rows.groupBy("digest", "record_id").agg(F.count("*").alias("n"))
    kept = each.groupBy("digest").agg(F.max(F.struct("record_id", "n")).alias("top"), F.sum("n").alias("copies")).filter("copies > 1")
    kept = materialize(kept.select("digest", F.col("top.record_id").alias("refers_to"), (F.col("top.n") > 1).alias("again"), "copies"), "warc-kept")
    rows = marked(rows, kept)
    single = rows.filter(~F.col("known")).withColumn("refers_to", F.lit(None).cast("long"))
    # where the filter errs a row has no partner, and is the only one of its payload
    copied = join_by_digest(rows.filter("known").drop("known"), kept, "left")
    top = F.col("copies").isNull() | F.col("record_id").eqNullSafe(F.col("refers_to"))
    again = F.coalesce("again", F.lit(False)) & top
    out = _records(single, F.lit(False)).unionByName(_records(copied.filter(~again), ~top))
    if not kept.filter("again").isEmpty():
        out = out.unionByName(_one_response(copied.filter(again)))
    heads = pages.select(F.substring(payload_col, 1, DICTIONARY_HEAD).cast("binary")).limit(DICTIONARY_SAMPLE).collect()
    return write_archives(out, fit_dictionary([bytes(r[0]) for r in heads if r[0]]))


def _one_response(rows: DataFrame) -> DataFrame:
    """Records of rows that repeat payload and identifier: the first by url is the response, whole repetitions are counted and put out in parts."""
    same = rows.groupBy("digest", "record_id", "refers_to", "url").agg(F.max("payload").alias("payload"), F.count("*").alias("n"))
    order = F.struct(F.col("url").isNull(), F.col("url"))
    same = materialize(same.withColumn("order", order), "warc-again")
    least = same.groupBy("digest").agg(F.min("order").alias("least"))
    same = same.join(least, "digest").withColumn("first", F.col("order").eqNullSafe(F.col("least")))
    left = F.col("n") - F.col("first").cast("long")
    parts = same.filter(left > 0).withColumn("left", left).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(left - 1) div {REPEATS_IN_PART}"))))
    parts = parts.repartition("digest", "url", "part")
    number = F.least(F.lit(REPEATS_IN_PART).cast("long"), F.col("left") - F.col("part") * REPEATS_IN_PART)
    revisits = parts.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), number)))
    return _records(same.filter("first"), F.lit(False)).unionByName(_records(revisits, F.lit(True)))


def _records(rows: DataFrame, revisit: Column) -> DataFrame:
    return rows.select("record_id", "url", "payload", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"))


def op6_warc_zst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through an archive and back."""
    archives = materialize(archive_pages(table(spark, sf_dir, "pages")), "warc")
    return read_archives(archives).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


QUERIES = {"op6_warc_zst": op6_warc_zst}
ORACLE_SQL = {
    # five hexadecimal digits of the SHA-1 are four of base 32
    "op6_warc_zst": """
        WITH hashed AS (
            SELECT page_id, url, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha FROM pages),
        fives AS (
            SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(sha, CAST(5 * i + 1 AS INTEGER), 5) AS INTEGER)) AS v FROM hashed),
        coded AS (
            SELECT *, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0],
                       lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31) + 1, 1)), '')), '') AS payload_digest
            FROM fives),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, url NULLS LAST) AS nth,
                   max(page_id) OVER (PARTITION BY payload) AS top
            FROM coded)
        SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN nth > 1 THEN top END AS refers_to
        FROM ranked
    """
}
