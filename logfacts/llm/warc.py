"""WARC archives compressed with Zstandard and a shared dictionary.

An archive is a skippable frame that holds the dictionary, then one Zstandard frame per record. The writer turns rows
into archives of bounded size, each complete in itself; the reader loads the dictionary from the leading frame, decodes
the frames one by one and checks version line, required headers, lengths and digests before it gives out a record.
Archives travel as rows (archive, content), so any store that Spark reads and writes will do; files that lie elsewhere
are read with ``spark.read.format("binaryFile")`` and the same reader.

Equal payloads of at least ``least_bytes`` are stored once: the one with the largest id is the response, the others are
revisits that name it. Only (id, digest, length) is shuffled to find out, and each digest's counts are summed before
that; rows of a digest with very many are dealt to several tasks, so a payload that a third of all rows share goes to no single one.

Rows: a null id is left out; a null payload is empty; repeated rows of one id give as many records, and the largest
id's response is then given by each of its rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfacts.llm.shared import cut, join_counted

#: Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadArchive(ValueError):
    """The bytes are no valid archive."""


def record(kind: str, number: int, uri: str, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """One record; a revisit has an empty block and states digest and length of the payload that it stands for."""
    block = b"" if kind == "revisit" else payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{number}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {length}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != VERSION:
        raise BadArchive("no version line or no end of headers")
    headers = {}
    for line in lines[1:]:
        try:
            name, colon, value = line.decode().partition(":")
        except UnicodeDecodeError as e:
            raise BadArchive(f"header line {line[:60]!r}") from e
        if not colon or not name.strip():
            raise BadArchive(f"header line {line[:60]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in REQUIRED:
        if name not in headers:
            raise BadArchive(f"no {name}")
    size = headers["content-length"]
    if not (size.isascii() and size.isdigit()) or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive(f"content-length {size} with {len(rest) - 4} bytes")
    block = rest[:-4]
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "")
    if kind == "response" and digest and digest != "sha1:" + hashlib.sha1(block).hexdigest():
        raise BadArchive("payload digest")
    if kind == "revisit" and ("warc-refers-to" not in headers or block):
        raise BadArchive("revisit without a target, or with a block")
    stated = headers.get("warc-payload-length", "0")
    if not (stated.isascii() and stated.isdigit()) or kind == "response" and "warc-payload-length" in headers and int(stated) != len(block):
        raise BadArchive(f"payload length {stated[:60]}")
    return headers, block


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def _loaded(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    """The dictionary of a leading frame, which may be compressed itself; a frame without bytes is no dictionary."""
    try:
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            frame = zstandard.ZstdDecompressor().decompressobj()
            raw = frame.decompress(raw)
            if not frame.eof or frame.unused_data:
                raise BadArchive("dictionary is cut off, or more than one frame")
        if not raw:
            return None
        dictionary = zstandard.ZstdCompressionDict(raw)
        zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()  # a damaged one is found out here
    except zstandard.ZstdError as e:
        raise BadArchive(f"dictionary: {e}") from e
    return dictionary


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive, a frame at a time; whatever is wrong with its bytes raises BadArchive."""
    at, dictionary = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", content, 4)[0]
        if 8 + size > len(content):
            raise BadArchive("dictionary is cut off")
        dictionary, at = _loaded(content[8 : 8 + size]), 8 + size
    engine = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(content)
    while at < len(content):
        frame = engine.decompressobj()
        parts = []
        step = 1 << 16
        while not frame.eof:
            if at >= len(content):
                raise BadArchive("frame is cut off")
            try:
                parts.append(frame.decompress(view[at : at + step]))
            except zstandard.ZstdError as e:
                raise BadArchive(str(e)) from e
            at += min(step, len(content) - at)
        at -= len(frame.unused_data)
        yield parse(b"".join(parts))


def train_dictionary(pages: DataFrame, most_rows: int = 256, size: int = 32768) -> bytes:
    """From at most that many payloads, the ones with the smallest ids; empty where there is too little to learn from."""
    fit = pages.where("payload is not null and length(payload) between 8 and 100000").select("id", "payload")
    last = fit.select("id").orderBy("id").limit(most_rows).agg(F.max("id")).first()[0]
    sample = [r["payload"] for r in fit.where(F.col("id") <= F.lit(last)).orderBy("id").limit(most_rows).collect()]
    if len(sample) < 16:
        return b""
    try:
        return zstandard.train_dictionary(size, [bytes(x) for x in sample]).as_bytes()
    except zstandard.ZstdError:
        return b""


def with_targets(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(id, uri, payload) with digest, length and, where equal payloads are stored once, the id of the stored one."""
    pages = pages.withColumn("digest", F.sha1("payload")).withColumn("length", F.length("payload").cast("long"))
    marks = cut(pages.where(F.col("length") >= least_bytes).select("id", "digest"))  # so that payloads are hashed for this once
    large = cut(marks.groupBy("digest").agg(F.max("id").alias("target"), F.count("*").alias("copies")).where("copies > 1"))
    revisits = join_counted(marks, large, "digest", "copies", ["id"]).where("id < target").select("id", "digest", "target").distinct()
    return pages.join(revisits, ["id", "digest"], "left")


def write_archives(pages: DataFrame, dictionary: bytes, most_bytes: int = 16 << 20, level: int = 3) -> DataFrame:
    """(id, uri, payload, digest, length, target) to rows (archive, content)."""
    bound = pages.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lead = dictionary_frame(bound.value)
        engine = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(bound.value) if bound.value else None)
        part, made, frames, held = TaskContext.get().partitionId(), 0, [lead], 0
        full = lambda: pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{made:06d}"]), pa.array([b"".join(frames)], pa.large_binary()).cast(pa.binary())], ["archive", "content"])
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("id", "uri", "payload", "digest", "length", "target")), strict=True):
                number, uri, payload, digest, length, target = (x.as_py() for x in row)
                kind = "response" if target is None else "revisit"
                frames.append(engine.compress(record(kind, number, " ".join((uri or "").split()), payload, digest, length, target)))
                held += len(frames[-1])
                if held >= most_bytes:
                    yield full()
                    made, frames, held = made + 1, [lead], 0
        if len(frames) > 1:
            yield full()

    return pages.select("id", "uri", "payload", "digest", "length", "target").mapInArrow(run, "archive string, content binary")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """(archive, content) to one row per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "record_id", "record_type", "uri", "payload_digest", "payload_bytes", "refers_to", "payload"]
        types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for name, content in zip(batch.column("archive"), batch.column("content"), strict=True):
                rows, held = [], 0
                for head, block in read_archive(content.as_py()):
                    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
                    size = len(block) if head["warc-type"] != "revisit" else int(head.get("warc-payload-length", 0))
                    rows.append((name.as_py(), head["warc-record-id"], head["warc-type"], head.get("warc-target-uri"), digest, size, head.get("warc-refers-to"), block if payloads else None))
                    held += len(block)
                    if len(rows) >= 1000 or held >= 8 << 20:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    return archives.select("archive", "content").mapInArrow(run, "archive string, record_id string, record_type string, uri string, payload_digest string, payload_bytes long, refers_to string, payload binary")


def round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(id, uri, payload): writes the archives into the shared folder and gives the records read back."""
    pages = pages.where("id is not null")
    return read_archives(cut(write_archives(with_targets(pages, least_bytes), train_dictionary(pages))), payloads=False)


def op3(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    number = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)", 1).cast("long")
    back = round_trip(rows)
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"))
