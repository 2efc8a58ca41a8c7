"""WARC archives: one gzip member per record, written once per distinct payload and read back sequentially.

Writing: payloads are compared by SHA-1, SHA-256 and length in a grouped aggregation (the smallest id of equal payloads
answers, the others revisit it); each task then appends records to archives of its own in the shared folder, which a
lost executor's successor writes anew under another name.  Only archives named in the written list are read.

Reading: an archive is read in blocks; each member is inflated as its bytes arrive, the header lines are parsed, and
Content-Length frames the block.  Block and payload digests are verified while the block passes.  A damaged record is
reported, never dropped: after an error in a member the reader says where and goes on at the next archive.

Archives are opened through Arrow's file systems, so the shared folder may be a local mount or an object store.

Defined cases: a null payload counts as empty; repeated rows of one id with equal payloads are all responses; a null id
is answered by the smallest id of its payload, and is a response with null id where there is none; payloads shorter than
``min_bytes`` are all responses; other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, shared_path, small_batches, written

BLOCK = 1 << 16
ARCHIVE_BYTES = 32 << 20
LEVEL = 6
EPOCH = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SIGN = 1 << 63  # record ids are UUIDs whose number is the id, shifted so that it is not negative


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(key: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(1 << 64 if key is None else key + SIGN))}>"


def urn_key(urn: str) -> int | None:
    number = uuid.UUID(urn.strip("<>")).int
    return None if number == 1 << 64 else number - SIGN


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def record(key: int | None, uri: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a response holds the payload, a revisit only the head of the answer."""
    block = http_head(len(payload)) + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_urn(key)}",
            f"WARC-Target-URI: {uri}", f"WARC-Date: {EPOCH}", f"WARC-Block-Digest: sha1:{digest32(block)}",
            f"WARC-Payload-Digest: sha1:{digest32(payload)}", "Content-Type: application/http;msgtype=response"]
    if revisit:
        head += [f"WARC-Refers-To: {record_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """The bytes as one gzip member; equal bytes give equal members."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def answered(pages: DataFrame, id_col: str, uri_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """page_id, uri, payload, refers_to: null for the row that answers its payload."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(uri_col), F.lit("")).alias("uri"),
                        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    digests = [F.sha1("payload").alias("d1"), F.sha2("payload", 256).alias("d2"), F.length("payload").alias("d3")]
    keys = rows.where(F.length("payload") >= min_bytes).select("page_id", *digests)
    # only payloads that come more than once have to be looked up
    shared = (keys.groupBy("d1", "d2", "d3").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1 AND first IS NOT NULL").drop("n"))
    return (rows.select("*", *digests).join(shared, ["d1", "d2", "d3"], "left")
            .select("page_id", "uri", "payload",
                    F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to")))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
               min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row into archives in ``folder``; returns the list of archives: path, records, bytes."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        context, done, out, size, count = TaskContext.get(), [], None, 0, 0
        for batch in batches:
            for key, uri, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    # a second attempt of a task never touches the first one's archives
                    name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(done):04d}.warc.gz"
                    out, size, count = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                data = member(record(key, uri.replace("\r", "%0D").replace("\n", "%0A"), payload, refers_to,
                                     refers_to is not None))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    out.close()
                    done, out = [*done, (f"{folder}/{name}", count, size)], None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count, size))
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "records", "bytes"), map(list, zip(*done, strict=True)),
                                                      strict=True)))

    small_batches(pages.sparkSession)
    made = answered(pages, id_col, uri_col, payload_col, min_bytes).mapInArrow(
        write, "path string, records long, bytes long")
    return written(made, "warc-list")


def inflated(stream: pa.NativeFile) -> Iterator[tuple[int, Iterator[bytes]]]:
    """The gzip members of a stream: the offset of each, and its bytes as they are inflated."""
    rest, offset = b"", 0
    while True:
        if not rest and not (rest := stream.read(BLOCK)):
            return
        z, used, start = zlib.decompressobj(31), 0, offset

        def pieces() -> Iterator[bytes]:
            nonlocal rest, used
            while not z.eof:
                if not rest and not (rest := stream.read(BLOCK)):
                    raise EOFError("the member ends too early")
                piece = z.decompress(rest, BLOCK)
                used += len(rest) - len(z.unconsumed_tail) - len(z.unused_data)
                rest = z.unused_data if z.eof else z.unconsumed_tail
                if piece:
                    yield piece

        members = pieces()
        yield start, members
        for _ in members:  # what the caller left
            pass
        offset += used


class Framed:
    """One record out of the pieces of its member."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def line_end(self, mark: bytes) -> bytes:
        """All up to a mark, which is consumed."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            piece = next(self.pieces, None)
            if piece is None:
                raise EOFError("no end of the header")
            self.held += piece
        out = bytes(self.held[:at])
        del self.held[:at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """Exactly n bytes, piece by piece."""
        while n > 0:
            if not self.held:
                piece = next(self.pieces, None)
                if piece is None:
                    raise EOFError("the block ends too early")
                self.held += piece
            piece = bytes(self.held[:n])
            del self.held[:n]
            n -= len(piece)
            yield piece


def fields(head: bytes) -> dict[str, str]:
    """Named fields of a header, by lower-case name."""
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def read_record(pieces: Iterator[bytes], with_payload: bool) -> dict:
    """One record: its fields, the payload's length and digest, and whether the digests hold.

    A revisit has no payload of its own; its length and digest are those that its head states.
    """
    framed = Framed(pieces)
    head = fields(framed.line_end(b"\r\n\r\n"))
    kind, left = head.get("warc-type", ""), int(head["content-length"])
    block, payload, kept = hashlib.sha1(), hashlib.sha1(), []
    answer, length, inside = bytearray(), 0, False
    for piece in framed.take(left):
        block.update(piece)
        if not inside:
            answer += piece
            if (at := answer.find(b"\r\n\r\n")) < 0:
                continue
            piece, inside = bytes(answer[at + 4:]), True
            del answer[at:]
        payload.update(piece)
        length += len(piece)
        if with_payload and kind == "response":
            kept.append(piece)
    stated = head.get("warc-payload-digest", "").removeprefix("sha1:")
    own = base64.b32encode(payload.digest()).decode()
    valid = head.get("warc-block-digest", "").removeprefix("sha1:") == base64.b32encode(block.digest()).decode()
    http_length = int(fields(bytes(answer)).get("content-length", 0))
    if kind == "response":
        valid = valid and own == stated and http_length == length
    refers = head.get("warc-refers-to")
    return {"page_id": urn_key(head["warc-record-id"]), "uri": head.get("warc-target-uri"), "record_type": kind,
            "payload_bytes": length if kind == "response" else http_length,
            "payload_digest": own if kind == "response" else stated, "refers_to": urn_key(refers) if refers else None,
            "payload": b"".join(kept) if with_payload and kind == "response" else None, "valid": valid, "error": None}


RECORD = ("archive string, offset long, page_id long, uri string, record_type string, payload_bytes long, "
          "payload_digest string, refers_to long, payload binary, valid boolean, error string")


def read_warc(spark: SparkSession, archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives named in the column ``path``, archives spread over all tasks.

    Rows out hold a record each; ``error`` tells where an archive could not be read on.
    """
    small_batches(spark)

    def rows(path: str) -> Iterator[dict]:
        store, name = fs.FileSystem.from_uri(path)
        with store.open_input_stream(name, compression=None) as stream:
            offset = 0
            try:
                for offset, pieces in inflated(stream):
                    yield {"archive": path, "offset": offset, **read_record(pieces, with_payload)}
            except (EOFError, KeyError, ValueError, zlib.error) as problem:
                yield {"archive": path, "offset": offset, "valid": False, "error": str(problem) or type(problem).__name__}

    schema = arrow_schema(RECORD)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for path in batch.column(0).to_pylist():
                for row in rows(path):
                    held.append(row)
                    size += len(row.get("payload") or b"") + 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(tasks, "path").mapInArrow(read, RECORD)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
                    min_bytes: int = 0) -> DataFrame:
    """Write the rows to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    if folder.startswith("/"):
        folder = "file://" + folder
    return read_warc(spark, write_warc(pages, folder, id_col, uri_col, payload_col, min_bytes), with_payload=False)
