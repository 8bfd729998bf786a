"""WARC archives through a chunked record table.

A payload is cut into rows (record, chunk number, bytes) of at most ``CHUNK`` bytes by
SQL functions, so no whole payload ever reaches Python. Each row carries the SHA-256 of
the payload up to its end, made from row to row, so the last one carries the payload's
digest. Chunk rows are what travels: they are dealt by record, sorted by record and
number, and streamed into the archive one by one, where the running digest is checked.
The reader streams blocks out of the archive in the same way. Only the table's own value,
which Spark's reader delivers whole, is ever held in one piece.

Equal payloads of at least ``least_bytes`` are stored once: the record with the
smallest id is a ``response``, the others are ``revisit`` records that name it.
Payloads compare by SHA-256 and length.

Archives are WARC/1.1, one gzip member for each record. Files have names of their own and
count once a finished task has reported them, so repeated or lost tasks do no harm.

Edge cases: a null payload is empty; a null url leaves out the target; smaller
payloads are all responses; repeated rows with one id are all written, and the
smallest id with a payload is a response in each of its rows; records with a null
id refer to others but are referred to only if no other id has the payload; an
empty table gives no archives. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalode.llm._shared import bound_batches, lean, salted_left_join, shared_path

CHUNK = 1 << 20
LEAST_BYTES = 100
GZIP = 16 + zlib.MAX_WBITS
MEMBER = b"\r\n\r\n"
#: The ids of records without one.
NO_ID = "null"


def record_id(key: object) -> str:
    return f"<urn:record:{NO_ID if key is None else key}>"


def _records(df: DataFrame, id_col: str, payload_col: str, url: Column) -> DataFrame:
    """(record, id, url, payload, digest, length); ``record`` numbers the rows of this one evaluation."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).alias("id"), url.alias("url"), payload.alias("payload"))
    return rows.select(F.monotonically_increasing_id().alias("record"), "*", F.sha2("payload", 256).alias("whole"), F.octet_length("payload").cast("long").alias("length"))


def _chunks(records: DataFrame, size: int) -> DataFrame:
    """(record, id, url, whole, length, chunk_no, chunk, digest of the payload so far); an empty payload is one empty chunk."""
    number = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("length") / size).cast("int") - 1, F.lit(0)))
    cut = records.select("record", "id", "url", "whole", "length", "payload", F.explode(number).alias("chunk_no"))
    cut = cut.select("record", "id", "url", "whole", "length", "chunk_no", F.substring("payload", F.col("chunk_no") * size + 1, F.lit(size)).alias("chunk"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running = hashlib.sha256()
        for batch in batches:
            so_far = []
            for no, part in zip(batch.column(5).to_pylist(), batch.column(6), strict=True):
                if not no:
                    running = hashlib.sha256()
                running.update(part.as_buffer())
                so_far.append(running.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(so_far, pa.string())], [*batch.schema.names, "digest"])

    kinds = dict(cut.dtypes)
    return cut.mapInArrow(lean(digested), ", ".join([*(f"{c} {kinds[c]}" for c in cut.columns), "digest string"]))


def chunk_table(df: DataFrame, id_col: str = "page_id", payload_col: str = "html", size: int = CHUNK) -> DataFrame:
    """The chunked record table: id, chunk_no, chunk, digest (of the payload so far), is_last."""
    bound_batches(df.sparkSession)
    made = _chunks(_records(df, id_col, payload_col, F.lit(None).cast("string")), size)
    return made.select(F.col("id").alias(id_col), F.col("chunk_no").cast("long").alias("chunk_no"), "chunk", "digest", (F.col("digest") == F.col("whole")).alias("is_last"))


class Writer:
    """Streams records into one archive; every record is a gzip member."""

    def __init__(self, out: BinaryIO) -> None:
        self.out = out

    def begin(self, head: dict[str, str]) -> None:
        self.press = zlib.compressobj(1, zlib.DEFLATED, GZIP)
        text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
        self.out.write(self.press.compress(text.encode()))

    def add(self, part: bytes) -> None:
        self.out.write(self.press.compress(part))

    def end(self) -> None:
        self.out.write(self.press.compress(MEMBER))
        self.out.write(self.press.flush())


class Reader:
    """Streams records out of an archive, ``CHUNK`` bytes at a time."""

    def __init__(self, source: BinaryIO, size: int = CHUNK) -> None:
        self.source, self.size = source, size
        self.unpress, self.raw, self.data = zlib.decompressobj(GZIP), b"", b""

    def _more(self) -> bool:
        """Appends to self.data; False at the end of the archive."""
        while True:
            if self.unpress.eof:
                self.raw, self.unpress = self.unpress.unused_data, zlib.decompressobj(GZIP)
            elif self.unpress.unconsumed_tail:
                self.raw = self.unpress.unconsumed_tail
            if not self.raw:
                self.raw = self.source.read(self.size)
                if not self.raw:
                    return False
            made, self.raw = self.unpress.decompress(self.raw, self.size), b""
            if made:
                self.data += made
                return True

    def _take(self, n: int) -> bytes:
        while len(self.data) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        taken, self.data = self.data[:n], self.data[n:]
        return taken

    def records(self) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
        """Header and payload chunks of each record; the chunks have to be read before the next record."""
        while self.data or self._more():
            while (end := self.data.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    raise ValueError("the archive ends inside a header")
            lines = self._take(end + 4).decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record starts with {lines[0][:40]!r}")
            head = dict(x.split(": ", 1) for x in lines[1:] if x)
            left = int(head["Content-Length"])

            def body(left: int = left) -> Iterator[bytes]:
                while left:
                    part = self._take(min(left, self.size))
                    left -= len(part)
                    yield part
                if self._take(4) != MEMBER:
                    raise ValueError("a record doesn't end where its length says")

            yield head, body()


def _head(key: int | None, url: str | None, digest: str, length: int, first: int | None, revisit: bool, date: str, kind: str) -> dict[str, str]:
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(key), "WARC-Date": date, "WARC-Payload-Digest": f"sha256:{digest}", "Payload-Length": str(length)}
    if url is not None and not any(c in url for c in "\r\n"):
        head["WARC-Target-URI"] = url
    if revisit:
        return head | {"WARC-Refers-To": record_id(first), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Content-Length": "0"}
    return head | {"Content-Type": kind, "Content-Length": str(length)}


def _archive(folder: str, batches: Iterator[pa.RecordBatch], date: str, kind: str) -> Iterator[pa.RecordBatch]:
    """Chunk rows in order of record and number -> one archive; a record ends with its last chunk."""
    files, base = fs.FileSystem.from_uri(folder)
    name, out, n, left, seen = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, 0, hashlib.sha256()
    for batch in batches:
        for key, url, whole, length, no, part, digest, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out is None:
                out = files.open_output_stream(f"{base}/{name}", compression=None)
                writer = Writer(out)
            if not no:
                if left:
                    raise ValueError("a record ends before its last chunk")
                writer.begin(_head(key, url, whole, length, first, revisit, date, kind))
                left, seen, n = 0 if revisit else length, hashlib.sha256(), n + 1
            if not revisit:
                seen.update(part)
                left -= len(part)
                if seen.hexdigest() != digest or not left and digest != whole:
                    raise ValueError(f"{record_id(key)}: chunk {no} doesn't have the digest it was filed under")
                writer.add(part)
            if not left:
                writer.end()
    if left:
        raise ValueError("a record ends before its last chunk")
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": [n]})


def write_archives(
    df: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", least_bytes: int = LEAST_BYTES, size: int = CHUNK,
    date: str | None = None, content_type: str = "text/html",
) -> list[str]:
    """Writes a record for each row under the shared folder; the archives' paths. ``date`` is the
    records' WARC-Date, the time of the call if not given."""
    spark = df.sparkSession
    bound_batches(spark)
    folder = shared_path(spark, "warc")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    records = _records(df, id_col, payload_col, url).withColumn("id", F.col("id").cast("long"))
    large = records.filter(F.col("length") >= least_bytes).select("id", "whole", "length")
    # of payloads that stand more than once, the smallest id; no payload goes through this shuffle
    firsts = large.groupBy("whole", "length").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    marks = salted_left_join(large, firsts.drop("n"), ["whole", "length"], "id")
    revisits = marks.filter("first IS NOT NULL AND NOT (id <=> first)").select(F.col("id").alias("r_id"), F.col("whole").alias("r_whole"), "first").distinct()
    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    joined = _chunks(records, size).join(revisits.hint("shuffle_hash"), F.expr("id <=> r_id AND whole = r_whole"), "left").withColumn("revisit", F.col("first").isNotNull())
    # a revisit is its header alone
    ready = joined.filter("NOT revisit OR chunk_no = 0").withColumn("chunk", F.when(~F.col("revisit"), F.col("chunk"))).sortWithinPartitions("record", "chunk_no")
    ready = ready.select("id", "url", "whole", "length", "chunk_no", "chunk", "digest", "first", "revisit")
    written = ready.mapInArrow(lean(lambda b: _archive(folder, b, date, content_type)), "file string, records long").collect()  # a row for each task
    return sorted(r["file"] for r in written)


def _read(batches: Iterator[pa.RecordBatch], id_col: str, size: int) -> Iterator[pa.RecordBatch]:
    def key(urn: str | None) -> int | None:
        name = urn[len("<urn:record:") : -1] if urn else NO_ID
        return None if name == NO_ID else int(name)

    for path in (p for b in batches for p in b.column(0).to_pylist()):
        files, base = fs.FileSystem.from_uri(path)
        rows: list[tuple] = []
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [id_col, "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date"])
        with files.open_input_stream(base, compression=None) as source:
            for head, parts in Reader(source, size).records():
                digest, n = hashlib.sha256(), 0
                for part in parts:
                    digest.update(part)
                    n += len(part)
                stated = head["WARC-Payload-Digest"].removeprefix("sha256:")
                if head["WARC-Type"] == "response" and (digest.hexdigest() != stated or n != int(head["Payload-Length"])):
                    raise ValueError(f"{path}: {head['WARC-Record-ID']} doesn't match its digest")
                rows.append((key(head["WARC-Record-ID"]), int(head["Payload-Length"]), stated, head["WARC-Type"], key(head.get("WARC-Refers-To")), head.get("WARC-Target-URI"), head["WARC-Date"]))
                if len(rows) == 5000:
                    yield pack(rows)
                    rows = []
        if rows:
            yield pack(rows)


def read_archives(spark: SparkSession, paths: list[str], id_col: str = "page_id", size: int = CHUNK) -> DataFrame:
    """One row per record: id, payload_bytes, payload_digest, record_type, refers_to,
    url, date. Payloads stream past their digest check; revisits state those of the full payload."""
    todo = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    shape = f"`{id_col}` long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string"
    return todo.mapInArrow(lambda b: _read(b, id_col, size), shape)


def read_payloads(spark: SparkSession, paths: list[str], id_col: str = "page_id", size: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives' responses: id, chunk_no, chunk, digest
    (of the payload so far)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            files, base = fs.FileSystem.from_uri(path)
            with files.open_input_stream(base, compression=None) as source:
                for head, parts in Reader(source, size).records():
                    name, digest = head["WARC-Record-ID"][len("<urn:record:") : -1], hashlib.sha256()
                    for no, part in enumerate(parts):
                        digest.update(part)
                        yield pa.RecordBatch.from_arrays([pa.array([None if name == NO_ID else int(name)], pa.int64()), pa.array([no], pa.int64()), pa.array([part], pa.binary()), pa.array([digest.hexdigest()])], [id_col, "chunk_no", "chunk", "digest"])

    todo = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return todo.mapInArrow(run, f"`{id_col}` long, chunk_no long, chunk binary, digest string")
