"""WARC archives: monolithic gzip files, their normalisation to one member a record, and sidecar offset indexes."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of payload in an archive beyond which the next begins, and read at once.
ROLL, READ = 64 << 20, 1 << 20
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
INDEX = "record_id\twarc_type\ttarget_uri\toffset\tlength"


def _files(root: str):
    """The file system of a folder that all executors share, and the folder's path in it."""
    from pyarrow import fs

    if root.startswith("/"):
        return fs.LocalFileSystem(), root
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[5:].lstrip("/")
    return fs.FileSystem.from_uri(root)


def header_value(value: object) -> str:
    """A header's value on one line."""
    return " ".join(str(value).split())


def record(kind: str, page: int, url: str | None, payload: bytes, digest: bytes, size: int, refers_to: int | None) -> bytes:
    """A WARC/1.1 record, named by page and payload. A revisit has no payload but tells the full payload's digest and size and the record it refers to."""
    name = lambda p: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{p}:{digest.hex()}')}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page)}",
        f"WARC-Date: {EPOCH}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"X-Page-ID: {page}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
        payload = b""
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


class Inflated(io.RawIOBase):
    """The bytes of a gzip file of one or many members, inflated as a stream."""

    def __init__(self, source):
        self.source, self.unzip, self.rest, self.held = source, zlib.decompressobj(31), b"", b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self.held:
            if self.unzip.eof:
                self.rest, self.unzip = self.unzip.unused_data, zlib.decompressobj(31)
                self.rest = self.rest or self.source.read(READ)
                if not self.rest:
                    return 0
            elif not self.rest:
                self.rest = self.source.read(READ)
                if not self.rest:
                    return 0
            self.held = self.unzip.decompress(self.rest, READ)
            self.rest = self.unzip.unconsumed_tail
        n = min(len(target), len(self.held))
        target[:n], self.held = self.held[:n], self.held[n:]
        return n


def records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, whole record) of each record of an inflated archive."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record here: {line[:40]!r}")
        head, fields = [line], {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            head.append(line)
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError("the archive ends within a record")
        yield fields, block, b"".join([*head, b"\r\n", block, b"\r\n\r\n"])


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def normalise(files, source: str, target: str) -> int:
    """Rewrites a gzip archive so that every record is a member of its own, and writes target + '.idx'; returns the records."""
    at, n, lines = 0, 0, [INDEX]
    with files.open_input_stream(source, compression=None) as raw, files.open_output_stream(target + ".part", compression=None) as out:
        for fields, _, whole in records(io.BufferedReader(Inflated(raw), READ)):
            data = member(whole)
            out.write(data)
            lines.append("\t".join([fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri", ""), str(at), str(len(data))]))
            at, n = at + len(data), n + 1
    with files.open_output_stream(target + ".idx.part", compression=None) as out:
        out.write(("\n".join(lines) + "\n").encode())
    files.move(target + ".part", target)
    files.move(target + ".idx.part", target + ".idx")
    return n


def read_indexed(files, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Each record of a normalised archive, inflated alone from the offset that the index tells."""
    with files.open_input_stream(path + ".idx", compression=None) as f:
        rows = [line.split("\t") for line in f.read().decode().split("\n")[1:-1]]
    with files.open_input_file(path) as f:
        for name, kind, _, offset, length in rows:
            f.seek(int(offset))
            whole = zlib.decompress(f.read(int(length)), 31)
            ((fields, block, _),) = records(io.BufferedReader(io.BytesIO(whole)))
            if fields["warc-record-id"] != name or fields["warc-type"] != kind:
                raise ValueError(f"{path}: the index does not match at {offset}")
            yield fields, block


def archive_pages(pages: DataFrame, min_revisit: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None) -> DataFrame:
    """Writes the pages as archives, normalises these and reads them back: (page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, archive).

    Of records with equal payloads of at least min_revisit bytes, that with the largest id is a response, the others
    revisit it; smaller ones are responses. Payloads are equal when SHA-1 and size are. A null payload is empty, a null
    url is left out; rows with a null id are dropped. Rows of a repeated id have a record each: of equal payloads all rows
    of the largest id are responses. Other columns are ignored; an empty table gives no archive and no row.

    The response of a group is found by an aggregate over digests, so a page that a third of the rows repeat is no
    burden. Each task writes monolithic gzip files of ROLL payload bytes (parts, renamed when whole, so a task that runs
    again replaces them). A second job inflates every file once as a stream, rewrites each record as its own member and
    writes the offset index; the rows come from a read through that index. Files stay in `folder` if one is given.
    """
    spark = pages.sparkSession
    scratch = C.Scratch(spark, "warc")
    root = folder or scratch.path("archives")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")).where("page is not null")
    keys = rows.select("page", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size"))
    chosen = keys.where(F.col("size") >= min_revisit).groupBy("sha", "size").agg(F.max("page").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = keys.join(chosen, ["sha", "size"]).where("page <> response").select("page", "sha", "size", "response").distinct()
    planned = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload")).join(revisits, ["page", "sha", "size"], "left").drop("sha", "size")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, path = _files(root)
        path += "/monolithic"
        files.create_dir(path, recursive=True)
        names, out, z, name, held = [], None, None, "", 0

        def close() -> None:
            nonlocal out
            if out:
                out.write(z.flush())
                out.close()
                files.move(name + f".{task.taskAttemptId()}", name)
                names.append(name)
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, held = f"{path}/part-{task.partitionId():05d}-{len(names):04d}.warc.gz", 0
                    out, z = files.open_output_stream(name + f".{task.taskAttemptId()}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                payload, refers = row["payload"], row["response"]
                kind = "response" if refers is None else "revisit"
                out.write(z.compress(record(kind, row["page"], row["url"], payload, hashlib.sha1(payload).digest(), len(payload), refers)))
                held += len(payload)
                if held >= ROLL:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["archive"])

    archives = scratch.write(planned.mapInArrow(write, "archive string"), "names")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, path = _files(root)
        files.create_dir(path + "/records", recursive=True)
        for batch in batches:
            done = []
            for name in batch.column("archive").to_pylist():
                target = f"{path}/records/{name.rpartition('/')[2]}"
                work = f"{target}.{TaskContext.get().taskAttemptId()}"
                normalise(files, name, work)
                files.move(work, target)
                files.move(work + ".idx", target + ".idx")
                done.append(target)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["archive"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _files(root)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                out = []
                for fields, block in read_indexed(files, name):
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
                    kind = fields["warc-type"]
                    if kind == "response" and (hashlib.sha1(block).digest() != digest or len(block) != int(fields["x-payload-length"])):
                        raise ValueError(f"{name}: a payload does not match its digest")
                    refers = fields.get("x-refers-to-page")
                    out.append({"page_id": int(fields["x-page-id"]), "payload_bytes": int(fields["x-payload-length"]), "payload_digest": digest.hex(), "record_type": kind, "refers_to": None if refers is None else int(refers), "target_uri": fields.get("warc-target-uri"), "archive": name})
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    text = pa.string()
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", text), ("record_type", text), ("refers_to", pa.int64()), ("target_uri", text), ("archive", text)])
    form = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, archive string"
    spread = C.parallelism(spark)
    normal = scratch.write(archives.repartition(spread).mapInArrow(rewrite, "archive string"), "normal")
    if not folder:
        scratch.drop("archives/monolithic")
    return scratch.write(normal.repartition(spread).mapInArrow(read, form), "read")
