"""WARC archives: a writer with revisit records, and a reader that salvages.

Writer: every record is a gzip member of its own, in files of bounded size in
a folder that all executors share.  Rows that have a payload in common are
told by its digest, which is aggregated before it is shuffled; a file counts
only if the task that wrote it ended well, for only then is it in the manifest.

Reader: at each offset a gzip member or a plain version line is expected.  A
record whose header, length or block digest fails its check is left; the reader
searches for the next version line (or gzip mark, outside of members) that
starts a valid record, goes on there, and logs the bytes between as a
quarantined gap.  A member may hold many records and is inflated as a stream,
so that one record at a time is held.  Of a member that ends early or fails its
own checks, the records whose block digest holds are kept, and the rest of the
member is a gap: its last row starts at the member and ends at the next valid
offset.  Gaps inside a member name their inflated bytes in ``problem``, and of a member's rows only the last one ends
where the member does; the others end where they start.

Defined results: a null payload is the empty one; a null page_id gives a
record without a page id, which never is the one that others revisit unless
all that share its payload lack ids (then all are responses); rows with one
page_id and payload are alike, all responses if that page_id is the smallest;
a null url is empty; an empty table gives an empty manifest and no records;
numbers that are malformed or beyond 64 bits damage a record's header, and are
no page id.  Other columns of the pages aren't written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkmap.llm.common import materialise, shared_dir, tune

#: A writer's file is closed when it has so many bytes.
ROTATE = 32 << 20
STEP = 1 << 18

MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType()), T.StructField("n_bytes", T.LongType())])

RECORD = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("problem", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("record_id", T.StringType()),
    T.StructField("target_uri", T.StringType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("refers_to", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("payload", T.BinaryType()),
])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def _plain_uri(url: str | None) -> str:
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), url or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a revisit keeps the HTTP header, with the full length, and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {_plain_uri(url)}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, first): first is the smallest page_id with an equal payload of at least min_bytes that more than one row has."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.concat(F.unhex(F.sha1("html")), F.unhex(F.md5("html")))).withColumn("large", F.octet_length("html") >= min_bytes)
    # written, so that the join can split a payload that very many pages have
    firsts = rows.where("large").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    return rows.join(materialise(firsts, "firsts"), "digest", "left").select("page_id", "url", "html", "first")


def write(pages: DataFrame, folder: str, min_bytes: int = 0, rotate: int = ROTATE) -> DataFrame:
    """Write all rows as records to files in folder; returns the manifest (path, n_records, n_bytes), which is a written table."""
    spark = tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        out, path, n, size, k = None, "", 0, 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=MANIFEST.names)

        for b in batches:
            for page_id, url, html, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    system.create_dir(root, recursive=True)
                    path = f"{root}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{k:03d}.warc.gz"
                    out, n, size, k = system.open_output_stream(path, compression=None), 0, 0, k + 1
                data = member(record(page_id, url, html.encode("utf-8"), first, first is not None and page_id != first))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= rotate:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    path = f"{folder.rstrip('/')}-manifest"
    mark_revisits(pages, min_bytes).mapInArrow(run, MANIFEST).write.parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


class _File:
    """Reads and searches a file without holding all of it."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size

    def read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(min(n, self.size - at)) if at < self.size else b""

    def starts(self, at: int) -> Iterator[int]:
        """Offsets from at on where a member or a version line may start."""
        keep = 8
        while at < self.size:
            data = self.read(at, STEP + keep)
            for m in re.finditer(rb"\x1f\x8b\x08|WARC/\d\.", data):
                if m.start() < STEP:
                    yield at + m.start()
            at += STEP


class Damaged(ValueError):
    pass


#: A record's header has no more bytes than this, and its block no more than a table's cell can hold.
MOST_HEADER, MOST_BLOCK = 16 * STEP, (1 << 31) - 1


def _number(text: str | bytes | None) -> int | None:
    """A non-negative decimal number of 64 bits; None for anything else."""
    text = text.decode("ascii", "replace") if isinstance(text, bytes) else text or ""
    return int(text) if re.fullmatch("[0-9]{1,18}", text) else None


def _page(name: str) -> int | None:
    m = re.fullmatch("<urn:x-page:(-?[0-9]{1,19})>", name)
    return int(m[1]) if m and -(1 << 63) <= int(m[1]) < 1 << 63 else None


def _head(data: bytes) -> tuple[dict[str, str], int]:
    """Header fields and the length of the block that follows; data ends with the empty line."""
    lines = data[:-4].decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/[0-9]\.[0-9]+", lines[0]):
        raise Damaged("no version line")
    fields: dict[str, str] = {}
    for x in lines[1:]:
        k, colon, v = x.partition(":")
        if not colon:
            raise Damaged("header line without a name")
        fields[k.strip().lower()] = v.strip()
    n = _number(fields.get("content-length"))
    if n is None or n > MOST_BLOCK:
        raise Damaged("no length")
    return fields, n


def _digest(name: str) -> str:
    return name.rpartition(":")[2].upper()


def _checked(fields: dict[str, str], block: bytes) -> dict:
    """The record's row; ``sure`` tells whether a digest vouches for its block."""
    want = _digest(fields.get("warc-block-digest", ""))
    if want and want != base32_sha1(block):
        raise Damaged("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type", "")
    digest, size = _digest(fields.get("warc-payload-digest", "")), len(payload)
    if kind == "revisit":
        m = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", http)
        payload, size = b"", (_number(m[1]) or 0) if m else 0
    elif digest and digest != base32_sha1(payload):
        raise Damaged("payload digest differs")
    return {
        "record_type": kind, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "page_id": _page(fields.get("warc-record-id", "")), "refers_to": _page(fields.get("warc-refers-to", "")),
        "payload_bytes": size, "payload_digest": digest or base32_sha1(payload), "payload": payload, "sure": bool(want),
    }


class _Plain:
    """Bytes of a file from an offset on."""

    def __init__(self, f: _File, start: int):
        self.f, self.start = f, start

    def get(self, at: int, n: int) -> bytes:
        return self.f.read(self.start + at, n)

    def drop(self, at: int) -> None:
        """Nothing before ``at`` is asked for again."""


class _Inflated:
    """The inflated bytes of a gzip member, of which only what was not yet dropped is held."""

    def __init__(self, f: _File, start: int):
        self.f, self.where = f, start
        self.d = zlib.decompressobj(31)
        self.base, self.held = 0, bytearray()
        self.raw, self.piece = b"", STEP
        #: What is wrong with the member, once it is found.
        self.problem: str | None = None

    def _more(self) -> bool:
        if self.d.eof or self.problem:
            return False
        if not self.raw:
            self.raw = self.f.read(self.where, STEP)
            self.where += len(self.raw)
        part, before = self.raw[: self.piece], self.d.copy()
        try:
            out = self.d.decompress(part, 4 * STEP)
        except zlib.error as e:
            if len(part) > 1:  # what comes before the damage in these bytes is good: again, by smaller pieces
                self.d, self.piece = before, 1024 if len(part) > 1024 else 1
                return True
            self.problem = f"gzip: {e}"
            return False
        self.held += out
        self.raw = self.d.unconsumed_tail + self.raw[len(part) :]
        if not part and not out and not self.d.eof:
            self.problem = "member ends early"
        return self.problem is None

    def get(self, at: int, n: int) -> bytes:
        while self.base + len(self.held) < at + n and self._more():
            pass
        return bytes(self.held[at - self.base : at - self.base + n])

    def drop(self, at: int) -> None:
        if at - self.base >= STEP:
            del self.held[: at - self.base]
            self.base = at

    def end(self) -> int:
        """The offset after the member, in the file; after all of it was read."""
        return self.where - len(self.d.unused_data) - len(self.raw)


def _parse(source: _Plain | _Inflated, at: int) -> tuple[dict, int]:
    """The record at an offset of a source, and the offset after it."""
    data, n = b"", 1 << 12
    while (end := data.find(b"\r\n\r\n")) < 0:
        if n > MOST_HEADER or (data and len(data) < n // 4):
            raise Damaged("no end of header")
        data = source.get(at, n)
        if not data.startswith(b"WARC/"):
            raise Damaged("no version line")
        n *= 4
    fields, length = _head(data[: end + 4])
    block = source.get(at + end + 4, length + 4)
    if block[length:] != b"\r\n\r\n":
        raise Damaged("record ends early" if len(block) < length + 4 else "no end of record")
    return _checked(fields, block[:length]), at + end + 4 + length + 4


def _next_record(source: _Inflated, at: int) -> int | None:
    """The next offset after at of a member's bytes where a valid record starts."""
    at += 1
    while data := source.get(at, STEP + 8):
        for m in re.finditer(rb"WARC/[0-9]\.", data):
            if m.start() < STEP:
                try:
                    _parse(source, at + m.start())
                except Damaged:
                    continue
                return at + m.start()
        at += STEP
        source.drop(at)
    return None


def _member(f: _File, start: int) -> Iterator[dict]:
    """The rows of a gzip member; the last one is a gap without end if the member fails its checks."""
    source, at, unsure = _Inflated(f, start), 0, []
    while source.get(at, 1):
        try:
            one, end = _parse(source, at)
        except Damaged as e:
            rest = _next_record(source, at)
            if rest is None and source.problem:
                break
            to = rest if rest is not None else source.base + len(source.held)
            yield {"problem": f"{e} (inflated bytes {at} to {to})"}
            at = to
        else:
            if one.pop("sure"):
                yield one
            else:  # it counts only if the member's own checks hold
                unsure.append(one)
            at = end
        source.drop(at)
    if source.problem:
        yield {"problem": source.problem, "end": None}
    else:
        yield from unsure
        yield {"end": source.end()}


def _valid_at(f: _File, at: int) -> bool:
    """Whether a valid record starts at an offset of a file, in a member or plainly."""
    if f.read(at, 3) == b"\x1f\x8b\x08":
        return any("record_type" in x for x in _member(f, at))
    try:
        _parse(_Plain(f, at), 0)
    except Damaged:
        return False
    return True


def salvage(f: _File) -> Iterator[dict]:
    """All valid records of a file, and the gaps between them."""
    at = 0
    while at < f.size:
        start, end, problem = at, None, None
        if f.read(at, 3) == b"\x1f\x8b\x08":
            held: list[dict] = []
            for x in _member(f, at):
                if "end" in x:
                    end, problem = x["end"], x.get("problem")
                else:
                    held.append(x)
                    if len(held) > 1:
                        yield {"start": start, "end": start} | held.pop(0)
            if end is None:
                yield from ({"start": start, "end": start} | x for x in held)
            elif held:
                yield {"start": start, "end": end} | held[0]
        else:
            try:
                one, n = _parse(_Plain(f, at), 0)
                one.pop("sure")
                end = at + n
                yield {"start": start, "end": end} | one
            except Damaged as e:
                problem = str(e)
        if end is None:
            end = next((k for k in f.starts(at + 1) if _valid_at(f, k)), f.size)
            yield {"start": start, "end": end, "problem": problem}
        at = end


def read(files: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps (``problem`` is not null) of the files in column ``path``; paths are those of folder's file system."""
    tune(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([(n, {"start": pa.int64(), "end": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}.get(n, pa.string())) for n in RECORD.names])
        for b in batches:
            for path in b.column(0).to_pylist():
                with system.open_input_file(path) as source:
                    held, size = [], 0
                    for x in salvage(_File(source, source.size())):
                        x["path"] = path
                        if not with_payload:
                            x.pop("payload", None)
                        held.append(x)
                        size += len(x.get("payload") or b"") + 500
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)

    return files.select("path").mapInArrow(run, RECORD)


def archive(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, str]:
    """Write pages to a fresh shared folder; returns the manifest and the folder."""
    folder = shared_dir(spark, "warc")
    return write(pages, folder, min_bytes), folder
