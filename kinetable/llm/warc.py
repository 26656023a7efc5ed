"""Operator 8: WARC archives with revisit records, read back by boundary-chain verification.

Writing: each row becomes a WARC/1.1 record whose block is an HTTP response; of equal payloads of ``REVISIT_BYTES`` or more
the one with the largest id is the response and the others are revisit records without the payload. Archives are stored
as a table of chunks (only Spark's writers reach the shared folder) that tasks read on their own, each with a look ahead
as long as the archive's longest header; ``archive_files`` puts them together to whole ``.warc`` files.

Reading: a task finds every record magic in its chunk, also those inside payloads, and emits for each candidate the
offset of its successor and, following successors inside the chunk, the offset where its chain leaves the chunk. Pointer
jumping from the archive's start over these exits (the jumps double each round) finds where the true chain enters each
chunk; a walk from there keeps the reachable records and rejects all other candidates. Records that cross chunks are put
together from their pieces. Length and SHA-1 of a response's payload come from the bytes read, and ``intact`` tells
whether the header says the same; a revisit has no payload, its values are those of its header.

Defined cases: a null payload is empty; a null url gives no target; line breaks in a url are percent-encoded; a null id gives an
id-less record, which is a response that nothing refers to unless all equal payloads are id-less; rows equal in id and
payload to the response are responses too; an empty table gives no archive and no record; a damaged header ends its
archive's chain. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, prepare, shared_dir, spread_join, stored, table

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 16 << 20
CHUNK_BYTES = 1 << 20
_MAGIC = b"WARC/1.1\r\n"
_END = b"\r\n\r\n"
_LENGTH = re.compile(rb"\r\nContent-Length: (\d{1,15})(?=\r\n)", re.I)
_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*)$", re.S)
_CHUNKS = "archive string, start long, data binary, ahead binary"
_RECORD = "archive string, offset long, length long, id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, intact boolean"
_NAMES = [x.split()[0] for x in _RECORD.split(", ")]
_KINDS = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in _RECORD.split(", ")]


def _name(i) -> bytes:
    return b"<urn:page:%s>" % (b"" if i is None else str(i).encode())


def record(i, url, payload: bytes, digest: str, refers_to) -> tuple[bytes, int]:
    """One record and the bytes of its header; ``refers_to`` makes it a revisit of that id."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + _name(i), b"WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.encode("utf-8", "surrogatepass").replace(b"\r", b"%0D").replace(b"\n", b"%0A"))
    head.append(b"WARC-Payload-Digest: sha1:" + digest.encode())
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + _name(refers_to)]
    block = http if refers_to is not None else http + payload
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    header = _MAGIC + b"\r\n".join(head) + _END
    return header + block + _END, len(header)


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """id, url, payload, digest, refers_to of every row."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    groups = rows.where(large).groupBy("digest").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 and keeper is not null")
    groups = stored(groups, "warc-groups")
    out = spread_join(rows, groups, ["digest"], "n", pages.count(), "left")
    other = large & F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    return out.select("id", "url", "payload", "digest", F.when(other, F.col("keeper")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write the rows of ``pages`` as WARC archives, in chunks, below ``path``."""
    prepare(pages.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        part, n, buffer, header = TaskContext.get().partitionId(), 0, bytearray(), 0

        def chunks():
            name = f"part-{part:06d}-{n:06d}.warc"
            data = bytes(buffer)
            for at in range(0, len(data), CHUNK_BYTES):
                end = at + CHUNK_BYTES
                cols = [pa.array([name]), pa.array([at], pa.int64()), pa.array([data[at:end]], pa.binary()), pa.array([data[end : end + header]], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["archive", "start", "data", "ahead"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                data, size = record(*row)
                buffer += data
                header = max(header, size)
                if len(buffer) >= ARCHIVE_BYTES:
                    yield from chunks()
                    buffer, header, n = bytearray(), 0, n + 1
        yield from chunks()

    with_revisits(pages, id_col, url_col, payload_col).mapInArrow(run, _CHUNKS).write.option("compression", "zstd").parquet(path)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of the archives below ``path``: each content is a whole .warc file of about ``ARCHIVE_BYTES``."""
    prepare(spark)
    parts = spark.read.schema(_CHUNKS).parquet(path).groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("start", "data"))).alias("parts"))
    return parts.select("archive", F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["data"])).alias("content"))


def _page(name: bytes):
    digits = name.removeprefix(b"<urn:page:").removesuffix(b">")
    try:
        return int(digits)
    except ValueError:
        return None


def candidates(data: bytes, ahead: bytes, start: int) -> list[tuple[int, int, int | None]]:
    """(offset, successor, exit of its chain) of every place in ``data`` where a record may begin. A candidate's header
    ends at the next empty line, and the last Content-Length before that is its own; all are found in one scan each."""
    both = data + ahead
    ends = [m.start() for m in re.finditer(b"(?=" + _END + b")", both)]
    lengths = [(m.start(), int(m[1])) for m in _LENGTH.finditer(both)]
    found = []
    for m in re.finditer(re.escape(_MAGIC), data + ahead[: len(_MAGIC) - 1]):
        at = m.start()
        i = bisect_left(ends, at)
        if i == len(ends):
            break
        k = bisect_right(lengths, (ends[i], 0)) - 1
        if k >= 0 and lengths[k][0] > at:
            found.append((start + at, start + ends[i] + len(_END) + lengths[k][1] + len(_END)))
    exits: dict[int, int | None] = {}
    for offset, to in reversed(found):
        exits[offset] = to if to >= start + len(data) else exits.get(to)
    return [(offset, to, exits[offset]) for offset, to in found]


def parse(archive: str, offset: int, data: bytes) -> tuple:
    """One record's row from its bytes."""
    end = data.find(_END)
    fields = dict(m.groups() for line in data[len(_MAGIC) : end].split(b"\r\n") if (m := _FIELD.match(line)))
    block = data[end + len(_END) : -len(_END)]
    head = block.find(_END)
    said = _LENGTH.search(block[: head + 2]) if head >= 0 else None
    size, digest = int(said[1]) if said else None, fields.get(b"WARC-Payload-Digest", b"").removeprefix(b"sha1:").decode("latin-1")
    kind = fields.get(b"WARC-Type", b"").decode("latin-1")
    intact = data[-len(_END) :] == _END and size is not None
    if kind != "revisit":
        payload = block[head + len(_END) :] if head >= 0 else block
        found = hashlib.sha1(payload).hexdigest()
        intact = intact and (len(payload), found) == (size, digest)
        size, digest = len(payload), found
    url = fields[b"WARC-Target-URI"].decode("utf-8", "replace") if b"WARC-Target-URI" in fields else None
    return archive, offset, len(data), _page(fields.get(b"WARC-Record-ID", b"")), kind, size, digest, _page(fields.get(b"WARC-Refers-To", b"")), url, intact


def _batch(rows: list[tuple]) -> list[pa.Array]:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_KINDS)
    return [pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)]


def _entries(spark: SparkSession, jump: DataFrame, chunks: DataFrame) -> DataFrame:
    """(archive, offset) where the chain from each archive's start enters a chunk, by pointer jumping."""
    reached = stored(chunks.select("archive", F.lit(0).cast("long").alias("offset")).distinct(), "warc-reached")
    while True:
        step = jump.select("archive", "offset", F.col("exit").alias("_to"))
        # only offsets where some candidate stands lead on; the archive's end doesn't
        fresh = reached.hint("merge").join(step, ["archive", "offset"]).select("archive", F.col("_to").alias("offset")).distinct().join(reached, ["archive", "offset"], "left_anti")
        fresh = stored(fresh, "warc-fresh")
        if fresh.isEmpty():
            discard(spark, jump, fresh)
            return reached
        wider = stored(reached.unionByName(fresh), "warc-reached")
        farther = stored(step.hint("merge").join(jump.select("archive", F.col("offset").alias("_to"), F.col("exit").alias("_far")), ["archive", "_to"]).select("archive", "offset", F.col("_far").alias("exit")), "warc-jump")
        discard(spark, reached, fresh, jump)
        reached, jump = wider, farther


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(archive, offset, length, id, record_type, payload_bytes, payload_digest, refers_to, url, intact) of every true record."""
    prepare(spark)
    chunks = spark.read.schema(_CHUNKS).parquet(path)

    def scan(batches):
        for b in batches:
            for archive, start, data, ahead in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                found = [(offset, to) for offset, _, to in candidates(data, ahead, start) if to is not None]
                cols = [pa.array([archive] * len(found), pa.string()), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["archive", "offset", "exit"])

    jump = stored(chunks.mapInArrow(scan, "archive string, offset long, exit long"), "warc-jump")
    places = chunks.select("archive", "start")
    reached = _entries(spark, jump, places)
    # a chunk is entered at the first reached offset in it; the bytes before that belong to the record that ends there
    later = Window.partitionBy("archive").orderBy("start").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    marks = places.withColumn("hit", F.lit(None).cast("long")).unionByName(reached.select("archive", F.col("offset").alias("start"), F.col("offset").alias("hit")))
    entries = marks.withColumn("until", F.min("hit").over(later)).where("hit is null and until is not null").drop("hit")
    entries = stored(entries, "warc-entries")
    discard(spark, reached)

    def walk(batches):
        for b in batches:
            for archive, start, data, ahead, entry in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                end, rows, pieces = start + len(data), [], []
                if entry > start:
                    pieces.append((archive, entry, start, data[: entry - start]))
                follow = {offset: to for offset, to, _ in candidates(data, ahead, start)} if entry < end else {}
                while (to := follow.get(entry)) is not None:
                    if to <= end:
                        rows.append(parse(archive, entry, data[entry - start : to - start]))
                    else:
                        pieces.append((archive, to, entry, data[entry - start :]))
                    entry = to
                if pieces:
                    a, u, s, p = zip(*pieces, strict=True)
                    more = [pa.array(a, pa.string()), pa.array(u, pa.int64()), pa.array(s, pa.int64()), pa.array(p, pa.binary())]
                    none = [pa.nulls(len(pieces), k) for k in _KINDS[1:]]
                    yield pa.RecordBatch.from_arrays([more[0], *none, *more[1:]], [*_NAMES, "until", "at", "piece"])
                if rows:
                    none = [pa.nulls(len(rows), k) for k in (pa.int64(), pa.int64(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([*_batch(rows), *none], [*_NAMES, "until", "at", "piece"])

    def join(batches):
        for b in batches:
            rows = []
            for archive, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = b"".join(p["piece"] for p in parts)
                if data.startswith(_MAGIC):
                    rows.append(parse(archive, parts[0]["at"], data))
            yield pa.RecordBatch.from_arrays(_batch(rows), _NAMES)

    walked = chunks.join(entries, ["archive", "start"]).select("archive", "start", "data", "ahead", "until")
    walked = stored(walked.mapInArrow(walk, f"{_RECORD}, until long, at long, piece binary"), "warc-walked")
    discard(spark, entries)
    # the pieces of one record: the chunk it begins in, and the heads of those that it reaches into
    crossing = walked.where("piece is not null").groupBy("archive", "until").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("parts"))
    crossing = crossing.select("archive", "parts").mapInArrow(join, _RECORD)
    return walked.where("piece is null").select(*_NAMES).unionByName(crossing)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "archive", "offset", "length", "intact")


QUERIES = {"op8_warc": op8_warc}
ORACLES: dict[str, str] = {}
