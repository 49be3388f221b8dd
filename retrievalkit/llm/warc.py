"""Deterministic sharded WARC writer, and its reader.

Records are range-sorted by key, those of one key by a hash of their payload's
digest: exact byte counts set where shards begin. Each shard is written by one task, which rolls files by compressed size. Every record is its own gzip member; HTTP and
WARC headers and the digests of payload and block are made anew from the
payload. Files are written under temporary names and renamed when complete;
their names and content follow from the rows alone, so a task that runs again
after a lost executor writes the same files. The manifest, written last, lists
the files that count, and readers read nothing else.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrievalkit.llm._shards import LEAST, ORDER, shard_cuts, shard_of
from retrievalkit.llm._spark import files_of, prepare, stored

_CRLF = b"\r\n"
_MANIFEST = "file string, shard long, records long, bytes long, sha256 string, first_key long, last_key long"


def _record(row: dict, date: str, key_header: str) -> bytes:
    """One record: headers made anew, then the HTTP response or nothing."""
    payload, key, digest = row["payload"], row["key"], row["digest"]
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    revisit = row["kind"] == "revisit"
    block = http if revisit else http + payload
    name = hashlib.sha256(f"{key}|{row['copy']}|{digest}".encode()).hexdigest()
    head = [
        ("WARC-Type", row["kind"]),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(name[:32])}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", " ".join((row["uri"] or "").split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        (key_header, "" if key is None else str(key)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("X-Refers-To-Key", str(row["refers_to"]))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head)]
    return "\r\n".join(lines).encode() + _CRLF * 2 + block + _CRLF * 2


class _Roller:
    """Writes members to files of about ``limit`` compressed bytes; a file gets
    its name when it is complete."""

    def __init__(self, folder: str, shard: int, limit: int):
        self.store, self.path = files_of(folder)
        self.shard, self.limit, self.number = shard, limit, 0
        self.attempt = uuid.uuid4().hex
        self.out, self.done = None, []

    def add(self, member: bytes, key: int | None) -> None:
        if self.out is None:
            self.temporary = f"{self.path}/_temporary/{self.attempt}-{self.number:05d}"
            self.store.create_dir(f"{self.path}/_temporary", recursive=True)
            self.out = self.store.open_output_stream(self.temporary, compression=None)
            self.size, self.records, self.sha, self.first = 0, 0, hashlib.sha256(), key
        self.out.write(member)
        self.size, self.records, self.last = self.size + len(member), self.records + 1, key
        self.sha.update(member)
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
        self.store.move(self.temporary, f"{self.path}/{name}")
        self.done.append((name, self.shard, self.records, self.size, self.sha.hexdigest(), self.first, self.last))
        self.out, self.number = None, self.number + 1


def _writer(folder: str, limit: int, date: str, key_header: str, level: int):
    """Rows of a sorted partition: of those with one key and payload, first the
    one that decides their kind, if they have one, then each with its payload."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, at, done = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if roller is None or roller.shard != row["shard"]:
                    if roller is not None:
                        roller.close()
                        done += roller.done
                    roller = _Roller(folder, row["shard"], limit)
                if at != (row["key"], row["digest"]):
                    at, copies, refers, copied = (row["key"], row["digest"]), -1, None, False
                if row["payload"] is None:
                    refers, copied = row["refers_to"], True
                    continue
                copies += 1
                if copies and copied and refers is None:
                    refers = row["key"]                 # a repeated row revisits the first of its copies
                row |= {"refers_to": refers, "copy": copies, "kind": "response" if refers is None else "revisit"}
                roller.add(gzip.compress(_record(row, date, key_header), level, mtime=0), row["key"])
        if roller is not None:
            roller.close()
            done += roller.done
            yield pa.RecordBatch.from_pylist([dict(zip(
                ("file", "shard", "records", "bytes", "sha256", "first_key", "last_key"), d)) for d in done],
                schema=pa.schema([("file", pa.string()), ("shard", pa.int64()), ("records", pa.int64()),
                                  ("bytes", pa.int64()), ("sha256", pa.string()), ("first_key", pa.int64()),
                                  ("last_key", pa.int64())]))

    return write


def _dealer(cuts: list[tuple[int, int, int]]):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sorting = pa.RecordBatch.from_arrays(
                [batch.column("key").fill_null(LEAST), batch.column("hash"), pa.nulls(len(batch), pa.int64()).fill_null(0)],
                names=ORDER)
            yield batch.append_column("shard", pa.array(shard_of(sorting, cuts)))

    return deal


def write_warc(pages: DataFrame, folder: str, key_col: str = "page_id", uri_col: str = "url",
               payload_col: str = "html", *, shard_bytes: int = 32 << 20, roll_bytes: int = 16 << 20,
               least_bytes: int = 100, date: str = "2000-01-01T00:00:00Z", key_header: str = "X-Page-Id",
               level: int = 6) -> DataFrame:
    """Write a record per row of ``pages`` below ``folder``, a URI that all
    executors reach, and return the manifest ``(file, shard, records, bytes,
    sha256, first_key, last_key)``, also written as ``folder/_manifest``.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with
    the smallest key is a response record and the others revisit it; smaller
    payloads are always responses. A null payload is empty, a null URI is blank.
    Rows that repeat key and payload: the first is the response. Rows with a
    null key refer to the smallest key with their payload, if any, and else are
    responses. Shards hold about ``shard_bytes`` of payload; only rows that
    repeat both key and payload are never cut. Other columns are not written. An empty table gives no files and
    an empty manifest. A folder with a manifest is refused.
    """
    spark = pages.sparkSession
    prepare(spark)
    store, path = files_of(folder)
    if store.get_file_info(f"{path}/_manifest").type != fs.FileType.NotFound:
        raise FileExistsError(f"{folder} holds an archive already")
    payload = F.encode(F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{key_col}`").cast("long").alias("key"), F.col(f"`{uri_col}`").cast("string").alias("uri"),
                        payload.alias("payload"))
    digest = F.sha2("payload", 256)
    # nulls have hashes below all others
    place = F.expr("shiftrightunsigned(xxhash64(digest), 1) ^ if(key is null, -1L, 0L)").alias("hash")
    heads = stored(rows.select("key", digest.alias("digest"), F.octet_length("payload").alias("size")).select(
        "key", "digest", "size", place), "warc-heads")
    narrow = heads.filter(F.col("size") >= least_bytes).select("key", "digest", "hash")
    first = narrow.groupBy("digest").agg(F.min("key").alias("least"), F.count("*").alias("n")).filter(
        "n > 1 and least is not null")
    # one small row per (key, payload) with copies goes with the pages, so payloads are shuffled once, by key
    kinds = narrow.distinct().join(first, "digest").select(
        "key", F.lit(None).cast("string").alias("uri"), F.lit(None).cast("binary").alias("payload"), "digest", "hash",
        F.expr("if(key <=> least, null, least)").alias("refers_to"))
    both = rows.withColumn("digest", digest).select(
        "key", "uri", "payload", "digest", place, F.lit(None).cast("long").alias("refers_to")).unionByName(kinds)
    cuts = shard_cuts(heads.select(F.coalesce("key", F.lit(LEAST)).alias("key"), "hash", F.lit(0).cast("long").alias("row"),
                                   F.col("size").cast("long").alias("bytes")), shard_bytes)
    dealt = both.mapInArrow(_dealer(cuts), "key long, uri string, payload binary, digest string, hash long, "
                                           "refers_to long, shard long")
    # shards are whole partitions; of equal keys and payloads the row that tells their kind is first
    manifest = dealt.repartitionById(len(cuts) + 1, F.col("shard").cast("int")).sortWithinPartitions(
        "shard", "key", "hash", "digest", F.col("payload").isNotNull(), "uri").mapInArrow(
        _writer(folder, roll_bytes, date, key_header, level), _MANIFEST)
    manifest.write.parquet(f"{folder}/_manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")


_RECORD = ("key long, uri string, kind string, refers_to long, payload_bytes long, payload_digest string, "
           "payload binary, intact boolean, file string")


def _members(data: memoryview) -> Iterator[bytes]:
    """The members of a file, each fed in small pieces, so that what follows it
    is not copied member by member."""
    at = 0
    while at < len(data):
        z, out = zlib.decompressobj(31), []
        while not z.eof and at < len(data):
            piece = data[at:at + (16 << 10)]
            out.append(z.decompress(piece))
            at += len(piece)
        if not z.eof:
            raise ValueError("a member ends early")
        at -= len(z.unused_data)
        yield b"".join(out)


def _parse(record: bytes, key_header: str) -> dict:
    head, _, rest = record.partition(_CRLF * 2)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[:int(h["Content-Length"])]
    payload = block.partition(_CRLF * 2)[2] if h["WARC-Type"] == "response" else None
    intact = h["WARC-Block-Digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}" and rest[len(block):] == _CRLF * 2
    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
    if payload is not None:
        intact = intact and digest == hashlib.sha256(payload).hexdigest() and len(payload) == int(h["X-Payload-Length"])
    number = lambda k: int(h[k]) if h.get(k) else None
    return {"key": number(key_header), "uri": h["WARC-Target-URI"], "kind": h["WARC-Type"],
            "refers_to": number("X-Refers-To-Key"), "payload_bytes": number("X-Payload-Length"),
            "payload_digest": digest, "payload": payload, "intact": intact}


def read_warc(spark: SparkSession, folder: str, key_header: str = "X-Page-Id", payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest in ``folder`` lists, with
    ``intact``: whether the record's digests and lengths hold. ``payloads``:
    whether to return them (null for revisits)."""
    prepare(spark)
    files = spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest").select("file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = files_of(folder)
        fields = pa.schema([("key", pa.int64()), ("uri", pa.string()), ("kind", pa.string()), ("refers_to", pa.int64()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
                            ("intact", pa.bool_()), ("file", pa.string())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{path}/{name}", compression=None) as f:
                    data = memoryview(f.read())          # a file holds roll_bytes or one record
                rows = []
                for n, member in enumerate(_members(data), 1):
                    row = _parse(member, key_header) | {"file": name}
                    rows.append(row if payloads else row | {"payload": None})
                    if n % 1000 == 0:
                        yield pa.RecordBatch.from_pylist(rows, schema=fields)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)

    # one task per few files
    n = spark.sparkContext.defaultParallelism * 4
    return files.repartition(n, "file").mapInArrow(read, _RECORD)
