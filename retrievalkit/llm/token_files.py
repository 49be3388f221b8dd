"""Token ids as binary files: one concatenated id array, with the boundaries of
its documents in Elias-Fano code.

The documents in ascending order of id are cut into shards of about equal text
size. A shard is two files. ``.ids`` holds its ids and nothing else, as
little-endian integers of 2 bytes if the vocabulary allows it, else 4, so a
training job can map it. ``.idx`` holds where its documents begin: a rising
sequence of n numbers up to u, stored as the ``log2(u / n)`` low bits of each,
and their high bits in unary, about 2 bits each. One bit position (32 bits) in
256 entries is kept as well; from there a few bytes lead to any entry, so an
offset is found without a table of 64-bit numbers. The document ids, which rise
too, have the same code.

Files are written under temporary names and renamed when complete, and follow
from the rows alone, so a task that runs again after a lost executor writes the
same bytes. The manifest is written last; readers read what it lists.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retrievalkit.llm._shards import LEAST, ORDER, shard_cuts, shard_of
from retrievalkit.llm._spark import files_of, prepare, text_of
from retrievalkit.llm.tokens import default_path, word_tokens

_MANIFEST = "shard long, name string, documents long, ids long, bytes long, sha256 string"
_SAMPLE = 256
_HEAD = "<8sIIQQ"                           # magic, id width, documents, ids, documents with a null id
_MAGIC = b"EFIDS\x00\x00\x01"


class EliasFano:
    """A sequence of integers that never fall, from 0 up, in near-minimal space.

    ``select(i)`` gives entries, ``last_at_most(x)`` the place of the last entry
    of at most ``x`` (-1 if none)."""

    _HEAD = struct.Struct("<QQI")           # entries, first entry, low bits

    def __init__(self, data: memoryview | bytes):
        self.n, self.first, self.low = self._HEAD.unpack_from(data)
        at = self._HEAD.size
        size = -(-self.n * self.low // 8)
        self._lows = np.frombuffer(data, np.uint8, size, at)
        at += size
        samples = -(-self.n // _SAMPLE)
        self._samples = np.frombuffer(data, "<u4", samples, at)
        at += 4 * samples
        size, = struct.unpack_from("<Q", data, at)
        self._highs = np.frombuffer(data, np.uint8, size, at + 8)
        self.size = at + 8 + size

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        x = np.asarray(values)
        n, first = len(x), int(x[0]) if len(x) else 0
        x = (x.astype(np.int64).view(np.uint64) - np.uint64(first % (1 << 64)))
        low = max(0, ((int(x[-1]) + 1) // n).bit_length() - 1) if n else 0
        bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :low]
        lows = np.packbits(bits.ravel(), bitorder="little")
        places = (x >> np.uint64(low)).astype(np.int64) + np.arange(n) if n else np.zeros(0, np.int64)
        unary = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        if len(unary) >= 1 << 32:
            raise ValueError("more entries than 32-bit positions can tell")
        unary[places] = 1
        highs = np.packbits(unary, bitorder="little")
        return (cls._HEAD.pack(n, first % (1 << 64), low) + lows.tobytes() + places[::_SAMPLE].astype("<u4").tobytes()
                + struct.pack("<Q", len(highs)) + highs.tobytes())

    def _joined(self, high: np.ndarray, i: np.ndarray) -> np.ndarray:
        out = high.astype(np.uint64) << np.uint64(self.low)
        for b in range(self.low):
            at = i * self.low + b
            out |= ((self._lows[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
        return (out + np.uint64(self.first)).view(np.int64)

    def select(self, i) -> np.ndarray:
        """The entries at places ``i``: from the sampled bit before each, byte by
        byte, to its own bit."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        place = self._samples[i // _SAMPLE].astype(np.int64)
        left = i % _SAMPLE                              # set bits to pass, after the sampled one
        byte = place >> 3
        here = self._highs[byte] & (np.uint8(255) << (place & 7).astype(np.uint8)).astype(np.uint8)
        todo = np.arange(len(i))
        while True:
            count = np.bitwise_count(here[todo]).astype(np.int64)
            todo, count = todo[count <= left[todo]], count[count <= left[todo]]
            if not len(todo):
                break
            left[todo] -= count
            byte[todo] += 1
            here[todo] = self._highs[byte[todo]]
        bits = np.unpackbits(here[:, None], axis=1, bitorder="little")
        inside = np.argmax(np.cumsum(bits, axis=1) == (left + 1)[:, None], axis=1)
        return self._joined(byte * 8 + inside - i, i)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self._highs, bitorder="little"))[:self.n]
        i = np.arange(self.n)
        return self._joined(places - i, i)

    def last_at_most(self, x) -> np.ndarray:
        x = np.atleast_1d(np.asarray(x, np.int64))
        lo, hi = np.full(len(x), -1), np.full(len(x), self.n)
        while len(open_ := np.flatnonzero(hi - lo > 1)):
            mid = (lo[open_] + hi[open_]) // 2
            less = self.select(mid) <= x[open_]
            lo[open_[less]], hi[open_[~less]] = mid[less], mid[~less]
        return lo


# ---- writing -----------------------------------------------------------------------

def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key`` (nulls first), and what orders rows of one key: a hash of the text,
    and for equal rows, which may stand in any order, their place in the input."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text")).select(
        "id", "text", F.coalesce("id", F.lit(LEAST)).alias("key"),
        F.expr("shiftrightunsigned(xxhash64(text), 1) ^ if(id is null, -1L, 0L)").alias("hash"),   # nulls are below
        F.monotonically_increasing_id().alias("row"))


def _encoder(path: str, end_id: int, width: int, cuts: list[tuple[int, int, int]]):
    """Each document's ids as bytes, and its shard."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        end = np.array([end_id], f"<u{width}").tobytes()
        for batch in batches:
            shard = shard_of(batch, cuts)
            for lo, hi, ids, off in tokens.encode(batch.column("text")):
                data = ids.astype(f"<u{width}").tobytes()
                own = [data[width * a:width * b] + end for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[lo:hi]), *(batch.column(c).slice(lo, hi - lo) for c in ("id", "key", "hash", "row")),
                     pa.array(own, pa.binary())], names=["shard", "id", "key", "hash", "row", "ids"])

    return encode


def _writer(folder: str, width: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = files_of(folder)
        shard, out = None, None

        def close() -> pa.RecordBatch:
            out.close()
            ends = np.append(0, np.cumsum(np.array(sizes, np.int64) // width))
            index = (struct.pack(_HEAD, _MAGIC, width, len(keys), int(ends[-1]), nulls) + EliasFano.encode(ends)
                     + EliasFano.encode(np.array(keys[nulls:], np.int64)))
            with store.open_output_stream(f"{temporary}.idx", compression=None) as f:
                f.write(index)
            name = f"shard-{shard:08d}"
            for kind in ("ids", "idx"):
                store.move(f"{temporary}.{kind}", f"{path}/{name}.{kind}")
            sha.update(index)
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "name": name, "documents": len(keys), "ids": int(ends[-1]),
                "bytes": sum(sizes) + len(index), "sha256": sha.hexdigest()}])

        for batch in batches:
            begins = np.append(0, np.flatnonzero(np.diff(batch.column("shard").to_numpy())) + 1)
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(batch)]):
                if batch.column("shard")[a].as_py() != shard:
                    if out is not None:
                        yield close()
                    shard, sha, keys, sizes, nulls = batch.column("shard")[a].as_py(), hashlib.sha256(), [], [], 0
                    store.create_dir(f"{path}/_temporary", recursive=True)
                    temporary = f"{path}/_temporary/{uuid.uuid4().hex}"
                    out = store.open_output_stream(f"{temporary}.ids", compression=None)
                own = batch.slice(a, b - a)
                for data in own.column("ids"):
                    data = data.as_buffer()
                    out.write(data)
                    sha.update(data)
                    sizes.append(data.size)
                nulls += own.column("id").null_count
                keys += own.column("key").to_pylist()
        if out is not None:
            yield close()

    return write


def write_ids(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", *,
              tokenizer: str | None = None, end_id: int = 2, shard_bytes: int = 16 << 20) -> DataFrame:
    """Write the ids of all documents below ``folder``, a URI that all executors
    reach, and return the manifest ``(shard, name, documents, ids, bytes,
    sha256)``, also written as ``folder/_manifest``.

    A document is its ids by the tokenizer file, then ``end_id``. Documents come
    in ascending order of their integer id, nulls first; rows that share an id
    in an order of their own. Null and empty texts are the end id alone,
    repeated rows are written each, and other columns are not read. An empty
    table gives no files and an empty manifest. A shard holds about
    ``shard_bytes`` of text, or one longer document. A folder with a manifest is
    refused.
    """
    spark = docs.sparkSession
    prepare(spark)
    store, path = files_of(folder)
    if store.get_file_info(f"{path}/_manifest").type.name != "NotFound":
        raise FileExistsError(f"{folder} holds ids already")
    tokenizer = tokenizer or default_path()
    width = 2 if max(end_id, word_tokens(tokenizer).top) < 1 << 16 else 4
    rows = _rows(docs, id_col, text_col)
    cuts = shard_cuts(rows.select(*ORDER, F.octet_length("text").alias("bytes")), shard_bytes)
    cut = rows.mapInArrow(_encoder(tokenizer, end_id, width, cuts),
                          "shard long, id long, key long, hash long, row long, ids binary")
    manifest = cut.repartitionById(len(cuts) + 1, F.col("shard").cast("int")).sortWithinPartitions(
        "shard", "key", "hash", "row").mapInArrow(_writer(folder, width), _MANIFEST)
    manifest.write.parquet(f"{folder}/_manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")


# ---- reading ----------------------------------------------------------------------

class Shard:
    """The documents of one shard's files."""

    def __init__(self, folder: str, name: str):
        self.store, path = files_of(folder)
        self.path = f"{path}/{name}"
        with self.store.open_input_stream(f"{self.path}.idx", compression=None) as f:
            data = f.read()
        magic, self.width, self.documents, self.ids, self.nulls = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError(f"{self.path}.idx is no index of ids")
        self.starts = EliasFano(memoryview(data)[struct.calcsize(_HEAD):])
        self.keys = EliasFano(memoryview(data)[struct.calcsize(_HEAD) + self.starts.size:])

    def key(self, i: np.ndarray) -> list[int | None]:
        """The ids of the documents at places ``i``."""
        known = i[i >= self.nulls]
        found = iter(self.keys.select(known - self.nulls).tolist() if len(known) else [])
        return [None if j < self.nulls else next(found) for j in i.tolist()]

    def runs(self, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(first document, starts and end, ids)`` of runs of about ``size`` ids."""
        starts = self.starts.all()
        with self.store.open_input_stream(f"{self.path}.ids", compression=None) as f:
            lo = 0
            while lo < self.documents:
                hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + size, "right")) - 1)
                data = f.read(int(starts[hi] - starts[lo]) * self.width)
                yield lo, starts[lo:hi + 1], np.frombuffer(data, f"<u{self.width}")
                lo = hi


def _bases(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with ``base``, the ids before each shard (one row a shard)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest").withColumn(
        "base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, start, n_tokens, ids)`` of every document in the files that the
    manifest in ``folder`` lists: ``start`` counts the ids of all documents
    before it, ``ids`` are little-endian unsigned 32-bit integers (binary)."""
    prepare(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                shard = Shard(folder, name)
                for lo, starts, ids in shard.runs():
                    data, at = ids.astype("<u4").tobytes(), starts - starts[0]
                    own = [data[4 * a:4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.key(np.arange(lo, lo + len(own))), pa.int64()), pa.array(starts[:-1] + base),
                         pa.array(np.diff(starts)), pa.array(own, pa.binary())], names=["id", "start", "n_tokens", "ids"])

    files = _bases(spark, folder).select("name", "base")
    return files.repartition(spark.sparkContext.defaultParallelism * 4, "name").mapInArrow(
        read, "id long, start long, n_tokens long, ids binary")


def locate(spark: SparkSession, folder: str, positions: DataFrame, column: str = "position") -> DataFrame:
    """``(position, id, offset)`` for places in the whole id array: the document
    that holds each and the place within it. Positions that are null or outside
    the array have a null id and offset; repeated ones are answered each. Only
    the index files are read."""
    prepare(spark)
    shards = _bases(spark, folder).select("name", "base", "ids").orderBy("base").collect()     # one row a shard
    ends = np.cumsum([s["ids"] for s in shards])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).fill_null(-1).to_numpy()
            shard = np.where(at < 0, len(shards), np.searchsorted(ends, at, "right"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard)], names=["position", "shard"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[int, Shard] | None = None
        for batch in batches:
            which = batch.column("shard").to_numpy()
            for s in np.unique(which).tolist():
                at = batch.column("position").filter(pa.array(which == s))
                if s == len(shards):
                    keys, offset = pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64())
                else:
                    if opened is None or opened[0] != s:
                        opened = s, Shard(folder, shards[s]["name"])
                    local = at.to_numpy() - shards[s]["base"]
                    i = opened[1].starts.last_at_most(local)
                    keys, offset = pa.array(opened[1].key(i), pa.int64()), pa.array(local - opened[1].starts.select(i))
                yield pa.RecordBatch.from_arrays([at, keys, offset], names=["position", "id", "offset"])

    wanted = positions.select(F.col(f"`{column}`").cast("long").alias("position"))
    # several tasks may read one shard's index, so no shard needs all its positions in one
    return wanted.mapInArrow(deal, "position long, shard long").sortWithinPartitions("shard").mapInArrow(
        find, "position long, id long, offset long")
