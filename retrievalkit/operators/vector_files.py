"""Vectors as block files in the shared folder, and the schedule of (group of
queries, strip of documents) tasks over them.

A block is some thousand vectors in one Parquet file of one row: their ids, the
matrix, and a ball that holds them all (centre and radius). Spark writes the
blocks, so a lost task leaves none that count; only their paths and row counts
come to the driver (some 150 bytes a block of up to 8 MB), never a vector. A
task reads the block files of its queries, and then those of its strip, nearest
ball first; a block whose ball lies too far away from all its queries is not
read, by the triangle inequality, so the rows are those of a full scan.

Vectors that are null, empty, or hold a null or non-finite component are in no
block.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrievalkit.operators import _kernel
from retrievalkit.session import ensure_checkpoint_dir, shared_files, ship_package

BLOCK_ROWS = 16_384
BLOCK_BYTES = 8 << 20
TASK_PAIRS = 4_000_000_000         # pairs of vectors of one task, about half a minute of plain search
_BLOCK = ("rows int, dim int, ids array<string>, matrix binary, centre array<double>, radius double, "
          "unit_centre array<double>, unit_radius double")
_HEAD = ["centre", "radius", "unit_centre", "unit_radius"]


@dataclass(frozen=True)
class VectorBlocks:
    """Blocks on disk: ``(path, rows, dimension)`` each."""

    spark: SparkSession
    files: tuple[tuple[str, int, int], ...]
    item: str                                    # little-endian float type of the matrices

    @property
    def dim(self) -> int:
        """The most frequent dimension (of equal counts the largest), 0 if empty."""
        rows = Counter()
        for _, n, d in self.files:
            rows[d] += n
        return max(rows, key=lambda d: (rows[d], d), default=0)

    def of_dim(self, dim: int) -> list[tuple[str, int]]:
        return [(path, n) for path, n, d in self.files if d == dim]


def _packer(item: str, block_rows: int):
    """Blocks of a partition's vectors; a change of ``cluster`` ends a block."""
    def blocks(parts: list) -> Iterator[pa.RecordBatch]:
        ids, m = np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts])
        step = max(1, min(block_rows, BLOCK_BYTES // (8 * m.shape[1])))
        for lo in range(0, len(ids), step):
            own = m[lo:lo + step]
            ball = _kernel.Bounds.of(own)
            yield pa.RecordBatch.from_pylist([{
                "rows": len(own), "dim": m.shape[1], "ids": ids[lo:lo + step].tolist(),
                "matrix": own.astype(item).tobytes(), "centre": ball.centre.tolist(), "radius": ball.radius,
                "unit_centre": ball.unit_centre.tolist(), "unit_radius": ball.unit_radius}], schema=pa.schema([
                    ("rows", pa.int32()), ("dim", pa.int32()), ("ids", pa.list_(pa.string())), ("matrix", pa.binary()),
                    ("centre", pa.list_(pa.float64())), ("radius", pa.float64()),
                    ("unit_centre", pa.list_(pa.float64())), ("unit_radius", pa.float64())]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}               # by dimension
        at = None
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cluster)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if cluster[a] != at:
                    for parts in held.values():
                        yield from blocks(parts)
                    held, at = {}, cluster[a]
                vec = batch.column("vec").slice(a, b - a)
                for dim in set(pc.unique(pc.list_value_length(vec)).to_pylist()):
                    ids, m = _kernel.usable(batch.column("id").slice(a, b - a), vec, dim)
                    if not len(ids):
                        continue
                    parts = held.setdefault(dim, [])
                    parts.append((ids, m))
                    rows = sum(len(i) for i, _ in parts)
                    if rows >= block_rows or rows * dim * 8 >= BLOCK_BYTES:
                        yield from blocks(held.pop(dim))
        for parts in held.values():
            yield from blocks(parts)

    return pack


def _clustered(rows: DataFrame, clusters: int, block_rows: int, sample: int, seed: int) -> DataFrame:
    """Rows with the nearest of ``clusters`` k-means centres, each centre's rows
    side by side in tasks of a few blocks, so that a crowded one is many blocks.
    The centres are fitted on about ``sample`` rows, chosen by a hash of the id;
    they decide where rows stand, not what a search returns."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sound = rows.where("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    counts = sound.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if counts is None:
        return rows.withColumn("cluster", F.lit(0))
    usual = sound.where(F.size("vec") == counts["d"]).withColumn("v", array_to_vector("vec"))
    share = min(1.0, sample / counts["count"])
    picked = usual.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    model = KMeans(k=clusters, maxIter=8, seed=seed, featuresCol="v", predictionCol="cluster").fit(picked)
    dealt = model.transform(usual).select("id", "vec", "cluster")
    sizes = dealt.groupBy("cluster").count().select(
        "cluster", F.expr(f"int(ceil(count / {4 * block_rows}))").alias("parts"))          # a row a cluster
    dealt = dealt.join(F.broadcast(sizes), "cluster").withColumn("part", F.expr("pmod(xxhash64(id), parts)"))
    tasks = max(1, math.ceil(counts["count"] / (4 * block_rows)) + clusters)
    return dealt.repartition(tasks, "cluster", "part").sortWithinPartitions("cluster").select("id", "vec", "cluster")


def write_vectors(vectors: DataFrame, id_col: str = "id", vec_col: str = "vec", *, block_rows: int = BLOCK_ROWS,
                  clusters: int = 0, sample: int = 20_000, seed: int = 42) -> VectorBlocks:
    """The vectors as block files. With ``clusters`` they are first put in order
    by k-means centres, so that blocks are small balls and searches leave out
    most of them; vectors of an unusual length are then dropped at once."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).alias("vec")).where(
        "id is not null and vec is not null and size(vec) > 0")
    item = "<f4" if dict(rows.dtypes)["vec"] == "array<float>" else "<f8"
    rows = _clustered(rows, clusters, block_rows, sample, seed) if clusters else rows.withColumn("cluster", F.lit(0))
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    rows.mapInArrow(_packer(item, block_rows), _BLOCK).write.option("maxRecordsPerFile", 1).parquet(folder)
    found = spark.read.schema(_BLOCK).parquet(folder).select(
        F.col("_metadata.file_path").alias("path"), "rows", "dim").collect()
    return VectorBlocks(spark, tuple(sorted(map(tuple, found))), item)


class BlockFile:
    """One block, read in parts: first the ball, then, if need be, the vectors."""

    def __init__(self, path: str):
        import pyarrow.parquet as pq

        store, where = shared_files(path)
        self.file = pq.ParquetFile(store.open_input_file(where))
        self.rows = self.file.read(columns=["rows"]).column(0)[0].as_py()

    def ball(self) -> _kernel.Bounds:
        row = self.file.read(columns=_HEAD).to_pylist()[0]
        return _kernel.Bounds(np.array(row["centre"]), row["radius"], np.array(row["unit_centre"]), row["unit_radius"])

    def vectors(self, item: str, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        table = self.file.read(columns=["ids", "matrix"])
        ids = np.array(table.column("ids")[0].as_py(), dtype=object)
        m = np.frombuffer(table.column("matrix")[0].as_buffer(), item).reshape(self.rows, -1)
        return ids[lo:hi], m[lo:hi].astype(np.float64)


def groups_of(blocks: list[tuple[str, int]], rows: int) -> list[list[tuple[str, int, int]]]:
    """The blocks cut into groups of at most ``rows`` vectors: lists of
    ``(path, first, end)``."""
    out, room = [], 0
    for path, n in blocks:
        at = 0
        while at < n:
            if not room:
                out.append([])
                room = rows
            take = min(room, n - at)
            out[-1].append((path, at, at + take))
            at, room = at + take, room - take
    return out


def pair_tasks(queries: VectorBlocks, q_dim: int, group_rows: int, corpus: VectorBlocks, c_dim: int, schema: str,
               work: Callable[[list[tuple[np.ndarray, np.ndarray]], Iterator[BlockFile]], Iterator[pa.RecordBatch]], *,
               bundle_rows: int = 0, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Every group of queries against every block of documents: ``work(groups,
    blocks)`` for some groups, each ``(ids, matrix)``, and one strip of the blocks
    is one task. Small groups of together at most ``bundle_rows`` queries share a
    task, which then reads its blocks once. A task has at most about ``task_pairs``
    pairs of vectors, so more vectors make more tasks, not longer ones. The
    plan is one scan of task numbers, whatever the number of blocks."""
    spark = queries.spark
    asked = sum(n for _, n in queries.of_dim(q_dim))
    if asked:                                        # groups of like size
        group_rows = math.ceil(asked / math.ceil(asked / group_rows))
    groups = groups_of(queries.of_dim(q_dim), group_rows)
    blocks = corpus.of_dim(c_dim)
    files = [path for path, _ in blocks]
    if not groups or not files:
        return spark.createDataFrame([], schema)
    slots = spark.sparkContext.defaultParallelism
    each = max(1, min(bundle_rows // group_rows, math.ceil(len(groups) / (2 * slots))))
    bundles = [groups[i:i + each] for i in range(0, len(groups), each)]
    pairs = min(each * group_rows, asked) * sum(n for _, n in blocks)
    strips = min(len(files), max(1, math.ceil(2 * slots / len(bundles)), math.ceil(pairs / task_pairs)))
    handle = spark.sparkContext.broadcast((bundles, files))      # paths
    item = queries.item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundles, files = handle.value
        for batch in batches:
            for task in batch.column(0).to_pylist():
                g, s = divmod(task, strips)
                own = []
                for group in bundles[g]:
                    parts = [BlockFile(path).vectors(item, a, b) for path, a, b in group]
                    own.append((np.concatenate([i for i, _ in parts]), np.concatenate([m for _, m in parts])))
                yield from work(own, map(BlockFile, files[s::strips]))

    n = len(bundles) * strips
    return spark.range(0, n, 1, n).mapInArrow(run, schema)


__all__ = ["VectorBlocks", "BlockFile", "write_vectors", "pair_tasks", "groups_of"]
