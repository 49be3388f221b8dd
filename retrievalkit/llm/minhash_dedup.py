"""Near-duplicate documents by tensored MinHash banding.

A plain LSH index of ``L`` tables needs ``L`` independent band hashes. Here two
collections of only ``m`` band hashes each are computed (``A`` and ``B``), and
the ``m * m`` table keys are all pairs ``(A_i, B_j)``: with ``rows`` MinHashes a
band, ``2 * m * rows`` MinHashes serve ``m**2`` tables, about the square root of
the work. A pair of similarity ``s`` shares a table if it agrees in some band
of each collection, with probability ``(1 - (1 - s**rows)**m)**2``; ``m`` is the
least that misses a pair at the threshold with probability ``miss`` or less.

Candidates are verified on full shingle sets. Buckets are never expanded into
all pairs: each bucket first links its members to one pivot, the least by one of
a few orders of ids, so that different tables try different pivots. Only where the members of a
bucket still lie in different components are the members of its band compared
block against block, across components, with a union-find that emits at most
one link per member and block pair.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrievalkit.llm import _words as W
from retrievalkit.llm._spark import keyed, prepare, stored, text_of
from retrievalkit.llm.components import components

BLOCK = 256          # members of one side of a block comparison
_SEED = 0x2545F4914F6CDD1D
_ORDERS = [0, 0x2AAAAAAAAAAAAAAA, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179]   # ids are ordered by id ^ order


def bands(threshold: float, rows: int, miss: float) -> int:
    """Bands per collection, so that a pair at ``threshold`` is missed with
    probability ``miss`` at most."""
    each = 1 - math.sqrt(1 - miss)
    return max(2, math.ceil(math.log(each) / math.log(1 - threshold ** rows)))


def _signer(k: int, rows: int, m: int, lower: bool):
    n_hash = 2 * m * rows
    state = W.mix(np.arange(1, 2 * n_hash + 1, dtype=np.uint64) * np.uint64(_SEED))
    mul, add = state[:n_hash] | np.uint64(1), state[n_hash:]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, off in W.chunks(batch.column(1)):
                words = W.Words(buf, off)
                sh, so = W.shingles(words.hashes(lower), words.first, k)
                sh, so = W.distinct(sh, so)
                n = hi - lo
                mins = np.zeros((n, n_hash), np.uint64)
                for h in range(n_hash):
                    v = sh * mul[h] + add[h]
                    v ^= v >> np.uint64(32)
                    mins[:, h] = W.run_mins(v, so, np.uint64(0))
                sets = W.run_sums(W.mix(sh + np.uint64(1)), so), W.run_sums(W.mix(sh ^ np.uint64(_SEED)), so)
                band = np.zeros((n, 2 * m), np.uint64)
                for r in range(rows):
                    band = W.mix(band + mins[:, r::rows] + np.uint64(r + 1))
                flat = pa.array(band.view(np.int64).ravel())
                size = np.diff(so)
                sig = (mins >> np.uint64(32)).astype(np.uint32).view(np.int32)
                width = lambda w: pa.array(np.arange(0, n * w + 1, w, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, n), pa.array(size, pa.int64()),
                    pa.array(sets[0].view(np.int64)), pa.array(sets[1].view(np.int64)),
                    pa.ListArray.from_arrays(width(2 * m), flat),
                    pa.ListArray.from_arrays(width(n_hash), pa.array(sig.ravel())),
                ], names=["id", "n", "s1", "s2", "band", "sig"])

    return sign


def _sets(k: int, lower: bool):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in W.chunks(batch.column(1)):
                words = W.Words(buf, off)
                sh, so = W.distinct(*W.shingles(words.hashes(lower), words.first, k))
                sets = [sh[a:b].tobytes() for a, b in zip(so[:-1], so[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["id", "words"])

    return make


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = _shared(a, b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _verify(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ok = [_linked(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), percent)
                  for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return check


def _compare_blocks(percent: int, m: int, agree: int):
    """Links across components within one pair of blocks of the members that
    agree in one band of the first collection."""
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        ids, comp = rows["id"].to_numpy(), rows["component"].to_numpy()
        block = rows["block"].to_numpy()
        size = rows["n"].to_numpy()
        sig, band = np.stack(rows["sig"].to_list()), np.stack(rows["band"].to_list())
        mine, same_block = int(rows["i"].iloc[0]), bool((block == block[0]).all())
        sets = [np.frombuffer(w, np.uint64) for w in rows["words"]]
        root = {c: c for c in set(comp.tolist())}

        def top(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for i in range(len(ids)):
            other = np.arange(i + 1, len(ids))
            if not same_block:
                other = other[block[other] != block[i]]
            other = other[comp[other] != comp[i]]
            other = other[100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])]
            other = other[(sig[other] == sig[i]).sum(axis=1) >= agree]
            if len(other):   # pairs that share a table, in the first band they share
                same = band[other] == band[i]
                other = other[(same[:, :m].argmax(axis=1) == mine) & same[:, m:].any(axis=1)]
            for j in other.tolist():
                a, b = top(comp[i]), top(comp[j])
                if a != b and _linked(sets[i], sets[j], percent):
                    root[max(a, b)] = min(a, b)
                    out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return compare


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                    k: int = 5, percent: int = 80, rows: int = 2, miss: float = 1e-4,
                    lower: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``(id, n_shingles, component)``.

    Two documents are linked if ``100 * |intersection| >= percent * |union|``
    of their sets of distinct ``k``-word shingles (A-Z lower-cased if
    ``lower``; a text of fewer words is one shingle). ``component`` is the
    smallest id that links reach. ``id_col`` holds integers.

    Null or blank texts have an empty set and no links (their component is
    their own id); a null id has a null component and never links others. Rows
    with one id are one document: their links are united. Equal sets are
    collapsed before any banding, so exact copies cost one row. Other columns
    of ``docs`` are not read. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    prepare(spark)
    m = bands(percent / 100, rows, miss)
    n_hash = 2 * m * rows
    # below this agreement a pair at the threshold is found with probability < 1e-8
    agree = max(1, math.floor(n_hash * percent / 100
                              - 6 * math.sqrt(n_hash * percent / 100 * (1 - percent / 100))))
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))
    signed = stored(source.mapInArrow(
        _signer(k, rows, m, lower),
        "id long, n long, s1 long, s2 long, band array<long>, sig array<int>"), "signed")

    # equal sets: links to the least id, which stands for the set
    known = signed.filter("n > 0 and id is not null")
    least = known.groupBy("s1", "s2").agg(F.min("id").alias("rep"))
    member = known.select("id", "s1", "s2").join(least, ["s1", "s2"]).select("id", "rep")
    same = member.filter("id != rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    # one row per (representative, set); a repeated id may stand for two sets
    reps = stored(known.join(least.withColumnRenamed("rep", "id"), ["s1", "s2", "id"], "left_semi")
                  .dropDuplicates(["s1", "s2"]).select("id", "n", "band", "sig"), "reps")

    cell = F.explode(F.expr(
        f"flatten(transform(slice(band, 1, {m}), (x, i) -> transform(slice(band, {m + 1}, {m}), "
        f"(y, j) -> struct(int(i * {m} + j) as t, xxhash64(x, y, i * {m} + j) as key))))")).alias("c")
    # the pivot is the least id in one of a few orders, so copies of one text meet few pivots in all tables
    order = f"element_at(array({', '.join(f'{o}L' for o in _ORDERS)}), t % {len(_ORDERS)} + 1)"
    keys = reps.select("id", cell).select("id", F.col("c.t").alias("t"), F.col("c.key").alias("key"))
    bucket = keys.groupBy("key").agg(F.min(F.expr(f"id ^ {order}")).alias("low"), F.min("t").alias("t"),
                                     F.count("*").alias("size"))
    bucket = bucket.filter("size > 1").select("key", "size", F.expr(f"low ^ {order}").alias("pivot"))
    inside = stored(keys.join(bucket, "key"), "buckets")

    pairs = inside.filter("id != pivot").select(
        F.least("id", "pivot").alias("u"), F.greatest("id", "pivot").alias("v")).distinct()
    info = reps.select("id", "n", "sig")
    for side in ("u", "v"):
        pairs = pairs.join(info.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"),
                                       F.col("sig").alias(f"sig_{side}")), side)
    pairs = stored(pairs.filter(f"100 * least(n_u, n_v) >= {percent} * greatest(n_u, n_v)").filter(
        "aggregate(zip_with(sig_u, sig_v, (a, b) -> if(a = b, 1, 0)), 0, (s, e) -> s + e) "
        f">= {agree}").select("u", "v").distinct(), "pairs")

    def sets_of(ids: DataFrame) -> DataFrame:
        ids = stored(ids.distinct(), "ids")
        return stored(source.join(keyed(ids, ids.count()), "id", "left_semi").mapInArrow(
            _sets(k, lower), "id long, words binary"), "sets").dropDuplicates(["id", "words"])

    sets = sets_of(pairs.select(F.col("u").alias("id")).union(pairs.select("v")))
    both = pairs
    for side in ("u", "v"):
        both = both.join(sets.select(F.col("id").alias(side), F.col("words").alias(f"w_{side}")), side)
    links = both.select("u", "v", "w_u", "w_v").mapInArrow(_verify(percent), "u long, v long")
    edges = stored(links.unionByName(same), "links")
    found = components(edges)

    # buckets of three or more whose members are not all in one component yet
    wide = inside.filter("size > 2").join(found, "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    open_ = wide.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter(
        "lo != hi").select("key")
    # the tables of one band of the first collection are compared together: a member is there once
    rest = stored(wide.join(open_, "key").select("id", "component", F.expr(f"t div {m}").alias("i")).distinct()
                  .join(reps, "id").withColumn("key", F.expr("xxhash64(i, band[i])")), "open")
    if rest.limit(1).count():
        sets = sets_of(rest.select("id"))
        size = rest.groupBy("key").agg(F.expr(f"int(ceil(count(*) / {BLOCK}))").alias("blocks"))
        rest = rest.join(size, "key").withColumn("block", F.expr("int(pmod(xxhash64(id), blocks))"))
        # a block meets itself and every other block of its bucket once
        rest = rest.withColumn("meets", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
            "key", "i", "id", "component", "block", "n", "band", "sig",
            F.least("block", "meets").alias("b1"), F.greatest("block", "meets").alias("b2"))
        more = rest.join(sets, "id").groupBy("key", "b1", "b2").applyInPandas(
            _compare_blocks(percent, m, agree), "u long, v long")
        more = stored(more, "links")
        if more.limit(1).count():
            found = components(edges.unionByName(more))

    # back to every row; a component is stored for linked ids only
    whole = signed.select("id", "n").join(stored(found, "found"), "id", "left")
    return whole.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))


def _told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text) with a ``key``: one of their own for texts that share an
    id: a hash, under a salt for which no two of these, and no other id, agree.
    Ids that have one text are their key."""
    texts = stored(rows.filter("id is not null").groupBy("id").agg(
        F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).filter("a != b").select("id"), "shared-ids")
    n = texts.count()
    if not n:
        return rows.withColumn("key", F.col("id"))
    shared = texts.withColumn("shared", F.lit(True))
    marked = rows.join(keyed(shared, n), "id", "left")
    ids = stored(rows.select("id").distinct(), "ids")
    for salt in range(64):
        key = F.xxhash64(F.lit(salt), "id", "text")
        own = stored(marked.filter("shared").select("id", F.sha2("text", 256).alias("h"), key.alias("key")).distinct(), "keys")
        clash = own.groupBy("key").count().filter("count > 1").limit(1).count() + own.join(
            ids.select(F.col("id").alias("key")), "key", "left_semi").limit(1).count()
        if not clash:
            return marked.withColumn("key", F.when(F.col("shared"), key).otherwise(F.col("id"))).drop("shared")
    raise RuntimeError("no salt tells the texts apart")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 5,
                 percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each group of
    linked texts the row with the smallest id stays (of texts that share this id
    the one with the smallest hash).

    Rows that share an id are apart unless their texts are linked or equal; of
    rows equal in id and text one stays, the least by a hash of its columns.
    Rows without an id always stay, as do null and blank texts under ids of
    their own. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    prepare(spark)
    key, mark = (f"_{name}_{uuid.uuid4().hex}" for name in ("key", "row"))
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))
    told = _told_apart(slim)
    groups = stored(near_duplicates(told.select("key", "text"), "key", "text", k=k, percent=percent).filter(
        "id is not null").groupBy("id").agg(F.min("component").alias("c"), F.count("*").alias("n")), "groups")
    # the first member of each group that has several
    member = groups.join(stored(told.filter("key is not null").select(F.col("key").alias("id"), F.col("id").alias("doc")).distinct(),
                                "members"), "id")
    first = member.groupBy("c").agg(F.min(F.struct("doc", "id")).alias("first"), F.count("*").alias("size")).filter(
        "size > 1").select("c", F.col("first.id").alias("first"))
    first = stored(first, "firsts")
    gone = stored(member.join(keyed(first, first.count()), "c").filter("id != first").select(F.col("id").alias(key)), "gone")
    again = stored(groups.filter("n > 1").select(F.col("id").alias(key)), "again")
    n_gone, n_again = gone.count(), again.count()
    whole = _keyed_rows(docs, id_col, text_col, told, key)
    out = whole.join(keyed(gone, n_gone), key, "left_anti") if n_gone else whole
    if n_again:
        few = out.join(keyed(again, n_again), key, "left_semi").withColumn(
            mark, F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
        least = few.groupBy(key).agg(F.min(mark).alias(mark))
        once = few.join(least, [key, mark], "left_semi").dropDuplicates([key]).drop(mark)
        out = out.join(keyed(again, n_again), key, "left_anti").unionByName(once)
    return out.drop(key)


def _keyed_rows(docs: DataFrame, id_col: str, text_col: str, told: DataFrame, key: str) -> DataFrame:
    """``docs`` with the key of each row."""
    whole = docs.withColumn(key, F.col(f"`{id_col}`").cast("long"))
    other = stored(told.filter("key != id").select(F.col("id").alias(key), F.sha2("text", 256).alias("_hash"),
                                                   F.col("key").alias("_own")).distinct(), "own-keys")
    n = other.count()
    if not n:
        return whole
    names = {c: f"_{c}_{uuid.uuid4().hex}" for c in ("hash", "own")}
    other = other.withColumnsRenamed({"_hash": names["hash"], "_own": names["own"]})
    found = whole.withColumn(names["hash"], F.sha2(text_of(text_col), 256)).join(
        keyed(other, n), [key, names["hash"]], "left")
    return found.withColumn(key, F.coalesce(names["own"], key)).drop(*names.values())
