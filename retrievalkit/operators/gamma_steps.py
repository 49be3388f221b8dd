"""The validation accuracy of NUDGE as a step function of gamma, exactly.

With x = gamma for NUDGE-M and x the angle of the move (gamma = 2 sin(x / 2))
for NUDGE-N, the score of a query and a tuned document is

* NUDGE-M: q.D + x q.u, a line;
* NUDGE-N: cos(x) q.D + sin(x) q.z up to the angle between D and u, from there
  on the constant q.u (D and u of unit length, z the unit part of u across D);
* a document that is not tuned: a constant.

A query's relevant documents have an upper envelope of a few pieces. Every other
document beats a piece on at most three intervals, whose ends have a closed
form; their union, merged as documents stream by, is all a task keeps of them.
What is left of the pieces are the intervals in which the query's best document
is relevant. Their ends are the events of a sweep: sorted by place, a running
sum gives the hits between any two events. No value of gamma is tried.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retrievalkit.functions.vectors import l2_normalize, to_double
from retrievalkit.operators.search import GROUP_BYTES, _group_rows
from retrievalkit.operators.vector_files import pair_tasks, write_vectors
from retrievalkit.session import materialised

TOL = 1e-12          # scores closer than this are equal: the smaller document id is first
LEAST = 1e-9         # (ends of stretches are rounded to it)
                     # stretches of x shorter than this are not told apart
_CELLS = 100_000     # (piece, document) pairs looked at at a time
_PAIRS = 200_000_000 # and those of a task


class Curves:
    """Scores as functions of x: ``p cos x + s sin x`` (N) or ``p + s x`` (M) up to
    ``turn``, and ``k`` from there on. One entry a document, or a row a query."""

    def __init__(self, kind: str, p, s, k, turn):
        self.kind, self.p, self.s, self.k, self.turn = kind, p, s, k, turn

    @classmethod
    def of(cls, kind: str, Q: np.ndarray, D: np.ndarray, U: np.ndarray, tuned: np.ndarray) -> Curves:
        """All queries (rows) with all documents (columns)."""
        a, e = Q @ D.T, Q @ U.T
        if kind == "nudge-m":
            return cls(kind, a, np.where(tuned, e, 0.0), np.zeros_like(a), np.full(len(D), np.inf))
        t = np.clip(np.einsum("ij,ij->i", D, U), -1.0, 1.0)
        across = np.sqrt(np.maximum(np.einsum("ij,ij->i", U - t[:, None] * D, U - t[:, None] * D), 0.0))
        moves = tuned & (across > 0)                    # u = -D stays where it is
        with np.errstate(divide="ignore", invalid="ignore"):
            z = np.where(moves, (e - t * a) / across, 0.0)
        there = tuned & (t > 0) & ~moves                # u = D already
        return cls(kind, a, z, np.where(moves | there, e, a), np.where(moves, np.arctan2(across, t), 0.0))

    def basis(self, x):
        return (np.cos(x), np.sin(x)) if self.kind == "nudge-n" else (np.ones_like(x), x)

    def at(self, x):
        one, two = self.basis(np.asarray(x, float))
        return np.where(x < self.turn, self.p * one + self.s * two, self.k)


def above(kind: str, p, s, k, lo, hi) -> list[tuple[np.ndarray, np.ndarray]]:
    """Where ``p cos x + s sin x + k > 0`` (M: ``p + s x + k``) within ``lo..hi``:
    lists of interval ends, empty where end <= begin. Never-changing values count
    by their sign."""
    if kind == "nudge-m":
        value = p + k
        flat = np.abs(s) <= TOL
        with np.errstate(divide="ignore", invalid="ignore"):
            root = -value / s
        begin = np.where(flat, np.where(value > TOL, lo, hi), np.where(s > 0, np.maximum(lo, root), lo))
        end = np.where(flat, hi, np.where(s > 0, hi, np.minimum(hi, root)))
        return [(begin, end)]
    size = np.hypot(p, s)
    flat = size <= TOL
    with np.errstate(divide="ignore", invalid="ignore"):
        v = -k / size
    peak = np.arctan2(s, p)
    half = np.where(flat, np.where(k > TOL, 9.0, 0.0), np.where(v < -1, 9.0, np.where(v >= 1, 0.0, np.arccos(np.clip(v, -1, 1)))))
    whole = half > math.pi
    out = [(np.where(whole, lo, np.maximum(lo, peak - half)), np.where(whole, hi, np.minimum(hi, peak + half)))]
    for turn in (-2 * math.pi, 2 * math.pi):
        out.append((np.where(whole, hi, np.maximum(lo, peak + turn - half)), np.minimum(hi, peak + turn + half)))
    return out


def merged(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals by row, as disjoint intervals in order."""
    step = far + 1.0
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    reach = np.maximum.accumulate(hi + row * step) - row * step
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (lo[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return row[first], lo[first], np.maximum.reduceat(hi, first) if len(first) else hi


def envelope(kind: str, c: Curves, ids: list[str], far: float) -> list[tuple[float, float, int]]:
    """Upper envelope of some documents' curves on ``0..far``: ``(from, to,
    document)``, of equal curves the smallest id."""
    pieces: list[tuple[float, float, int]] = []
    for i in sorted(range(len(ids)), key=ids.__getitem__):
        cut: list[tuple[float, float, int]] = []
        for lo, hi, j in pieces or [(0.0, far, i)]:
            marks = sorted({lo, hi, *(x for x in (c.turn[i], c.turn[j]) if lo < x < hi)})
            wins = []
            for a, b in zip(marks[:-1], marks[1:]):
                p, s, k = (u - v for u, v in zip(_form(c, i, a), _form(c, j, a)))
                wins += [(float(x), float(y)) for x, y in above(kind, p, s, k, a, b) if y - x > LEAST] if i != j else []
            at = lo
            for x, y in sorted(wins):
                if x > at:
                    cut.append((at, x, j))
                cut.append((max(x, at), y, i))
                at = max(at, y)
            if at < hi:
                cut.append((at, hi, j))
        pieces = []
        for lo, hi, j in cut:
            if pieces and pieces[-1][2] == j:
                pieces[-1] = (pieces[-1][0], hi, j)
            elif hi > lo:
                pieces.append((lo, hi, j))
    return pieces


def _form(c: Curves, i: int, x: float) -> tuple[float, float, float]:
    """The curve's formula from x on: factors of the two functions, and a constant."""
    return (c.p[i], c.s[i], 0.0) if x < c.turn[i] else (0.0, 0.0, c.k[i])


# ---- the pieces of the queries ----------------------------------------------------

_PIECE = "id string, vec array<double>"
_STRETCH = "id string, lo double, hi double, b_lo double, b_hi double"


def _pieces(kind: str, far: float, dim: int):
    """By query: its vector and the pieces of its relevant documents' envelope, a
    row each. A piece of no length stands for gamma 0 itself."""
    def pieces(key, table):
        q = np.array(table.column("q")[0].as_py())
        ids = table.column("doc_id").to_pylist()
        D, U = (np.array(table.column(c).to_pylist(), float).reshape(-1, dim) for c in ("vec", "u"))
        c = Curves.of(kind, q[None, :], D, U, table.column("tuned").to_numpy())
        c = Curves(kind, c.p[0], c.s[0], c.k[0], c.turn)
        start = c.at(np.zeros(len(ids)))
        best = min(np.flatnonzero(start >= start.max() - TOL).tolist(), key=ids.__getitem__)
        out = [(0.0, 0.0, best), *envelope(kind, c, ids, far)]
        rows = []
        for lo, hi, i in out:
            marks = [lo, *([c.turn[i]] if lo < c.turn[i] < hi else []), hi]
            rows += [(json.dumps([key[0].as_py(), ids[i]]), [*q, a, b, *_form(c, i, a)]) for a, b in zip(marks[:-1], marks[1:])]
        return pa.table({"id": pa.array([r[0] for r in rows]), "vec": pa.array([r[1] for r in rows], pa.list_(pa.float64()))})

    return pieces


def _beaten(kind: str, far: float, dim: int):
    """The stretches of each piece in which some document is better: a task's
    pieces against its strip of documents."""
    def work(groups: list, blocks) -> Iterator[pa.RecordBatch]:
        (ids, rows), = groups
        asked = [json.loads(i) for i in ids.tolist()]
        own = np.array([a[1] for a in asked])
        Q, lo, hi, P, S, K = rows[:, :dim], *rows[:, dim:].T
        one, two = Curves(kind, P, S, K, None).basis(np.stack([lo, (lo + hi) / 2, hi]))
        least = (P * one + S * two + K).min(axis=0)
        # a sinusoid may fall below the three values between them, by no more than this
        least -= np.hypot(P, S) * (hi - lo) ** 2 / 8 if kind == "nudge-n" else 0.0
        held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))

        def keep(parts) -> tuple:
            return merged(*(np.concatenate(c) for c in zip(held, *parts)), far)

        for block in blocks:
            names, m = block.vectors("<f8")
            names = names.astype(str)
            D, U, tuned = m[:, :dim], m[:, dim:2 * dim], m[:, -1] > 0
            step = max(1, _CELLS // max(1, len(names)))
            for r in range(0, len(rows), step):
                c = Curves.of(kind, Q[r:r + step], D, U, tuned)
                if kind == "nudge-n":
                    most = np.maximum(np.where(c.turn > 0, np.hypot(c.p, c.s), -np.inf), c.k)
                else:
                    most = np.maximum(c.p + c.s * lo[r:r + step, None], c.p + c.s * hi[r:r + step, None])
                i, j = np.nonzero(most >= least[r:r + step, None] - TOL)
                if not len(i):
                    continue
                p, s, k, turn = c.p[i, j], c.s[i, j], c.k[i, j], c.turn[j]
                i = i + r
                first, last = lo[i], hi[i]
                parts = []
                smaller = names[j] < own[i]
                # the point 0
                point = first == last
                value = np.where(turn > 0, p, k) - (P[i] * 1.0 + K[i])
                hit = point & ((value > TOL) | ((np.abs(value) <= TOL) & smaller))
                parts.append((i[hit], first[hit], last[hit]))
                for a, b, form in ((first, np.minimum(last, turn), (p, s, 0.0)), (np.maximum(first, turn), last, (0.0, 0.0, k))):
                    d = form[0] - P[i], form[1] - S[i], form[2] - K[i]
                    equal = (np.abs(d[0] + (d[2] if kind == "nudge-m" else 0.0)) <= TOL) & (np.abs(d[1]) <= TOL) & (
                        (kind == "nudge-m") | (np.abs(d[2]) <= TOL))
                    tie = equal & smaller & (b - a > LEAST)
                    parts.append((i[tie], a[tie], b[tie]))
                    for x, y in above(kind, *d, a, b):
                        ok = ~equal & (y - x > LEAST)
                        parts.append((i[ok], x[ok], y[ok]))
                held = keep(parts)
        row, a, b = held
        if len(row):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row].tolist(), pa.string()), pa.array(lo[row]), pa.array(hi[row]), pa.array(a), pa.array(b)],
                names=["id", "lo", "hi", "b_lo", "b_hi"])

    return work


def _left(piece):
    """A piece without the stretches where it is beaten; rows of the piece itself
    have a null ``b_lo``."""
    rows = piece.to_pylist()
    lo, hi = rows[0]["lo"], rows[0]["hi"]
    cuts = sorted((r["b_lo"], r["b_hi"]) for r in rows if r["b_lo"] is not None)
    out, at = [], lo
    if lo == hi:
        out = [] if cuts else [(lo, hi)]
    else:
        for a, b in [*cuts, (hi, hi)]:
            if a - at > LEAST:
                out.append((at, a))
            at = max(at, b)
    return pa.table({"lo": pa.array([x for x, _ in out], pa.float64()), "hi": pa.array([y for _, y in out], pa.float64())})


def _running(events: DataFrame) -> DataFrame:
    """``(x, hits)`` after each place of ``(x, change)``, in order: ranges of x are
    summed on their own, and the sums before each range (one row a range) added."""
    placed = materialised(events.repartitionByRange("x").sortWithinPartitions("x").select(
        "x", "change", F.spark_partition_id().alias("part")), "gamma-events")
    before = placed.groupBy("part").agg(F.sum("change").alias("sum")).withColumn("before", F.coalesce(F.sum("sum").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum("change").over(Window.partitionBy("part").orderBy("x"))
    return placed.withColumn("within", within).join(F.broadcast(before.select("part", "before")), "part").select(
        "x", (F.col("within") + F.col("before")).alias("hits"), "part")


def gamma_steps(doc_vecs: DataFrame, targets: DataFrame, val_query_vecs: DataFrame, val_qrels: DataFrame,
                kind: str = "nudge-n", max_gamma: float = 2.0, competitors: DataFrame | None = None) -> DataFrame:
    """Top-1 accuracy as a step function of gamma: ``(gamma_lo, gamma_hi,
    hits, accuracy, n_queries, gamma, best)``.

    One row for gamma 0 itself and one for each stretch between neighbouring
    changes up to ``max_gamma`` (NUDGE-N: at most 2), ``gamma`` its middle.
    ``best`` marks the first row of the largest accuracy. Documents with equal
    scores (within ``TOL``) rank by id; stretches below ``LEAST`` in x are not
    told apart. Zero documents have no cosine (NUDGE-N); a query whose relevant
    documents are not in the corpus is a miss everywhere, as is a query without
    a vector. ``competitors`` are extra documents that stay as they are. Without
    judged queries there are no rows.
    """
    if kind not in ("nudge-n", "nudge-m"):
        raise ValueError("kind must be 'nudge-n' or 'nudge-m'")
    spark = doc_vecs.sparkSession
    far = 2 * math.asin(min(max_gamma, 2.0) / 2) if kind == "nudge-n" else float(max_gamma)
    rel = val_qrels.where("relevance = 1").select("query_id", "doc_id").dropDuplicates()
    n = rel.select("query_id").distinct().count()
    unit = targets.select(F.col("doc_id").alias("id"), l2_normalize("g").alias("u"))
    vec = to_double("vec") if kind == "nudge-m" else l2_normalize("vec")
    docs = doc_vecs.select("id", vec.alias("vec")).join(unit, "id", "left")
    if competitors is not None:
        docs = docs.unionByName(competitors.select("id", vec.alias("vec"), F.lit(None).cast("array<double>").alias("u")))
    sizes = docs.where("vec is not null").groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count")).first()
    empty = spark.createDataFrame([], "gamma_lo double, gamma_hi double, hits long, accuracy double, n_queries long, "
                                      "gamma double, best boolean")
    if not n or sizes is None:
        return empty
    dim = sizes["d"]
    tuned = F.col("u").isNotNull() & F.exists("u", lambda x: x != 0)
    nonzero = F.lit(True) if kind == "nudge-m" else F.exists("vec", lambda x: x != 0)
    docs = materialised(docs.where((F.size("vec") == dim) & nonzero).select(
        "id", "vec", F.when(tuned, F.col("u")).otherwise(F.array_repeat(F.lit(0.0), dim)).alias("u"),
        tuned.alias("tuned")), "gamma-docs")
    q = val_query_vecs.select(F.col("id").alias("query_id"), to_double("vec").alias("q")).where(
        (F.size("q") == dim) & F.exists("q", lambda x: x != 0))
    known = rel.join(q, "query_id").join(docs.withColumnRenamed("id", "doc_id"), "doc_id")
    pieces = materialised(known.groupBy("query_id").applyInArrow(_pieces(kind, far, dim), _PIECE), "gamma-pieces")
    both = docs.select("id", F.concat("vec", "u", F.array(F.col("tuned").cast("double"))).alias("vec"))
    rows, blocks = write_vectors(pieces), write_vectors(both)
    beaten = pair_tasks(rows, dim + 5, _group_rows(dim + 5, 64, GROUP_BYTES), blocks, 2 * dim + 1,
                        _STRETCH, _beaten(kind, far, dim), task_pairs=_PAIRS)
    own = pieces.select("id", F.col("vec")[dim].alias("lo"), F.col("vec")[dim + 1].alias("hi")).select(
        "id", "lo", "hi", F.lit(None).cast("double").alias("b_lo"), F.lit(None).cast("double").alias("b_hi"))
    return _swept(own.unionByName(beaten), kind, far, n)


def _swept(beaten: DataFrame, kind: str, far: float, n: int) -> DataFrame:
    """The steps from pieces (``b_lo`` null) and the stretches where they are beaten."""
    spark = beaten.sparkSession
    left = materialised(beaten.groupBy("id", "lo", "hi").applyInArrow(_left, "lo double, hi double"), "gamma-left")
    at_zero = left.where("lo = hi").count()
    events = left.where("lo < hi").selectExpr("inline(array(struct(lo as x, 1L as change), struct(hi as x, -1L as change)))")
    events = events.unionByName(spark.createDataFrame([(0.0, 0), (far, 0)], "x double, change long"))
    events = events.groupBy(F.round("x", 9).alias("x")).agg(F.sum("change").alias("change"))
    steps = materialised(_running(events), "gamma-steps")
    # the next place of the last row of a range is the first of the next range
    first = steps.groupBy("part").agg(F.min("x").alias("first")).withColumn(
        "after", F.min("first").over(Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)))
    inner = F.lead("x").over(Window.partitionBy("part").orderBy("x"))
    rows = steps.withColumn("next", inner).join(F.broadcast(first.select("part", "after")), "part").select(
        F.col("x").alias("lo"), F.coalesce("next", "after").alias("hi"), "hits").where(f"hi - lo > {LEAST!r}")
    rows = rows.unionByName(spark.createDataFrame([(0.0, 0.0, at_zero)], "lo double, hi double, hits long"))
    to_gamma = (lambda c: 2 * F.sin(F.col(c) / 2)) if kind == "nudge-n" else F.col
    rows = materialised(rows.select(to_gamma("lo").alias("gamma_lo"), to_gamma("hi").alias("gamma_hi"), "hits",
                                    (F.col("hits") / F.lit(n)).alias("accuracy"), F.lit(n).cast("long").alias("n_queries")),
                        "gamma-rows").withColumn("gamma", (F.col("gamma_lo") + F.col("gamma_hi")) / 2)
    top = rows.orderBy(F.desc("hits"), "gamma_lo", "gamma_hi").select("gamma").first()["gamma"]
    return rows.withColumn("best", F.col("gamma") == F.lit(top))


__all__ = ["gamma_steps"]
