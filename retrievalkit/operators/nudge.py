"""Corpus-vector tuning without a model (NUDGE, arXiv 2409.02343) as table
aggregation (N1-N7).

D = a document vector, G = the sum of the vectors of the training queries whose
answer it is, u = G / |G|, t = u.D.

* NUDGE-M: D' = D + gamma * u (not unit length; searched with dot).
* NUDGE-N: D' on the unit sphere with |D' - D| <= gamma maximising u.D':
  D' = u when t >= 1 - gamma^2/2, else D' = c D + s z with
  c = 1 - gamma^2/2, s = gamma sqrt(1 - gamma^2/4), z = unit(u - t D);
  z undefined (u = -D) leaves D unchanged.
* gamma: the value with the best top-1 accuracy on validation queries, ties to
  the smaller; 0 (no change) is always a candidate. ``choose_gamma`` tries the
  values of a grid, ``gamma_steps`` finds the best of all values.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrievalkit.functions.vectors import axpy, dot, l2_normalize, sq_l2, to_double
from retrievalkit.operators import _kernel
from retrievalkit.operators.gamma_steps import gamma_steps
from retrievalkit.operators.search import GROUP_BYTES, _group_rows
from retrievalkit.operators.topk import KeptRun, best_of, insert_docs
from retrievalkit.operators.vector_files import VectorBlocks, pair_tasks, write_vectors
from retrievalkit.session import materialised

KINDS = ("nudge-n", "nudge-m")
SCAN_PAIRS = 500_000_000         # (query, document) pairs of a task, each scored for the whole grid
SCAN_CELLS = 250_000             # (query, document) pairs that a task holds scores of at a time
DEFAULT_GRID = tuple(round(0.1 * i, 1) for i in range(0, 21))   # 0.0 .. 2.0


def nudge_targets(query_vecs: DataFrame, qrels: DataFrame, train_ids: DataFrame) -> DataFrame:
    """``(doc_id, g array<double>)`` = sum of the training query vectors
    answered by each document. A query with several answers adds to each;
    documents without training queries get no row.

    ``Summarizer.sum`` is a JVM aggregate with map-side combine, so a document
    answering a third of all queries is summed in partial aggregates.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    pos = (qrels.where("relevance = 1").select("query_id", "doc_id").dropDuplicates()
           .join(train_ids.select("query_id").distinct(), "query_id", "left_semi"))
    qv = query_vecs.select(F.col("id").alias("query_id"), F.col("vec"))
    j = pos.join(qv, "query_id").where(F.col("vec").isNotNull())
    return (j.groupBy("doc_id").agg(Summarizer.sum(array_to_vector("vec")).alias("g"))
            .select("doc_id", vector_to_array("g").alias("g")))


def _unit_targets(targets: DataFrame) -> DataFrame:
    return targets.select("doc_id", l2_normalize("g").alias("u"))


def with_unit_targets(doc_vecs: DataFrame, targets: DataFrame) -> DataFrame:
    """``(id, vec array<double>, u)``: each document with its unit target
    (NULL when it has no training query)."""
    t = _unit_targets(targets).withColumnRenamed("doc_id", "id")
    return doc_vecs.select("id", to_double("vec").alias("vec")).join(t, "id", "left")


def _moved_m(j: DataFrame, gamma: float) -> DataFrame:
    new = F.when(F.col("u").isNotNull() & (F.lit(gamma) != 0.0),
                 axpy(F.lit(float(gamma)), F.col("u"), F.col("vec"))).otherwise(F.col("vec"))
    return j.select("id", new.alias("vec"))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _moved_n(j: DataFrame, gamma: float) -> DataFrame:
    g = float(gamma)
    c = 1.0 - g * g / 2.0
    s = g * math.sqrt(1.0 - g * g / 4.0) if g <= 2.0 else 0.0

    def towards(t, zr, zn):
        z = F.transform(zr, lambda x: x / zn)
        moved = F.zip_with("vec", z, lambda d, zz: F.lit(c) * d + F.lit(s) * zz)
        return F.when(t >= F.lit(c), F.col("u")).when(zn > 0, moved).otherwise(F.col("vec"))

    def across(t, zr):                                   # u - t D
        return _bound(F.sqrt(F.aggregate(F.transform(zr, lambda x: x * x), F.lit(0.0), lambda a, x: a + x)),
                      lambda zn: towards(t, zr, zn))

    # each sum is bound once: inside the inner functions it would be computed anew for every element
    new = F.when(F.col("u").isNull() | (F.lit(g) == 0.0), F.col("vec")).otherwise(_bound(dot("u", "vec"), lambda t: _bound(
        F.zip_with("u", "vec", lambda a, b: a - t * b), lambda zr: across(t, zr))))
    return j.select("id", new.alias("vec"))


def nudge_m(doc_vecs: DataFrame, targets: DataFrame, gamma: float) -> DataFrame:
    """``(id, vec array<double>)`` with D' = D + gamma u for targeted docs."""
    return _moved_m(with_unit_targets(doc_vecs, targets), gamma)


def nudge_n(doc_vecs: DataFrame, targets: DataFrame, gamma: float) -> DataFrame:
    """``(id, vec array<double>)`` on the unit sphere, chord <= gamma."""
    return _moved_n(with_unit_targets(doc_vecs, targets), gamma)


def apply_nudge(doc_vecs: DataFrame, targets: DataFrame, gamma: float, kind: str) -> DataFrame:
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    return (nudge_n if kind == "nudge-n" else nudge_m)(doc_vecs, targets, gamma)


def _seq_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise sequential double sums, as Spark's ``aggregate`` adds them."""
    acc = np.zeros(len(a))
    for j in range(a.shape[1]):
        acc += a[:, j] * b[:, j]
    return acc


def _chord(gamma: float) -> tuple[float, float]:
    g = float(gamma)
    return 1.0 - g * g / 2.0, g * math.sqrt(1.0 - g * g / 4.0) if g <= 2.0 else 0.0


def _moved_rows(D: np.ndarray, U: np.ndarray, gamma: np.ndarray, kind: str) -> np.ndarray:
    """The closed forms of ``_moved_m`` / ``_moved_n`` for rows of matrices,
    one gamma per row."""
    if kind == "nudge-m":
        return np.where((gamma != 0.0)[:, None], gamma[:, None] * U + D, D)
    cs = np.array([_chord(g) for g in gamma]).reshape(-1, 2)
    c, s = cs[:, 0], cs[:, 1]
    t = _seq_dot(U, D)
    zr = U - t[:, None] * D
    zn = np.sqrt(_seq_dot(zr, zr))
    with np.errstate(divide="ignore", invalid="ignore"):
        moved = c[:, None] * D + s[:, None] * (zr / zn[:, None])
    out = np.where((zn > 0)[:, None], moved, D)
    out = np.where((t >= c)[:, None], U, out)
    return np.where((gamma == 0.0)[:, None], D, out)


class _Shape:
    """Moved documents in the plane of D and of z, which has unit length and
    points from D towards u (NUDGE-M: of D and u): the score of a query q for a
    gamma is ``a q.D + b q.z``."""

    def __init__(self, D: np.ndarray, U: np.ndarray | None, kind: str):
        self.kind, self.sides = kind, [D]
        dd = _seq_dot(D, D)
        self.rows = {"d": np.sqrt(dd)}
        if U is not None and kind == "nudge-m":
            self.sides.append(U)
            self.rows["z"] = np.sqrt(_seq_dot(U, U))
        elif U is not None:
            t = _seq_dot(U, D)
            across = U - t[:, None] * D
            zn = np.sqrt(_seq_dot(across, across))
            Z = across / np.where(zn > 0, zn, 1.0)[:, None]
            self.sides.append(Z)
            self.rows |= {"t": t, "zn": zn, "un": np.sqrt(_seq_dot(U, U)), "z": np.sqrt(_seq_dot(Z, Z)), "dz": _seq_dot(D, Z)}

    @property
    def longest(self) -> float:
        return float(max(self.rows["d"].max(), self.rows.get("z", self.rows["d"]).max()))

    def part(self, some: slice) -> _Shape:
        out = object.__new__(_Shape)
        out.kind, out.sides, out.rows = self.kind, [m[some] for m in self.sides], {k: v[some] for k, v in self.rows.items()}
        return out

    def mix(self, gamma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """``a``, ``b``, the documents without a score, and the most ``|a D| + |b z|``."""
        r, none = self.rows, np.zeros(0, np.int64)
        d, z = r["d"], r.get("z", np.zeros(len(r["d"])))
        if self.kind == "nudge-m":
            a, b = np.ones(len(d)), np.full(len(d), gamma)
            return a, b, none, float((d + abs(gamma) * z).max())
        a, b = np.ones(len(d)), np.zeros(len(d))
        norm = d
        if gamma != 0.0:
            c, s = _chord(gamma)
            moves, there = r["zn"] > 0, r["t"] >= c
            a = np.where(there, r["t"], np.where(moves, c, 1.0))
            b = np.where(there, r["zn"], np.where(moves, s, 0.0))
            moved = np.sqrt(np.maximum(c * c * d * d + s * s * z * z + 2 * c * s * r["dz"], 0.0))
            norm = np.where(there, r["un"], np.where(moves, moved, d))
        gone = np.flatnonzero(norm == 0)
        norm = np.where(norm > 0, norm, 1.0)
        a, b = a / norm, b / norm
        return a, b, gone, float((np.abs(a) * d + np.abs(b) * z).max())


class _GammaScan:
    """Best touched document per (gamma, query) over a stream of documents.

    A document enters by three numbers per query and document only (q.D, q.u
    and t = u.D): the score for every gamma follows from them. Pairs within the
    kernel's margin of the best are scored again on the moved vector with the
    exact sums, so ranks are those of a search per gamma. Pairs are looked at
    ``cells`` at a time, however many queries and documents meet.

    ``bar`` gives the scan a document to beat, ``(score, document)`` per (gamma,
    query), -inf for none. It then finds where some document ranks before it
    (``lost``), and leaves a (gamma, query) alone as soon as one does."""

    def __init__(self, q_ids: np.ndarray, Q: np.ndarray, grid: list[float], kind: str, cells: int = SCAN_CELLS,
                 bar: tuple[np.ndarray, np.ndarray] | None = None):
        self.q_ids, self.Q, self.grid, self.kind, self.cells = q_ids, Q, grid, kind, cells
        self.qn = _kernel.seq_sq_norms(Q)
        self.score = np.full((len(grid), len(q_ids)), -np.inf)
        self.doc = np.full((len(grid), len(q_ids)), None, dtype=object)
        if bar is not None:
            self.score, self.doc = bar
            self.barred = self.score > -np.inf
            self.open = self.barred.copy()
            self.looked = 0                          # scores made in the products

    def _mix(self, gamma: float, t, dn, un) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By document the factors of q.D and q.u in the score for a unit query
        (NUDGE-M: any query), and whether they are too close to tell: such a
        document is scored exactly. Not finite where there is no score."""
        if self.kind == "nudge-m":
            return np.ones(len(t)), np.full(len(t), gamma), np.zeros(len(t), bool)
        c, s = _chord(gamma)
        zn = np.sqrt(np.maximum(un - 2 * t * t + t * t * dn, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            norm = np.sqrt(c * c * dn + s * s + 2 * c * s * (t - t * dn) / zn)
            moved = zn > 1e-7
            a, b = np.where(moved, (c - s * t / zn) / norm, np.nan), np.where(moved, s / zn / norm, np.nan)
            at_u = t >= c
            a, b = np.where(at_u, 0.0, a), np.where(at_u, 1.0 / np.sqrt(un), b)
            if gamma == 0.0:
                a, b = 1.0 / np.sqrt(dn), np.zeros(len(t))
        return a, b, ~(np.isfinite(a) & np.isfinite(b)) & (dn > 0)

    def add(self, d_ids: np.ndarray, D: np.ndarray, U: np.ndarray) -> None:
        if not len(d_ids) or not len(self.q_ids):
            return
        t, dn, un = _seq_dot(U, D), _seq_dot(D, D), _seq_dot(U, U)
        wide = min(len(d_ids), self.cells)
        step = max(1, self.cells // wide)
        asked = np.arange(len(self.q_ids)) if self.kind == "nudge-m" else np.flatnonzero(self.qn > 0)
        for a in range(0, len(d_ids), wide):
            some = slice(a, a + wide)
            mixes = [self._mix(gamma, t[some], dn[some], un[some]) for gamma in self.grid]
            for q in range(0, len(asked), step):
                self._add(asked[q:q + step], d_ids[some], D[some], U[some], mixes)

    def _add(self, own: np.ndarray, d_ids: np.ndarray, D: np.ndarray, U: np.ndarray, mixes: list) -> None:
        Q, qn = self.Q[own], self.qn[own]
        unit = Q if self.kind == "nudge-m" else Q / np.sqrt(qn)[:, None]
        G0, G1 = unit @ D.T, unit @ U.T
        S, part = np.empty_like(G0), np.empty_like(G0)
        for n, (a, b, close) in enumerate(mixes):
            with np.errstate(invalid="ignore"):
                np.multiply(G0, a, out=S)
                np.multiply(G1, b, out=part)
                S += part
            most = S.max(axis=1)
            if not np.isfinite(most).all():
                S[~np.isfinite(S)] = -np.inf
                most = S.max(axis=1)
            best = np.maximum(most, self.score[n, own])
            least = best - _kernel._margin(best)
            rows = np.flatnonzero((most >= least) & (most > -np.inf))
            qi, di = np.nonzero(S[rows] >= np.maximum(least[rows], -1e308)[:, None])
            qi = rows[qi]
            if close.any():
                more = np.flatnonzero(close)
                qi, di = np.append(qi, np.repeat(np.arange(len(own)), len(more))), np.append(di, np.tile(more, len(own)))
            if len(qi):
                self._merge(n, own, Q, qn, qi, di, d_ids, D, U)

    def _merge(self, n: int, own: np.ndarray, Q, qn, qi, di, d_ids, D, U) -> None:
        """The exact scores of some pairs, and the best of them by query."""
        rows, back = np.unique(di, return_inverse=True)
        M = _moved_rows(D[rows], U[rows], np.full(len(rows), self.grid[n]), self.kind)
        exact = _kernel.round_half_up(_kernel.exact_scores(
            Q, M, qi, back, search_metric(self.kind), qn, _kernel.seq_sq_norms(M)))
        ok = ~np.isnan(exact) & (exact >= self.score[n, own[qi]])
        qi, ids, exact = own[qi[ok]], d_ids[di[ok]].astype(str), exact[ok]
        order = np.lexsort((ids, -exact, qi))
        qi, ids, exact = qi[order], ids[order], exact[order]
        one = np.append(True, qi[1:] != qi[:-1])[:len(qi)]
        for q, i, v in zip(qi[one].tolist(), ids[one].tolist(), exact[one].tolist()):
            if v > self.score[n, q] or i < self.doc[n, q]:
                self.score[n, q], self.doc[n, q] = v, i

    def beat(self, d_ids: np.ndarray, D: np.ndarray, U: np.ndarray | None) -> None:
        """Documents against the bars; without ``U`` they do not move. A few go
        first: most bars that fall do so at once."""
        at, wide = 0, 64
        shape = _Shape(D, U, self.kind)
        while at < len(d_ids) and self.open.any():
            some = slice(at, at + wide)
            self._beat(d_ids[some], D[some], None if U is None else U[some], shape.part(some))
            at, wide = at + wide, min(2 * wide, _kernel.TILE, self.cells)

    def _beat(self, d_ids, D, U, shape: _Shape) -> None:
        asked = np.flatnonzero(self.open.any(axis=0))
        unit = self.Q[asked] if self.kind == "nudge-m" else _kernel.unit(self.Q[asked], self.qn[asked])
        size = np.sqrt(_kernel.seq_sq_norms(unit))
        mixes = [shape.mix(gamma) for gamma in (self.grid if U is not None else [0.0])]
        # of doubles where floats might not hold a product; float32 sums are off by no more than ``error`` times the query
        fits = size.max() * max(1.0, shape.longest) * max(1.0, max(w for *_, w in mixes)) < 1e30
        kind = np.float32 if fits else float
        error = [(D.shape[1] + 12) * 2.0 ** -23 * w if fits else 0.0 for *_, w in mixes]
        left, right = unit.astype(kind), [m.astype(kind) for m in shape.sides]
        factors = [(a.astype(kind), b.astype(kind)) for a, b, _, _ in mixes]
        step = max(1, self.cells // len(d_ids))
        for lo in range(0, len(asked), step):
            own = asked[lo:lo + step]
            G = [left[lo:lo + step] @ m.T for m in right]
            for n, ((a, b), (_, _, gone, _)) in enumerate(zip(factors, mixes)):
                of = [n] if U is not None else list(range(len(self.grid)))
                rows = np.flatnonzero(self.open[of][:, own].any(axis=0))
                if not len(rows):
                    continue
                parts = G if len(rows) == len(own) else [x[rows] for x in G]
                S = parts[0] * a
                if U is not None:
                    S += parts[1] * b
                if not fits:
                    S[~np.isfinite(S)] = -np.inf
                S[:, gone] = -np.inf
                self.looked += S.size
                most = S.max(axis=1).astype(float)
                bar = self.score[of][:, own[rows]]
                slack = _kernel._margin(bar) + error[n] * size[lo:lo + step][rows]
                is_open = self.open[of][:, own[rows]]
                sure = is_open & (most > bar + slack)
                near = is_open & ~sure & (most >= bar - slack)
                for i, g in enumerate(of):
                    self.open[g, own[rows[sure[i]]]] = False
                    some = np.flatnonzero(near[i])
                    if len(some):
                        qi, di = np.nonzero(S[some] >= (bar[i] - slack[i])[some, None])
                        self._close(g, own[rows[some[qi]]], di, d_ids, D, U)

    def _close(self, g: int, qi, di, d_ids, D, U) -> None:
        """The exact scores of some pairs against the bars of a gamma."""
        rows, back = np.unique(di, return_inverse=True)
        M = D[rows] if U is None else _moved_rows(D[rows], U[rows], np.full(len(rows), self.grid[g]), self.kind)
        exact = _kernel.round_half_up(_kernel.exact_scores(
            self.Q, M, qi, back, search_metric(self.kind), self.qn, _kernel.seq_sq_norms(M)))
        bar = self.score[g, qi]
        self.open[g, qi[exact > bar]] = False
        for q, d in zip(qi[exact == bar].tolist(), di[exact == bar].tolist()):
            if d_ids[d] < self.doc[g, q]:
                self.open[g, q] = False

    def lost(self) -> pa.RecordBatch:
        """By query the places in the grid at which its bar fell."""
        fell = self.barred & ~self.open
        q = np.flatnonzero(fell.any(axis=0))
        return pa.RecordBatch.from_arrays([
            pa.array(self.q_ids[q].tolist(), pa.string()),
            pa.array([np.flatnonzero(fell[:, i]).tolist() for i in q], pa.list_(pa.int32()))], names=["id", "lost"])

    def result(self) -> pa.RecordBatch:
        g, q = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([
            pa.array(np.array(self.grid)[g], pa.float64()), pa.array(self.q_ids[q].tolist(), pa.string()),
            pa.array(self.doc[g, q].tolist(), pa.string()), pa.array(self.score[g, q])],
            names=["gamma", "query_id", "doc_id", "score"])


def _finite(column: str) -> Column:
    return F.expr(f"forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def _own_scores(pairs: DataFrame, dim: int, grid: list[float], kind: str) -> DataFrame:
    """``(query_id, doc_id, scores)`` of ``(query_id, doc_id, q, vec, u)``, a score
    per gamma as a search of the moved vectors has it (null: none); a null ``u``
    stands for a document that does not move."""
    sound = [F.size(c).eqNullSafe(dim) & _finite(c) for c in ("q", "vec")]
    sound.append(F.col("u").isNull() | (F.size("u").eqNullSafe(dim) & _finite("u")))
    metric = search_metric(kind)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            moves = batch.column("u").is_valid().to_numpy(zero_copy_only=False)
            own = np.arange(n)
            Q, D = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, dim) for c in ("q", "vec"))
            U = np.zeros((n, dim))
            U[moves] = batch.column("u").filter(batch.column("u").is_valid()).flatten().to_numpy(
                zero_copy_only=False).reshape(-1, dim)
            qn, out = _kernel.seq_sq_norms(Q), []
            for gamma in grid:
                M = D.copy()
                M[moves] = _moved_rows(D[moves], U[moves], np.full(int(moves.sum()), gamma), kind)
                out.append(_kernel.round_half_up(_kernel.exact_scores(Q, M, own, own, metric, qn, _kernel.seq_sq_norms(M))))
            flat = np.stack(out, axis=1).ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column("query_id"), batch.column("doc_id"),
                pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(grid) + 1, len(grid)), pa.int32()),
                                         pa.array(flat, pa.float64(), from_pandas=True))],
                names=["query_id", "doc_id", "scores"])

    return pairs.where(sound[0] & sound[1] & sound[2]).mapInArrow(
        scores, "query_id string, doc_id string, scores array<double>")


def _bars(own: DataFrame, queries: DataFrame, size: int) -> DataFrame:
    """By query the best of ``(query_id, doc_id, scores, relevant)`` at every gamma:
    ``(id, vec)``, ``id`` a JSON of the query and its documents, ``vec`` the query,
    the scores, and which document has each, -1 where it is none or not relevant."""
    best = own.groupBy("query_id").agg(*[
        F.min(F.when(F.col("scores")[i].isNotNull(), F.struct((-F.col("scores")[i]).alias("s"), "doc_id", "relevant"))).alias(f"b{i}")
        for i in range(size)])
    best = best.select("query_id", F.array(*[f"b{i}" for i in range(size)]).alias("best"))
    docs = F.array_distinct(F.transform(F.filter("best", lambda b: b["relevant"]), lambda b: b["doc_id"]))
    vec = F.concat("q", F.transform("best", lambda b: F.coalesce(F.lit(0.0) - b["s"], F.lit(0.0))), F.transform(
        "best", lambda b: F.when(b["relevant"], F.array_position("docs", b["doc_id"]) - 1.0).otherwise(-1.0)))
    return best.withColumn("docs", docs).where(F.size("docs") > 0).join(queries, "query_id").select(
        F.to_json(F.struct("query_id", "docs")).alias("id"), vec.alias("vec"))


def _standing(bars: DataFrame, docs: VectorBlocks, dim: int, grid: list[float], kind: str, moves: bool) -> DataFrame:
    """The bars (as ``_bars`` gives them) that hold against some documents, whose
    blocks have D and u side by side if they move."""
    size, rows = len(grid), write_vectors(bars)
    width, item = dim + 2 * size, docs.item

    def work(groups: list, blocks) -> Iterator[pa.RecordBatch]:
        (ids, m), = groups
        names = [json.loads(i)["docs"] for i in ids.tolist()]
        which = m[:, dim + size:].T.astype(int)
        doc = np.array([[d[w] if w >= 0 else None for d, w in zip(names, row)] for row in which.tolist()], object)
        score = np.where(which >= 0, m[:, dim:dim + size].T, -np.inf)
        scan = _GammaScan(ids, np.ascontiguousarray(m[:, :dim]), grid, kind, bar=(score, doc))
        for block in blocks:
            if not scan.open.any():
                break
            d_ids, d = block.vectors(item)
            scan.beat(d_ids, d[:, :dim], d[:, dim:] if moves else None)
        yield scan.lost()

    lost = pair_tasks(rows, width, _group_rows(width, size, GROUP_BYTES), docs, 2 * dim if moves else dim,
                      "id string, lost array<int>", work, task_pairs=SCAN_PAIRS)
    lost = lost.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("lost"))).alias("lost"))
    fell = lambda x, i: F.when((i >= dim + size) & F.array_contains("lost", i - (dim + size)), -1.0).otherwise(x)
    left = bars.join(lost.hint("merge"), "id", "left").select(
        "id", F.when(F.col("lost").isNull(), F.col("vec")).otherwise(F.transform("vec", fell)).alias("vec"))
    return materialised(left.where(F.exists(F.slice("vec", dim + size + 1, size), lambda x: x >= 0)), "gamma-bars")


def search_metric(kind: str) -> str:
    return "cosine" if kind == "nudge-n" else "dot"


def choose_gamma(doc_vecs: DataFrame, targets: DataFrame, val_query_vecs: DataFrame,
                 val_qrels: DataFrame, kind: str = "nudge-n", grid=DEFAULT_GRID,
                 competitors: DataFrame | None = None, rivals: DataFrame | None = None) -> DataFrame:
    """Accuracy of every grid value -> ``(gamma, accuracy, n_queries,
    best)`` (``best`` marks the chosen one).

    Top-1 accuracy over the tuned corpus of all judged validation queries; a
    query that finds nothing counts as a miss. A query is a hit where no document
    ranks before the best of its relevant ones, so that one is scored first, and
    every other document is held against it: the untouched ones, which do not
    depend on gamma, once, then the touched ones for the whole grid
    (``_GammaScan``). A query leaves at a gamma when a document beats it there.
    ``competitors`` are extra fixed vectors (N6: the existing corpus);
    ``rivals`` stands for such vectors by the best of them per query,
    ``(query_id, doc_id, score)`` as R1 scores it.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    spark = doc_vecs.sparkSession
    grid = sorted(set(float(x) for x in grid) | {0.0})
    rel = val_qrels.where("relevance = 1").select("query_id", "doc_id").dropDuplicates()
    asked = rel.select("query_id").distinct()
    vq = val_query_vecs.join(asked.select(F.col("query_id").alias("id")), "id", "left_semi").select(
        F.col("id").alias("query_id"), to_double("vec").alias("q"))
    usual = vq.where(_finite("q") & (F.size("q") > 0)).groupBy(F.size("q").alias("d")).count().orderBy(
        F.desc("count"), F.desc("d")).first()
    dim = usual["d"] if usual else 0
    tids = targets.select(F.col("doc_id").alias("id"))
    touched = with_unit_targets(doc_vecs.join(tids, "id", "left_semi"), targets).where("u is not null")
    fixed = doc_vecs.join(tids, "id", "left_anti")
    if competitors is not None:
        fixed = fixed.select("id", to_double("vec").alias("vec")).unionByName(
            competitors.select("id", to_double("vec").alias("vec")))
    touched, fixed = materialised(touched, "gamma-touched"), materialised(fixed, "gamma-fixed")
    unmoved = fixed.select("id", to_double("vec").alias("vec"), F.lit(None).cast("array<double>").alias("u"))
    pairs = rel.join(vq, "query_id").join(touched.unionByName(unmoved).withColumnRenamed("id", "doc_id"), "doc_id")
    own = _own_scores(pairs.select("query_id", "doc_id", "q", "vec", "u"), dim, grid, kind).withColumn("relevant", F.lit(True))
    if rivals is not None:
        known = rel.withColumn("relevant", F.lit(True))
        own = own.unionByName(rivals.join(known, ["query_id", "doc_id"], "left").select(
            "query_id", "doc_id", F.array_repeat("score", len(grid)).alias("scores"), F.coalesce("relevant", F.lit(False)).alias("relevant")))
    bars = materialised(_bars(own, vq, len(grid)), "gamma-bars")
    both = touched.select("id", F.when(
        (F.size("vec") == dim) & (F.size("u") == dim), F.concat("vec", "u")).alias("vec"))
    for docs, moves in ((fixed, False), (both, True)):
        bars = _standing(bars, write_vectors(docs), dim, grid, kind, moves)
    held = bars.select(F.posexplode(F.slice("vec", dim + len(grid) + 1, len(grid))).alias("i", "which")).where("which >= 0")
    hits = held.groupBy("i").agg(F.count("*").alias("hits"))
    n = asked.count()
    whole = spark.createDataFrame(list(enumerate(grid)), "i int, gamma double").join(hits, "i", "left")
    acc = whole.where(F.lit(n) > 0).select(
        "gamma", (F.coalesce("hits", F.lit(0)) / F.lit(max(n, 1))).alias("accuracy"), F.lit(n).cast("long").alias("n_queries"))
    wb = Window.orderBy(F.col("accuracy").desc(), F.col("gamma").asc())   # |grid| rows
    return acc.withColumn("best", F.row_number().over(wb) == 1)


def best_gamma(report: DataFrame) -> float:
    row = report.where("best").select("gamma").first()
    return 0.0 if row is None else float(row["gamma"])


def _gamma_report(doc_vecs, targets, vq, vrel, kind, grid, competitors=None) -> DataFrame:
    if grid is None:
        return gamma_steps(doc_vecs, targets, vq, vrel, kind, competitors=competitors)
    return choose_gamma(doc_vecs, targets, vq, vrel, kind, grid, competitors)


def nudge_finetune(doc_vecs: DataFrame, query_vecs: DataFrame, qrels: DataFrame,
                   splits: DataFrame, kind: str = "nudge-n", train_split: str = "train",
                   val_split: str = "val", grid=DEFAULT_GRID):
    """N1 on the training split, N4 on the validation split, N2/N3 with
    the chosen gamma, by ``grid`` or, if that is None, of all values. Returns
    ``(tuned vectors, gamma, report)``."""
    train = splits.where(F.col("split") == train_split).select("query_id")
    val = splits.where(F.col("split") == val_split).select("query_id")
    targets = nudge_targets(query_vecs, qrels, train).checkpoint(eager=True)
    vq = query_vecs.join(val.select(F.col("query_id").alias("id")), "id", "left_semi")
    vrel = qrels.join(val, "query_id", "left_semi")
    report = _gamma_report(doc_vecs, targets, vq, vrel, kind, grid).checkpoint(eager=True)
    gamma = best_gamma(report)
    return apply_nudge(doc_vecs, targets, gamma, kind), gamma, report


def _insert(existing_vecs: DataFrame, new_doc_vecs: DataFrame, query_vecs: DataFrame, qrels: DataFrame,
            splits: DataFrame, kind: str, train_split: str, val_split: str, grid,
            run: KeptRun | None) -> tuple[DataFrame, float]:
    """The tuned new vectors and their gamma; the old ones compete by ``run``
    if there is one."""
    clash = new_doc_vecs.select("id").join(existing_vecs.select("id"), "id", "left_semi")
    first = clash.limit(1).collect()
    if first:
        raise ValueError(f"document {first[0]['id']!r} is in both the old and the new corpus")
    new_ids = new_doc_vecs.select(F.col("id").alias("doc_id"))
    q_new = qrels.join(new_ids, "doc_id", "left_semi")
    train = splits.where(F.col("split") == train_split).select("query_id")
    val = splits.where(F.col("split") == val_split).select("query_id")
    targets = nudge_targets(query_vecs, q_new, train).checkpoint(eager=True)
    vq = query_vecs.join(val.select(F.col("query_id").alias("id")), "id", "left_semi")
    # validated on queries that the new documents answer
    vrel = q_new.join(val, "query_id", "left_semi")
    if run is None:
        report = _gamma_report(new_doc_vecs, targets, vq, vrel, kind, grid, competitors=existing_vecs)
    else:
        report = choose_gamma(new_doc_vecs, targets, vq, vrel, kind, grid, rivals=best_of(
            run, vrel.where("relevance = 1").select(F.col("query_id").alias("id")).distinct()))
    gamma = best_gamma(report.checkpoint(eager=True))
    return apply_nudge(new_doc_vecs, targets, gamma, kind), gamma


def nudge_insert(existing_vecs: DataFrame, new_doc_vecs: DataFrame, query_vecs: DataFrame,
                 qrels: DataFrame, splits: DataFrame, kind: str = "nudge-n",
                 train_split: str = "train", val_split: str = "val", grid=DEFAULT_GRID):
    """Add new documents, tune only them; existing vectors compete during
    gamma selection but do not change. An id already present fails.
    Returns ``(existing + tuned new vectors, gamma)``."""
    tuned, gamma = _insert(existing_vecs, new_doc_vecs, query_vecs, qrels, splits, kind,
                           train_split, val_split, grid, None)
    return existing_vecs.select("id", to_double("vec").alias("vec")).unionByName(tuned), gamma


def nudge_insert_kept(run: KeptRun, existing_vecs: DataFrame, new_doc_vecs: DataFrame, qrels: DataFrame,
                      splits: DataFrame, kind: str = "nudge-n", train_split: str = "train",
                      val_split: str = "val", grid=DEFAULT_GRID):
    """N6 batch after batch, with a run over the existing corpus that is kept up
    to date (``topk``), searched by the metric of ``kind``: the old vectors
    compete by their best per query in the run, and the tuned new ones enter it.
    Of ``existing_vecs`` the ids are read, to find an id that is in both, and
    no vector. Same rows as ``nudge_insert``; the grid must be given. Returns
    ``(existing + tuned new vectors, gamma, run)``."""
    if grid is None or run.metric != search_metric(kind):
        raise ValueError(f"a grid and a run by {search_metric(kind)} are needed")
    tuned, gamma = _insert(existing_vecs, new_doc_vecs, run.query_vecs, qrels, splits, kind,
                           train_split, val_split, grid, run)
    tuned = materialised(tuned, "tuned")              # the run and the result read it
    out = existing_vecs.select("id", to_double("vec").alias("vec")).unionByName(tuned)
    return out, gamma, insert_docs(run, tuned)


def changed_vectors(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(id, moved_by)`` for every vector that moved (Euclidean)."""
    b = before.select("id", F.col("vec").alias("b"))
    a = after.select("id", F.col("vec").alias("a"))
    return (b.join(a, "id").select("id", F.sqrt(sq_l2("b", "a")).alias("moved_by"))
            .where(F.col("moved_by") > 0))


__all__ = ["nudge_targets", "nudge_m", "nudge_n", "apply_nudge", "choose_gamma",
           "gamma_steps", "best_gamma", "nudge_finetune", "nudge_insert", "nudge_insert_kept",
           "changed_vectors"]
