"""numpy helpers for the exact top-k vector kernel (runs inside Spark tasks).

Contract, shared with the SQL oracle: a score is the *sequential* double sum
over the dimensions (same bits as Spark's ``aggregate(zip_with(...))`` and
DuckDB's ``list_dot_product``), rounded to 6 decimals with Spark's HALF_UP
rule, and candidates are ordered by rounded score, then id ascending.

The kernel screens with one BLAS product per tile, in float32, keeps every
candidate within ``MARGIN`` and the product's error of the k-th score, rescoring
only those sequentially in double, and then cuts to exactly k per query by the
contract order. Proof of the margin: two exact scores more than 1e-6 apart can
never round to the same 6-decimal value in the wrong order, so a document below
the k-th by more than 2e-6 is beaten by k others whatever their ids are. A
float32 sum of n products is off by at most (n + 2) / 2^24 of the sum of their
absolute values, which is no more than |q| |c|; twice that is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa

MARGIN = 2e-6
DIGITS = 6
METRICS = ("cosine", "dot", "sq_l2")
TILE = 2048                        # documents of one screening product


def seq_sq_norms(m: np.ndarray) -> np.ndarray:
    acc = np.zeros(m.shape[0])
    for j in range(m.shape[1]):
        col = m[:, j]
        acc += col * col
    return acc


def unit(m: np.ndarray, sq_norms: np.ndarray) -> np.ndarray:
    """Rows over their length; a zero row stays."""
    return m / np.sqrt(np.where(sq_norms > 0, sq_norms, 1.0))[:, None]


def exact_scores(Q, C, qi, ci, metric, qn=None, cn=None) -> np.ndarray:
    """Sequential (index 0 upward) double sums for the pairs (qi, ci)."""
    acc = np.zeros(len(qi))
    if metric == "sq_l2":
        for j in range(Q.shape[1]):
            d = Q[qi, j] - C[ci, j]
            acc += d * d
        return acc
    for j in range(Q.shape[1]):
        acc += Q[qi, j] * C[ci, j]
    if metric == "cosine":
        den = np.sqrt(qn[qi]) * np.sqrt(cn[ci])
        with np.errstate(divide="ignore", invalid="ignore"):
            acc = np.where(den > 0, acc / den, np.nan)
    return acc


def round_half_up(x: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """Spark's ``round(x, d)`` on doubles (HALF_UP on the decimal string).

    Values whose scaled fraction is not within 1e-6 of one half are rounded in
    numpy; the few near a tie go through ``Decimal(repr(x))``.
    """
    p = 10.0 ** digits
    ax = np.abs(x) * p
    fl = np.floor(ax)
    frac = ax - fl
    m = np.where(frac >= 0.5, fl + 1.0, fl)
    near = np.nonzero(np.abs(frac - 0.5) < 1e-6)[0]
    q = Decimal(1).scaleb(-digits)
    for i in near:
        m[i] = abs(float(Decimal(repr(float(x[i]))).quantize(q, rounding=ROUND_HALF_UP))) * p
        m[i] = np.round(m[i])
    return np.sign(x) * m / p + 0.0  # + 0.0 turns -0.0 into 0.0, as BigDecimal does


def _margin(x: np.ndarray) -> np.ndarray:
    return MARGIN + 1e-9 * np.abs(np.where(np.isfinite(x), x, 0.0))


def screen(S: np.ndarray, k: int, least: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, col) of S (higher is better; -inf = excluded) that may be in
    the top k of their row. ``least`` holds, per row, what a pair needs to enter
    the k best so far, -inf while they are fewer than k: then the k-th of the
    block stands for it. ``error`` is how far a row's entries may be off."""
    n = S.shape[1]
    todo = np.flatnonzero(least == -np.inf)
    least = least - error
    if len(todo):
        if n > k:
            kth = np.partition(S[todo], n - k, axis=1)[:, n - k].astype(float)
            least[todo] = kth - _margin(kth) - 2.0 * error[todo]
        least[todo] = np.maximum(least[todo], np.finfo(S.dtype).min)    # -inf itself never enters
    with np.errstate(over="ignore"):
        low = np.nextafter(least.astype(S.dtype), S.dtype.type(-np.inf))
    low = np.maximum(low, np.finfo(S.dtype).min)
    return np.divmod(np.flatnonzero(S >= low[:, None]), n)


@dataclass(frozen=True)
class Bounds:
    """A ball around a block's vectors, and one around their unit vectors
    (radius -2 where all are zero vectors, which have no cosine)."""

    centre: np.ndarray
    radius: float
    unit_centre: np.ndarray
    unit_radius: float

    @classmethod
    def of(cls, C: np.ndarray) -> Bounds:
        centre = C.mean(axis=0)
        norm = np.sqrt(seq_sq_norms(C))
        unit = C[norm > 0] / norm[norm > 0][:, None]
        unit_centre = unit.mean(axis=0) if len(unit) else np.zeros(C.shape[1])
        far = lambda m, c: float(np.sqrt(seq_sq_norms(m - c)).max())
        return cls(centre, far(C, centre), unit_centre, far(unit, unit_centre) if len(unit) else -2.0)


class Block:
    """Documents as searchers of one metric read them, prepared once for all."""

    def __init__(self, ids: np.ndarray, C: np.ndarray, metric: str):
        self.ids, self.C = ids, C
        self.sq_norms = cn = seq_sq_norms(C)
        self.longest = float(np.sqrt(cn.max(initial=0.0)))
        self.columns = np.ascontiguousarray(C.T)
        self.gone = np.flatnonzero(cn == 0) if metric == "cosine" else np.zeros(0, np.int64)
        # unit vectors, vectors, or (2 c, -|c|^2): with (q, 1) the squared distance less |q|^2
        right = unit(C, cn) if metric == "cosine" else np.column_stack([2.0 * C, -cn]) if metric == "sq_l2" else C
        self.right = {right.dtype: right}

    def screening(self, kind) -> np.ndarray:
        kind = np.dtype(kind)
        if kind not in self.right:
            self.right[kind] = self.right[np.dtype(float)].astype(kind)
        return self.right[kind]


class BlockSearcher:
    """Top-k of a fixed query matrix against a stream of corpus blocks.

    The state is two ``(queries, k)`` arrays (score in screening units, -inf
    where empty, and document id); a block only touches the rows of queries
    that gained a candidate."""

    def __init__(self, q_ids: np.ndarray, Q: np.ndarray, k: int, metric: str,
                 exclude_self: bool, chunk_bytes: int = 2 << 20):
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        self.q_ids, self.Q, self.k, self.metric = q_ids, Q, k, metric
        self.exclude_self = exclude_self
        self.qn = seq_sq_norms(Q)
        self.q_index = pd.Index(q_ids) if exclude_self else None
        self.chunk_bytes = chunk_bytes               # of screened scores held at a time: a cache's worth
        self.sign = -1.0 if metric == "sq_l2" else 1.0
        self.score = np.full((len(q_ids), k), -np.inf)
        self.doc = np.full((len(q_ids), k), None, dtype=object)

    def _screening(self, at: np.ndarray, block: Block):
        """What one product screens by, for some queries and a block; and by
        query how far float32 may be off. In double where a product might not fit."""
        left, q, c = self.Q[at], np.sqrt(self.qn[at]), block.longest
        size = q * c
        if self.metric == "cosine":
            left, size = unit(left, self.qn[at]), np.ones(len(at))
        elif self.metric == "sq_l2":
            left, size = np.column_stack([left, np.ones(len(at))]), 2.0 * size + c * c
        if max(q.max(), c, size.max()) < 1e30:
            return left.astype(np.float32), block.screening(np.float32), (left.shape[1] + 4) * 2.0 ** -23 * size
        return left, block.screening(float), np.zeros(len(at))

    def best_in(self, block: Bounds) -> np.ndarray:
        """By query, no smaller than its score (in screening units) with any
        vector of a block: by the triangle inequality around the block's centre."""
        if self.metric == "cosine":
            with np.errstate(divide="ignore", invalid="ignore"):
                unit = self.Q / np.sqrt(self.qn)[:, None]
            top = np.minimum(unit @ block.unit_centre + block.unit_radius, 1.0)
        elif self.metric == "dot":
            top = self.Q @ block.centre + np.sqrt(self.qn) * block.radius
        else:
            apart = self.Q - block.centre
            top = -np.maximum(np.sqrt(np.einsum("ij,ij->i", apart, apart)) - block.radius, 0.0) ** 2
        return top + 1e-9 * (1.0 + np.abs(top))

    @property
    def full(self) -> bool:
        """Whether every query has k documents."""
        return bool((self.score[:, -1] > -np.inf).all())

    def open_for(self, top: np.ndarray) -> np.ndarray:
        """The queries whose k best so far a score of ``top`` may still change."""
        kth = self.score[:, -1]
        return np.flatnonzero(~(top < kth - _margin(kth)))

    def add(self, d_ids: np.ndarray, C: np.ndarray, queries: np.ndarray | None = None) -> None:
        """Score a block of documents against all queries, or against some (sorted)."""
        if len(d_ids):
            self.add_block(Block(d_ids, C, self.metric), queries)

    def add_block(self, block: Block, queries: np.ndarray | None = None) -> None:
        some = np.arange(len(self.q_ids)) if queries is None else queries
        if self.metric == "cosine":
            some = some[self.qn[some] > 0]           # a zero query has no cosine
        d_ids, gone, columns, cn = block.ids, block.gone, block.columns, block.sq_norms
        if len(d_ids) == 0 or len(some) == 0:
            return
        own_row = np.full(len(self.q_ids), -1)       # by query its own place in the block, if it is excluded
        if self.exclude_self:
            hit = self.q_index.get_indexer(d_ids)
            own_row[hit[hit >= 0]] = np.flatnonzero(hit >= 0)
        left, right, error = self._screening(some, block)
        cells = max(1, self.chunk_bytes // 4)
        wide = min(len(d_ids), TILE, cells)
        rows = max(1, cells // wide)
        for s in range(0, len(some), rows):
            at, held = some[s:s + rows], []
            for lo in range(0, len(d_ids), wide):
                hi = min(lo + wide, len(d_ids))
                S = left[s:s + rows] @ right[lo:hi].T
                if S.dtype != np.float32:
                    S[~np.isfinite(S)] = -np.inf
                if len(gone):
                    S[:, gone[(gone >= lo) & (gone < hi)] - lo] = -np.inf
                if self.exclude_self:
                    mine = np.flatnonzero((own_row[at] >= lo) & (own_row[at] < hi))
                    S[mine, own_row[at[mine]] - lo] = -np.inf
                kth = self.score[at, -1]
                shift = self.qn[at] if self.metric == "sq_l2" else 0.0
                least = kth - _margin(kth) + shift
                qi, ci = screen(S, self.k, least, error[s:s + rows])
                if S.dtype == np.float32 and len(qi) > S.size // 16 and kth.min() > -np.inf:
                    # vectors of unlike lengths: float32 tells too few apart
                    S = self._double(at, block.C[lo:hi], cn[lo:hi], S)
                    qi, ci = screen(S, self.k, least, np.zeros(len(at)))
                held.append((qi, ci + lo))
                # at once while some query has no k documents, and before many pairs wait: the next tile is
                # screened by what they leave
                if hi == len(d_ids) or kth.min() == -np.inf or sum(len(q) for q, _ in held) > self.k * len(at) // 2:
                    qi, ci = (np.concatenate(x) for x in zip(*held))
                    held = []
                    self._score(at, qi, ci, columns, cn, d_ids)

    def _double(self, at: np.ndarray, C: np.ndarray, cn: np.ndarray, S: np.ndarray) -> np.ndarray:
        """``S`` in double."""
        if self.metric == "cosine":
            exact = unit(self.Q[at], self.qn[at]) @ unit(C, cn).T
        else:
            exact = self.Q[at] @ C.T
            if self.metric == "sq_l2":
                exact = 2.0 * exact - cn
        exact[S == -np.inf] = -np.inf
        return exact

    def _score(self, at, qi, ci, columns, cn, d_ids) -> None:
        v = self.sign * round_half_up(self._exact(at, qi, columns, ci, cn))
        qi = at[qi]
        ok = v >= self.score[qi, -1]                 # a nan is not; an equal score may have the smaller id
        self._merge(qi[ok], v[ok], d_ids[ci[ok]])

    def _exact(self, at, qi, columns, ci, cn) -> np.ndarray:
        """``exact_scores`` of pairs of a chunk, the documents given by columns."""
        own = np.ascontiguousarray(self.Q[at].T)
        acc = np.zeros(len(qi))
        for q, c in zip(own, columns):
            if self.metric == "sq_l2":
                d = q[qi] - c[ci]
                acc += d * d
            else:
                acc += q[qi] * c[ci]
        if self.metric == "cosine":
            den = np.sqrt(self.qn[at])[qi] * np.sqrt(cn[ci])
            with np.errstate(divide="ignore", invalid="ignore"):
                acc = np.where(den > 0, acc / den, np.nan)
        return acc

    def _merge(self, qi: np.ndarray, sc: np.ndarray, ids: np.ndarray) -> None:
        if len(qi) == 0:
            return
        touched = np.unique(qi)
        at, slot = np.nonzero(self.score[touched] > -np.inf)
        old = touched[at]
        q = np.concatenate([qi, old])
        v = np.concatenate([sc, self.score[old, slot]])
        d = np.concatenate([ids, self.doc[old, slot]])
        order = np.argsort(-v)
        small = np.searchsorted(touched, q).astype(np.uint16 if len(touched) <= 1 << 16 else np.int64)
        order = order[np.argsort(small[order], kind="stable")]
        same = (q[order][1:] == q[order][:-1]) & (v[order][1:] == v[order][:-1])
        if same.any():                               # equal scores stand by id
            tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
            own = order[tied]
            order[tied] = own[np.lexsort((d[own].astype(str), -v[own], q[own]))]
        q, v, d = q[order], v[order], d[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.score[touched], self.doc[touched] = -np.inf, None
        self.score[q[keep], rank[keep]], self.doc[q[keep], rank[keep]] = v[keep], d[keep]

    def result(self) -> pd.DataFrame:
        qi, slot = np.nonzero(self.score > -np.inf)
        return pd.DataFrame({"query_id": self.q_ids[qi].astype(object),
                             "doc_id": self.doc[qi, slot].astype(object),
                             "score": self.sign * self.score[qi, slot] + 0.0})


def usable(ids, vecs, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and float64 matrix of the vectors that take part in a search: not
    null, of length ``dim``, and every component a finite number. One rule for
    both sides and all strategies."""
    import pyarrow.compute as pc

    if isinstance(vecs, pa.ChunkedArray):
        vecs = vecs.combine_chunks()
    ids = np.asarray(ids.to_pylist(), dtype=object)
    keep = pc.fill_null(pc.equal(pc.list_value_length(vecs), dim), False)
    m = vecs.filter(keep).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    ids = ids[keep.to_numpy(zero_copy_only=False)]
    ok = np.isfinite(m).all(axis=1)
    return ids[ok], m[ok]
