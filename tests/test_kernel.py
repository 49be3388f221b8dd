"""The numpy top-k kernel against brute force, block by block (no Spark)."""

import numpy as np
import pandas as pd
import pytest

from retrievalkit.operators import _kernel as K


def brute(q_ids, Q, d_ids, C, k, metric, exclude_self):
    qi, ci = np.meshgrid(np.arange(len(q_ids)), np.arange(len(d_ids)), indexing="ij")
    qi, ci = qi.ravel(), ci.ravel()
    if exclude_self:
        keep = q_ids[qi] != d_ids[ci]
        qi, ci = qi[keep], ci[keep]
    ex = K.exact_scores(Q, C, qi, ci, metric, K.seq_sq_norms(Q), K.seq_sq_norms(C))
    df = pd.DataFrame({"query_id": q_ids[qi], "doc_id": d_ids[ci], "score": K.round_half_up(ex)}).dropna()
    df = df.sort_values(["query_id", "score", "doc_id"], ascending=[True, metric == "sq_l2", True], kind="mergesort")
    return df.groupby("query_id", sort=False).head(k)


@pytest.mark.parametrize("metric", ["cosine", "dot", "sq_l2"])
@pytest.mark.parametrize("block", [1, 7, 50, 1000])
def test_streamed_blocks_equal_brute_force(metric, block):
    rng = np.random.default_rng(11)
    C = rng.normal(size=(300, 8)).astype(np.float32).astype(np.float64)
    C[10:40] = C[5]                      # exact duplicates: ties on score, broken by id
    C[50] = 0.0                          # zero vector
    Q = np.vstack([C[:20], rng.normal(size=(15, 8)).astype(np.float32).astype(np.float64)])
    d_ids = np.array([f"{i}" for i in range(len(C))], dtype=object)
    q_ids = np.array([f"{i}" for i in range(20)] + [f"x{i}" for i in range(15)], dtype=object)
    for exclude_self in (False, True):
        s = K.BlockSearcher(q_ids, Q, 10, metric, exclude_self, chunk_bytes=8 * 64 * block)
        order = rng.permutation(len(C))
        for b in range(0, len(C), block):
            idx = order[b:b + block]
            s.add(d_ids[idx], C[idx])
        got = s.result().sort_values(["query_id", "doc_id"]).reset_index(drop=True)
        want = brute(q_ids, Q, d_ids, C, 10, metric, exclude_self).sort_values(
            ["query_id", "doc_id"]).reset_index(drop=True)
        pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("metric", ["cosine", "dot", "sq_l2"])
def test_state_and_screen_stay_small(metric):
    """64 MB of scores, several times over, were held per task.
    Large vectors, whose float32 product is far off, keep their ranks."""
    import tracemalloc

    rng = np.random.default_rng(3)
    C = rng.normal(size=(6000, 8)) * 10.0 ** rng.integers(-3, 6, size=(6000, 1))
    C[100:400] = C[5]
    ids = np.array([f"{i}" for i in range(len(C))], dtype=object)
    s = K.BlockSearcher(ids[:1500], C[:1500], 5, metric, True)
    tracemalloc.start()
    s.add(ids, C)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6                                       # all scores: 72 MB
    some = [5, 99, 150, 1499, *range(0, 1500, 100)]
    got = s.result()
    want = brute(ids[some], C[some], ids, C, 5, metric, True)
    got = got[got.query_id.isin(ids[some])]
    key = ["query_id", "doc_id"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True))
