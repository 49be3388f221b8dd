"""N4 without a grid: the step function of accuracy against a fine grid and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrievalkit.operators import gamma_steps as G
from retrievalkit.operators import nudge as N


def tuned(D, u, gamma, kind):
    """One document moved by the closed forms of the method."""
    if u is None or gamma == 0:
        return D
    if kind == "nudge-m":
        return D + gamma * u
    c = 1 - gamma ** 2 / 2
    t = u @ D
    if t >= c:
        return u
    z = u - t * D
    return c * D + gamma * np.sqrt(1 - gamma ** 2 / 4) * z / np.linalg.norm(z)


def accuracy(D, names, u, Q, rel, gamma, kind):
    M = np.array([tuned(d, u.get(i), gamma, kind) for i, d in zip(names, D)])
    scores = np.round(Q @ M.T, 13)
    order = np.argsort(names)                              # ties by id
    top = [names[order[np.argmax(s[order])]] for s in scores]
    return sum(t in rel[i] for i, t in enumerate(top))


@pytest.fixture(scope="module")
def case():
    rng = np.random.default_rng(12)
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    centre = unit(rng.normal(size=(8, 6)))
    D = unit(centre[rng.integers(0, 8, 40)] + 0.5 * rng.normal(size=(40, 6)))
    D[7], D[9] = D[3], D[3]                                # equal documents, tuned alike or not at all
    names = np.array([f"d{i:02d}" for i in range(40)])
    Q = unit(centre[rng.integers(0, 8, 90)] + 0.6 * rng.normal(size=(90, 6)))
    near = np.argsort(-(Q @ D.T), axis=1)[:, :6]
    rel = {i: {f"d{j:02d}" for j in rng.choice(near[i], size=rng.integers(1, 4), replace=False)} for i in range(90)}
    return D, names, Q, rel


@pytest.mark.parametrize("kind", ["nudge-n", "nudge-m"])
def test_steps_equal_every_gamma_of_a_fine_grid(spark, case, kind):
    D, names, Q, rel = case
    dv = spark.createDataFrame([(i, d.tolist()) for i, d in zip(names.tolist(), D)], "id string, vec array<double>")
    qv = spark.createDataFrame([(f"q{i:02d}", q.tolist()) for i, q in enumerate(Q)], "id string, vec array<double>")
    qrels = spark.createDataFrame([(f"q{i:02d}", d, 1) for i, own in rel.items() for d in sorted(own)],
                                  "query_id string, doc_id string, relevance int")
    train, val = qrels.where("query_id < 'q50'"), qrels.where("query_id >= 'q50'")
    targets = N.nudge_targets(qv, train, train.select("query_id"))
    u = {r["doc_id"]: np.array(r["g"]) / np.linalg.norm(r["g"]) for r in targets.collect()}
    assert 20 < len(u) < 40
    ours = sorted(G.gamma_steps(dv, targets, qv, val, kind).collect(), key=lambda r: (r.gamma_lo, r.gamma_hi))
    own = {i - 50: rel[i] for i in range(50, 90)}
    assert all(r.n_queries == 40 and r.accuracy == r.hits / 40 for r in ours)
    # the rows cover 0..2 without gaps, gamma 0 on its own
    assert (ours[0].gamma_lo, ours[0].gamma_hi) == (0, 0) and ours[1].gamma_lo == 0 and abs(ours[-1].gamma_hi - 2) < 1e-9
    assert all(abs(a.gamma_hi - b.gamma_lo) < 1e-8 for a, b in zip(ours, ours[1:])) and len(ours) > 10
    for r in ours:
        assert r.hits == accuracy(D, names, u, Q[50:], own, r.gamma, kind), r
    fine = np.linspace(0, 2, 10_001)
    lo = np.array([r.gamma_lo for r in ours[1:]])
    seen = [ours[0].hits] + [ours[1 + int(np.searchsorted(lo, g, "right")) - 1].hits for g in fine[1:]]
    for n in range(0, 10_001, 40):
        edge = np.abs(lo - fine[n]).min() < 1e-6 and n
        assert edge or seen[n] == accuracy(D, names, u, Q[50:], own, fine[n], kind), fine[n]
    best = [r for r in ours if r.best]
    assert len(best) == 1 and best[0].hits >= max(seen) and best[0].hits == max(r.hits for r in ours)
    assert not any(r.hits == best[0].hits and r.gamma_lo < best[0].gamma_lo for r in ours)


@pytest.mark.parametrize("kind", ["nudge-n", "nudge-m"])
def test_edge_cases(spark, kind):
    """Zero and opposite vectors, missing documents and queries, competitors, nothing judged."""
    vec, judged = "id string, vec array<double>", "query_id string, doc_id string, relevance int"
    dv = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None)], vec)
    qv = spark.createDataFrame([("t", [-1.0, 0.0]), ("q", [0.8, 0.6]), ("v", [0.0, 0.0]), ("w", [0.6, 0.8])], vec)
    rel = spark.createDataFrame([("t", "a", 1), ("q", "a", 1), ("v", "a", 1), ("w", "gone", 1), ("w", "b", 0)], judged)
    targets = N.nudge_targets(qv, rel, spark.createDataFrame([("t",)], "query_id string"))       # u = -a
    val = rel.where("query_id <> 't'")
    rows = sorted(G.gamma_steps(dv, targets, qv, val, kind).collect(), key=lambda r: (r.gamma_lo, r.gamma_hi))
    assert rows[0].hits == 1 and rows[0].best and rows[0].n_queries == 3
    if kind == "nudge-m":                                  # a moves away: 0.8 - 0.8 x falls below 0.6 at 0.25
        assert [(round(r.gamma_lo, 9), round(r.gamma_hi, 9), r.hits) for r in rows] == [(0, 0, 1), (0, 0.25, 1), (0.25, 2, 0)]
    else:
        assert [r.hits for r in rows] == [1, 1]
    rival = spark.createDataFrame([("0", [4.0, 3.0])], vec)
    assert all(r.hits == 0 for r in G.gamma_steps(dv, targets, qv, val, kind, competitors=rival).collect())
    assert G.gamma_steps(dv, targets, qv, val.where("relevance = 7"), kind).count() == 0
    assert G.gamma_steps(dv.limit(0), targets, qv, val, kind).count() == 0
    assert [r.hits for r in G.gamma_steps(dv, targets.limit(0), qv, val, kind).orderBy(F.desc("gamma")).collect()] == [1, 1]
