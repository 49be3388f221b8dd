import random

import numpy as np
import pyarrow as pa
import pytest

from retrievalkit.llm import _words as W
from retrievalkit.llm import minhash_dedup as M
from retrievalkit.llm.components import components


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute(rows, k, percent):
    """Component of each id by comparing all pairs."""
    sets, root = {}, {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, []).append(shingle_set(t, k))
            root[d] = d

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            for x in sets[a]:
                for y in sets[b]:
                    if x & y and 100 * len(x & y) >= percent * len(x | y):
                        p, q = top(a), top(b)
                        root[max(p, q)] = min(p, q)
    return {d: top(d) for d in ids}


def test_words_and_shingles_match_python():
    r = random.Random(3)
    texts = ["", " ", "a", "a b", "\x0bé\x0c\tb  c\n"] + [
        "".join(r.choice("ab cé\n\tZ 🙂") for _ in range(r.randint(0, 60))) for _ in range(300)]
    for size in (1, 50, 1 << 20):
        at = 0
        for lo, hi, buf, off in W.chunks(pa.array(texts, pa.string()), size):
            assert lo == at
            at = hi
            w = W.Words(buf, off)
            got = [bytes(buf[a:b]) for a, b in zip(w.start, w.end)]
            want = [t.encode().split() for t in texts[lo:hi]]
            assert got == [x for t in want for x in t] and w.count.tolist() == [len(t) for t in want]
            for k in (1, 3, 5):
                sh, so = W.distinct(*W.shingles(w.hashes(True), w.first, k))
                assert np.diff(so).tolist() == [len(shingle_set(t, k)) for t in texts[lo:hi]]
        assert at == len(texts)


def test_bands_reach_the_wanted_recall():
    for t in (0.8, 0.85, 0.95):
        m = M.bands(t, 2, 1e-4)
        assert (1 - (1 - t ** 2) ** m) ** 2 >= 1 - 1e-4 > (1 - (1 - t ** 2) ** (m - 1)) ** 2


def test_components_match_union_find(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(90)] + [(500 + i, 501 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: c for x, c in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_given_documents_match_all_pairs(spark, docs001, texts001):
    want = brute(list(texts001.items()), 3, 85)
    got = M.near_duplicates(docs001, k=3, percent=85).collect()
    assert {r["id"]: r["component"] for r in got} == want
    assert all(r["n_shingles"] == len(shingle_set(texts001[r["id"]], 3)) for r in got)


def test_groups_without_a_common_pivot_and_blocks(spark, monkeypatch):
    """Chains and clusters where the pivot of a bucket misses members."""
    monkeypatch.setattr(M, "BLOCK", 8)
    r = random.Random(7)
    rows, base = [], [f"t{i}" for i in range(120)]
    for g in range(3):
        words = [f"g{g}_{w}" for w in base]
        for i in range(40):
            words = list(words)
            words[r.randrange(len(words))] = f"new{g}_{i}"        # a chain: neighbours are near, ends are far
            rows.append((1000 * g + i, " ".join(words)))
    r.shuffle(rows)
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85).collect()
    assert {x["id"]: x["component"] for x in got} == brute(rows, 3, 85)


def test_many_exact_and_near_copies(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(i, base) for i in range(300, 0, -1)] + [(1000 + i, f"{base} extra{i}") for i in range(200)]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["component"] for x in got} == {1} and len(got) == 500


def test_messy_rows(messy):
    got = M.near_duplicates(messy).collect()
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    want = brute(rows, 5, 80)
    assert len(got) == len(rows)
    assert all(r["component"] == want.get(r["id"]) for r in got)
    assert {r["id"]: r["n_shingles"] for r in got if r["id"] in (3, 4, 5, 6, 7)} == {3: 0, 4: 0, 5: 0, 6: 1, 7: 1}


def test_empty_table(messy):
    assert M.near_duplicates(messy.limit(0)).count() == 0


@pytest.mark.parametrize("a,b", [([], [1]), ([1, 2], [2, 3]), ([5], [5])])
def test_shared(a, b):
    assert M._shared(np.array(a, np.uint64), np.array(b, np.uint64)) == len(set(a) & set(b))
