import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from retrievalkit.llm import lexical_search as S

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda x: x.group().lower(), text or ""))


def brute(docs, items, k=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    total, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scores = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10 ** 9 * b[t] // (1000 * b[t] + 8 * m))
                    for t in terms(text) if t in b)
            if s > 0:
                scores.append((-s, d is None, d, s))
        out += [(item, r, d, s) for r, (_, _, d, s) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "id", "score").collect()), key=repr)


def random_tree(r, n, vocabulary, leaf, deep):
    docs = [sorted(set(int(vocabulary * r.random() ** 3) for _ in range(r.randint(0, 8)))) for _ in range(n)]
    docs[n // 2:] = [docs[r.randrange(n)] if r.random() < 0.5 else d for d in docs[n // 2:]]    # shared paths, copies
    counts = [[r.randint(1, 3) for _ in d] for d in docs]
    m = np.array([r.randint(25, 40) for _ in docs])
    ids = np.array(r.sample(range(3 * n), n))
    flat = lambda x: np.array([v for own in x for v in own], np.int64)
    ends = np.append(0, np.cumsum([len(d) for d in docs]))
    return docs, counts, m, ids, S.Tree(ends, flat(docs), flat(counts), m, ids, leaf, deep)


def test_bounds_and_search_in_trees():
    """No subtree's bound is below a score under it, every document is under
    one path, and the search finds what looking at all documents finds."""
    r = random.Random(8)
    opened = whole = 0
    for n, leaf, deep in [(1, 4, 5), (3, 4, 5), (200, 4, 3), (300, 16, 256), (400, 2, 256), (150, 8, 0)]:
        docs, counts, m, ids, tree = random_tree(r, n, 30, leaf, deep)
        for _ in range(20):
            own = np.array(sorted(r.sample(range(30), 4)))
            weight = np.array([r.randint(0, 50) for _ in own])
            w = dict(zip(own.tolist(), weight.tolist()))
            score = np.array([sum(w.get(t, 0) * (10 ** 9 * c // (1000 * c + 8 * int(m[i]))) for t, c in zip(d, counts[i]))
                              for i, d in enumerate(docs)])
            seen = []

            def check(node, bound):
                a, b = tree.children[node]
                if a == b:
                    seen.append(int(tree.doc[node]))
                    assert bound == score[tree.doc[node]]
                    return [int(tree.doc[node])]
                found = [d for i, s in enumerate(tree.below(node, own, weight).tolist()) for d in check(a + i, s)]
                assert bound >= max(score[found]) and tree.least_id[node] == min(ids[found])
                return found

            check(0, 1 << 62)
            assert sorted(seen) == list(range(n))
            best = S.Best.none(5)
            opened += S.search(tree, ids, np.zeros(n, bool), own, weight, best)
            whole += tree.nodes - n
            want = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist()) if s > 0)[:5]
            assert list(zip((-best.score).tolist(), best.id.tolist())) == want
    assert opened < whole / 2                           # subtrees were left out


def test_search_of_documents(spark, docs001, texts001):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    want = brute(list(texts001.items()), rows)
    assert len(want) == 400
    assert got(S.ranked_search(docs001, items)) == want
    assert got(S.ranked_search(docs001, items, postings=300, block_terms=50)) == want    # many trees, many blocks


def test_ties_copies_and_few_documents(spark):
    docs = [(i, "alpha beta") for i in range(60, 20, -1)] + [(i, "alpha alpha beta gamma") for i in range(5)]
    docs += [(None, "alpha beta"), (7, "alpha beta"), (7, "alpha beta"), (100, "delta"), (101, "É é Straße x9y")]
    items = [(1, "Alpha BETA"), (2, "alpha alpha beta"), (3, "delta, delta!"), (4, None), (5, ""), (6, "unseen words"),
             (1, "gamma"), (1, "Alpha BETA"), (None, "é é É"), (8, " ".join(["alpha"] * 50 + ["gamma"] * 3))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    for k in (3, 10):
        assert got(S.ranked_search(d, i, k)) == brute(docs, items, k)


def test_messy_and_empty(spark, messy):
    docs = [(r["doc_id"], r["text"]) for r in messy.collect()]
    items = [(1, "a b c w5x5 w6x6 tail"), (2, "naïve Ünï x"), (3, "token one two")]
    i = spark.createDataFrame([(a, b, "x", 0) for a, b in items], "item_id long, text string, id string, nr int")
    assert got(S.ranked_search(messy, i)) == brute(docs, items)
    for d, e in ((messy.limit(0), i), (messy, i.limit(0)), (messy.filter("text is null"), i)):
        out = S.ranked_search(d, e)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "id", "score"]
