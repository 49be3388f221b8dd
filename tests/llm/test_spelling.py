import random
import re
import zlib
from collections import Counter

import numpy as np

from retrievalkit.llm import spelling_variants as S


def near(a, b):
    """Exactly one character inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, least=7, ratio=10):
    total = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
            total[run] += 1
    n = {w: c for w, c in total.items() if c >= 2 and len(w) >= least}
    words = sorted(n)
    out, form = {}, {}
    for w in words:
        close = [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = (len(close), form[w])
    rows = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], out[w][0], n[form[w]] if form[w] else None))
    return rows


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_pairs_along_sorted_lists():
    """The scan of sorted lists finds each pair of a block one edit apart, once."""
    r = random.Random(3)
    for _ in range(60):
        block, words = [], []
        for b in range(r.randint(1, 6)):
            own = sorted({"".join(r.choice("abc") for _ in range(r.choice((3, 4)))) for _ in range(r.randint(1, 25))})
            block += [b] * len(own)
            words += own
        length = np.array([len(w) for w in words])
        chars = np.frombuffer("".join(w.ljust(4, "\0") for w in words).encode("utf-32-le"), "<u4").reshape(-1, 4)
        a, b = S.near_pairs(chars, length, np.array(block))
        want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words))
                if block[i] == block[j] and near(words[i], words[j])}
        assert len(a) == len(want) and set(zip(a.tolist(), b.tolist())) == want


def test_variants_of_documents(docs001, texts001):
    want = brute(list(texts001.items()))
    assert len(want) > 300 and any(f for _, f, *_ in want)
    assert got(S.spelling_variants(docs001)) == want


def test_crowded_blocks_and_long_ways(spark):
    """Words of few letters, nearly all near one another; a block bound so small
    that blocks are cut down to single positions; ways of several forms."""
    r = random.Random(9)
    words = ["".join(r.choice("aé") for _ in range(r.choice((7, 8, 9)))) for _ in range(400)]
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx"]
    texts = [(i, " ".join(r.choices(words, k=40))) for i in range(100)]
    texts += [(1000 + i, " ".join([w] * 2 * 10 ** i)) for i, w in enumerate(chain)]
    texts += [(2000, "Q" * 5000 + " " + "q" * 5000), (2001, "q" * 5001 + " é " + "Q" * 5001)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute(texts)
    assert max(n for *_, n, _ in want) > 8
    assert {("abcdefgh", "abcdezyx"), ("abcdefyx", "abcdezyx")} <= {(w, root) for w, _, root, *_ in want}
    assert got(S.spelling_variants(df)) == want
    assert got(S.spelling_variants(df, block_chars=60)) == want


def test_messy_and_empty(messy, spark):
    want = brute([(r["doc_id"], r["text"]) for r in messy.collect()])
    assert got(S.spelling_variants(messy)) == want
    some = spark.createDataFrame([(None, "Colours colours"), (1, "colourss colourss COLOURSS"), (None, None), (2, "")],
                                 "doc_id long, text string")
    assert got(S.spelling_variants(some)) == brute([(None, "Colours colours"), (1, "colourss colourss COLOURSS")])
    assert S.spelling_variants(messy.limit(0)).count() == 0
