"""The substring join against Python's ``in``."""

import random

import numpy as np
import pytest

from retrievalkit.operators import substring_join as S


def test_windows_of_a_part_are_windows_of_the_whole():
    r = random.Random(1)
    for _ in range(300):
        size = r.choice((3, 8, 11, 12, 30, 46, 47, 80, 300))
        part = bytes(r.choice(b"abc") for _ in range(size))
        whole = bytes(r.choice(b"abc") for _ in range(r.randint(0, 90))) + part + bytes(r.choice(b"abc") for _ in range(r.randint(0, 90)))
        w, g = S.class_of(size)

        def own(text):
            v = S.prints(np.frombuffer(text, np.uint8), w)
            return set(v[S.kept(v, g)].tolist())

        assert own(part) and own(part) <= own(whole)
    for w in range(1, 17):                                 # equal windows alike, others not
        data = bytes(r.choice(b"ab") for _ in range(400))
        v = S.prints(np.frombuffer(data, np.uint8), w)
        assert len(v) == 401 - w and len(set(v.tolist())) == len({data[i:i + w] for i in range(401 - w)})


@pytest.mark.parametrize("listed", [S.LISTED, 0])
def test_pairs_equal_python(spark, listed):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abé🙂") for _ in range(r.randint(1, 5)))
    texts = [(i, " ".join(word() for _ in range(r.randint(0, 60)))) for i in range(120)]
    texts += [(200 + i, "the same text on many rows, held by a third of them all, long enough for any class") for i in range(60)]
    texts += [(5, "another text of id 5 with ab in it"), (300, None), (301, ""), (None, "aab baa"), (302, "ab " * 40_000)]
    patterns = []
    for n in (1, 2, 5, 11, 12, 13, 30, 46, 47, 48, 60, 120):
        for _ in range(6):
            t = r.choice(texts[:120])[1]
            at = r.randrange(max(1, len(t) - n + 1))
            patterns.append((len(patterns), t[at:at + n]))
    patterns += [(500, ""), (501, None), (502, "nowhere to be found in any of these texts at all, whatever the class"),
                 (503, "the same text on many rows"), (504, "the same text on many rows"), (505, "row"), (506, "ab " * 100),
                 (None, "held by a third"), (503, "any class")]
    p = spark.createDataFrame([(i, t, "x") for i, t in patterns], "id long, text string, row string")
    d = spark.createDataFrame([(i, t, 1) for i, t in texts], "id long, text string, class int")
    want = {(i, j) for i, t in patterns for j, u in texts if t is not None and u is not None and t in u}
    got = [tuple(x) for x in S.contains_pairs(p, d, listed=listed).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert S.contains_pairs(p.limit(0), d, listed=listed).count() == 0
    assert S.contains_pairs(p, d.limit(0), listed=listed).count() == 0
