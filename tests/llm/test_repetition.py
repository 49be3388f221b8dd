import random
import re
from collections import Counter

import numpy as np

from retrievalkit.llm.repetition import covered, repeats, repetition_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def in_repeats(words, k):
    n = Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = [False] * len(words)
    for i in range(len(words) - k + 1):
        if n[tuple(words[i:i + k])] > 1:
            out[i:i + k] = [True] * k
    return out


def longest(words):
    k = 0
    while any(v > 1 for v in Counter(tuple(words[i:i + k + 1]) for i in range(len(words) - k)).values()):
        k += 1
    return k


def base(text, least=8):
    words, lines, seen = WORD.findall(text or ""), 0, set()
    for line in (text or "").split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_dup_lines": lines,
            "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_repeat_words": sum(in_repeats(words, 3)),
            "covered_words": sum(in_repeats(words, least))}


def check(rows, got):
    by = Counter((d, t) for d, t in rows)
    assert len(got) == sum(by.values())
    want = Counter((d, tuple(sorted(base(t).items()))) for d, t in rows)
    assert Counter((r["id"], tuple(sorted((k, r[k]) for k in base("")))) for r in got) == want


def test_given_documents(docs001, texts001):
    got = repetition_quality(docs001).collect()
    check(list(texts001.items()), got)
    for r in got:
        words = WORD.findall(texts001[r["id"]])
        if len(words) < 300:
            assert r["longest_repeat"] == longest(words)
        marked = [any(s["start"] <= i < s["end"] for s in r["spans"]) for i in range(len(words))]
        assert marked == in_repeats(words, 8)
        failed = len(words) < 50 or 100 * r["n_repeat_words"] > 50 * len(words)
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and 100 * r["covered_words"] <= 50 * len(words) and r["longest_repeat"] <= 250)


def test_messy_and_empty(messy):
    check([(r["doc_id"], r["text"]) for r in messy.collect()], repetition_quality(messy).collect())
    assert repetition_quality(messy.limit(0)).count() == 0


def test_suffix_array_on_random_sequences():
    r = random.Random(5)
    for _ in range(60):
        texts = [[r.randrange(3) for _ in range(r.randrange(0, 25))] for _ in range(r.randrange(1, 6))]
        first = np.append(0, np.cumsum([len(t) for t in texts]))
        got = repeats(np.array([x for t in texts for x in t], np.uint64), first)
        want = []
        for t in texts:
            for i in range(len(t)):
                want.append(max((next((k for k in range(len(t)) if max(i, j) + k >= len(t) or t[i + k] != t[j + k]), 0)
                                 for j in range(len(t)) if j != i), default=0))
        assert got.tolist() == want
        assert covered(got, 4).tolist() == [x for t in texts for x in in_repeats(t, 4)]


def test_the_covered_part_decides_what_the_base_rules_keep(spark):
    """every covered word is in a window that occurs twice, so the covered
    fraction of the words never decided a row. That of the code points does."""
    r = random.Random(3)
    long = " ".join("".join(r.choice("abcdefgé") for _ in range(30)) for _ in range(8))
    rest = [f"{i:x}" for i in range(60)]
    short = " ".join("xyzuvwst")
    texts = [f"{' '.join(rest[:30])}\n{line}\n{' '.join(rest[30:])}\n{line}" for line in (long, short)] + [" ".join(rest), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["id"]: x for x in repetition_quality(df).collect()}
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        assert got[i]["covered_chars"] == sum(len(w) for w, c in zip(words, in_repeats(words, 8)) if c)
    assert [got[i]["base_failed"] for i in range(5)] == [False, False, False, True, True]
    assert [got[i]["kept"] for i in range(5)] == [False, True, True, False, False]
    assert got[0]["covered_words"] == got[1]["covered_words"] == 16
