import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from retrievalkit.llm import token_counts as C
from retrievalkit.llm import tokens as T
from retrievalkit.llm.packing import pack, place

ODD = ["don't we're I'd x's 's", "a_b __ _x_ !_! foo_bar1 ²½ é", "naïve İstanbul ΣΑΣ", "<|endoftext|> hi", "tab\x1cx y",
       "“quoted” … — –", "ﬁ ½", "🙂 hi", "ß ÀÉ × ÷ µ ª º", "--a__b--c_", "٣ ४", "", "   ", "é a", "a b c"]


@pytest.fixture(scope="module")
def tokens():
    return T.WordTokens(T.default_path())


def library(tokens, text):
    return tokens.whole.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(tokens, texts001):
    r = random.Random(5)
    plain = [chr(c) for c in range(0x250) if T._PLAIN.fullmatch(chr(c))]
    texts = ODD + list(texts001.values())[:60] + [
        "".join(r.choice(plain if r.random() < 0.5 else "a's_! 1té") for _ in range(r.randint(1, 14))) for _ in range(3000)]
    for room in (1_500_000, 20):                       # a store too small for a chunk is right as well
        tokens.room = room
        out = []
        for _, _, ids, off in tokens.encode(pa.array(texts, pa.string())):
            out += [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])]
        assert out == [library(tokens, t) for t in texts]
        assert tokens.counts(pa.array(texts, pa.string())).tolist() == [len(x) for x in out]


def check_packing(pieces, texts, tokens, window):
    """``texts``: ``(id, text)`` rows; rows of one id have one text here."""
    ids = {d: library(tokens, t) + [2] for d, t in texts}
    copies, per, seqs = Counter(d for d, _ in texts), defaultdict(Counter), defaultdict(list)
    for p in pieces:
        own = ids[p["id"]][p["start"]:p["start"] + p["length"]]
        assert len(own) == p["length"] > 0 and p["doc_tokens"] == len(ids[p["id"]])
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == p["ids_crc32"]
        for i in range(p["start"], p["start"] + p["length"]):
            per[p["id"]][i] += 1
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
    for d, n in copies.items():
        assert per[d] == Counter({i: n for i in range(len(ids[d]))})
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0      # nothing is padded


def test_packing(docs001, texts001, tokens):
    for window, shard in ((4096, 32_000_000), (256, 20_000)):
        got = pack(docs001, window=window, shard_ids=shard).collect()
        check_packing(got, list(texts001.items()), tokens, window)


def test_packing_messy_and_empty(messy, tokens):
    rows = [(r["doc_id"], r["text"]) for r in messy.filter("doc_id is not null").collect()]
    check_packing(pack(messy.filter("doc_id is not null"), window=64).collect(), rows, tokens, 64)
    assert sum(p["length"] for p in pack(messy).collect()) == sum(len(library(tokens, r["text"])) + 1 for r in messy.collect())
    assert pack(messy.limit(0)).count() == 0


def test_placement_minimises_the_sum_of_squares():
    r = random.Random(2)
    sizes = [r.randint(1, 31) for _ in range(400)]
    where, begun = place(sizes, 32)
    fill = []
    for s, (w, offset) in zip(sizes, where):
        def after(h):
            n = Counter(f for f in fill if f < 32)
            if h:
                n[h] -= 1
            if h + s < 32:
                n[h + s] += 1
            return sum(v * v for v in n.values())
        options = {0, *(f for f in fill if f + s <= 32)}
        assert after(offset) == min(map(after, options)) and offset in options
        if w == len(fill):
            fill.append(0)
        assert fill[w] == offset
        fill[w] += s
    assert begun == len(fill)


def test_histogram_and_suffix_sums(spark, docs001, texts001, tokens):
    n = np.array([len(library(tokens, t)) for t in texts001.values()])
    hist = C.length_histogram(docs001)
    sums = C.suffix_sums(hist)
    rows = sums.collect()
    assert {r["n_tokens"]: r["n_docs"] for r in rows} == dict(Counter(n.tolist()))
    for r in rows:
        at = r["n_tokens"]
        assert r["docs_at_least"] == (n >= at).sum() and r["tokens_at_least"] == n[n >= at].sum()
        assert r["docs_at_most"] == (n <= at).sum() and r["tokens_at_most"] == n[n <= at].sum()
        assert r["truncated_tokens"] == np.minimum(n, at).sum() and r["share_that_fits"] == (n <= at).mean()
    for r in C.at_limits(hist, [0, 100, 10 ** 9]).collect():
        assert r["truncated_tokens"] == np.minimum(n, r["limit"]).sum() and r["docs_that_fit"] == (n <= r["limit"]).sum()
        assert r["tokens_lost"] == n.sum() - r["truncated_tokens"]
    q = {r["share"]: r["n_tokens"] for r in C.quantiles(sums, [0.1, 0.5, 1.0]).collect()}
    assert q == {s: np.sort(n)[int(np.ceil(s * len(n))) - 1] for s in (0.1, 0.5, 1.0)}


def test_histogram_messy_and_empty(messy, tokens):
    want = Counter(len(library(tokens, r["text"])) for r in messy.collect())
    assert {r["n_tokens"]: r["n_docs"] for r in C.length_histogram(messy).collect()} == dict(want)
    assert C.suffix_sums(C.length_histogram(messy.limit(0))).count() == 0
    hist = C.length_histogram(messy)
    odd = hist.unionByName(hist.limit(1).selectExpr("cast(null as long) as n_tokens", "3L as n_docs"))
    assert sorted(C.suffix_sums(odd).collect()) == sorted(C.suffix_sums(hist).collect())
