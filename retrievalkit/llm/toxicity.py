"""Toxicity by a weighted finite-state pattern grammar.

A text is a sequence of symbols: each word is an insult, a threat, a target
(someone addressed), a negation, a verb of reported speech or other, and marks
end clauses. Four transducers rewrite these symbols: one marks insults and
threats inside the scope of a negation, one those in reported speech, one those
aimed at a target, and one turns threats that meet a target into matches. They
are composed, state by state, into one deterministic transducer, which reads
each text once; runs of other words are skipped in one step.

A match weighs its word's weight times the factor of its marks. Matches are
summed by clause, and a text's features are taken over its matched clauses: the
strongest, the sum, how many, and how many were negated or reported. A logistic
model of these features gives the score, so a lone word in a report counts for
less than a clause aimed at someone.

Word weights and the model are fitted on labelled rows; see ``fit``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrievalkit.llm import _words as W
from retrievalkit.llm._spark import prepare, stored, text_of

# The words the grammar knows before any label is seen.
INSULTS = ("asshole bastard bitch clown coward cretin degenerate disgusting dumb filth freak fool garbage "
           "hideous idiot idiotic imbecile jerk liar loser maggot moron moronic parasite pathetic pig rat "
           "repulsive retard scum scumbag sickening slob stupid trash ugly vermin vile worthless wretch").split()
THREATS = ("beat burn choke crush cut destroy hang hunt hurt kill murder punish shoot slap smash stab "
           "strangle torture").split()
TARGETS = "you your yours yourself u ur ya them they their he she him her his these those".split()
NEGATIONS = ("not no never none nobody neither nor without isn't aren't wasn't weren't don't doesn't didn't "
             "won't can't cannot couldn't wouldn't shouldn't ain't").split()
REPORTS = ("said says say saying told tells called calls claimed claims quoted quotes wrote writes reported "
           "reports alleged accused according").split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]")
FEATURES = 6


@dataclass
class Transducer:
    """Deterministic: ``step[state][symbol] = (state, output symbol)``; a symbol
    without an entry is passed on and leaves the state as it is."""

    start: object
    step: dict = field(default_factory=dict)

    def read(self, state, symbol):
        return self.step.get((state, symbol), (state, symbol))


def compose(first: Transducer, second: Transducer, symbols) -> Transducer:
    """``second`` reads what ``first`` writes; only states that can be reached."""
    start = (first.start, second.start)
    out, todo, seen = Transducer(start), [start], {start}
    while todo:
        a, b = todo.pop()
        for s in symbols:
            a2, mid = first.read(a, s)
            b2, end = second.read(b, mid)
            out.step[(a, b), s] = (a2, b2), end
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return out


def _scope(opener: int, width: int | None, mark: str) -> Transducer:
    """Mark insults and threats up to ``width`` symbols after ``opener`` (``None``:
    up to the end of the clause). Symbols are ``(kind, marks)`` pairs."""
    t = Transducer(0)
    for state in range((width or 1) + 1):
        for kind in range(7):
            for marks in [(), ("n",), ("r",), ("n", "r")]:
                down = 0 if kind == END else state if width is None else max(0, state - 1)
                to = (width or 1) if kind == opener else down
                out = (kind, (*marks, mark)) if state and kind in (INSULT, THREAT) else (kind, marks)
                t.step[state, (kind, marks)] = to, out
    return t


def grammar(window: int = 4) -> tuple[np.ndarray, list[list[tuple | None]], int]:
    """``(next state, output, start)`` by state and word class of the composed
    transducer; an output is ``None`` or the marks of a match."""
    symbols = [(k, ()) for k in range(7)]
    pairs = compose(_scope(NEGATION, 3, "n"), _scope(REPORT, None, "r"), symbols)
    aimed = Transducer(0)
    for state in range(window + 1):
        for kind in range(7):
            for marks in [(), ("n",), ("r",), ("n", "r")]:
                to = 0 if kind == END else window if kind == TARGET else max(0, state - 1)
                out = (kind, (*marks, "t")) if state and kind in (INSULT, THREAT) else (kind, marks)
                aimed.step[state, (kind, marks)] = to, out
    whole = compose(pairs, aimed, symbols)
    meets = Transducer(0)   # a threat counts once a target follows within the window, or stands before it
    for state in range(window + 1):
        for kind in range(7):
            for marks in [(), ("n",), ("r",), ("n", "r"), ("t",), ("n", "t"), ("r", "t"), ("n", "r", "t")]:
                to, out = (0 if kind == END else max(0, state - 1)), None
                if kind == INSULT:
                    out = ("insult", *marks)
                elif kind == THREAT:
                    to, out = (state, ("threat", *marks)) if "t" in marks else (window, None)
                elif kind == TARGET and state:
                    to, out = 0, ("threat", "t")
                meets.step[state, (kind, marks)] = to, out
    whole = compose(whole, meets, symbols)
    states = {s: i for i, s in enumerate(sorted({k[0] for k in whole.step}, key=repr))}
    nxt, outs = np.zeros((len(states), 7), np.int64), [[None] * 7 for _ in states]
    for (s, (kind, _)), (to, out) in whole.step.items():
        nxt[states[s], kind], outs[states[s]][kind] = states[to], out
    return nxt, outs, states[whole.start]


#: Factor of a match by its marks: negated, reported, aimed at a target.
FACTOR = {"n": 0.3, "r": 0.5, "t": 1.3}


class Lexicon(dict):
    """Word class by word; of words it lacks, by the longest known stem
    (an entry ``stem*``). Remembers a bounded number of words."""

    def __init__(self, stems: set[str], room: int = 200_000):
        super().__init__()
        self.stems, self.room = stems, room
        self.lengths = sorted({len(s) - 1 for s in stems}, reverse=True)

    def stem(self, word: str) -> str | None:
        return next((word[:n] + "*" for n in self.lengths if word[:n] + "*" in self.stems), None)

    def __missing__(self, word: str) -> int:
        kind = INSULT if self.stem(word) else OTHER
        if len(self) < self.room:
            self[word] = kind
        return kind


class Matcher:
    """Reads texts with the composed transducer and weighs their matches."""

    def __init__(self, weights: dict[str, float]):
        self.kind = Lexicon({w for w in weights if w.endswith("*")})
        self.kind.update(dict.fromkeys(".!?;\n", END))
        for words, kind in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT)):
            self.kind.update(dict.fromkeys(words, kind))
        self.kind.update({w: INSULT for w in weights if w not in THREATS and not w.endswith("*")})
        self.weights = weights
        self.next, self.out, self.start = grammar()
        runs = [np.arange(len(self.next))]      # state after so many other words
        for _ in range(8):
            runs.append(self.next[runs[-1], OTHER])
        self.skip = np.array(runs).tolist()
        self.step = self.next.tolist()

    def weight(self, word: str) -> float:
        return self.weights[word] if word in self.weights else self.weights.get(self.kind.stem(word), 1.0)

    def matches(self, text: str) -> tuple[list[tuple[int, str, tuple, float]], int]:
        """``(clause, word, marks, weight)`` of each match, and the token count."""
        tokens = _TOKEN.findall(text.lower())
        kinds = list(map(self.kind.__getitem__, tokens))
        if INSULT not in kinds and THREAT not in kinds:
            return [], len(tokens)
        found, state, last, clause, word = [], self.start, -1, 0, ""
        for at, kind in [(i, k) for i, k in enumerate(kinds) if k]:
            state = self.skip[min(at - last - 1, 8)][state]
            if kind == THREAT:
                word = tokens[at]
            out = self.out[state][kind]
            state, last = self.step[state][kind], at
            if out:
                hit = word if out[0] == "threat" else tokens[at]
                found.append((clause, hit, out, self.weight(hit) * math.prod(FACTOR[m] for m in out[1:])))
            clause += kind == END
        return found, len(tokens)

    def features(self, found: list, n: int) -> list[float]:
        clauses: dict[int, float] = {}
        for clause, _, _, weight in found:
            clauses[clause] = clauses.get(clause, 0.0) + max(weight, 0.0)
        total = sum(clauses.values())
        marked = sum(1 for _, _, m, _ in found if "n" in m or "r" in m)
        return [max(clauses.values(), default=0.0), math.log1p(total), math.log1p(len(clauses)),
                math.log1p(marked), total / math.sqrt(n + 25.0), 1.0 if found else 0.0]


@dataclass
class Model:
    """Word weights, and a logistic model of the features of matched clauses."""

    weights: dict[str, float]
    coef: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        x = (features.reshape(-1, FEATURES) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.coef[0] + x @ self.coef[1:], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    a = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (p - y) + penalty * beta
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), grad)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def _grams(text: str) -> set[str]:
    """The distinct words of a text and, marked ``*``, their stems of 3 to 8 letters."""
    words = set(_TOKEN.findall(text.lower())) - set(".!?;\n")
    return words | {w[:n] + "*" for w in words for n in range(3, min(9, len(w)))}


#: The model that the word list alone gives, where labels are absent or all equal.
_PRIOR = np.array([-3.0, 1.0, 0.5, 0.5, -0.5, 0.5, 1.5])


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic", min_log_odds: float = 3.0,
        min_share: float = 0.01) -> Model:
    """Fit on at most ``max_rows`` labelled rows, the first by a hash of the id.

    Rows whose ids give crc32 0 modulo 5 are never used. Copies count once: of
    rows with one MinHash of 3-word shingles only one is kept. A word, or a stem that
    inflected words share, becomes an insult if its smoothed log-odds reach ``min_log_odds`` and it explains at
    least ``min_share`` of the toxic rows beyond those that stronger words
    explain already, so the words of a few copied texts are not taken.
    """
    spark = docs.sparkSession
    prepare(spark)
    some = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    some = some.filter("id is not null and y in (0, 1) and crc32(cast(id as string)) % 5 != 0").dropDuplicates()
    some = some.orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mins = [np.zeros(0, np.uint64)]
            for _, _, buf, off in W.chunks(batch.column(2)):
                words = W.Words(buf, off)
                mins.append(W.run_mins(*W.shingles(words.hashes(True), words.first, 3), np.uint64(0)))
            yield batch.append_column("copy", pa.array(np.concatenate(mins).view(np.int64)))

    # at most max_rows rows on either side from here on
    rows = source.join(F.broadcast(some), "id").select("id", "y", "text").mapInArrow(
        sketch, "id long, y int, text string, copy long")
    rows = stored(rows, "labelled")
    one = rows.groupBy("copy").agg(F.min("id").alias("id"))
    rows = rows.join(F.broadcast(one), ["copy", "id"])
    # rows that share an id, or an id labelled both ways: the least label, then the least text
    rows = stored(rows.groupBy("id").agg(F.min(F.struct("y", "text")).alias("row")).select("id", "row.y", "row.text"), "fit")
    size = rows.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    pos, neg = int(size["p"]), int(size["n"] - size["p"])
    weights = {w: 3.0 for w in (*INSULTS, *THREATS)}
    if not pos or not neg:
        return Model(weights, _PRIOR, np.zeros(FEATURES), np.ones(FEATURES))

    def count(wanted: set[str] | None):
        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n: dict[str, int] = {}
                for t in batch.column(2):
                    grams = _grams(t.as_py())
                    for g in grams if wanted is None else grams & wanted:
                        n[g] = n.get(g, 0) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["gram", "n"])
        return tally

    def totals(of: DataFrame, wanted: set[str] | None, at_least: int) -> dict[str, int]:
        n = of.mapInArrow(count(wanted), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        return {r["gram"]: r["n"] for r in n.filter(F.col("n") >= at_least).collect()}

    # words and stems of at least min_share of the toxic rows: at most 1 / min_share texts' worth of them
    least = max(3, math.ceil(min_share * pos))
    p = totals(rows.filter("y = 1"), None, least)
    listed = {w: 0 for w in weights}
    listed |= totals(rows.filter("y = 1"), set(weights), 1)
    q = totals(rows.filter("y = 0"), set(p) | set(weights), 1)

    def odds(a: int, b: int) -> float:
        return math.log((a + 0.5) / (pos + 1)) - math.log((b + 0.5) / (neg + 1))

    for w, a in listed.items():   # the list's own words: between the labels' odds and the prior
        seen = a + q.get(w, 0)
        weights[w] = min(8.0, max(0.0, (odds(a, q.get(w, 0)) * seen + 3.0 * 2) / (seen + 2)))
    near = {g: o for g, a in p.items() if (o := odds(a, q.get(g, 0))) >= min_log_odds}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(_grams(t.as_py()) & near.keys()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["words"])

    toxic = [set(r["words"]) for r in rows.filter("y = 1").mapInArrow(hits, "words array<string>").collect()]
    while True:   # greedy cover of the toxic rows; of equal grams the longest
        left: dict[str, int] = {}
        for words in toxic:
            for w in words:
                left[w] = left.get(w, 0) + 1
        best = max(left, key=lambda w: (left[w] * near[w], not w.endswith("*"), len(w), w), default=None)
        if best is None or left[best] < least:
            break
        weights[best] = min(8.0, near[best])
        toxic = [w for w in toxic if best not in w]

    matcher = Matcher(weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [matcher.features(*matcher.matches(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["id", "y", "x"])

    seen = rows.mapInArrow(measure, "id long, y int, x array<double>").orderBy("id").toArrow()
    x = np.array(seen["x"].to_pylist(), float).reshape(-1, FEATURES)
    y = np.array(seen["y"].to_pylist(), float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    return Model(weights, _logistic((x - mean) / scale, y), mean, scale)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(id, score, matches)``, score from 0 to 1.

    ``matches`` holds the clause number, kind, word, marks and weight of every
    match. Only the text is read. Null and empty texts have no matches and the
    score of such texts; null ids stay null; repeated rows are scored each; an
    empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)   # a few hundred words
    match = pa.struct([("clause", pa.int64()), ("kind", pa.string()), ("word", pa.string()),
                       ("marks", pa.list_(pa.string())), ("weight", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        matcher = Matcher(m.weights)
        for batch in batches:
            x, found = [], []
            for t in batch.column(1):
                hits, n = matcher.matches(t.as_py())
                x.append(matcher.features(hits, n))
                found.append([{"clause": c, "kind": o[0], "word": w, "marks": list(o[1:]), "weight": v}
                              for c, w, o, v in hits])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(m.score(np.array(x, float))), pa.array(found, pa.list_(match))],
                names=["id", "score", "matches"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))
    return source.mapInArrow(score, "id long, score double, matches array<struct<clause:long,kind:string,"
                                    "word:string,marks:array<string>,weight:double>>")


def not_toxic(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``limit``, with all columns,
    filtered where they are. Null and empty texts score as such texts do; repeated
    rows are judged alike; an empty table gives an empty one."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        m = shared.value
        matcher = Matcher(m.weights)
        x = [matcher.features(*matcher.matches(t.as_py())) for t in texts]
        return pa.array(m.score(np.array(x, float).reshape(-1, FEATURES)))

    # only the text goes to Python, and a number comes back; the rows wait in the JVM
    return docs.filter(score(text_of(text_col)) < limit)
