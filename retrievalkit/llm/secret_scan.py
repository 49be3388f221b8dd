"""Secrets by patterns and by a randomness test battery, in DataFrame functions only.

Besides three fixed patterns, every long run of token characters is a candidate.
Its encoding is inferred (hex, base32, lower-case letters and digits, base64),
and three tests ask whether it looks drawn at random from that alphabet:
chi-squared uniformity of its characters, the runs test above and below the
middle of the alphabet, and lag-1 serial correlation. The sum of their squared
z-values is the candidate's statistic: small for keys, large for language.

Whether a small value is a discovery depends on how often language of that
length reaches it by chance. Per length class all letters of every document are
cut into stretches of that length; these and those of a fixed piece of prose are
the null population. Its p-values are empirical down to the lowest few stretches
and follow a power law below, so they are not bounded by the number of stretches. The Benjamini-Hochberg rule
over the candidates of a class that mix letters and digits sets its limit; UUIDs
and words and numbers joined by signs are classes of their own, so any number of
them takes nothing from the rest. All only need counts by class and bin, so the
false-discovery control covers the whole corpus with one small aggregate and no
sort.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrievalkit.llm._spark import prepare, text_of

# The base patterns.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "random"]

RUN = 20                                     # least length of a candidate
LENGTHS = [RUN, 24, 32, 48, 80]              # where length classes begin
BIN, BINS = 0.25, 4000                       # width and number of bins of the statistic
PIECE = math.lcm(*LENGTHS)                   # letters of a text looked at at a time; every class's stretches fit in whole
BITS, WORD = 5, 60                           # bits of a letter, and letters whose bits one number holds; divides PIECE
TAIL, SHARE = 10, 0.05                       # least number and share of the lowest stretches that set the tail
STEEP = (1.5, 8.0)                           # bounds of its exponent: three squares near zero, and what few stretches can show
REJECTED = 16.27                             # chi-squared with 3 degrees of freedom, upper 0.1 %
_CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % RUN
#: A text with a candidate that holds a digit: one stands within a run, near enough to its ends. Looks for a digit first.
_MIXED = r"[0-9](?:[A-Za-z0-9+/_=-]{%d}|(?<=[A-Za-z0-9+/_=-]{%d}[0-9]))" % ((RUN - 1) // 2, (RUN - 1) // 2)
_DIGIT_WORD = r"(?<![A-Za-z+/_=-])[A-Za-z+/_=-]*+[0-9][A-Za-z0-9+/_=-]*+"
_UUID = "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
#: Ordinary prose, so that a table with few or short documents has a null population.
PROSE = (
    "The old road leaves the village by the mill and follows the river for about three miles before it climbs into the "
    "hills. In winter the water often covers the lower fields, and people who work on the other side have to take the "
    "bridge further north. Nobody seems to mind very much, because the longer way passes the market and the small shop "
    "where everyone stops to talk. When the weather is better the children walk along the bank after school, looking for "
    "fish and throwing stones at whatever floats past. Most of the houses were built by the same family, who came here to "
    "quarry stone and stayed when the quarry closed. Their name is still written above the door of the chapel, although "
    "the letters have almost disappeared. A few years ago the council offered to repair them, but the question of who "
    "should pay could not be settled and the plan was quietly dropped. Further up the valley there is nothing except sheep "
    "and wind. The path becomes difficult after the second gate, and visitors are told to turn back if clouds begin to "
    "gather over the ridge. Those who go on are rewarded with a view of the whole coast, from the harbour in the south to "
    "the lighthouse on the far point. On a clear evening you can see the boats coming home, each with a line of gulls "
    "behind it. It is easy to stay too long up there and to find yourself walking down in the dark, with only the sound of "
    "the stream to show the direction. The farmer keeps a lamp in his window for that reason. He says that his father did "
    "the same, and that in all those years only one traveller ever knocked to ask for help, a young man who had lost both "
    "his shoes and his hat in the bog and who afterwards sent a letter of thanks every spring until he died.")
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: (what a body must look like, its alphabet in order, effective size)
ENCODINGS = [(r"^[0-9a-fA-F]+$", _DIGITS + "abcdef", 16), (r"^[A-Z2-7]+$", _UPPER + "234567", 32),
             (r"^[0-9a-z]+$", _DIGITS + _LOWER, 36), (r"^.*$", _UPPER + _LOWER + _DIGITS + "+/-_", 64)]


_HALF = (len(_DIGITS) + len(_LOWER)) // 2 - len(_DIGITS)       # letters in the lower half of digits and letters; a power of two
#: The JVM compiles no method of more than 8000 bytes; Spark splits those that it is told not to fuse.
_METHOD, _COMPILED = "spark.sql.codegen.hugeMethodLimit", 8000
_SIGNS = "".join(c for c in map(chr, range(128)) if not c.isalpha())
_P = "__secret_"                             # prefix of columns that the steps below add


def _add_matches(df: DataFrame, name: str, pattern: str, maybe: Column, group: int | None = None) -> DataFrame:
    """``df`` with ``__secret_<name>``: an array of ``(start, end, value)`` of the
    leftmost non-overlapping matches in ``__secret_text``, in code points;
    ``value`` is the match or the given group. Only texts with ``maybe`` are
    searched. One column a step, so no step is computed twice."""
    text, c = F.col(f"{_P}text"), lambda n: F.col(f"{_P}{name}_{n}")
    none = F.array().cast("array<string>")
    every = lambda g: F.when(c("maybe"), F.regexp_extract_all(text, F.lit(pattern), F.lit(g))).otherwise(none)
    df = df.withColumn(f"{_P}{name}_maybe", maybe).withColumn(f"{_P}{name}_hits", every(0))
    df = df.withColumn(f"{_P}{name}_value", c("hits") if group is None else every(group))
    # text before each match, then the match; what follows the last one does not matter
    gaps = F.when(F.size(c("hits")) > 0, F.slice(F.split(text, pattern, -1), 1, F.size(c("hits")))).otherwise(none)
    df = df.withColumn(f"{_P}{name}_step", F.zip_with(gaps, c("hits"), lambda g, h: F.struct(
        F.length(g).alias("gap"), F.length(h).alias("size"))))
    starts = F.aggregate(
        c("step"), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, x: F.struct((s["at"] + x["gap"] + x["size"]).alias("at"),
                              F.concat(s["out"], F.array(s["at"] + x["gap"])).alias("out")))["out"]
    df = df.withColumn(f"{_P}{name}", F.transform(
        F.arrays_zip(starts.alias("start"), c("step").alias("step"), c("value").alias("value")),
        lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["step"]["size"]).alias("end"), x["value"].alias("value"))))
    return df.drop(*[f"{_P}{name}_{n}" for n in ("maybe", "hits", "value", "step")])


def _add_base(df: DataFrame) -> DataFrame:
    """``df`` with the matches of the fixed patterns, as ``(start, kind, end)`` in
    ``__secret_base``."""
    text = F.col(f"{_P}text")
    # a run of hex digits or key letters that is long enough is whole, so the bound may stand in the pattern;
    # an assignment whose value is short still uses up its text
    hex_, access = f"[0-9a-f]{{{LEAST['hex']},}}", f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}"
    lower = F.col(f"{_P}lower")
    named = lower.contains("passw") | lower.contains("secret") | lower.contains("token") | lower.contains("api")
    df = df.withColumn(f"{_P}lower", F.lower(text))
    df = _add_matches(df, "assign", ASSIGN, named, 2).drop(f"{_P}lower")
    df = _add_matches(df, "access", access, text.contains("AKIA"))
    df = _add_matches(df, "hex", hex_, text.rlike(hex_))
    kinds = {k: F.col(f"{_P}{k}") for k in KINDS[:3]}
    kinds["assign"] = F.filter(kinds["assign"], lambda x: F.length(x["value"]) >= LEAST["assign"])
    return df.withColumn(f"{_P}base", F.concat(*[_named(kinds[k], n) for n, k in enumerate(KINDS[:3])])
                         ).drop(*[f"{_P}{k}" for k in KINDS[:3]])


def _named(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _square_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def _battery(body: Column, alphabet: str, k: int) -> Column:
    """The three z-values, squared and added."""
    n = F.length(body).cast("double")
    counts = F.transform(F.array(*[F.lit(c) for c in alphabet]),
                         lambda c: n - F.length(F.replace(body, c, F.lit(""))))
    chi = k / n * _square_sum(counts) - n
    z_chi = F.greatest((chi - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n), F.lit(0.0))
    half = len(alphabet) // 2
    bits = F.translate(body, alphabet, "0" * half + "1" * (len(alphabet) - half))
    ones = F.length(F.replace(bits, F.lit("0"), F.lit(""))).cast("double")
    turns = sum((n - F.length(F.replace(bits, F.lit(x), F.lit("")))) / 2 for x in ("01", "10"))
    mean = 2 * ones * (n - ones) / n
    z_runs = F.when(mean > 1, (turns - mean) / F.sqrt(F.greatest(mean * (mean - 1) / (n - 1), F.lit(0.01)))).otherwise(
        F.lit(6.0))
    v = F.transform(F.split(body, ""), lambda c: F.instr(F.lit(alphabet), c).cast("double"))
    return F.struct(n.alias("n"), (z_chi * z_chi + z_runs * z_runs).alias("z"), v.alias("v"))


def _serial(v: Column, n: Column, total: Column) -> Column:
    """Squared z-value of the lag-1 correlation of ``n`` values with that sum."""
    m = total / n
    spread = _square_sum(v) - n * m * m
    # sum of (a - m)(b - m) over neighbours, from plain sums: an outer value inside a lambda is computed per element
    pairs = F.aggregate(F.zip_with(v, F.slice(v, 2, F.size(v)), lambda a, b: F.coalesce(a * b, F.lit(0.0))),
                        F.lit(0.0), lambda s, x: s + x)
    lagged = pairs - m * (2 * total - F.element_at(v, 1) - F.element_at(v, -1)) + (n - 1) * m * m
    r = F.when(spread > 0, lagged / F.greatest(spread, F.lit(1e-9))).otherwise(F.lit(1.0))
    return r * r * n


def _joined_words(body: Column) -> Column:
    """1 for words, numbers and UUIDs joined by signs: no letter beside a digit. Else 0."""
    return (~F.regexp_replace(body, _UUID, "-").rlike("[A-Za-z][0-9]|[0-9][A-Za-z]")).cast("int")


def _statistic(bodies: Column) -> Column:
    """Array of ``(start, end, body)`` to one of ``(start, end, length, bin)``;
    ``length`` numbers the length classes, then those of joined words."""
    def with_tests(x: Column) -> Column:
        out = None
        for shape, alphabet, k in ENCODINGS:
            tests = _battery(F.lower(x["body"]) if k == 16 else x["body"], alphabet, k)
            out = F.when(x["body"].rlike(shape), tests) if out is None else out.when(x["body"].rlike(shape), tests)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), out.alias("t"),
                        (_joined_words(x["body"]) * len(LENGTHS)).alias("form"))

    def with_sum(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["t"].alias("t"), x["form"].alias("form"),
                        F.aggregate(x["t"]["v"], F.lit(0.0), lambda s, y: s + y).alias("sum"))

    def with_bin(x: Column) -> Column:
        total = x["t"]["z"] + _serial(x["t"]["v"], x["t"]["n"], x["sum"])
        length = x["form"] + sum((x["t"]["n"] >= at).cast("int") for at in LENGTHS[1:])
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), length.alias("length"),
                        F.least(F.floor(total / BIN), F.lit(BINS - 1)).cast("int").alias("bin"))

    return F.transform(F.transform(F.transform(bodies, with_tests), with_sum), with_bin)


def _add_tested(df: DataFrame) -> DataFrame:
    """``df`` with the candidates that mix letters and digits, as ``(start, end,
    length, bin)`` in ``__secret_tested``."""
    df = _add_matches(df, "run", _CANDIDATE, F.col(f"{_P}text").rlike(_MIXED))
    bodies = F.transform(F.col(f"{_P}run"), lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.regexp_replace(x["value"], "=+$", "").alias("body")))
    mixed = F.filter(bodies, lambda x: (F.length(x["body"]) >= RUN) & x["body"].rlike("[0-9]") & x["body"].rlike("[A-Za-z]"))
    return df.withColumn(f"{_P}tested", _statistic(mixed)).drop(f"{_P}run")


def _place(letter: int) -> int:
    """Of the n-th letter in the alphabet of digits and letters, as ``instr`` counts."""
    return len(_DIGITS) + 1 + letter


def _sum(columns) -> Column:
    return reduce(Column.__add__, columns)


def _null(texts: DataFrame) -> DataFrame:
    """``(length, bin)`` of every stretch of the letters of the ``__secret_text``s:
    per length class a text's letters are cut from its first on into stretches of
    that length, none overlapping; of texts with a candidate, without the words
    that hold a digit. The same statistic as ``_statistic`` gives lower-case
    letters, a row a stretch. A letter is its place in a-z, five bits; a stretch
    is five numbers with one of these bits of each of its letters (``p``, and ``q`` for
    the second half of one longer than a number), so that letters, neighbours and
    turns are counted by bit operations on all letters at once."""
    text, letters = F.col(f"{_P}text"), F.col(f"{_P}letters")
    # words with a digit may be the keys themselves
    plain = F.when(text.rlike(_MIXED), F.regexp_replace(text, _DIGIT_WORD, "")).otherwise(text)
    # a text without other signs than these needs no pattern
    df = texts.select(F.translate(plain, _SIGNS, "").alias(f"{_P}all"))
    df = df.select(F.lower(F.when(F.octet_length(f"{_P}all") > F.length(f"{_P}all"), F.regexp_replace(f"{_P}all", "[^A-Za-z]+", "")
                                  ).otherwise(F.col(f"{_P}all"))).alias(f"{_P}all"))
    df = df.select(F.explode_outer(F.regexp_extract_all(f"{_P}all", F.lit(f".{{1,{PIECE}}}"), F.lit(0))).alias(f"{_P}letters"))
    df = df.where(F.length(letters) >= RUN)
    digits = ["".join(str(i >> b & 1) for i in range(len(_LOWER))) for b in range(BITS)]
    df = df.select(F.length(letters).alias("size"), *[
        F.rpad(F.translate(letters, _LOWER, d), PIECE, "0").alias(f"bits{b}") for b, d in enumerate(digits)])
    df = df.select("size", *[F.array(*[
        F.conv(F.substring(f"bits{b}", at + 1, WORD), 2, 10).cast("long") for at in range(0, PIECE, WORD)]).alias(f"words{b}")
        for b in range(BITS)])

    def place(name: str, at: int, n: int) -> list[Column]:
        """Where ``n`` bits stand: the number, how many of them are in the next one (less than none: how many
        others follow), and ``n`` bits that are set."""
        return [F.lit(at // WORD).alias(f"{name}_in"), F.lit(at % WORD + n - WORD).alias(f"{name}_over"),
                F.lit((1 << n) - 1).cast("long").alias(f"{name}_set"), F.lit(n).alias(f"{name}_n")]

    places = F.array(*[F.struct(
        F.lit(i).alias("length"), F.lit(n).alias("n"), F.lit(at + n).alias("end"),
        *place("p", at, n if n <= WORD else n // 2), *place("q", *((0, 0) if n <= WORD else (at + n // 2, n - n // 2))))
        for i, n in enumerate(LENGTHS) for at in range(0, PIECE, n)])
    df = df.select("*", F.explode(places).alias("s")).where("s.end <= size")
    left, right = (lambda x, by, f=f: F.call_function(f, x, by) for f in ("shiftleft", "shiftright"))

    def bits(name: str, b: int) -> Column:
        at, over = F.col(f"s.{name}_in"), F.col(f"s.{name}_over")
        this, following = F.get(f"words{b}", at), F.get(f"words{b}", at + 1)
        found = F.when(over > 0, left(this, over).bitwiseOR(right(following, F.lit(WORD) - over))).otherwise(right(this, -over))
        return F.coalesce(found.bitwiseAND(F.col(f"s.{name}_set")), F.lit(0).cast("long")).alias(f"{name}{b}")   # never null: short code

    df = df.select("s.length", "s.n", "s.p_n", "s.q_n", "s.p_set", "s.q_set", *[bits(x, b) for x in "pq" for b in range(BITS)])
    # where a stretch has letters with these low bits, and with these high ones
    low, high = range(BITS - 2), range(BITS - 2, BITS)

    def alike(name: str, of: range, value: int) -> Column:
        return reduce(Column.bitwiseAND, [F.col(f"{name}{b}") if value >> i & 1 else F.bitwise_not(f"{name}{b}")
                                          for i, b in enumerate(of)], F.col(f"{name}_set"))

    df = df.select("*", *[alike(x, low, v).alias(f"{x}_low{v}") for x in "pq" for v in range(1 << len(low))],
                   *[alike(x, high, v).alias(f"{x}_high{v}") for x in "pq" for v in range(1 << len(high))])
    # sums in double, without checks of an integer's bounds
    count = lambda i: _sum(F.bit_count(F.col(f"{x}_low{i % (1 << len(low))}").bitwiseAND(
        F.col(f"{x}_high{i >> len(low)}"))).cast("double") for x in "pq")
    end = lambda x, by: _sum(F.shiftleft(right(F.col(f"{x}{b}"), by).bitwiseAND(F.lit(1)).cast("int"), b) for b in range(BITS))
    upper = lambda x: reduce(Column.bitwiseOR, [F.col(f"{x}{b}") for b in range(BITS) if 1 << b >= _HALF])
    kept = ["length", "n", *[f"{x}{b}" for x in "pq" for b in range(BITS)]]
    df = df.select(*kept, "q_n", *[count(i).alias(f"of_{c}") for i, c in enumerate(_LOWER)],
                   *[upper(x).alias(f"{x}_upper") for x in "pq"], *[F.shiftright(f"{x}_set", 1).alias(f"{x}_pairs") for x in "pq"],
                   end("p", F.col("p_n") - 1).alias("first"), end("p", F.lit(0)).alias("before"),
                   end("q", F.col("q_n") - 1).alias("after"), end("q", F.lit(0)).alias("last"))
    halves, before, after = F.col("q_n") > 0, F.col("before"), F.col("after")
    counts = [F.col(f"of_{c}") for c in _LOWER]
    neighbours = [F.bit_count(F.shiftright(f"{x}{a}", 1).bitwiseAND(F.col(f"{x}{b}"))).cast("double") * float(1 << a + b)
                  for x in "pq" for a in range(BITS) for b in range(BITS)]
    turns = [F.bit_count(F.col(f"{x}_upper").bitwiseXOR(F.shiftright(f"{x}_upper", 1)).bitwiseAND(F.col(f"{x}_pairs"))) for x in "pq"]
    df = df.select("length", F.col("n").cast("double").alias("n"), *[f"of_{c}" for c in _LOWER], "first",
                   F.when(halves, F.col("last")).otherwise(before).alias("last"),
                   (_sum(neighbours) + before * after).alias("pairs"),     # the halves of a stretch meet in the last
                   (_sum(turns) + (halves & ((before < _HALF) != (after < _HALF))).cast("int")).alias("turns"))
    df = df.select("length", "n", "first", "last", "pairs", "turns", _sum(counts[_HALF:]).alias("ones"),
                   _sum(c * c for c in counts).alias("equal"), _sum(counts[:6]).alias("hex"),
                   _sum(c * float(i) for i, c in enumerate(counts)).alias("total"),
                   _sum(c * float(i * i) for i, c in enumerate(counts)).alias("squares"))
    # from places in a-z to places in the alphabet
    n, total, ends, base = F.col("n"), F.col("total"), F.col("first") + F.col("last"), float(_place(0))
    df = df.select("length", "n", "turns", "ones", "equal", "hex",
                   (total + n * base).alias("total"), (F.col("squares") + total * (2 * base) + n * (base * base)).alias("squares"),
                   (F.col("pairs") + (total * 2 - ends) * base + (n - 1) * (base * base)).alias("pairs"),
                   (F.col("first") + base).alias("first"), (F.col("last") + base).alias("last"))
    hexes = F.col("hex") == F.col("n")
    k = F.when(hexes, F.lit(16)).otherwise(F.lit(len(_DIGITS) + len(_LOWER)))
    df = df.withColumn("k", k).withColumn("mean", F.when(hexes, F.lit(0.0)).otherwise(
        2 * F.col("ones") * (n - F.col("ones")) / n)).withColumn("m", F.col("total") / n)
    k, mean, m = F.col("k"), F.col("mean"), F.col("m")
    chi = k / n * F.col("equal") - n
    z_chi = F.greatest((chi - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n), F.lit(0.0))
    z_runs = F.when(mean > 1, (F.col("turns") - mean) / F.sqrt(F.greatest(mean * (mean - 1) / (n - 1), F.lit(0.01)))).otherwise(
        F.lit(6.0))
    spread = F.col("squares") - n * m * m
    lagged = F.col("pairs") - m * (2 * F.col("total") - F.col("first") - F.col("last")) + (n - 1) * m * m
    r = F.when(spread > 0, lagged / F.greatest(spread, F.lit(1e-9))).otherwise(F.lit(1.0))
    df = df.select("length", "n", z_chi.alias("z"), z_runs.alias("runs"), r.alias("r"))
    total = F.col("z") * F.col("z") + F.col("runs") * F.col("runs") + F.col("r") * F.col("r") * n
    return df.select("length", F.least(F.floor(total / BIN), F.lit(BINS - 1)).cast("int").alias("bin"))


def p_values(null: list[int]) -> list[float]:
    """Per bin the chance that language falls in it or below, from the counts of
    null stretches by bin.

    Empirical where enough of the lowest stretches lie below. Under those a power
    law whose exponent is a lower bound (95 %) of Hill's estimate from them: a
    tail that gets steeper downwards is overestimated, never under the counts."""
    whole, below, out = sum(null), 0, []
    for n in null:
        below += n
        out.append((1 + below) / (1 + whole))
    lowest = max(TAIL, int(SHARE * whole))
    if whole < TAIL:
        return out
    below, logs = 0, 0.0
    top = next(b for b, p in enumerate(out) if p * (1 + whole) - 1 >= lowest - 0.5)
    for b, n in enumerate(null[:top + 1]):
        below += n
        logs += n * math.log((top + 1) / (b + 0.5))
    steep = min(max(below / logs * (1 - 1.645 / math.sqrt(below)), STEEP[0]), STEEP[1])
    tail, below = out[top], 0
    for b in range(top):
        below += null[b]
        out[b] = min(out[b], max(tail * ((b + 1) / (top + 1)) ** steep, below / (1 + whole)))
    return out


def discoveries(p: list[float], tested: list[int], rate: float) -> int:
    """The Benjamini-Hochberg rule on counts by bin: the bins below the returned
    number are discoveries."""
    m, passed, best = sum(tested), 0, 0
    for b, n in enumerate(tested):
        passed += n
        if passed and p[b] <= rate * passed / m:     # each counts to its bin's upper end
            best = b + 1
    return best


def limits(docs: DataFrame, text_col: str = "text", rate: float = 0.01) -> list[int]:
    """Per class (the length classes, then those of joined words) the bins of
    the statistic that are discoveries at the false-discovery ``rate``: those
    below the returned number."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(text_of(text_col).alias(f"{_P}text"))
    every = texts.unionByName(spark.range(1).select(F.lit(PROSE).alias(f"{_P}text")))
    runs = _add_tested(texts).select(F.explode_outer(f"{_P}tested").alias("t")).where("t is not null")
    seen = _null(every).select("length", "bin", F.lit(0).alias("t")).unionByName(
        runs.select("t.length", "t.bin", F.lit(1).alias("t"))).groupBy("length", "bin").agg(
        F.sum(1 - F.col("t")).alias("null"), F.sum("t").alias("tested"))
    n = len(LENGTHS)
    null, tested = [[0] * BINS for _ in range(n)], [[0] * BINS for _ in range(2 * n)]
    fused = spark.conf.get(_METHOD, None)
    spark.conf.set(_METHOD, str(min(int(fused or _COMPILED), _COMPILED)))
    try:
        rows = seen.collect()                # at most classes x bins rows
    finally:
        spark.conf.unset(_METHOD) if fused is None else spark.conf.set(_METHOD, fused)
    for r in rows:
        null[r["length"] % n][r["bin"]] += r["null"]     # letters only: of no form
        tested[r["length"]][r["bin"]] += r["tested"]
    p = [p_values(x) for x in null]
    # a key must also pass the tests themselves
    return [min(int(REJECTED / BIN) + 1, discoveries(p[c % n], tested[c], rate)) for c in range(2 * n)]


def _add_spans(df: DataFrame, text_col: str, limit: list[int]) -> DataFrame:
    """``df`` with all spans, ``(start, kind, end)``, sorted, in ``__secret_spans``."""
    df = _add_tested(_add_base(df.withColumn(f"{_P}text", text_of(text_col))))
    limit = limit * 2 if len(limit) == len(LENGTHS) else limit
    known, most = F.col(f"{_P}base"), F.array(*[F.lit(b) for b in limit])
    random = F.filter(F.col(f"{_P}tested"), lambda x: x["bin"] < F.element_at(most, x["length"] + 1))
    random = F.filter(random, lambda x: ~F.exists(known, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return df.withColumn(f"{_P}spans", F.array_sort(F.concat(known, _named(random, 3))))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rate: float = 0.01,
                 limit: list[int] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``(id, n_assign, n_access, n_hex, n_random,
    base, spans)``; ``spans`` holds ``(start, kind, end)`` in code points, end
    exclusive, sorted, kinds numbered as in ``KINDS``; ``base`` those of the
    fixed patterns. Random spans that touch a base span are left out.

    ``limit`` as ``limits`` returns it, or one number a length class, by default taken from ``docs``. Null and
    empty texts have no spans; null ids are returned as they are; repeated rows
    are scanned each; other columns are not read; an empty table gives an empty
    one. Uses DataFrame functions only.
    """
    limit = limits(docs, text_col, rate) if limit is None else limit
    out = _add_spans(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")),
                     "text", limit).select("id", F.col(f"{_P}spans").alias("spans"))
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")
    return out.select("id", *[count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)],
                      F.filter("spans", lambda s: s["kind"] < 3).alias("base"), "spans")


def redact_secrets(docs: DataFrame, text_col: str = "text", *, rate: float = 0.01, mask: str = "[SECRET]",
                   limit: list[int] | None = None) -> DataFrame:
    """``docs`` with every span of a secret, or of several that overlap,
    replaced by ``mask`` in ``text_col``; other columns, null texts and rows
    without secrets stay as they are."""
    limit = limits(docs, text_col, rate) if limit is None else limit
    text, spans = F.col(f"{_P}text"), F.col(f"{_P}spans")
    kept = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(x["start"] >= s["at"], F.struct(
            x["end"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mask)).alias("out"))
        ).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))))
    clean = F.when(F.size(spans) > 0, F.concat(kept["out"], F.substring(text, kept["at"] + 1, F.length(text))))
    return _add_spans(docs, text_col, limit).select(*[
        F.coalesce(clean, F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def joined(spans: str) -> Column:
    """A spans column as text: ``kind:start:end``, comma-joined."""
    return _joined(F.col(spans))
