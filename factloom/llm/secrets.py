"""Secret scan with a randomness test battery, in DataFrame operations only.

Base kinds are regular expressions: assign (a named credential with its value), access (a cloud access key), hex (a long
run of hexadecimal digits). The battery adds `random`: unbroken tokens of at least MIN_LENGTH characters with letters and
digits whose characters look uniformly drawn. For each token the encoding is inferred (hex, base32, base36, base62,
base64, or the letters of both base64 forms, which every token meets), and three tests ask whether it may come from a uniform source over
that alphabet: chi-squared over eight stretches of the alphabet, each with its own probability, the number of runs above and below
the middle, and the lag-one serial correlation. A token that fails them together at UNIFORM is no secret.

What passes may still be natural, the more easily the shorter it is. So each token is also held against written language: letters with
the frequencies of LETTERS, digits, capitals and signs in fixed shares. For n such characters the chi-squared statistic is
noncentral, its noncentrality n times how far those frequencies are from uniform in that alphabet; how small the token's own
statistic is under that law is its p. A Benjamini-Hochberg step over all tokens of the whole table, one for each length class because
longer tokens have more power, rejects language at false-discovery rate FDR: at most that share of the reported tokens is expected to
be natural. It needs one small histogram (length class by p-bin, bounded by their numbers), gathered from the texts with a token
in a first pass; the second pass is map-only and shuffles nothing.

Null text is empty and has no spans; repeated rows stay; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import listed, masked, spans_of, with_matches

#: Fixed patterns of the base kinds, in the order in which kinds are listed.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
#: The value of an assignment is what a match has behind its name, sign and quote.
_ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
MIN_VALUE = 6
MIN_LENGTH = 20
FDR = 0.05
#: Tokens that a uniform source would give more rarely than this are not uniform.
UNIFORM = 0.01
#: Length classes of the false-discovery step: a token's class is the number of these that it reaches.
CLASSES = (24, 32, 40, 48, 64, 96, 128)
_P_BINS = 160  # tenths of -log10(p)
_TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH

#: Alphabets in their natural order, tried in this order.
_ENCODINGS = (
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("^[A-Za-z0-9_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("^[A-Za-z0-9+/=]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("^[A-Za-z0-9+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)


# Per cent of each letter in English text, a to z, and the shares of other characters in identifiers.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
_DIGITS, _CAPITALS, _SIGNS = 0.12, 0.1, 0.05
_CELLS = 8


def _cells(letters: str) -> list[int]:
    """The stretch of the alphabet in which each of its characters lies."""
    return [int((i + 0.5) / len(letters) * _CELLS) for i in range(len(letters))]


def _shares(letters: str) -> tuple[list[float], float]:
    """The uniform probability of each stretch, and how far written language is from it, per character."""

    def natural(c: str) -> float:
        if c.isdigit():
            return _DIGITS / 10
        if not c.isalpha():
            return _SIGNS / 4
        own = LETTERS[ord(c.lower()) - 97] / sum(LETTERS)
        return own * (_CAPITALS if c.isupper() and any(x.islower() for x in letters) else 1.0 - _CAPITALS)

    cells, weights = _cells(letters), [natural(c) for c in letters]
    uniform = [cells.count(b) / len(letters) for b in range(_CELLS)]
    said = [sum(w for w, c in zip(weights, cells) if c == b) / sum(weights) for b in range(_CELLS)]
    return uniform, sum((f - u) ** 2 / u for f, u in zip(said, uniform))


def _let(value: Column, body) -> Column:
    """`body` of `value`, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _upper_tail(z: Column) -> Column:
    """P(N(0,1) > z) by the logistic form 1/(1+exp(1.5976 z + 0.07056 z^3)), within 2e-4 and monotone."""
    return 1 / (1 + F.exp(F.greatest(F.lit(-300.0), F.least(F.lit(300.0), 1.5976 * z + 0.07056 * z * z * z))))


def battery(token: Column) -> Column:
    """struct(uniform, natural) for one token: p of the three tests together under a uniform source, and p under written language.

    Below eight characters of the alphabet there is nothing to test: both are 1. A token that is not uniform has natural 1.
    """
    known = None
    for pattern, letters in reversed(_ENCODINGS):
        uniform, apart = _shares(letters)
        one = F.struct(F.lit(letters).alias("letters"), F.array(*[F.lit(x) for x in uniform]).alias("shares"), F.lit(apart).alias("apart"))
        known = one if known is None else F.when(token.rlike(pattern), one).otherwise(known)

    def tested(a: Column) -> Column:
        # Places in the alphabet, scaled to (0, 1); padding has none.
        places = F.transform(F.filter(F.split(token, ""), lambda c: (c != "") & (F.instr(a["letters"], c) > 0)), lambda c: (F.instr(a["letters"], c) - 0.5) / F.length(a["letters"]))
        return _let(places, lambda u: F.when(F.size(u) >= 8, statistics(u, a)).otherwise(F.struct(F.lit(1.0).alias("uniform"), F.lit(1.0).alias("natural"))))

    def statistics(u: Column, a: Column) -> Column:
        n = F.size(u).cast("double")
        steps = lambda f: F.transform(F.sequence(F.lit(1), F.size(u) - 1), f)
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
        cells = F.transform(a["shares"], lambda share, b: (F.size(F.filter(u, lambda q: F.floor(q * _CELLS) == b)) - n * share) * (F.size(F.filter(u, lambda q: F.floor(q * _CELLS) == b)) - n * share) / (n * share))
        runs = 1 + total(steps(lambda i: ((F.get(u, i) >= 0.5) != (F.get(u, i - 1) >= 0.5)).cast("double")))
        lag = total(steps(lambda i: (F.get(u, i) - 0.5) * (F.get(u, i - 1) - 0.5)))
        above = F.size(F.filter(u, lambda q: q >= 0.5)).cast("double")
        return _let(F.struct(total(cells).alias("chi"), runs.alias("runs"), lag.alias("lag"), (2 * above * (n - above) / n + 1).alias("mean")), lambda x: judged(n, x, a))

    def judged(n: Column, x: Column, a: Column) -> Column:
        # Wilson-Hilferty for chi-squared with 7 degrees; the normal approximation for runs; the product of two
        # independent uniform deviations has variance 1/144. The least of three, each taken for independent.
        p_chi = _upper_tail((F.pow(x["chi"] / 7, F.lit(1 / 3)) - (1 - 2 / 63)) / (2 / 63) ** 0.5)
        spread = (x["mean"] - 1) * (x["mean"] - 2) / (n - 1)
        p_runs = F.when(spread > 0, 2 * _upper_tail(F.abs(x["runs"] - x["mean"]) / F.sqrt(spread))).otherwise(F.lit(0.0))
        p_lag = 2 * _upper_tail(F.abs(x["lag"]) * 12 / F.sqrt(n - 1))
        uniform = 1 - F.pow(1 - F.least(F.lit(1.0), p_chi, p_runs, p_lag), F.lit(3.0))
        # Noncentral chi-squared by Patnaik's central one with (7 + l)^2 / (7 + 2 l) degrees; Wilson-Hilferty again for its lower tail.
        l = n * a["apart"]  # noqa: E741
        rest = 2 * (7 + 2 * l) / (9 * (7 + l) * (7 + l))
        natural = _upper_tail((1 - rest - F.pow(x["chi"] / (7 + l), F.lit(1 / 3))) / F.sqrt(rest))
        return F.struct(uniform.alias("uniform"), F.when(uniform < UNIFORM, 1.0).otherwise(natural).alias("natural"))

    return _let(known, tested)


def _class(length: Column) -> Column:
    return sum(((length >= c).cast("int") for c in CLASSES), F.lit(0))


def _bin(p: Column) -> Column:
    """Tenths of -log10 p, rounded down: every p of a bin is at most 10^(-bin/10)."""
    return F.least(F.lit(_P_BINS), F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-16)))).cast("int"))


def thresholds(histogram: list[tuple[int, int, int]], rate: float = FDR) -> dict[int, int]:
    """From (class, bin, count): the least bin of each class for whose tokens Benjamini-Hochberg rejects written language.

    A bin's upper edge stands for every p in it, which is conservative. No bin qualifies: _P_BINS + 1.
    """
    out = {}
    for own in range(len(CLASSES) + 1):
        counts = {b: n for c, b, n in histogram if c == own}
        m, seen, best = sum(counts.values()), 0, _P_BINS + 1
        for b in sorted(counts, reverse=True):
            seen += counts[b]
            if 10 ** (-b / 10) <= rate * seen / m:
                best = b
        out[own] = best
    return out


def _prepared(docs: DataFrame, *keep: str) -> DataFrame:
    """Adds `__text`, base spans `base` in listed order, and `__tokens`: candidate spans off the base spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*keep, text.alias("__text"))
    sign = F.contains("__text", F.lit(":")) | F.contains("__text", F.lit("="))
    df = with_matches(df, "__text", PATTERNS | {"random": _TOKEN}, {"assign": sign, "access": F.contains("__text", F.lit("AKIA"))})
    df = df.select(*keep, "__text", *[spans_of(k, i).alias(k) for i, k in enumerate([*PATTERNS, "random"])])
    value = lambda x: F.length(F.regexp_replace(x["m"], _ASSIGN_HEAD, "")) >= MIN_VALUE
    df = df.withColumn("assign", F.filter("assign", value))
    df = df.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    off = F.filter("random", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return df.withColumn("__tokens", F.when(F.size("random") > 0, off).otherwise(F.col("random")))


def scan(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, then __text, assign, access, hex, random, base and all: arrays of struct(s, o, k, e, m)."""
    # Few texts have a token: the first pass looks for one and takes only those texts apart. An outer explode, since of an inner one
    # the optimiser would make a filter that works out the tokens once more.
    tokens = _prepared(docs.where(F.col("text").rlike(_TOKEN))).select(F.explode_outer("__tokens.m").alias("t")).where("t IS NOT NULL").withColumn("p", battery(F.col("t"))["natural"])
    histogram = tokens.groupBy(_class(F.length("t")).alias("c"), _bin(F.col("p")).alias("b")).agg(F.count("*").alias("n"))
    limits = thresholds([tuple(r) for r in histogram.collect()])  # at most (len(CLASSES) + 1) x (_P_BINS + 1) rows
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    # Tokens of a row are judged in the row itself: no explode, no shuffle, no key.
    kept = F.filter("__tokens", lambda x: _bin(battery(x["m"])["natural"]) >= F.element_at(limit, _class(F.length(x["m"]))))
    df = _prepared(docs, *keep).withColumn("random", F.when(F.size("__tokens") > 0, kept).otherwise(F.col("__tokens")))
    return df.withColumn("all", F.array_sort(F.concat("base", "random"))).drop("__tokens")


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every secret in `text` replaced by [kind] and n_chars, if there, renewed; no row goes, other columns stay.

    A null text stays null. Extra columns, whatever their names, pass through.
    """
    df = scan(docs.select(F.struct("*").alias("__row"), "text"), "__row")
    hit = F.size("all") > 0
    text = F.when(hit, masked(F.col("__text"), "all")).otherwise(F.col("__row.text"))
    df = df.select("__row", hit.alias("hit"), text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("hit"), F.length("text").cast("long")).otherwise(F.col("__row.n_chars") if "n_chars" in docs.columns else None)}
    return df.select(*[new[c].alias(c) if c in new else F.col("__row").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in (*PATTERNS, "random")]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))
