"""Printed figures and their units as comparable numbers (NV1 to NV12), in built-in expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scale words in order of precedence.
SCALES = (
    ("trillion", 1e12), ("billion", 1e9), ("million", 1e6), ("thousand", 1e3), ("hundred", 1e2), ("crore", 1e7),
    ("lakh", 1e5), ("lac", 1e5), ("bn", 1e9), ("mn", 1e6), ("tn", 1e12), ("cr", 1e7), ("k", 1e3),
)

# Currency tokens in order of precedence, and their ISO codes.
CURRENCIES = (
    ("inr", "INR"), ("rs.", "INR"), ("rs", "INR"), ("rupee", "INR"), ("₹", "INR"),
    ("us$", "USD"), ("a$", "AUD"), ("c$", "CAD"), ("s$", "SGD"), ("hk$", "HKD"), ("nz$", "NZD"),
    ("australian dollar", "AUD"), ("canadian dollar", "CAD"), ("singapore dollar", "SGD"), ("hong kong dollar", "HKD"),
    ("new zealand dollar", "NZD"), ("usd", "USD"), ("aud", "AUD"), ("cad", "CAD"), ("sgd", "SGD"), ("hkd", "HKD"),
    ("nzd", "NZD"), ("$", "USD"), ("dollar", "USD"), ("eur", "EUR"), ("€", "EUR"), ("euro", "EUR"), ("gbp", "GBP"),
    ("£", "GBP"), ("sterling", "GBP"), ("jpy", "JPY"), ("¥", "JPY"), ("yen", "JPY"), ("chf", "CHF"), ("sfr", "CHF"),
    ("swiss franc", "CHF"), ("cny", "CNY"), ("rmb", "CNY"), ("renminbi", "CNY"), ("yuan", "CNY"), ("krw", "KRW"),
    ("₩", "KRW"), ("aed", "AED"), ("dirham", "AED"), ("sar", "SAR"), ("qar", "QAR"), ("zar", "ZAR"), ("brl", "BRL"),
    ("mxn", "MXN"), ("rub", "RUB"), ("sek", "SEK"), ("nok", "NOK"), ("dkk", "DKK"), ("pln", "PLN"), ("try", "TRY"),
    ("ils", "ILS"), ("₪", "ILS"), ("idr", "IDR"), ("myr", "MYR"), ("thb", "THB"), ("php", "PHP"), ("vnd", "VND"),
    ("bdt", "BDT"), ("pkr", "PKR"), ("lkr", "LKR"), ("ngn", "NGN"), ("kes", "KES"), ("egp", "EGP"),
)

# Fixed patterns.
_PERCENT = r"per cent|percent|pct|%"
_RANGE = r"(\d[\d,]*(?:\.\d+)?)\s*(?:-|–|—|to)\s*(\d[\d,]*(?:\.\d+)?)"
_NUMBER_COMPAT = r"[-+]?\d{1,3}(?:[, ]\d{2,3})*(?:\.\d+)?|[-+]?\d*\.?\d+"
#: The same with ungrouped numbers read whole.
_NUMBER = r"[-+]?\d{1,3}(?:[, ]\d{2,3})+(?!\d)(?:\.\d+)?|[-+]?\d+(?:\.\d+)?|[-+]?\.\d+"


def nfkc(text: Column) -> Column:
    """Compatibility folding (NV1), for which Spark has no built-in. Arrow batches that are all ASCII pass as they are."""

    def fold(texts: pa.Array) -> pa.Array:
        if pc.all(pc.string_is_ascii(texts)).as_py() is not False:
            return texts
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(fold, "string")(text)


def _bounded(token: str) -> str:
    return r"(?<![a-z])\Q" + token + r"\E(?![a-z])"


def _first(tokens: list[tuple[str, str]], low: Column) -> Column:
    """The answer of the first (token, answer) found. Tokens of letters stand alone, others match anywhere.

    A look-ahead finds, at each place where a word begins, the first token of letters, and at each place the first of the others; the
    least rank of all decides.
    """
    names, answers = (F.array(*[F.lit(x) for x in side]) for side in zip(*tokens))
    words = "|".join(t for t, _ in tokens if t.isalpha())
    others = "|".join(r"\Q" + t + r"\E" for t, _ in tokens if not t.isalpha())
    begun = F.regexp_extract_all(low, F.lit(f"(?<![a-z])(?=((?:{words})(?![a-z])))"), F.lit(1))
    if others:
        begun = F.concat(begun, F.regexp_extract_all(low, F.lit(f"(?=({others}))"), F.lit(1)))
    rank = F.array_min(F.transform(begun, lambda t: F.array_position(names, t)))
    return F.get(answers, rank.cast("int") - 1)


def scale_token(low: Column) -> Column:
    """The first scale word of the table that stands alone in the text (NV8), or null."""
    return _first([(t, t) for t, _ in SCALES], low)


def scale_factor(token: Column) -> Column:
    factors = F.create_map(*[F.lit(x) for pair in SCALES for x in pair])
    return F.coalesce(F.try_element_at(factors, token), F.lit(1.0))


def currency(low: Column) -> Column:
    """ISO code of the first currency token of the table in the text (NV9), or null."""
    return _first(list(CURRENCIES), low)


def with_values(df: DataFrame, value: str = "value_raw", unit: str = "unit_raw", compat: bool = False) -> DataFrame:
    """Add value_num, value_unit, value_dim, scale_applied, is_range and value_notes for a printed value and its unit."""
    as_number = lambda c: F.regexp_replace(c, "[, ]", "").try_cast("double")
    df = df.withColumns({"_v": nfkc(F.col(value)), "_u": nfkc(F.coalesce(F.col(unit), F.lit("")))})
    df = df.withColumns({"_v": F.trim("_v"), "_u": F.trim("_u")}).withColumn("_low", F.lower(F.trim(F.concat_ws(" ", "_v", "_u"))))
    df = df.withColumns({
        "_n": as_number(F.regexp_extract("_v", _NUMBER_COMPAT if compat else _NUMBER, 0)),
        "_lo": as_number(F.regexp_extract("_v", _RANGE, 1)),
        "_hi": as_number(F.regexp_extract("_v", _RANGE, 2)),
        "_scale": F.coalesce(scale_token(F.lower("_u")), scale_token(F.lower("_v"))),
        "_iso": currency(F.col("_low")),
    })
    df = df.withColumn("is_range", F.coalesce(F.col("_hi") >= F.col("_lo"), F.lit(False)) & F.col("_n").isNotNull())
    number = F.when(F.col("is_range"), (F.col("_lo") + F.col("_hi")) / 2).otherwise(F.col("_n"))
    negative = F.col("_v").rlike(r"^\(\s*[^)]*\d[^)]*\)$")
    df = df.withColumn("_x", F.when(negative, -F.abs(number)).otherwise(number))
    low = F.col("_low")
    bps = F.contains(low, F.lit("basis point")) | low.rlike(_bounded("bps"))
    pp = F.contains(low, F.lit("percentage point"))
    percent = low.rlike(_PERCENT)
    plain = ~(bps | pp | percent)
    strip = r"[\d,.\s()%-]"

    def unscaled(text: Column) -> Column:
        """Without the scale word that applies; one fixed pattern a word, so that none is compiled for a row."""
        out = F.when(F.col("_scale").isNull(), text)
        for token, _ in SCALES:
            out = out.when(F.col("_scale") == token, F.regexp_replace(text, _bounded(token), ""))
        return out

    stripped = lambda text: F.regexp_replace(text, strip, "")
    residual = unscaled(stripped(F.lower("_u"))) if compat else stripped(unscaled(F.lower("_u")))
    df = df.withColumns({"_plain": plain, "_bps": bps, "_rate": bps | pp, "_res": F.trim(residual)})
    numeric, empty = F.col("_x").isNotNull(), F.coalesce(F.length(value), F.lit(0)) == 0
    unit_of = F.when(F.col("_rate"), "pp").when(~F.col("_plain"), "percent").when(F.col("_iso").isNotNull(), F.col("_iso")).when(F.col("_res") != "", F.col("_res")).otherwise("count")
    dim_of = F.when(F.col("_rate"), "rate_delta").when(~F.col("_plain"), "ratio").when(F.col("_iso").isNotNull(), "currency").when(F.col("_res") != "", "quantity").otherwise("count")
    factor = F.when(F.col("_plain"), scale_factor(F.col("_scale"))).otherwise(F.lit(1.0))
    df = df.withColumns({
        "value_num": F.when(F.col("_bps"), F.col("_x") / 100).otherwise(F.col("_x") * factor),
        "value_unit": F.when(numeric, unit_of),
        "value_dim": F.when(empty, F.lit(None)).when(~numeric, "categorical").otherwise(dim_of),
        "scale_applied": F.when(numeric, factor).otherwise(F.lit(1.0)),
        "value_notes": F.array_compact(F.array(
            F.when(F.col("is_range"), F.lit("range, midpoint used")),
            F.when(numeric & F.col("_bps"), F.lit("basis points converted to percentage points")),
            F.when(numeric & F.col("_plain") & F.col("_scale").isNotNull(), F.concat(F.lit("scale "), F.col("_scale"))),
        )),
    })
    return df.drop("_v", "_u", "_low", "_n", "_lo", "_hi", "_scale", "_iso", "_x", "_plain", "_bps", "_rate", "_res")


def display_number(x: Column) -> Column:
    """Short display with T, B and M (NV12)."""
    a = F.abs(x)
    short = lambda d, s: F.concat(F.format_number(x / d, 2), F.lit(s))
    return F.when(a >= 1e12, short(1e12, "T")).when(a >= 1e9, short(1e9, "B")).when(a >= 1e6, short(1e6, "M")).when(a >= 1e4, F.format_number(x, 0)).when(a >= 1, F.format_number(x, 2)).otherwise(F.format_number(x, 4))
