"""Period phrases as canonical keys with bounds (PD0 to PD14). The first rule that fits wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.values import nfkc

# Month prefixes and number words.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
_ORDINALS = ("first", "second", "third", "fourth")

_DMY = r"(\d{1,2})(?:st|nd|rd|th)?\s+([a-z]{3,9})\.?,?\s+(\d{4})"
_MDY = r"([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"


def _q(pattern: str) -> str:
    """A pattern as a raw SQL literal."""
    return "r\"" + pattern + "\""


def _group(pattern: str, k: int, text: str = "_p") -> str:
    return f"nullif(regexp_extract({text}, {_q(pattern)}, {k}), '')"


def _int(x: str) -> str:
    return f"try_cast({x} AS int)"


def _month(x: str) -> str:
    return f"nullif(array_position(array({', '.join(repr(m) for m in MONTHS)}), substring({x}, 1, 3)), 0)"


def _year(x: str) -> str:
    """Two digits below 70 are 20xx, from 70 on 19xx."""
    return f"(CASE WHEN {_int(x)} < 70 THEN 2000 + {_int(x)} WHEN {_int(x)} < 100 THEN 1900 + {_int(x)} ELSE {_int(x)} END)"


def _date(y: str, m: str, d: str) -> str:
    return f"try_to_date(concat({y}, '-', {m}, '-', {d}), 'yyyy-M-d')"


def with_periods(df: DataFrame, raw: str = "time_scope_raw", fallback: str | None = None, fy_start: int = 4, compat: bool = False) -> DataFrame:
    """Add period_key, period_start, period_end, period_kind, period_inherited.

    Facts repeat few phrases, so each distinct phrase is parsed once and joined back; a phrase of very many facts is one row there.
    """
    blank = f"nullif(trim({raw}), '')"
    other = f"nullif(trim({fallback}), '')" if fallback else "cast(NULL AS string)"
    df = df.withColumns({"period_inherited": F.expr(f"{blank} IS NULL AND {other} IS NOT NULL"), "_phrase": F.expr(f"coalesce({blank}, {other})")})
    return df.join(_parsed(df.select("_phrase").where("_phrase IS NOT NULL").distinct(), fy_start, compat), "_phrase", "left").drop("_phrase")


def _parsed(df: DataFrame, fy_start: int, compat: bool) -> DataFrame:
    """(_phrase, period_key, period_start, period_end, period_kind) of distinct phrases."""
    df = df.withColumn("_p", F.translate(F.lower(nfkc(F.col("_phrase"))), "–—", "--"))
    fy_of = (lambda y, m: f"({y})") if fy_start == 1 else (lambda y, m: f"(CASE WHEN {m} < {fy_start} THEN {y} ELSE {y} + 1 END)")
    quarter = lambda m: f"cast(((({m}) + {12 - fy_start}) % 12) div 3 + 1 AS int)"
    first = lambda fy: f"make_date({fy}{'' if fy_start == 1 else ' - 1'}, {fy_start}, 1)"
    last = lambda fy: f"date_sub(add_months({first(fy)}, 12), 1)"
    rlike = lambda p: f"_p RLIKE {_q(p)}"
    null = "cast(NULL AS date)"

    months_digits = _int(_group(r"\b(\d{1,2})\s*[-\s]?\s*months?\b", 1))
    word = _group(r"\b([a-z]+)[-\s]months?\b", 1)
    months_word = f"nullif(array_position(array({', '.join(repr(x) for x in NUMBER_WORDS)}), {word}), 0)"
    dmy = _date(_group(_DMY, 3), _month(_group(_DMY, 2)), _group(_DMY, 1))
    mdy = _date(_group(_MDY, 3), _month(_group(_MDY, 1)), _group(_MDY, 2))
    iso = "cast(NULL AS date)" if compat else f"try_to_date({_group(r'\b(\d{4}-\d{2}-\d{2})\b', 1)}, 'yyyy-MM-dd')"
    as_at = r"as\s+(?:at|of|on)\s+(?:the\s+)?([a-z]{3,9})\.?,?\s*(\d{4})"
    q_ = r"q([1-4])\s*[-/]?\s*(?:fy)?\s*'?(\d{2,4})(?:\s*[-/]\s*(\d{2,4}))?"
    q_words = r"\b(first|second|third|fourth)\s+quarter\s+(?:of\s+)?(?:fy\s*)?(\d{2,4})(?:\s*[-/]\s*(\d{2,4}))?"
    h_ = r"h([12])\s*[-/]?\s*(?:fy)?\s*'?(\d{2,4})" + ("" if compat else r"(?:\s*[-/]\s*(\d{2,4}))?")
    h_words = r"\b(first|second)\s+half\s+(?:of\s+)?(?:fy\s*)?(\d{2,4})(?:\s*[-/]\s*(\d{2,4}))?"
    lead = r"(?:fy|fiscal(?:\s+year)?)" if compat else r"(?:fy|fiscal(?:\s+year)?|financial\s+year)"
    fy2 = lead + r"\s*'?(\d{2,4})\s*[-/]\s*'?(\d{2,4})"
    fy1 = lead + r"\s*'?(\d{2,4})"
    bare2 = r"\b(\d{4})\s*[-/]\s*(\d{2,4})\b"
    m4, m2 = r"\b([a-z]{3,9})\.?\s+(\d{4})\b", r"\b([a-z]{3,9})\.?-(\d{2})\b"
    cy = r"\b(?:cy|calendar\s+year)?\s*(\d{4})\b"
    ordinal = lambda x: f"array_position(array({', '.join(repr(o) for o in _ORDINALS)}), {x})"

    def spanned(a: str, b: str | None) -> str:
        """The fiscal year of `a` or `a-b`: two digits of b mean the year after a."""
        return _year(a) if b is None else f"(CASE WHEN {b} IS NULL THEN {_year(a)} WHEN {_int(b)} < 100 THEN {_year(a)} + 1 ELSE {_int(b)} END)"

    df = df.withColumns({
        "_ended": F.expr(rlike(r"end(?:ed|ing)\b" if compat else r"\bend(?:ed|ing)\b")),
        "_day": F.expr(f"coalesce({dmy}, {mdy}, {iso})"),
        "_months": F.expr(f"coalesce({months_digits}, cast({months_word} AS int))"),
        "_atm": F.expr(_month(_group(as_at, 1))), "_aty": F.expr(_int(_group(as_at, 2))),
        "_q": F.expr(f"coalesce({_int(_group(q_, 1))}" + ("" if compat else f", cast(nullif({ordinal(_group(q_words, 1))}, 0) AS int)") + ")"),
        "_qy": F.expr(f"CASE WHEN {rlike(q_)} THEN {spanned(_group(q_, 2), _group(q_, 3))}" + ("" if compat else f" WHEN {rlike(q_words)} THEN {spanned(_group(q_words, 2), _group(q_words, 3))}") + " END"),
        "_h": F.expr(f"coalesce({_int(_group(h_, 1))}" + ("" if compat else f", cast(nullif({ordinal(_group(h_words, 1))}, 0) AS int)") + ")"),
        "_hy": F.expr(f"CASE WHEN {rlike(h_)} THEN {spanned(_group(h_, 2), None if compat else _group(h_, 3))}" + ("" if compat else f" WHEN {rlike(h_words)} THEN {spanned(_group(h_words, 2), _group(h_words, 3))}") + " END"),
        "_fy": F.expr(f"CASE WHEN {rlike(fy2)} THEN {spanned(_group(fy2, 1), _group(fy2, 2))} WHEN {rlike(fy1)} THEN {_year(_group(fy1, 1))} END"),
        "_ba": F.expr(_int(_group(bare2, 1))), "_bb": F.expr(_int(_group(bare2, 2))),
        "_mm": F.expr(f"CASE WHEN {rlike(m4)} THEN {_month(_group(m4, 1))} ELSE {_month(_group(m2, 1))} END"),
        "_my": F.expr(f"CASE WHEN {rlike(m4)} THEN {_int(_group(m4, 2))} ELSE {_year(_group(m2, 2))} END"),
        "_cy": F.expr(_int(_group(cy, 1))),
    })
    century = "(_ba div 100) * 100" if compat else "((_ba + 1) div 100) * 100"
    df = df.withColumns({
        "_by": F.expr(f"cast(CASE WHEN _bb > 100 THEN _bb ELSE {century} + _bb END AS int)"),
        "_dy": F.expr("year(_day)"), "_dm": F.expr("month(_day)"),
        "_dfy": F.expr(fy_of("year(_day)", "month(_day)")), "_dq": F.expr(quarter("month(_day)")),
    })
    ends = "_ended AND _day IS NOT NULL"
    half = rlike(r"\bhalf[-\s]?year\b|\bsix[-\s]months?\b")
    quarter_start = f"add_months({first('_qy')}, 3 * (_q - 1))"

    def result(key: str, kind: str, start: str = null, end: str = null) -> str:
        return f"named_struct('key', {key}, 'start', {start}, 'end', {end}, 'kind', '{kind}')"

    rules = [
        (f"{ends} AND {rlike(chr(92) + 'bquarter' + chr(92) + 'b|' + chr(92) + 'bq[1-4]')}", result("concat('Q', _dq, 'FY', _dfy)", "quarter", null, "_day")),
        (f"{ends} AND ({half} OR _months = 6)", result("concat('H', CASE WHEN _dq <= 2 THEN 1 ELSE 2 END, 'FY', _dfy)", "half", null, "_day")),
        (f"{ends} AND _months IS NOT NULL AND _months NOT IN (0, 12)", result("concat(_months, 'M@', _day)", "range", null, "_day")),
        (f"{ends} AND _dm = 12 AND {fy_start} != 1", result("concat('CY', _dy)", "calendar_year", "make_date(_dy, 1, 1)", "make_date(_dy, 12, 31)")),
        (ends, result("concat('FY', _dfy)", "fiscal_year", first("_dfy"), last("_dfy"))),
        ("_dy BETWEEN 1900 AND 2100", result("concat('@', _day)", "instant", "_day", "_day")),
        ("_atm IS NOT NULL", result("concat('@', make_date(_aty, cast(_atm AS int), 1))", "instant", "make_date(_aty, cast(_atm AS int), 1)", "make_date(_aty, cast(_atm AS int), 1)")),
        ("_q IS NOT NULL AND _qy IS NOT NULL", result("concat('Q', _q, 'FY', _qy)", "quarter", quarter_start, f"date_sub(add_months({quarter_start}, 3), 1)")),
        ("_h IS NOT NULL AND _hy IS NOT NULL", result("concat('H', _h, 'FY', _hy)", "half")),
        ("_fy IS NOT NULL", result("concat('FY', _fy)", "fiscal_year", first("_fy"), last("_fy"))),
        ("_by = _ba + 1", result("concat('FY', _by)", "fiscal_year", first("_by"), last("_by"))),
        ("_mm IS NOT NULL AND _my BETWEEN 1900 AND 2100", result("concat(_my, '-', lpad(_mm, 2, '0'))", "month", "make_date(_my, cast(_mm AS int), 1)")),
        ("_cy BETWEEN 1900 AND 2100", result("concat('CY', _cy)", "calendar_year", "make_date(_cy, 1, 1)", "make_date(_cy, 12, 31)")),
    ]
    df = df.withColumn("_r", F.expr("CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r in rules) + " END"))
    return df.select("_phrase", F.col("_r.key").alias("period_key"), F.col("_r.start").alias("period_start"), F.col("_r.end").alias("period_end"), F.col("_r.kind").alias("period_kind"))
