"""Basis cues, metric identity and claim texts (ID1 to ID6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.values import nfkc

# Cues in order of precedence, stop words, and period tokens.
BASIS_CUES = (
    ("projection", ("projected", "projection", "forecast", "outlook for", "expected to", "is expected")),
    ("estimate", ("estimate", "estimated", "advance estimate", "provisional", "pe)", "ae)")),
    ("target", ("target", "guidance", "aims to", "aspires")),
)
STOP_WORDS = (
    "the", "a", "an", "of", "for", "in", "on", "at", "to", "and", "or", "by", "its", "their", "this", "that", "with",
    "from", "as", "is", "was", "were", "total", "overall",
)
PERIOD_TOKEN = r"^(?:fy\d{2,4}|q[1-4]|h[12]|cy\d{4}|\d{4}|\d{4}[-/]\d{2,4}|fy)$"


def basis(given: Column, *hints: Column) -> Column:
    """The stated basis unless it is 'actual' or unknown and a cue in the hints says otherwise (ID1)."""
    said = F.lower(F.trim(F.coalesce(given, F.lit(""))))
    blob = F.lower(F.concat_ws(" ", *hints))
    out = F.when(said.isin("estimate", "projection", "target"), said)
    for label, cues in BASIS_CUES:
        found = F.lit(False)
        for cue in cues:
            found = found | F.contains(blob, F.lit(cue))
        out = out.when(found, label)
    return out.when(said == "actual", "actual").otherwise("unknown")


def slug_tokens(text: Column) -> Column:
    """Folded lower-case tokens without stop words, crudely singular (ID2)."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(nfkc(text), F.lit(""))), r"[^a-z0-9]+", " ")), " ")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    plural = lambda w: (F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss")
    return F.transform(kept, lambda w: F.when(plural(w), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def without_periods(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.rlike(PERIOD_TOKEN))


def metric_key(subject: Column, predicate: Column) -> Column:
    """A coarse blocking key: the first four subject and five predicate tokens, sorted and distinct (ID4)."""
    side = lambda text, n: F.array_join(F.array_sort(F.array_distinct(F.slice(without_periods(slug_tokens(text)), 1, n))), "-")
    return F.concat(side(subject, 4), F.lit("|"), side(predicate, 5))


def strip_periods(text: Column) -> Column:
    """The phrase without its period words; the phrase itself if nothing else is left (ID3)."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(plain, r"(?U)\s+"), lambda w: ~F.lower(F.regexp_replace(w, r"^[,;:()]+|[,;:()]+$", "")).rlike(PERIOD_TOKEN))
    # Every period word holds a digit or is "fy": most phrases have neither and are not taken apart.
    kept = F.when(plain.rlike(r"(?i)[0-9]|fy"), F.array_join(words, " ")).otherwise(F.regexp_replace(plain, r"(?U)\s+", " "))
    cleaned = F.regexp_replace(kept, r"^[ \-–—,;:]+|[ \-–—,;:]+$", "")
    return F.coalesce(F.get(F.filter(F.array(cleaned, plain), lambda x: x != ""), F.lit(0)), F.lit(""))


def canonical_claim(subject: Column, predicate: Column, qualifiers: Column) -> Column:
    """What is embedded: neither value nor period (ID5)."""
    blank = lambda c: F.nullif(c, F.lit(""))
    named = F.array_join(F.filter(F.transform(F.coalesce(qualifiers, F.array().cast("array<string>")), lambda q: F.trim(q)), lambda q: q != ""), "; ")
    return F.concat_ws(" — ", blank(strip_periods(subject)), blank(strip_periods(predicate)), blank(named))


def display_claim(subject: Column, predicate: Column, value: Column, unit: Column, period: Column) -> Column:
    """One readable line (ID6)."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws(" ", blank(subject), blank(predicate), F.lit("="), blank(value), blank(unit), F.concat(F.lit("("), blank(period), F.lit(")")))
