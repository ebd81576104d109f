"""Text clean-up and label candidates (TXT2 to TXT5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_block(text: Column) -> Column:
    """White space runs become one space (TXT2)."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def cap_whitespace(text: Column) -> Column:
    """At most three blanks in a row, none before a line's end, at most one empty line in a row (TXT4)."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]{3,}", "   "), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"(?U)^\s+|\s+\z", "")


def render_table(rows: Column) -> Column:
    """An array of rows of cells as lines of ' | '-joined cells, or '' with fewer than two rows that hold anything (TXT3)."""
    cleaned = F.transform(rows, lambda r: F.transform(r, lambda c: F.coalesce(clean_block(c), F.lit(""))))
    full = F.filter(cleaned, lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(full, lambda r: F.size(r)))
    padded = F.transform(full, lambda r: F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "))
    return F.when(F.size(full) >= 2, F.array_join(padded, "\n")).otherwise("")


def page_tables(tables: Column, most: int = 6, longest: int = 20_000) -> Column:
    """The first `most` tables of a page, rendered; then those too long or repeated go."""
    drawn = F.transform(F.slice(tables, 1, most), render_table)
    return F.array_distinct(F.filter(drawn, lambda t: (t != "") & (F.length(t) < longest)))


def with_tables(text: Column, tables: Column) -> Column:
    return F.concat(text, F.array_join(F.transform(tables, lambda t: F.concat(F.lit("\n\n[table]\n"), t)), ""))


def label_candidates(text: Column) -> Column:
    """Possible printed page labels: the last three lines, then the first two (TXT5)."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    n = F.size(lines)
    band = F.concat(F.slice(lines, F.greatest(n - 2, F.lit(1)), F.lit(3)), F.slice(lines, 1, 2))

    def found(line: Column) -> Column:
        word = F.regexp_extract(line, r"(?i)(?:page|p\.)\s*([0-9]{1,4})", 1)
        bare = F.regexp_extract(line, r"^[^0-9a-zA-Z]*([0-9]{1,4})[^0-9a-zA-Z]*$", 1)
        parts = F.transform(F.split(line, "[|·•]"), lambda p: F.trim(p))
        good = F.filter(parts, lambda p: p.rlike("^[0-9]{1,4}$") | p.rlike("(?i)^[ivxlcdm]{1,5}$"))
        return F.when(F.length(line) > 90, F.array().cast("array<string>")).when(word != "", F.array(word)).when(bare != "", F.array(bare)).otherwise(F.transform(good, F.lower))

    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.flatten(F.transform(band, found))))
