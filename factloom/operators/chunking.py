"""Chunks: greedy packing of pages, oversize pages split, runts merged (CH1 to CH6)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import DEFAULT, Config
from factloom.sources.tables import small_batches


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+\z", "")


def split_page(text: str, limit: int) -> list[str]:
    """An oversize page in parts: by paragraphs, and by lines where a paragraph is too long itself (CH2)."""
    parts: list[str] = []

    def gather(pieces: list[str], glue: str, deeper) -> None:
        held: list[str] = []
        size = 0
        for piece in pieces:
            if len(piece) > limit and deeper:
                if held:
                    parts.append(glue.join(held))
                held, size = [], 0
                deeper(piece)
                continue
            if held and size + len(piece) > limit:
                parts.append(glue.join(held))
                held, size = [], 0
            held.append(piece)
            size += len(piece) + len(glue)
        if held:
            parts.append(glue.join(held))

    gather(re.split(r"\n\s*\n", text), "\n\n", lambda p: gather(p.split("\n"), "\n", None))
    return [p for p in parts if p.strip()]


def units(pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(doc_id, page_index, part, solo, piece): pages that hold enough, trimmed and marked; an oversize page as parts of its own (CH2)."""

    def parts(texts: pa.Array) -> pa.Array:
        return pa.array((split_page(t.as_py(), config.page_limit) if t.is_valid else None for t in texts), pa.list_(pa.string()))

    small_batches(pages.sparkSession)
    body = pages.select("doc_id", F.col("page_index").cast("bigint").alias("page_index"), trimmed(F.col("text")).alias("body")).where(F.length("body") >= config.page_min)
    mark = F.concat(F.lit("[[page "), F.col("page_index").cast("string"), F.lit("]]\n"))
    solo = F.length("body") > config.page_limit
    usual = body.where(~solo).select("doc_id", "page_index", F.lit(0).alias("part"), F.lit(False).alias("solo"), F.concat(mark, "body").alias("piece"))
    large = body.where(solo).select("doc_id", "page_index", F.posexplode(F.arrow_udf(parts, "array<string>")("body")).alias("part", "text"))
    return usual.unionByName(large.select("doc_id", "page_index", "part", F.lit(True).alias("solo"), F.concat(mark, "text").alias("piece")))


def packed_units(pieces: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(doc_id, page_index, part, ordinal): each unit's chunk (CH1, CH3 to CH5), in built-in expressions.

    Packing is sequential within a document: a fold over its units' lengths, nothing of their text, decides. A part of an oversize
    page is a chunk, so it opens a new one and lets nothing follow.
    """
    sized = pieces.select("doc_id", "page_index", "part", "solo", F.length("piece").alias("size"))
    item = "named_struct('page', x.page_index, 'part', x.part, 'size', x.size, 'chunk', {})"
    full = 2 * config.chunk_target + 1_000_000_000
    fold = f"""aggregate(array_sort(collect_list(struct(page_index, part, solo, size))),
      named_struct('chunk', 0, 'used', 0L, 'out', cast(array() AS array<struct<page:bigint,part:int,size:int,chunk:int>>)),
      (s, x) -> CASE WHEN s.used > 0 AND (x.solo OR s.used + x.size > {config.chunk_target})
        THEN named_struct('chunk', s.chunk + 1, 'used', IF(x.solo, {full}L, x.size + 2L), 'out', concat(s.out, array({item.format('s.chunk + 1')})))
        ELSE named_struct('chunk', s.chunk, 'used', IF(x.solo, {full}L, s.used + x.size + 2L), 'out', concat(s.out, array({item.format('s.chunk')}))) END, s -> s.out)"""
    rows = sized.groupBy("doc_id").agg(F.expr(fold).alias("p"))
    # The last chunk joins the one before it when its joined text is short.
    last = F.array_max(F.transform("p", lambda x: x["chunk"]))
    tail = F.aggregate(F.filter("p", lambda x: x["chunk"] == F.col("last")), F.lit(-2), lambda a, x: a + x["size"] + 2)
    rows = rows.withColumn("last", last).withColumn("runt", (F.col("last") >= 1) & (tail < config.runt_min))
    flat = rows.select("doc_id", "last", "runt", F.explode("p").alias("x"))
    ordinal = F.when(F.col("runt") & (F.col("x.chunk") == F.col("last")), F.col("last") - 1).otherwise(F.col("x.chunk"))
    return flat.select("doc_id", F.col("x.page").alias("page_index"), F.col("x.part").alias("part"), ordinal.alias("ordinal"))


def packed(pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(doc_id, page_index, ordinal): the chunk in which each page begins."""
    return packed_units(units(pages, config), config).where("part = 0").drop("part")


def chunks(pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(doc_id, ordinal, page_start, page_end, text): units of one chunk, joined by an empty line (CH1 to CH5)."""
    pieces = units(pages, config)
    placed = pieces.join(packed_units(pieces, config), ["doc_id", "page_index", "part"])
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "part", "piece"))), lambda x: x["piece"]), "\n\n")
    page = lambda f: f("page_index").cast("int")
    return placed.groupBy("doc_id", "ordinal").agg(page(F.min).alias("page_start"), page(F.max).alias("page_end"), texts.alias("text"))


def ingest_plan(pages: DataFrame, packed_pages: DataFrame, keys: int = 1, rpm: int = DEFAULT.rpm_per_key) -> DataFrame:
    """Pages, characters, chunks, calls and minutes by document, and in all (doc_id null) (CH6)."""
    sizes = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))
    n = packed_pages.groupBy("doc_id").agg((F.max("ordinal") + 1).cast("long").alias("chunks"))
    df = sizes.join(n, "doc_id", "left").na.fill(0, ["chunks"]).withColumn("calls", F.col("chunks") + 1)
    total = df.rollup("doc_id").agg(*[F.sum(c).alias(c) for c in ("pages", "chars", "chunks", "calls")])
    return total.withColumn("minutes", F.round(F.col("calls") / (keys * rpm), 2))
