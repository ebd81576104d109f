"""Page layout: reading order, printed labels, a document's opening (TXT1, TXT6, TXT7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions.text import clean_block


def reading_order(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_index, text): a page's blocks as text, columns one after the other (TXT1).

    Blocks have doc_id, page_index, page_x0, page_x1, block_no, x0, y0, x1, text, type. With at least three blocks in either half and
    at most four tenths across both, full-width blocks cut the page into bands; in each band the left half comes first.
    """
    page = W.partitionBy("doc_id", "page_index")
    mid, slack = (F.col("page_x0") + F.col("page_x1")) / 2, 0.04 * (F.col("page_x1") - F.col("page_x0"))
    df = blocks.where((F.col("type") == 0) & (clean_block(F.col("text")) != ""))
    df = df.withColumn("side", F.when(F.col("x1") <= mid + slack, 0).when(F.col("x0") >= mid - slack, 1).otherwise(2))
    count = lambda s: F.sum((F.col("side") == s).cast("int")).over(page)
    df = df.withColumn("columns", (count(0) >= 3) & (count(1) >= 3) & (count(2) <= 0.4 * F.count("*").over(page)))
    # A block's band: how many full-width blocks begin at or above it; a full-width block ends its own band.
    tops = F.array_sort(F.collect_list(F.when(F.col("side") == 2, F.col("y0"))).over(page))
    df = df.withColumn("tops", tops)
    above = F.when(F.col("side") == 2, F.size(F.filter("tops", lambda t: t < F.col("y0")))).otherwise(F.size(F.filter("tops", lambda t: t <= F.col("y0"))))
    key = F.when(F.col("columns"), F.struct(above.cast("double").alias("u"), F.col("side").cast("double").alias("v"), F.col("y0").alias("w"), F.col("block_no").alias("n")))
    key = F.coalesce(key, F.struct(F.bround(F.col("y0") / 6).alias("u"), F.col("x0").alias("v"), F.col("y0").alias("w"), F.col("block_no").alias("n")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(key.alias("key"), clean_block(F.col("text")).alias("text")))), lambda x: x["text"])
    return df.groupBy("doc_id", "page_index").agg(F.array_join(lines, "\n").alias("text"))


def label_runs(pages: DataFrame) -> DataFrame:
    """Add printed_label from `candidates`: kept where a neighbour continues the run, single gaps filled, else a leading roman (TXT6).

    A declared label (column `declared`, if there) stays.
    """
    order = W.partitionBy("doc_id").orderBy("page_index")
    numbers = F.transform(F.filter("candidates", lambda c: c.rlike("^[0-9]+$")), lambda c: c.cast("int"))
    df = pages.withColumn("_n", numbers)
    df = df.withColumns({"_after": F.lead("_n").over(order), "_before": F.lag("_n").over(order)})
    runs = lambda v: F.coalesce(F.array_contains("_after", v + 1), F.lit(False)) | F.coalesce(F.array_contains("_before", v - 1), F.lit(False))
    df = df.withColumn("_label", F.get(F.filter("_n", runs), F.lit(0)))
    before, after = F.lag("_label").over(order), F.lead("_label").over(order)
    df = df.withColumn("_fill", F.when(F.col("_label").isNull() & (after - before == 2), before + 1))
    first = F.get("candidates", F.lit(0))
    label = F.coalesce(F.coalesce("_label", "_fill").cast("string"), F.when(~first.rlike("^[0-9]+$"), first))
    label = F.coalesce("declared", label) if "declared" in pages.columns else label
    return df.withColumn("printed_label", label).drop("_n", "_after", "_before", "_label", "_fill")


def opening(pages: DataFrame, most_pages: int = 12, most_chars: int = 9000) -> DataFrame:
    """(doc_id, text): the document's first pages, marked, within a cap (TXT7)."""
    order = W.partitionBy("doc_id").orderBy("page_index")
    df = pages.withColumn("_r", F.row_number().over(order)).where((F.col("_r") <= most_pages) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    piece = F.concat(F.lit("[[page "), F.coalesce("printed_label", F.col("page_index").cast("string")), F.lit("]]\n"), F.trim("text"))
    df = df.withColumn("_piece", piece)
    used = F.coalesce(F.sum(F.length("_piece")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("_room", most_chars - used).where("_room > 0").withColumn("_piece", F.substring("_piece", F.lit(1), F.col("_room").cast("int")))
    return df.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "_piece"))), lambda x: x["_piece"]), "\n\n").alias("text"))
