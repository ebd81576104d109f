"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

Two texts are equal when they are identical after deleting every space and U+0009 to U+000D.

1. The log: (digest, id, length) of every row, written once; MEMTABLES slices of its parts are the memtables.
2. Flush: a memtable becomes a run, one row a digest with the row that stays (most code points of the original, then the smallest
   id) and the group's size, sorted by digest, in Parquet, with a filter: bitmaps over positions that digests hash to,
   BITS_PER_DIGEST a digest.
3. Compaction merges runs two by two, level by level, until one is left. The digests of one run are looked up in the other's
   filter; those it lacks are in no need of a merge and pass on as they are, and so do the other run's rows that no hit names.
   Only hits are merged, keeping the row that stays; a filter answers falsely for some 6 % of absent digests, which costs a
   look-up and changes nothing.
4. Groups of more than one row receive byte verification: a group is sound when the least and the greatest normalised text in it
   are the same bytes. Both are partial aggregates, so a third of all rows being copies of one text costs one text a task.
   Digests that fail are regrouped by the text itself.

Flushing and merging aggregate partially, and runs hold a digest once, so a hot digest is one row. Filters and hits are broadcast only
up to a bound, else joined by shuffle. Null text counts as empty, an empty table gives an empty result, rows that repeat a doc_id with the
same text count as members of its group, a null doc_id sorts before all others. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import BROADCAST_ROWS, bounded, join_skewed, table

#: Characters whose deletion makes texts comparable.
DELETED = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

MEMTABLES = 4
BITS_PER_DIGEST = 16
#: Filters of at most so many bits (16 MB) are broadcast.
BROADCAST_BITS = 1 << 27


def normalised(text: Column) -> Column:
    """The text without the characters of DELETED; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in DELETED:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _digest(norm: Column, bits: int) -> Column:
    return F.sha2(norm, 256) if bits == 256 else F.substring(F.sha2(norm, 256), 1, bits // 4)


def written_log(docs: DataFrame, bits: int = 256) -> DataFrame:
    """(part, digest, doc_id, fp, n_cp, and sha where the digest is shortened): what the index learns of every row."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("fp"), normalised(F.col("text")).alias("norm"), F.length(F.coalesce("text", F.lit(""))).alias("n_cp"))
    full = [] if bits == 256 else [F.sha2("norm", 256).alias("sha")]
    return table(rows.select(F.spark_partition_id().alias("part"), _digest(F.col("norm"), bits).alias("digest"), "doc_id", "fp", "n_cp", *full), "exact-log", scan=True)


def flush(log: DataFrame, *keys: str) -> DataFrame:
    """A run of a memtable: one row a digest, sorted."""
    run = log.groupBy(*keys).agg(F.min(F.struct((-F.col("n_cp")).alias("shorter"), "doc_id", "fp")).alias("best"), F.count("*").alias("group_size"))
    return table(run.sortWithinPartitions(keys[0]), "exact-run")


def _position(digest: str, width: Column) -> Column:
    """A digest's place among `width` bits, from 1."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % width + 1


def filter_of(run: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, bits) and the width: bitmaps with the place of every digest of a run."""
    width = max(32_768, BITS_PER_DIGEST * run.count())
    places = run.select(_position("digest", F.lit(width)).alias("at"))
    return table(places.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")), "exact-filter"), width


def maybe_in(rows: DataFrame, made: tuple[DataFrame, int]) -> DataFrame:
    """`rows` with `maybe`: false where the filter of a run says that it lacks the digest."""
    bitmaps, width = made
    few = width <= BROADCAST_BITS
    asked = rows.withColumn("at", _position("digest", F.lit(width))).withColumn("bucket", F.bitmap_bucket_number("at"))
    found = asked.join(F.broadcast(bitmaps) if few else bitmaps, "bucket", "left")
    bit = F.bitmap_bit_position("at")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return found.withColumn("maybe", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop("at", "bucket", "bits")


def merged(older: DataFrame, newer: DataFrame) -> DataFrame:
    """One run of two: only digests of `newer` that the filter of `older` may hold are looked up and merged."""
    asked = table(maybe_in(newer, filter_of(older)), "exact-asked")
    wanted = bounded(asked.where("maybe").select("digest"))
    hits = older.join(wanted, "digest", "left_semi").unionByName(asked.where("maybe").drop("maybe"))
    best = hits.groupBy("digest").agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
    rest = older.join(wanted, "digest", "left_anti").unionByName(asked.where("NOT maybe").drop("maybe"))
    return table(rest.unionByName(best).sortWithinPartitions("digest"), "exact-run")


def compacted(log: DataFrame, memtables: int = MEMTABLES) -> DataFrame:
    """The index over the whole log: (digest, keep_id, keep_fp, group_size), one row a digest."""
    level = [flush(log.where(F.pmod("part", F.lit(memtables)) == k), "digest") for k in range(memtables)]
    while len(level) > 1:
        pairs = [level[k : k + 2] for k in range(0, len(level), 2)]
        level = [merged(*p) if len(p) == 2 else p[0] for p in pairs]
    return _kept(level[0])


def _kept(run: DataFrame) -> DataFrame:
    return run.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.fp").alias("keep_fp"), "group_size")


def decided(docs: DataFrame, bits: int = 256, memtables: int = MEMTABLES) -> DataFrame:
    """(doc_id, fp, keep_id, keep_fp, group_size, text_sha256), a row for every row of `docs`; fp is a hash of the original text.

    `bits` shortens the index digest; tests use it to force collisions, which byte verification must undo.
    """
    log = written_log(docs, bits)
    groups = compacted(log, memtables)
    multi = groups.where("group_size > 1")
    n_multi, total = groups.agg(F.sum((F.col("group_size") > 1).cast("long")), F.sum("group_size")).first()
    n_multi, total = n_multi or 0, total or 0

    texts = docs.select("doc_id", F.xxhash64("text").alias("fp"), normalised(F.col("text")).alias("norm"), F.length(F.coalesce("text", F.lit(""))).alias("n_cp"))
    texts = texts.withColumn("digest", _digest(F.col("norm"), bits))
    hits = multi.select("digest")
    # Only texts of hits travel; past the broadcast bound the same semi join shuffles.
    hit_texts = texts.join(F.broadcast(hits) if n_multi <= BROADCAST_ROWS else hits, "digest", "left_semi")
    verified = hit_texts.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    unsound = table(verified.where("least != most").select("digest"), "exact-unsound") if n_multi else None

    sha = "digest" if bits == 256 else "sha"
    if unsound is None or unsound.isEmpty():
        return _members(log, groups, total, sha)
    # Different texts under one digest: group those by their bytes.
    split = flush(texts.join(unsound, "digest", "left_semi").withColumn("sha", F.sha2("norm", 256)), "norm", "sha")
    split = table(_kept(split.drop("norm").withColumnRenamed("sha", "digest")), "exact-split")
    left = log.join(unsound, "digest", "left_anti")
    again = log.join(unsound, "digest", "left_semi").drop("digest").withColumnRenamed("sha", "digest")
    good = _members(left, groups.join(unsound, "digest", "left_anti"), total, sha)
    return good.unionByName(_members(again, split, total, "digest"))


def _members(log: DataFrame, groups: DataFrame, total: int, sha: str) -> DataFrame:
    multi = groups.where("group_size > 1")
    joined = join_skewed(log, multi, "digest", multi.select("digest", "group_size"), total)
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id", "fp", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(alone, F.col("fp")).otherwise(F.col("keep_fp")).alias("keep_fp"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col(sha).alias("text_sha256"),
    )


def exact_groups(docs: DataFrame, bits: int = 256, memtables: int = MEMTABLES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for every row of `docs`."""
    df = decided(docs, bits, memtables)
    return df.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, all columns: one of each group of equal texts, the one that the index keeps.

    Rows are told apart by doc_id and text, so one id may stand on several texts, and no id on any number of them.
    """
    mine = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("fp") == F.col("keep_fp"))
    found = table(decided(docs).where("group_size > 1").select("doc_id", "fp", mine.alias("stays")), "exact-found")
    gone = table(found.where("NOT stays").select(F.col("doc_id").alias("__factloom_gone_id"), F.col("fp").alias("__factloom_gone_fp")).distinct(), "exact-gone")
    twice = table(found.where("stays").groupBy("doc_id", "fp").count().where("count > 1").select(F.col("doc_id").alias("__factloom_twice_id"), F.col("fp").alias("__factloom_twice_fp")), "exact-twice")
    own_fp = F.xxhash64("text")
    rest = docs.join(bounded(gone), F.col("doc_id").eqNullSafe(F.col("__factloom_gone_id")) & (own_fp == F.col("__factloom_gone_fp")), "left_anti")
    if twice.isEmpty():
        return rest
    same = F.col("doc_id").eqNullSafe(F.col("__factloom_twice_id")) & (own_fp == F.col("__factloom_twice_fp"))
    mark = "__factloom_fp"
    again = rest.join(twice, same, "left_semi").withColumn(mark, own_fp).dropDuplicates(["doc_id", mark]).drop(mark)
    return rest.join(twice, same, "left_anti").unionByName(again)


def query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, norm, n_cp, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS keep_id
  FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM r
"""
