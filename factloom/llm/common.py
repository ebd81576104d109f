"""What the corpus operators share: the shared folder, written tables, span arithmetic."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words everywhere in this subpackage: space and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Rows above which a table is never broadcast; below it a row here has at most some 40 bytes.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, else, on one machine only, one of our own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


#: Rows of an Arrow batch at most, whatever Spark's default of 10,000: texts may be very long.
ARROW_ROWS = 2_000


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of ARROW_ROWS rows or fewer.

    The bound is the session's setting, which is lowered once where it is higher and then stays: Spark knows no other place for it.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))
    return df.mapInArrow(run, schema)


#: Files of a result for each core that the session has: of what comes out of a shuffle, and of what is read and mapped.
FILES_PER_CORE = 4
SCAN_FILES_PER_CORE = 16


def few_files(df: DataFrame, scan: bool = False) -> DataFrame:
    """`df` in at most FILES_PER_CORE parts a core, or SCAN_FILES_PER_CORE of what is read; fewer stay. Parts are merged, not shuffled."""
    return df.coalesce((SCAN_FILES_PER_CORE if scan else FILES_PER_CORE) * df.sparkSession.sparkContext.defaultParallelism)


def table(df: DataFrame, name: str, scan: bool = False) -> DataFrame:
    """Write `df` once to the shared folder and read it back, which cuts its lineage for good.

    A lost executor costs a re-read of the files, never a recomputation, and readers prune columns. Many small files cost more than they
    bring, so their number is bounded; `scan` allows more for what comes straight from a source.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    few_files(df, scan).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stretches(batch: pa.RecordBatch, size: int = 1 << 20, rows: int = 1 << 15) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch cut where its column `text` reaches some `size` bytes or `rows` rows, each part with its texts (null: empty).

    Whatever number of rows Arrow brings at once, Python holds the strings of one part only.
    """
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths, dtype=np.int64) - lengths) // size
    edges = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, np.arange(0, len(part), rows), [len(part)]])) if len(part) else [0, 0]
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            own = batch.slice(a, b - a)
            yield own, ["" if t is None else t for t in own.column("text").to_pylist()]


def join_skewed(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, total: int, share: int = 1000) -> DataFrame:
    """Left join on `key`, where `right` has one row a key and any key may hold a third of `left`.

    `sizes` has (key, group_size). Keys with at least total/share rows number at most `share`, so their rows
    of `right` are broadcast with a proven bound; every other key goes through an ordinary shuffle, in which
    no key exceeds a `share`-th of the rows.
    """
    limit = max(2, -(-total // share))
    heavy = F.broadcast(sizes.where(F.col("group_size") >= limit).select(key).distinct())
    heavy_right = F.broadcast(right.join(heavy, key, "left_semi"))
    hot = left.join(heavy, key, "left_semi").join(heavy_right, key, "left")
    rest = left.join(heavy, key, "left_anti").join(right.join(heavy, key, "left_anti"), key, "left")
    return hot.unionByName(rest)


def bounded(df: DataFrame) -> DataFrame:
    """A written table with the hint to broadcast it if it is small; past the bound the same join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_BLOCK = 256


def with_matches(df: DataFrame, text: str, patterns: dict[str, str], only: dict[str, Column] | None = None) -> DataFrame:
    """Add, for each kind, `<kind>_m` (all leftmost non-overlapping matches) and `<kind>_g` (the gaps around them).

    `only` gives a cheap condition a text must meet to have any match of that kind.
    """
    only = only or {}
    none = F.array().cast("array<string>")

    def found(kind: str, pattern: str) -> Column:
        all_of = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        return F.when(only[kind], all_of).otherwise(none) if kind in only else all_of

    df = df.withColumns({f"{k}_m": found(k, p) for k, p in patterns.items()})
    gaps = {f"{k}_g": F.when(F.size(f"{k}_m") > 0, F.split(F.col(text), p, -1)).otherwise(none) for k, p in patterns.items()}
    return df.withColumns(gaps)


def spans_of(kind: str, order: int) -> Column:
    """From `<kind>_m` and `<kind>_g`: array of struct(s, o, k, e, m), code points, end exclusive.

    Starts are prefix sums of the lengths of gaps and matches, taken in blocks so that a text with very many
    matches costs O(n) appends a block instead of O(n^2).
    """
    sql = f"""
    CASE WHEN size({kind}_m) = 0 THEN cast(array() AS array<struct<s:int,o:int,k:string,e:int,m:string>>) ELSE
    aggregate(
      transform(sequence(0, cast((size({kind}_m) - 1) div {_BLOCK} AS int)), b ->
        aggregate(
          sequence(b * {_BLOCK}, least(size({kind}_m), (b + 1) * {_BLOCK}) - 1),
          named_struct('p', 0, 'out', cast(array() AS array<struct<s:int,o:int,k:string,e:int,m:string>>)),
          (a, i) -> named_struct(
            'p', a.p + length({kind}_g[i]) + length({kind}_m[i]),
            'out', concat(a.out, array(named_struct('s', a.p + length({kind}_g[i]), 'o', {order}, 'k', '{kind}',
                                  'e', a.p + length({kind}_g[i]) + length({kind}_m[i]), 'm', {kind}_m[i])))))),
      named_struct('p', 0, 'out', cast(array() AS array<array<struct<s:int,o:int,k:string,e:int,m:string>>>)),
      (a, b) -> named_struct('p', a.p + b.p, 'out', concat(a.out, array(transform(b.out, x ->
          named_struct('s', x.s + a.p, 'o', x.o, 'k', x.k, 'e', x.e + a.p, 'm', x.m))))),
      a -> flatten(a.out)) END"""
    return F.expr(sql)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda x: F.concat(x["k"], F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def masked(text: Column, spans: str) -> Column:
    """`text` with each span of the sorted array column `spans` replaced by [kind]; a span that overlaps an earlier one widens it."""
    return F.aggregate(
        F.col(spans),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["e"]).alias("at"),
            F.when(x["s"] < a["at"], a["out"])
            .otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit("["), x["k"], F.lit("]")))
            .alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
