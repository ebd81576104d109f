"""Candidate pairs: exact vector top-k, equality blocking, same-document conflicts, and their union (JN4 to JN7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.config import DEFAULT
from factloom.sources.tables import tasks

#: Vectors of a shard: a task holds one shard, one batch of new facts and their product.
SHARD = 4096
#: New facts that are sorted behind a shard in one task.
ASKING = 131_072
#: Vectors a shard has at least where more cores wait.
LEAST = 256
#: Facts of one key that are paired in one task; a key with more is split.
SPLIT = 1000


def _unit(batch: pa.RecordBatch) -> np.ndarray:
    vec = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, -1)
    return vec / np.maximum(np.sqrt((vec * vec).sum(axis=1, keepdims=True)), 1e-300)


def _best_of_shard(k: int, threshold: float):
    """Batches sorted by (key, asks), a key for each shard and block of new facts: of each key first the shard's vectors, then new facts, whose k best of the shard are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard = None, [], None
        for batch in batches:
            pair = np.stack([batch.column("key").to_numpy(), batch.column("asks").to_numpy()])
            cuts = np.concatenate([[0], np.flatnonzero((pair[:, 1:] != pair[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
            for begin, end in zip(cuts[:-1], cuts[1:]):
                if begin == end:
                    continue
                own = batch.slice(begin, end - begin)
                if pair[0, begin] != key:
                    key, held, shard = pair[0, begin], [], None
                if not pair[1, begin]:
                    held.append(own)
                    continue
                if shard is None and held:
                    every = pa.Table.from_batches(held).sort_by("id").combine_chunks()  # ties go to the lesser id
                    shard, held = (every, np.concatenate([_unit(b) for b in every.to_batches()])), []
                for at in range(0, own.num_rows, 1024) if shard is not None else ():
                    yield _hits(own.slice(at, 1024), *shard, k, threshold)

    return run


def _hits(new: pa.RecordBatch, every: pa.Table, unit: np.ndarray, k: int, threshold: float) -> pa.RecordBatch:
    s = np.round(_unit(new) @ unit.T, 12)
    ids = np.asarray(every.column("id").to_pylist(), object)
    s[np.asarray(new.column("id").to_pylist(), object)[:, None] == ids[None, :]] = -np.inf
    least = np.full(len(s), threshold)
    if len(ids) > k:
        least = np.maximum(least, np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k])
    row, place = np.nonzero(s >= least[:, None])
    order = np.lexsort((place, -s[row, place], row))
    row, place = row[order], place[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    row, place = row[nth < k], place[nth < k]
    take = lambda column, at: column.take(pa.array(at)).combine_chunks() if isinstance(column, pa.ChunkedArray) else column.take(pa.array(at))
    columns = [take(new.column("id"), row), take(every.column("id"), place), take(new.column("doc_id"), row), take(every.column("doc_id"), place), pa.array(s[row, place])]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "a_doc", "b_doc", "similarity"])


def cosine_topk(new: DataFrame, every: DataFrame, k: int = DEFAULT.top_k, threshold: float = DEFAULT.similarity, shard: int = SHARD, asking: int = ASKING) -> DataFrame:
    """(a, b, a_doc, b_doc, similarity, rank): each new fact's k most similar facts with at least `threshold`, other documents only.

    Inputs have (id, doc_id, vec). The top k is taken over all facts, of the same document too, which use up places; only then
    are hits within a document dropped. Stored vectors are dealt to shards, new facts to blocks, and each shard meets each block in a task of its
    own, so that what a task sorts and holds is bounded and each pair is scored once, by a matrix product; every shard hands on its own k best.
    """
    usable = lambda df: df.where(F.size("vec") > 0).select("id", "doc_id", F.col("vec").cast("array<double>").alias("vec"))
    new, every = usable(new), usable(every)
    n = every.count()
    blocks = max(1, -(-new.count() // asking))
    shards = max(1, -(-n // shard), min(every.sparkSession.sparkContext.defaultParallelism, n // LEAST))
    part = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts))
    key = lambda shard_, block: (shard_ * blocks + block).cast("int").alias("key")
    own = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).select(key(part(shards), F.col("block")), F.lit(0).alias("asks"), "id", "doc_id", "vec")
    asks = new.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).select(key(F.col("shard"), part(blocks)), F.lit(1).alias("asks"), "id", "doc_id", "vec")
    rows = own.unionByName(asks).repartition(shards * blocks, "key").sortWithinPartitions("key", "asks")
    hits = rows.mapInArrow(_best_of_shard(k, threshold), "a string, b string, a_doc string, b_doc string, similarity double")
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return hits.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("a_doc") != F.col("b_doc")))


def _paired(keyed: DataFrame, keys: list[str], *carried: str) -> DataFrame:
    """Pairs (a_<c>, b_<c>) of rows with equal keys, b's fact_id the lesser. Only ids and what is compared travel.

    Keys of one row are left out. A key of more than SPLIT rows is dealt to as many tasks as it has multiples of that: rows of one side to
    one of them each, rows of the other to all.
    """
    sizes = keyed.groupBy(*keys).agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    several = keyed.join(sizes, keys)
    side = lambda name, part: several.select(*keys, part.alias("part"), *[F.col(c).alias(f"{name}_{c}") for c in ("fact_id", *carried)])
    a = side("a", F.pmod(F.xxhash64("fact_id"), F.col("parts")).cast("int"))
    b = side("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return a.join(b, [*keys, "part"]).where("b_fact_id < a_fact_id")


def metric_pairs(facts: DataFrame) -> DataFrame:
    """(a_id, b_id, similarity): facts of different documents with one metric key (JN5), each unordered pair once, a the greater id."""
    # A key without any token would join everything with everything.
    keyed = facts.where(F.col("metric_key").isNotNull() & (F.col("metric_key") != "|")).select("metric_key", "fact_id", "doc_id")
    pairs = _paired(keyed, ["metric_key"], "doc_id").where("a_doc_id != b_doc_id")
    return pairs.select(F.col("a_fact_id").alias("a_id"), F.col("b_fact_id").alias("b_id"), F.lit(1.0).alias("similarity"))


def same_doc_pairs(facts: DataFrame, tolerance: float = DEFAULT.tolerance) -> DataFrame:
    """(a_id, b_id, similarity): facts of one document, metric and period that state different numbers (JN6). Units are not compared."""
    keyed = facts.where(F.col("metric_key").isNotNull() & (F.col("metric_key") != "|") & F.col("period_key").isNotNull() & F.col("value_num").isNotNull())
    pairs = _paired(keyed.select("doc_id", "metric_key", "period_key", "fact_id", "value_num"), ["doc_id", "metric_key", "period_key"], "value_num")
    x, y = F.col("a_value_num"), F.col("b_value_num")
    apart = pairs.where(F.abs(x - y) > tolerance * F.greatest(F.abs(x), F.abs(y)))
    return apart.select(F.col("a_fact_id").alias("a_id"), F.col("b_fact_id").alias("b_id"), F.lit(0.99).alias("similarity"))


def same_key_pairs(facts: DataFrame, tolerance: float = DEFAULT.tolerance) -> DataFrame:
    """(a, b, similarity): `metric_pairs` and `same_doc_pairs` in one, with both facts as structs, a the greater id.

    Both want equal metric keys, so one join of the facts with themselves brings them, and of the facts only columns that are used later
    travel, once a side. Keys of more than SPLIT facts are few; they are dealt to tasks as ids, and the facts are joined to them.
    """
    keyed = facts.where(F.col("metric_key").isNotNull() & (F.col("metric_key") != "|"))
    crowded = keyed.groupBy("metric_key").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT).select("metric_key").collect()
    few, dense = keyed, None
    if crowded:
        keys = F.broadcast(facts.sparkSession.createDataFrame(crowded, "metric_key string"))
        few, many = keyed.join(keys, "metric_key", "left_anti"), keyed.join(keys, "metric_key", "left_semi").select(*facts.columns)
        dense = with_facts(metric_pairs(many).unionByName(same_doc_pairs(many, tolerance)), many)
    parts = tasks(facts.sparkSession, facts.count())
    side = lambda name: few.select(*[F.col(c).alias(f"{name}_{c}") for c in facts.columns]).repartition(parts, f"{name}_metric_key")
    x, y = F.col("a_value_num"), F.col("b_value_num")
    apart = (F.col("a_period_key") == F.col("b_period_key")) & (F.abs(x - y) > tolerance * F.greatest(F.abs(x), F.abs(y)))
    similarity = F.when(F.col("a_doc_id") != F.col("b_doc_id"), 1.0).when((F.col("a_doc_id") == F.col("b_doc_id")) & apart, 0.99)
    met = side("a").join(side("b"), (F.col("a_metric_key") == F.col("b_metric_key")) & (F.col("b_fact_id") < F.col("a_fact_id")) & similarity.isNotNull())
    whole = lambda name: F.struct(*[F.col(f"{name}_{c}").alias(c) for c in facts.columns]).alias(name)
    pairs = met.select(whole("a"), whole("b"), similarity.alias("similarity"))
    return pairs if dense is None else pairs.unionByName(dense)


def with_facts(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b, similarity): pairs of ids with both facts as structs."""
    one = lambda side: facts.select(F.col("fact_id").alias(f"{side}_id"), F.struct(*facts.columns).alias(side))
    return pairs.join(one("a"), "a_id").join(one("b"), "b_id").select("a", "b", "similarity")


def metric_blocking(facts: DataFrame) -> DataFrame:
    return with_facts(metric_pairs(facts), facts)


def same_doc_conflicts(facts: DataFrame, tolerance: float = DEFAULT.tolerance) -> DataFrame:
    return with_facts(same_doc_pairs(facts, tolerance), facts)


def union_pairs(*sources: DataFrame) -> DataFrame:
    """(a_id, b_id, similarity, source) of sources (a_id, b_id, similarity), each unordered pair once; an earlier source wins (JN7)."""
    ranked = [s.select("a_id", "b_id", "similarity", s["source"] if "source" in s.columns else F.lit(r).alias("source")) for r, s in enumerate(sources)]
    every = ranked[0]
    for s in ranked[1:]:
        every = every.unionByName(s)
    pair = W.partitionBy(F.least("a_id", "b_id"), F.greatest("a_id", "b_id")).orderBy("source", "a_id")
    return every.withColumn("_n", F.row_number().over(pair)).where("_n = 1").drop("_n")


def union_candidates(*sources: DataFrame) -> DataFrame:
    """Candidates (a, b, similarity) of all sources, each unordered pair once; an earlier source wins (JN7)."""
    ranked = [s.select("a", "b", "similarity", F.lit(r).alias("source")) for r, s in enumerate(sources)]
    every = ranked[0]
    for s in ranked[1:]:
        every = every.unionByName(s)
    pair = W.partitionBy(F.least("a.fact_id", "b.fact_id"), F.greatest("a.fact_id", "b.fact_id")).orderBy("source", "a.fact_id")
    return every.withColumn("_n", F.row_number().over(pair)).where("_n = 1").drop("_n")
