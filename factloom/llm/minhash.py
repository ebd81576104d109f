"""Near-duplicate detection by circulant MinHash, with exact verification.

A document's set holds its distinct word shingles (64-bit hashes). Documents with one and the same set collapse to a
node before anything else. Circulant MinHash: the shingle's place in a universe of UNIVERSE is permuted once; a
second permutation, circularly shifted by k, gives coordinate k of the signature. Since shift k of the second permutation
is the next entry of its table, the K values of a shingle are K neighbouring entries. BANDS bands of ROWS coordinates give
buckets; at similarity 0.8 a pair shares none with probability (1 - 0.8^ROWS)^BANDS, 3 in a million.

Candidates are clusters, not pairs. Every member of a bucket is held against the smallest members of its buckets, four at most; a
pair whose sketches (one byte a coordinate) agree on MARGIN or more joins two clusters. Buckets that still hold several
clusters are compared inside their task, sketch by sketch, and hand on only the pairs that join clusters, so a bucket of m members
emits fewer than m rows. A sketch that agrees on less than MARGIN is over five deviations below the threshold.

Verification is exact and inside the task too: each text of a cluster travels once, to the task of its cluster, where full sets are
intersected through an inverted index and components are searched breadth first; again fewer than m rows leave. A cluster of
more than CHUNK shingles is cut in chunks: links are searched inside each, then among a few members of every component found,
then between all members outside the largest component and all members of the cluster, chunk against chunk. No link between
components is lost: a pair is left untested only if both are in one component already.

Null or empty texts have an empty set, and link with nothing. Texts of fewer words than a shingle have one shingle, the whole
sequence. Sets, not ids, are linked: rows that share a doc_id but not the text stay apart. A row without doc_id links by its set; its
component is the smallest doc_id there is, or none. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.llm.common import BROADCAST_ROWS, bounded, in_arrow, join_skewed, stretches, table
from factloom.llm.words import hasher, mix, text_of

UNIVERSE = 1 << 21
BANDS = 32
ROWS = 5
K = BANDS * ROWS
SEED = 20240229
#: Sketch bytes that must agree for a pair to join two clusters: 0.62 of K.
MARGIN = int(0.62 * K)
#: Members of a bucket that are compared in one task at most.
BLOCK = 2048
#: Shingles of a cluster that are verified in one task; bounds its memory (some 100 MB).
CHUNK = 1_500_000
#: Members of each component of a chunk that meet those of other chunks first. What they leave open is compared in full.
ENVOYS = 8
_TABLES: list[np.ndarray] = []


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        rng = np.random.default_rng(SEED)
        _TABLES.append(rng.permutation(UNIVERSE).astype(np.uint32))
        second = rng.permutation(UNIVERSE).astype(np.uint32)
        _TABLES.append(np.concatenate([second, second[:K]]))  # circular
    return _TABLES[0], _TABLES[1]


def shingle_set(text, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    h = hasher().of(text_of(text))
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The K coordinates of a non-empty set."""
    first, second = _permutations()
    windows = np.lib.stride_tricks.sliding_window_view(second, K)
    at = first[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)].astype(np.int64)
    out = np.full(K, UNIVERSE, np.uint32)
    for k in range(0, len(at), 4096):
        np.minimum(out, windows[at[k : k + 4096]].min(axis=0), out=out)
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h.view(np.int64)


def _sketch(sig: np.ndarray) -> bytes:
    return (mix(sig.astype(np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes()


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text): rows that repeat a doc_id are told apart by a hash of their text."""
    return docs.select("doc_id", F.xxhash64("text").alias("fp"), "text")


def described(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp, n, d, bands, sketch): size and digest of each document's set, its buckets and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in stretches(batch):
                n, d, bands, sketch = [], [], [], []
                for text in texts:
                    s = shingle_set(text, words)
                    sig = signature(s) if len(s) else None
                    n.append(len(s))
                    d.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b"")
                    bands.append(None if sig is None else _bands(sig))
                    sketch.append(None if sig is None else _sketch(sig))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("fp"), pa.array(n, pa.int64()), pa.array(d, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    ["doc_id", "fp", "n", "d", "bands", "sketch"],
                )

    return in_arrow(_marked(docs), run, "doc_id long, fp long, n long, d binary, bands array<long>, sketch binary")


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, K)


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            alike = (_sketches(batch.column("sa")) == _sketches(batch.column("sb"))).sum(axis=1) >= MARGIN
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(alike)), batch.column("b").filter(pa.array(alike))], ["a", "b"])


def _sizes_fit(na: str, nb: str) -> Column:
    """Sets whose sizes differ too much cannot reach the similarity."""
    return 100 * F.least(na, nb) >= 80 * F.greatest(na, nb)


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links (a, b) reach, for every node that has a link. Least labels travel and jump.

    Labels of nodes with a thousandth of all links or more (at most 2,000 nodes) are broadcast, so that no hub meets in one task.
    """
    links = table(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")), "nd-links")
    labels = table(links.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label"), F.count("*").alias("group_size")), "nd-labels")
    total = labels.agg(F.sum("group_size")).first()[0] or 0
    degrees = labels.select(F.col("node").alias("v"), "group_size")
    hubs = total > BROADCAST_ROWS  # of fewer links every join is small
    labels = labels.select("node", "label")
    while True:
        by_v = labels.toDF("v", "l")
        told = join_skewed(links, by_v, "v", degrees, total) if hubs else links.join(by_v, "v")
        heard = told.groupBy(F.col("u").alias("node")).agg(F.min("l").alias("l"))
        stepped = labels.join(heard, "node", "left").select("node", "label", F.least("label", "l").alias("new"))
        jumps = labels.select(F.col("node").alias("new"), F.col("label").alias("over"))
        if hubs:
            jumped = join_skewed(stepped, jumps, "new", stepped.groupBy("new").agg(F.count("*").alias("group_size")), total)
        else:
            jumped = stepped.join(jumps, "new", "left")
        following = table(jumped.select("node", F.least("new", "over").alias("label"), (F.least("new", "over") < F.col("label")).alias("moved")), "nd-labels")
        labels = following.select("node", "label")
        if following.where("moved").isEmpty():
            return labels


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column("key").to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        if held and held[-1].column("key")[0].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket, pairs of members that join clusters: fewer than the bucket has members."""
    out_a, out_b = [], []
    for group in _by_key(batches):
        node, label, n = (group.column(c).to_numpy().copy() for c in ("node", "label", "n"))
        outer, inner = (group.column(c).to_numpy() for c in ("outer_side", "inner_side"))
        sketch = _sketches(group.column("sketch"))
        for i in np.flatnonzero(outer):
            j = np.flatnonzero(inner & (label != label[i]) & (100 * np.minimum(n, n[i]) >= 80 * np.maximum(n, n[i])))
            if len(j):
                j = j[(sketch[j] == sketch[i]).sum(axis=1) >= MARGIN]
            for k in j.tolist():
                if label[k] != label[i]:
                    out_a.append(int(node[i]))
                    out_b.append(int(node[k]))
                    label[label == label[k]] = label[i]
        if len(out_a) >= 10_000:
            yield _edges(out_a, out_b)
            out_a, out_b = [], []
    yield _edges(out_a, out_b)


def linked(sets: list[np.ndarray], labels: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of sets with 100 * intersection >= 80 * union, enough to join all that such pairs connect.

    `labels` says what is connected already. Breadth first over an inverted index of what is not yet reached.
    """
    m = len(sets)
    sizes = np.asarray([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(m), sizes)
    often = np.bincount(code)
    code, owner = code[often[code] > 1], owner[often[code] > 1]
    first = np.searchsorted(owner, np.arange(m + 1))
    free, out = np.ones(m, bool), []
    if not len(code):
        return out

    def index() -> tuple[np.ndarray, np.ndarray]:
        sel = free[owner]
        order = np.argsort(code[sel], kind="stable")
        return np.concatenate([[0], np.cumsum(np.bincount(code[sel], minlength=len(often)))]), owner[sel][order]

    begin, posting = index()
    indexed = m
    for start in range(m):
        if not free[start]:
            continue
        queue = np.flatnonzero(labels == labels[start]).tolist()
        free[queue] = False
        while queue and (left := int(free.sum())):
            if 2 * left < indexed:
                begin, posting = index()
                indexed = left
            x = queue.pop()
            own = code[first[x] : first[x + 1]]
            lo, many = begin[own], begin[own + 1] - begin[own]
            total = int(many.sum())
            if not total:
                continue
            at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(total)
            common = np.bincount(posting[at], minlength=m)
            for y in np.flatnonzero(free & (common > 0) & (100 * common >= 80 * (sizes[x] + sizes - common))).tolist():
                if free[y]:
                    out.append((x, y))
                    reached = np.flatnonzero(labels == labels[y])
                    free[reached] = False
                    queue += reached.tolist()
    return out


def _verified(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_key(batches):
            node, place = np.unique(group.column("node").to_numpy(), return_index=True)
            if len(node) < 2:
                continue
            labels, text = group.column("label").to_numpy()[place], group.column("text")
            pairs = linked([shingle_set(text[int(k)].as_py(), words) for k in place], labels)
            if pairs:
                yield _edges(*([int(node[k]) for k in side] for side in zip(*pairs)))

    return run


def verify(wanted: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Links (a, b) inside each key of `wanted` (key, node, label, doc_id, fp), confirmed on the full sets of the texts of `docs`."""
    wanted = table(wanted.select("key", "node", "label", F.col("doc_id").alias("own_id"), F.col("fp").alias("own_fp")), "nd-wanted")
    texts = _marked(docs).join(bounded(wanted), F.col("fp").eqNullSafe(F.col("own_fp")) & F.col("doc_id").eqNullSafe(F.col("own_id")))
    grouped = texts.select("key", "node", "label", "text").repartition("key").sortWithinPartitions("key")
    return table(in_arrow(grouped, _verified(words), "a long, b long"), "nd-confirmed")


def confirmed(clusters: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, chunk: int) -> DataFrame:
    """Links inside `clusters` (node, label), enough to connect all that links connect. `nodes`: (node, n, first)."""
    members = table(clusters.withColumnRenamed("label", "cluster").join(nodes, "node").select("node", "cluster", "n", "first.doc_id", "first.fp"), "nd-cluster")
    sizes = members.groupBy("cluster").agg(F.sum("n").alias("size"))
    big = table(sizes.where(F.col("size") > chunk).select("cluster", F.ceil(F.col("size") / chunk).cast("int").alias("chunks")), "nd-big")
    if big.isEmpty():
        return verify(members.select(F.col("cluster").alias("key"), "node", F.col("node").alias("label"), "doc_id", "fp"), docs, words)
    members = members.join(bounded(big), "cluster", "left").withColumn("at", F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))))
    members = table(members, "nd-chunks")
    links = verify(members.select(F.xxhash64("cluster", "at").alias("key"), "node", F.col("node").alias("label"), "doc_id", "fp"), docs, words)

    def labelled() -> DataFrame:
        found = components(links).withColumnRenamed("node", "own")
        large = members.where("chunks IS NOT NULL")
        return table(large.join(found, large["node"] == found["own"], "left").drop("own").withColumn("label", F.coalesce("label", "node")), "nd-large")

    # A few of each component of a chunk meet those of other chunks.
    now = labelled()
    place = F.row_number().over(W.partitionBy("cluster", "at", "label").orderBy("node"))
    crowd = now.groupBy("cluster", "at", "label").agg(F.count("*").alias("m")).where("m > 1")
    envoys = now.join(crowd, ["cluster", "at", "label"]).withColumn("place", place).where(F.col("place") <= ENVOYS)
    weight = envoys.groupBy("cluster").agg(F.ceil(F.sum("n") / chunk).cast("int").alias("tables"))
    envoys = envoys.join(weight, "cluster").withColumn("seat", F.pmod(F.xxhash64("cluster", "place", "label"), F.col("tables")))
    links = table(links.union(verify(envoys.select(F.xxhash64("cluster", "seat").alias("key"), "node", "label", "doc_id", "fp"), docs, words)), "nd-links2")
    # All outside the largest component against all.
    now = labelled()
    main = now.groupBy("cluster", "label").agg(F.count("*").alias("m")).groupBy("cluster").agg(F.max(F.struct("m", "label"))["label"].alias("main"))
    now = table(now.join(main, "cluster"), "nd-main")
    outer = now.where("label != main").groupBy("cluster").agg(F.ceil(F.sum("n") / chunk).cast("int").alias("outer_chunks"))
    now = now.join(outer, "cluster")
    i, j = F.pmod(F.xxhash64("node", F.lit(1)), F.col("outer_chunks")), F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks"))
    as_outer = now.where("label != main").select("*", i.cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"))
    as_inner = now.select("*", F.explode(F.sequence(F.lit(0), F.col("outer_chunks") - 1)).alias("i"), j.cast("int").alias("j"))
    both = as_outer.union(as_inner).select(F.xxhash64("cluster", "i", "j").alias("key"), "node", "label", "doc_id", "fp")
    return table(links.union(verify(both, docs, words)), "nd-links3")


def clustered(members: DataFrame, sides: DataFrame) -> DataFrame:
    """(node, label): clusters of nodes whose sketches let a link pass, over members (band, node, pivot, m) of buckets."""
    # A member is held against the smallest pivot of each quarter of its buckets: at most four pairs, however large its group.
    star = members.where("node != pivot").groupBy(F.col("node").alias("b"), F.pmod("band", F.lit(4)).alias("quarter")).agg(F.min("pivot").alias("a")).select("a", "b").distinct()
    star = table(star, "nd-star")
    pivots = star.groupBy("a").agg(F.count("*").alias("group_size"))
    known = join_skewed(star.join(sides.toDF("b", "nb", "sb"), "b"), sides.toDF("a", "na", "sa"), "a", pivots, star.count())
    near = table(in_arrow(known.where(_sizes_fit("na", "nb")).select("a", "b", "sa", "sb"), _agree, "a long, b long"), "nd-near")
    labels = components(near)

    # Buckets that still hold more than one cluster.
    placed = table(members.join(labels, "node", "left").select("band", "node", "m", F.coalesce("label", "node").alias("label")), "nd-placed")
    main = table(placed.groupBy("band").agg(F.min("label").alias("main"), F.max("label").alias("other")).where("main != other").select("band", "main"), "nd-main-label")
    mixed = table(placed.join(bounded(main), "band"), "nd-mixed")
    outer = table(mixed.groupBy("band").agg(F.count_if(F.col("label") != F.col("main")).alias("m_outer")), "nd-outer")
    inside = mixed.join(bounded(outer), "band").join(sides, "node")
    # Up to two blocks of members are compared at once. Larger buckets: blocks of those outside the main cluster,
    # each against blocks of all members.
    small = F.col("m") <= 2 * BLOCK
    rows_outer, rows_all = F.ceil(F.col("m_outer") / BLOCK).cast("int"), F.ceil(F.col("m") / BLOCK).cast("int")
    whole = inside.where(small).select(F.xxhash64("band").alias("key"), "node", "label", "n", "sketch", (F.col("label") != F.col("main")).alias("outer_side"), F.lit(True).alias("inner_side"))
    spread = inside.where(~small)
    own_outer, own_all = F.pmod(F.xxhash64("node"), rows_outer), F.pmod(F.xxhash64("node", F.lit(1)), rows_all)
    as_outer = spread.where("label != main").select("band", "node", "label", "n", "sketch", own_outer.cast("int").alias("i"), F.explode(F.sequence(F.lit(0), rows_all - 1)).alias("j"), F.lit(True).alias("outer_side"))
    as_all = spread.select("band", "node", "label", "n", "sketch", F.explode(F.sequence(F.lit(0), rows_outer - 1)).alias("i"), own_all.cast("int").alias("j"), F.lit(False).alias("outer_side"))
    blocks = as_outer.unionByName(as_all).select(F.xxhash64("band", "i", "j").alias("key"), "node", "label", "n", "sketch", "outer_side", (~F.col("outer_side")).alias("inner_side"))
    sorted_ = whole.unionByName(blocks).repartition("key").sortWithinPartitions("key")
    more = table(in_arrow(sorted_, _inside, "a long, b long"), "nd-inside")
    return labels if more.isEmpty() else components(near.union(more))


def labelled(docs: DataFrame, words: int, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fp, n_shingles, component_id, chosen_id, chosen_fp): for each row the smallest doc_id of its component and the row that stands for it."""
    every = table(described(docs, words), "nd-docs", scan=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "fp")).alias("first")
    nodes = every.where("n > 0").groupBy("d").agg(first, F.count("*").alias("group_size"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = table(nodes.withColumn("node", F.monotonically_increasing_id()), "nd-nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    buckets = table(banded.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("m")).where("m > 1"), "nd-buckets")
    total = buckets.agg(F.sum("m")).first()[0] or 0
    members = table(join_skewed(banded, buckets, "band", buckets.select("band", F.col("m").alias("group_size")), total).where("m IS NOT NULL"), "nd-members")
    clusters = clustered(members, nodes.select("node", "n", "sketch"))
    links = confirmed(clusters, nodes.select("node", "n", "first"), docs, words, chunk)

    # Of each component the first row; nodes without a link stand for themselves.
    joined = table(components(links).join(nodes.select("node", "first"), "node"), "nd-joined")
    of_label = table(joined.groupBy("label").agg(F.min("first").alias("chosen"), F.count("*").alias("group_size")), "nd-chosen")
    of_node = join_skewed(joined.select("node", "label"), of_label.select("label", "chosen"), "label", of_label.select("label", "group_size"), joined.count()).select("node", "chosen")
    of_set = table(nodes.select("d", "group_size", "node", "first").join(of_node, "node", "left").select("d", "group_size", F.coalesce("chosen", "first").alias("chosen")), "nd-sets")
    rows = every.select("doc_id", "fp", "n", "d")
    found = join_skewed(rows.where("n > 0"), of_set.select("d", "chosen"), "d", of_set.select("d", "group_size"), rows.count())
    found = found.select("doc_id", "fp", "n", F.col("chosen.doc_id").alias("component_id"), F.col("chosen.doc_id").alias("chosen_id"), F.col("chosen.fp").alias("chosen_fp"))
    alone = rows.where("n = 0").select("doc_id", "fp", "n", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("chosen_id"), F.col("fp").alias("chosen_fp"))
    return found.unionByName(alone).withColumnRenamed("n", "n_shingles")


def near_groups(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`; kept where doc_id is the component's, null ids included."""
    return labelled(docs, words).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of `docs` that stay, all columns: of each component the one with the smallest doc_id (ids before none, then by a hash of the text).

    Of rows that repeat both doc_id and text one stays; rows without words all stay.
    """
    found = table(labelled(docs, words).where("n_shingles > 0").select("doc_id", "fp", (F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (F.col("fp") == F.col("chosen_fp"))).alias("stays")), "nd-found")
    gone = table(found.where("NOT stays").select(F.col("doc_id").alias("__factloom_gone_id"), F.col("fp").alias("__factloom_gone_fp")).distinct(), "nd-gone")
    twice = table(found.where("stays").groupBy("doc_id", "fp").count().where("count > 1").select(F.col("doc_id").alias("__factloom_twice_id"), F.col("fp").alias("__factloom_twice_fp")), "nd-twice")
    own_fp = F.xxhash64("text")
    rest = docs.join(bounded(gone), F.col("doc_id").eqNullSafe(F.col("__factloom_gone_id")) & (own_fp == F.col("__factloom_gone_fp")), "left_anti")
    if twice.isEmpty():
        return rest
    same = F.col("doc_id").eqNullSafe(F.col("__factloom_twice_id")) & (own_fp == F.col("__factloom_twice_fp"))
    mark = "__factloom_fp"
    again = rest.join(twice, same, "left_semi").withColumn(mark, own_fp).dropDuplicates(["doc_id", mark]).drop(mark)
    return rest.join(twice, same, "left_anti").unionByName(again)


def query(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g
  FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS far FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.far),
c AS (SELECT doc_id, least(doc_id, min(far)) AS low FROM r GROUP BY doc_id)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.low, t.doc_id) AS component_id, t.doc_id = coalesce(c.low, t.doc_id) AS kept
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN c ON c.doc_id = t.doc_id
"""
