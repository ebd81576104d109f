"""Packing by non-negative least squares.

Every document is tokenised once; its ids (with the end id) are cut into full windows and one remainder. Full windows
are sequences of their own, without padding. The remainders' length histogram, whose size is bounded by the window,
goes to the driver. There shallow combinations of lengths that fill a window are enumerated, non-negative least
squares finds how often to repeat each so that the histogram is used up, counts are rounded down, and what is left is
packed greedily, longest first into the tightest fit, again by counts. The plan has at most as many kinds of sequences
as combinations plus lengths, so it is bounded too, and is broadcast; documents get their slots by their rank among
pieces of one length, found from counts by written part, so that no length, however common, meets in one task.

Null text counts as empty (one piece: the end id alone). Repeated rows are packed as often as they occur.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import few_files, in_arrow, stretches, table
from factloom.llm.tokens import byte_bpe, tokenizer_path

WINDOW = 2048
END_ID = 1
_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Cut each document's ids into windows: (doc_id, start, length, ids_crc32, doc_tokens)."""
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer)
        for batch in batches:
            for part, texts in stretches(batch):
                owner, rows = [], []
                for k, ids in enumerate(encoder.encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    for at in range(0, n, window):
                        own = ids[4 * at : 4 * (at + window)]
                        owner.append(k)
                        rows.append((at, len(own) // 4, zlib.crc32(own), n))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner)), *columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return in_arrow(docs.select("doc_id", "text"), cut, _PIECES)


def combinations(have: np.ndarray, window: int, deep: int = 24) -> list[tuple[int, ...]]:
    """Pairs that fill the window exactly, triples over the `deep` most frequent lengths, and repeats of one length.

    `have` counts pieces by length (index = length).
    """
    out: set[tuple[int, ...]] = set()
    lengths = np.flatnonzero(have)
    here = set(lengths.tolist())
    for a in lengths.tolist():
        if window - a in here and a <= window - a:
            out.add((window - a, a))
        if window % a == 0 and window // a <= 16:
            out.add((a,) * (window // a))
    common = sorted(here, key=lambda x: (-have[x], x))[:deep]
    for a in common:
        for b in lengths.tolist():
            c = window - a - b
            if c in here:
                out.add(tuple(sorted((a, b, c), reverse=True)))
    return sorted(out)


def nnls(columns: list[tuple[int, ...]], have: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Repeat counts x >= 0 that least-squares fit sum(columns * x) to the histogram, by coordinate descent."""
    x = np.zeros(len(columns))
    rest = have.astype(float).copy()
    parts = [np.unique(np.asarray(c), return_counts=True) for c in columns]
    norms = [float((n * n).sum()) for _, n in parts]
    for _ in range(rounds):
        moved = 0.0
        for j, (at, n) in enumerate(parts):
            new = max(0.0, x[j] + float((n * rest[at]).sum()) / norms[j])
            if new != x[j]:
                rest[at] -= n * (new - x[j])
                moved = max(moved, abs(new - x[j]))
                x[j] = new
        if moved < 0.25:
            break
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, how many such sequences)], using every piece of the histogram exactly once."""
    have = np.zeros(window + 1, dtype=np.int64)
    for length, n in histogram.items():
        have[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    if have[window]:
        out.append(((window,), int(have[window])))
        have[window] = 0
    columns = combinations(have, window)
    for column, want in zip(columns, nnls(columns, have)):
        at, n = np.unique(np.asarray(column), return_counts=True)
        times = int(min(np.floor(want + 1e-9), (have[at] // n).min()))
        if times > 0:
            have[at] -= n * times
            out.append((column, times))
    while True:  # residuals: each step uses up at least one length or ends a length's run
        lengths = np.flatnonzero(have)
        if not len(lengths):
            return out
        left, shape, room = have.copy(), [], window
        while True:
            fit = np.flatnonzero(left[: room + 1])
            if not len(fit) or fit[-1] == 0:
                break
            a = int(fit[-1])
            left[a] -= 1
            shape.append(a)
            room -= a
        at, n = np.unique(np.asarray(shape), return_counts=True)
        times = int((have[at] // n).min())
        have[at] -= n * times
        out.append((tuple(shape), times))


def _slots(made: list[tuple[tuple[int, ...], int]]) -> pa.Table:
    """For each slot of the plan: ranks [lo, hi) of pieces of `length` go to sequences seq + rank - lo at `offset`."""
    used: dict[int, int] = {}
    rows, seq = [], 0
    for shape, times in made:
        at = 0
        for length in shape:
            lo = used.get(length, 0)
            rows.append((length, lo, lo + times, seq, at))
            used[length] = lo + times
            at += length
        seq += times
    kinds = {"length": pa.int32(), "lo": pa.int64(), "hi": pa.int64(), "seq": pa.int64(), "offset": pa.int64()}
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row a piece."""
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer or tokenizer_path("byte_bpe_50k.json"), window, end_id)
    # The part and the place in it are stored with the rows: read again, they are the same whatever fails.
    # monotonically_increasing_id is the part's number times 2^33 plus the place.
    cut = table(cut.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33).cast("int")), "pack-pieces", scan=True)
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = table(counts, "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    slots = spark.createDataFrame(_slots(plan(histogram, window)))
    # Parts times lengths may be many rows: this join shuffles, and part and length together are no hot key.
    before = counts.selectExpr("length", "part", "cast(sum(n) OVER (PARTITION BY length ORDER BY part) - n AS bigint) AS before")
    # Within a part ranks are local; each (part, length) holds no more rows than its part.
    ranked = cut.selectExpr("*", "row_number() OVER (PARTITION BY part, length ORDER BY place) - 1 AS local")
    ranked = ranked.join(before.hint("merge"), ["length", "part"]).withColumn("rank", F.col("local") + F.col("before"))
    here = F.broadcast(slots)
    placed = ranked.join(here, (ranked["length"] == here["length"]) & (ranked["rank"] >= here["lo"]) & (ranked["rank"] < here["hi"]))
    return few_files(placed).select(
        "doc_id", "start", ranked["length"].cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("seq") + F.col("rank") - F.col("lo")).cast("long").alias("sequence_id"), "offset",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
