"""Language-model scoring with a weighted backoff automaton.

Tokens are words (A to Z lower-cased) and one end a text. Counts of all tokens of all training texts give the
add-one unigram distribution P1(v) = (c + 1) / (N + V + 1), the automaton's empty state. Every word (and the start of a text)
is a state of its own. From state u the arc for v, one for every pair seen, weighs log10((c_uv - D) / c_u + b_u P1(v)),
absolute discounting with the freed mass b_u = D n_u / c_u, n_u being the distinct words seen behind u; the failure arc of u
weighs log10 b_u and leads to the empty state, whose arcs weigh log10 P1(v). Every state's probabilities sum to one. A text is
read once from left to right; the state carried is its last word, and a word that training lacks is the empty state.

No pair and no word is left out, and none is held by all workers: the automaton is dealt by state.

1. One pass counts the tokens, and for the HOT histories that a sample finds frequent the distinct words behind them.
2. The traversal reads each text once. Words of the DICTIONARY, a broadcast cache of the most frequent ones, get their P1 there; for each
   step it hands on the arc (state, word) that it takes, packed by the task that owns it: by the state, or, where the state is
   hot, by state and word. What a task holds at once is bounded by BUCKET tokens, as far as one state that is not hot allows; of very
   many tokens a task of at most TASKS gets several such buckets, deals them apart and meets them in turn.
3. There the arcs' counts are summed over training texts, n_u and b_u follow, and each step's weight goes back, summed by text. Only steps
   to words outside the dictionary wait for one more join with the counts of words.

DICTIONARY, HOT and BUCKET say where things happen; scores do not depend on them. Words are told apart by 63-bit hashes (expected wrong
pairs: V^2 / 2^64). Null text is empty: one token, the end. Repeated rows are scored, and counted, as often as they occur. An empty table gives
an empty result; with no training text every token is unknown, at P1 = 1. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import in_arrow, stretches, table
from factloom.llm.words import WordHashes

DICTIONARY = 500_000
HOT = 512
#: Tokens met in one task; bounds its memory (some 90 MB beside what a worker has anyway).
BUCKET = 2_000_000
DISCOUNT = 0.75
#: Tasks among which arcs are dealt at most; more arcs than they hold at once are met in turns, sorted on disk.
TASKS = 20_000
#: Steps that a task deals to its turns at once.
_TURNED = 8_000_000
#: Of the texts one in so many finds the hot histories.
SAMPLED = 64
#: A word cannot hold a space, so these are no words.
_END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))
_START = np.uint64(xxhash.xxh3_64_intdigest(b" start"))
#: Tokens that a worker counts together.
_MEMTABLE = 2_000_000
_TOP_BIT = np.uint64(1 << 63)


def _mixed(x: np.ndarray, y: np.ndarray | int = 0) -> np.ndarray:
    """One 64-bit hash for each pair."""
    x = np.asarray(x).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) + np.asarray(y, np.int64).view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _finder(hashes: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Places among sorted hashes, -1 for those that are not there."""

    def find(h: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return np.where(hashes[at] == h, at, -1)

    return find


class Sheet:
    """The token sequences of some texts, one behind the other, each with its end."""

    def __init__(self, words: WordHashes, texts: list[str], end_tag: int, start_tag: int):
        read = [words.tagged(t) for t in texts]
        self.sizes = np.asarray([len(h) + 1 for h, _ in read], np.int64)
        ends = np.cumsum(self.sizes) - 1
        inner = np.ones(int(self.sizes.sum()), bool)
        inner[ends] = False
        self.hash, self.tag = np.full(len(inner), _END), np.full(len(inner), end_tag, np.int64)
        self.hash[inner], self.tag[inner] = np.concatenate([h for h, _ in read]), np.concatenate([t for _, t in read])
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        #: The state in which each token is read.
        self.state_hash, self.state_tag = np.append(_START, self.hash[:-1]), np.append(start_tag, self.tag[:-1])
        self.state_hash[ends[:-1] + 1], self.state_tag[ends[:-1] + 1] = _START, start_tag


def _joined(values: list[bytes | None], kind, width: int | None = None) -> np.ndarray:
    """What all values hold, numbers of `width` bytes in a wider `kind`. The list is emptied meanwhile, so that nothing is held twice."""
    size = np.dtype(kind).itemsize
    width = width or size
    out = np.zeros((sum(len(v or b"") for v in values) // width, size), np.uint8)
    done = 0
    for k, v in enumerate(values):
        part = np.frombuffer(v or b"", np.uint8).reshape(-1, width)
        out[done : done + len(part), :width] = part
        done += len(part)
        values[k] = None
    return out.view(kind).ravel()


def _runs(*sorted_: np.ndarray) -> np.ndarray:
    """Where a new value begins among sorted ones."""
    new = np.ones(len(sorted_[0]), bool)
    if len(new):
        new[1:] = np.any([x[1:] != x[:-1] for x in sorted_], axis=0)
    return np.flatnonzero(new)


def _unsigned(column: str) -> Column:
    """A 64-bit hash as workers name words outside the dictionary: with its top bit set."""
    return F.col(column).bitwiseOR(F.lit(-(2**63)))


def hot_words(train: DataFrame) -> np.ndarray:
    """Hashes of the words that a sample of the texts holds most often. They decide where arcs are counted, never how."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for _, texts in stretches(batch):
                k, n = np.unique(np.concatenate([words.of(t) for t in texts]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["h", "c"])

    some = in_arrow(train.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text"), run, "h long, c long")
    rows = some.groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(HOT).collect()
    return np.sort(np.asarray([r["h"] for r in rows], np.int64).view(np.uint64))


def counted(train: DataFrame, hot: np.ndarray) -> DataFrame:
    """(u, h, c, kinds): of every token h its count (u null); of every hot history u, the start being its last, the distinct words behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = WordHashes(_finder(hot)), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            after, state = (np.concatenate(x) for x in zip(*held))
            held.clear()
            token, n = np.unique(after, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(token), pa.int32()), pa.array(token.view(np.int64)), pa.array(n)], ["u", "h", "c"])
            del token, n
            after, state = after[state >= 0], state[state >= 0]
            _, first = np.unique(_mixed(after, state), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(state[first]), pa.array(after[first].view(np.int64)), pa.array(np.ones(len(first), np.int64))], ["u", "h", "c"])

        for batch in batches:
            for _, texts in stretches(batch):
                s = Sheet(words, texts, -1, len(hot))
                held.append((s.hash, s.state_tag.astype(np.int32)))
                size += len(s.hash)
                if size > _MEMTABLE:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    once = in_arrow(train.select("text"), run, "u int, h long, c long").groupBy("u", "h").agg(F.sum("c").alias("c"))
    own = F.when(F.col("u").isNull(), F.col("h")).alias("h")
    return once.groupBy("u", own).agg(F.sum("c").alias("c"), F.count("*").alias("kinds"))


def _least_count(counts: DataFrame, most: int) -> int:
    """The least count such that at most `most` rows have it or more, from a histogram of exact small and binned large counts."""
    c = F.col("c")
    edge = F.when(c < 4096, c.cast("double")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(c) * 16) / 16))
    rows = sorted(((r["e"], r["n"]) for r in counts.groupBy(edge.alias("e")).agg(F.count("*").alias("n")).collect()), reverse=True)
    seen, out = 0, None
    for at, n in rows:
        seen += n
        if seen > most:
            break
        out = at
    if out is None:  # even the top bin holds more than `most`
        return int(rows[0][0] * 2) + 1 if rows else 1
    return max(1, int(np.ceil(out)))


class Automaton:
    """What every worker knows: the dictionary with its counts, and n_u of the hot states. Arrays only, so that it travels well."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, starts: int, hot: dict[int, int], start_kinds: int):
        order = np.argsort(hashes.view(np.uint64))
        self.hashes = hashes.view(np.uint64)[order]
        #: Of each word, and last of the start of a text: how often it is a state.
        self.counts = np.append(counts[order], starts).astype(np.int64)
        self.total, self.distinct = int(total), int(distinct)
        self.log_p1 = np.log10((self.counts[:-1] + 1) / (self.total + self.distinct + 1))
        self.start = len(self.hashes)
        self.hot_kinds = np.full(len(self.counts), -1, np.int64)
        self.hot_kinds[self.start] = start_kinds
        keys = np.asarray(list(hot), np.int64).view(np.uint64)
        at = _finder(self.hashes)(keys)
        self.hot_kinds[at[at >= 0]] = np.asarray(list(hot.values()), np.int64)[at >= 0]
        self.end = int(_finder(self.hashes)(np.asarray([_END]))[0])
        self.key_bytes = max(1, -(-max(1, len(self.counts) * max(1, self.start)).bit_length() // 8))

    def home(self, state: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
        """The bucket of each arc: its state's, or its own where the state is hot."""
        split = self.hot_kinds[np.where(state >= 0, state, 0)] >= 0
        split &= state >= 0
        return (np.where(split, _mixed(state, word), _mixed(state)) % np.uint64(buckets)).astype(np.int64)

    def pack(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Pairs of the dictionary as rows of key_bytes bytes."""
        return (state * max(1, self.start) + word).view(np.uint8).reshape(-1, 8)[:, : self.key_bytes]

    def unpack(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        key = np.zeros((len(raw) // self.key_bytes, 8), np.uint8)
        key[:, : self.key_bytes] = np.frombuffer(raw, np.uint8).reshape(-1, self.key_bytes)
        return np.divmod(key.view(np.int64).ravel(), max(1, self.start))

    def states(self, state: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States seen in training, the distinct words behind each and, of those outside the dictionary, how often each was one.

        From distinct pairs, of which all of a state that is not hot are here, with the number of times training saw them. States are places in
        the dictionary or, outside, negative, and so come first.
        """
        states, kinds = np.unique(state[times > 0], return_counts=True)
        far = (state < 0) & (times > 0)
        rare = int(np.searchsorted(states, 0))
        return states, kinds, np.bincount(np.searchsorted(states[:rare], state[far]), times[far], rare)

    def arcs(self, state: np.ndarray, times: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(c_uv - D) / c_u, not below 0, and b_u for some of the distinct pairs from which `known` is."""
        states, kinds, rare = known
        at = _finder(states)(state)
        inside = state >= 0
        hot = np.where(inside, self.hot_kinds[np.where(inside, state, 0)], -1)
        own_kinds = np.where(hot >= 0, hot, np.append(kinds, 0)[at])
        history = np.where(inside, self.counts[np.where(inside, state, 0)], np.append(rare, 0)[np.where(inside | (at < 0), len(rare), at)]).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(history > 0, np.maximum(times - DISCOUNT, 0.0) / history, 0.0)
            b = np.where(history > 0, DISCOUNT * own_kinds / history, 1.0)
        return a, b


_STEPS = "bucket int, sheet long, docs binary, keys binary, far_docs binary, far_states binary, far_words binary, doc_id array<long>, n_tokens binary, n_known binary, base binary"


_PACKED = pa.schema([("bucket", pa.int32()), ("sheet", pa.int64()), *((c, pa.binary()) for c in ("docs", "keys", "far_docs", "far_states", "far_words")), ("doc_id", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("n_tokens", "n_known", "base"))])


def _arcs_packed(m: Automaton, bucket: np.ndarray, sheet: np.ndarray | int, doc: np.ndarray, state: np.ndarray, word: np.ndarray) -> pa.RecordBatch:
    """Arcs as a row for each bucket and sheet."""
    near = (state >= 0) & (word >= 0)
    # One number for each pair of bucket and sheet.
    sheets, which = np.unique(sheet, return_inverse=True) if isinstance(sheet, np.ndarray) else (np.asarray([sheet]), 0)
    place = bucket * len(sheets) + which
    rows = np.unique(place)

    def dealt(mine: np.ndarray, *values: np.ndarray) -> list[list[bytes]]:
        own = place[mine]
        order = np.argsort(own, kind="stable")
        first = np.searchsorted(own[order], rows)
        edges = np.append(first, len(order))
        out = []
        for v in values:
            raw, width = np.ascontiguousarray(v[order]).tobytes(), v.itemsize * (v.shape[1] if v.ndim > 1 else 1)
            out.append([raw[width * i : width * j] for i, j in zip(edges[:-1], edges[1:])])
        return out

    columns = [*dealt(near, doc[near], m.pack(state[near], word[near])), *dealt(~near, doc[~near], state[~near], word[~near])]
    none = [None] * len(rows)
    values = [(rows // len(sheets)).tolist(), sheets[rows % len(sheets)].tolist(), *columns, none, none, none, none]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(values, _PACKED)], schema=_PACKED)


def _arcs_of(m: Automaton, packed: dict[str, list]) -> tuple[np.ndarray, ...]:
    """(row, doc, state, word) of all arcs of some packed rows, given as lists by column."""

    def joined(name: str, kind) -> tuple[np.ndarray, np.ndarray]:
        values = [np.frombuffer(raw or b"", kind) for raw in packed[name]]
        return np.concatenate([np.zeros(0, kind), *values]), np.repeat(np.arange(len(values)), [len(v) for v in values])

    doc, row = joined("docs", np.uint16)
    far_doc, far_row = joined("far_docs", np.uint16)
    state, word = m.unpack(b"".join(x or b"" for x in packed["keys"]))
    return np.concatenate([row, far_row]), np.concatenate([doc, far_doc]), np.concatenate([state, joined("far_states", np.int64)[0]]), np.concatenate([word, joined("far_words", np.int64)[0]])


def steps(docs: DataFrame, model: Automaton, buckets: int, tasks: int) -> DataFrame:
    """The traversal of docs (doc_id, text, train): each step's arc, packed by the task that owns it, and what is known of each text.

    Texts are numbered within sheets of at most 32,768; in `docs` a number's lowest bit says whether the text trains.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m = shared.value
        words, number = WordHashes(_finder(m.hashes)), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in stretches(batch, 4 << 20):
                s = Sheet(words, texts, m.end, m.start)
                train = part.column("train").to_numpy(zero_copy_only=False)
                doc = (2 * s.doc + train[s.doc]).astype(np.uint16)
                known = s.tag >= 0
                base = np.bincount(s.doc, np.where(known, m.log_p1[np.where(known, s.tag, 0)] if m.start else 0.0, 0.0), len(texts))
                mine = [int(number % tasks)], [number], [None], [None], [None], [None], [None], [part.column("doc_id").to_pylist()], [s.sizes.tobytes()], [np.bincount(s.doc, known, len(texts)).astype(np.int64).tobytes()], [base.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(mine, _PACKED)], schema=_PACKED)
                state = np.where(s.state_tag >= 0, s.state_tag, (s.state_hash | _TOP_BIT).view(np.int64))
                word = np.where(known, s.tag, (s.hash | _TOP_BIT).view(np.int64))
                del s, known
                yield _arcs_packed(m, m.home(state, word, buckets) % tasks, number, doc, state, word)
                number += 1

    return in_arrow(docs.select("doc_id", "text", "train"), run, _STEPS)


def turns(dealt: DataFrame, model: Automaton, buckets: int, tasks: int) -> DataFrame:
    """What a task owns, dealt to the buckets it meets in turn and sorted by them; what is known of texts comes first (bucket -1)."""
    shared = dealt.sparkSession.sparkContext.broadcast(model)
    names = ("docs", "keys", "far_docs", "far_states", "far_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        held, sheets, size = {c: [] for c in names}, [], 0

        def flush() -> pa.RecordBatch:
            row, doc, state, word = _arcs_of(m, held)
            return _arcs_packed(m, m.home(state, word, buckets) // tasks, np.asarray(sheets, np.int64)[row], doc, state, word)

        for batch in batches:
            texts = batch.filter(batch.column("doc_id").is_valid())
            if texts.num_rows:
                yield texts.set_column(0, _PACKED.field(0), pa.array([-1] * texts.num_rows, pa.int32()))
            arcs = batch.filter(batch.column("doc_id").is_null())
            for k in range(arcs.num_rows):
                sheets.append(arcs.column("sheet")[k].as_py())
                for c in names:
                    held[c].append(arcs.column(c)[k].as_py())
                size += len(held["docs"][-1] or b"") // 2 + len(held["far_docs"][-1] or b"") // 2
                if size > _TURNED:
                    yield flush()
                    held, sheets, size = {c: [] for c in names}, [], 0
        if size:
            yield flush()

    return in_arrow(dealt, run, _STEPS).sortWithinPartitions("bucket")


_RESOLVED = "sheet long, docs binary, sums binary, doc_id array<long>, n_tokens binary, n_known binary, base binary, doc int, word long, a double, b double"


_WEIGHED = pa.schema([("sheet", pa.int64()), ("docs", pa.binary()), ("sums", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("n_tokens", pa.binary()), ("n_known", pa.binary()), ("base", pa.binary()), ("doc", pa.int32()), ("word", pa.int64()), ("a", pa.float64()), ("b", pa.float64())])
#: Pairs, or steps, that are worked on together.
_SOME = 1 << 17


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _WEIGHED], schema=_WEIGHED)


def _weighed(m: Automaton, held: dict[str, list], sheets: list[int]) -> Iterator[pa.RecordBatch]:
    """All arcs of one bucket, whose packed rows are given as lists by column. The lists are emptied.

    A bucket is most of what a task holds, so nothing is kept for each step but its pair, its text and then its weight.
    """
    if not any(held["docs"]) and not any(held["far_docs"]):
        return
    names, own = np.unique(np.asarray(sheets, np.int64), return_inverse=True)
    own = own.astype(np.uint32 if len(names) <= 1 << 16 else np.int64) << 16

    def placed(docs: list[bytes | None]) -> np.ndarray:
        """Sheet and number of each step's text; the lowest bit says whether it trains."""
        out = np.repeat(own, [len(v or b"") // 2 for v in docs])
        out |= _joined(docs, np.uint16)
        return out

    wide = max(1, m.start)
    place, far_place = placed(held["docs"]), placed(held["far_docs"])
    # Pairs of the dictionary are one number; few others are.
    key = _joined(held["keys"], np.int64, m.key_bytes)
    order = np.argsort(key)
    key = key[order]
    first = _runs(key)
    state, word = np.divmod(key[first], wide)
    del key
    far_state, far_word = _joined(held["far_states"], np.int64), _joined(held["far_words"], np.int64)
    far_order = np.lexsort((far_word, far_state))
    far_state, far_word = far_state[far_order], far_word[far_order]
    far_first = _runs(far_state, far_word)
    near = len(first)
    state, word = np.concatenate([state, far_state[far_first]]), np.concatenate([word, far_word[far_first]])
    del far_state, far_word
    times = np.concatenate([np.add.reduceat((p & 1).astype(np.uint8)[o], f, dtype=np.int64) if len(f) else np.zeros(0, np.int64) for p, o, f in ((place, order, first), (far_place, far_order, far_first))])
    known = m.states(state, times)
    weight, a, b = np.zeros(len(state)), np.zeros(len(far_first)), np.zeros(len(far_first))
    for i in range(0, len(state), _SOME):
        some = slice(i, i + _SOME)
        x, y = m.arcs(state[some], times[some], known)
        inside = word[some] >= 0
        p1 = 10 ** m.log_p1[np.where(inside, word[some], 0)] if m.start else np.zeros(len(x))
        weight[some] = np.log10(np.where(inside, x + y * p1, 1.0))
        from_far = max(0, near - i)
        a[max(0, i - near) :][: max(0, len(x) - from_far)], b[max(0, i - near) :][: max(0, len(x) - from_far)] = x[from_far:], y[from_far:]
    word = word[near:]
    del state, times, known

    def of_steps(values: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each step its pair's value."""
        out = np.empty(len(at), values.dtype)
        out[at] = np.repeat(values, np.diff(np.append(first, len(at))))
        return out

    weight, far_weight = of_steps(weight[:near], order, first), of_steps(weight[near:], far_order, far_first)
    del order, first
    place >>= 1
    far_place >>= 1
    # Back by text, sheet by sheet.
    texts = np.unique(np.concatenate([place[_runs(place)], far_place[_runs(far_place)]]))
    sums = np.zeros(len(texts))
    for p, w in ((place, weight), (far_place, far_weight)):
        for i in range(0, len(p), _SOME):
            at = np.searchsorted(texts, p[i : i + _SOME])
            low, high = int(at.min()), int(at.max()) + 1
            sums[low:high] += np.bincount(at - low, w[i : i + _SOME], high - low)
    del place, weight
    at, number, sums = texts >> 15, (texts & 0x7FFF).astype(np.uint16), sums.astype(np.float32)
    edges = np.append(_runs(at), len(at))
    back = [(int(names[at[i]]), number[i:j].tobytes(), sums[i:j].tobytes()) for i, j in zip(edges[:-1], edges[1:])]
    yield _rows(len(back), sheet=pa.array([x[0] for x in back]), docs=pa.array([x[1] for x in back]), sums=pa.array([x[2] for x in back]))
    pair = of_steps(np.arange(len(word)), far_order, far_first)
    out = np.flatnonzero(word[pair] < 0)
    for k in range(0, len(out), 100_000):
        i = out[k : k + 100_000]
        p = pair[i]
        yield _rows(len(i), sheet=pa.array(names[far_place[i] >> 15]), doc=pa.array((far_place[i] & 0x7FFF).astype(np.int32)), word=pa.array(word[p]), a=pa.array(a[p]), b=pa.array(b[p]))


def resolved(packed: DataFrame, model: Automaton, buckets: int, tasks: int) -> DataFrame:
    """Steps with their weights, summed by text (docs, sums); steps to words outside the dictionary as rows (doc, word, a, b)."""
    shared = packed.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, now = shared.value, None
        names = ("docs", "keys", "far_docs", "far_states", "far_words")
        held, sheets = {c: [] for c in names}, []
        for batch in batches:
            texts = batch.filter(batch.column("doc_id").is_valid())
            if texts.num_rows:
                yield _rows(texts.num_rows, **{c: texts.column(c) for c in ("sheet", "doc_id", "n_tokens", "n_known", "base")})
            arcs = batch.filter(batch.column("doc_id").is_null())
            bucket = arcs.column("bucket").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else []
            for i, j in zip(cuts[:-1], cuts[1:]):
                if bucket[i] != now:
                    yield from _weighed(m, held, sheets)
                    held, sheets, now = {c: [] for c in names}, [], bucket[i]
                some = arcs.slice(i, j - i)
                sheets += some.column("sheet").to_pylist()
                for c in names:
                    held[c] += some.column(c).to_pylist()
        yield from _weighed(m, held, sheets)

    dealt = packed.repartitionById(tasks, "bucket")
    return in_arrow(turns(dealt, model, buckets, tasks) if buckets > tasks else dealt, run, _RESOLVED)


def assembled(parts: DataFrame, late: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every text from the sums of all tasks; `late` has (sheet, doc, known, more_base, more)."""
    names = ("sheet", "docs", "sums", "doc_id", "n_tokens", "n_known", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["sheet"], []).append(row)
        for rows in held.values():
            own = next(r for r in rows if r["doc_id"] is not None)
            n, known, base = (np.frombuffer(own[c], k).copy() for c, k in (("n_tokens", np.int64), ("n_known", np.int64), ("base", np.float64)))
            score = np.zeros(len(n))
            for r in rows:
                if r["sums"] is not None:
                    score[np.frombuffer(r["docs"], np.uint16)] += np.frombuffer(r["sums"], np.float32)
                elif r["doc"] is not None:
                    known[r["doc"]] += r["known"]
                    base[r["doc"]] += r["more_base"]
                    score[r["doc"]] += r["more"]
            yield pa.RecordBatch.from_arrays([pa.array(own["doc_id"], pa.int64()), pa.array(n), pa.array(known), pa.array(base), pa.array(score)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    every = parts.where("word IS NULL").select(*names).unionByName(late, allowMissingColumns=True)
    return in_arrow(every.repartition("sheet"), run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def train(texts: DataFrame) -> tuple[Automaton, DataFrame]:
    """What every worker knows, and the counts (h, c) of all words."""
    hot = hot_words(texts)
    every = table(counted(texts, hot), "lm-counts")
    counts = every.where("u IS NULL").select("h", "c")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known = counts.where(F.col("c") >= _least_count(counts, DICTIONARY)).toArrow()  # at most DICTIONARY rows
    kinds = {r["u"]: r["kinds"] for r in every.where("u IS NOT NULL").collect()}  # at most HOT + 1 rows
    starts = counts.where(F.col("h") == int(_END.astype(np.int64))).first()
    by_hash = {int(h): kinds[k] for k, h in enumerate(hot.view(np.int64)) if k in kinds}
    model = Automaton(known["h"].to_numpy(), known["c"].to_numpy(), total, distinct, starts["c"] if starts else 0, by_hash, kinds.get(len(hot), 0))
    return model, counts


def score(docs: DataFrame, apart: Column | None = None) -> tuple[DataFrame, Automaton]:
    """(doc_id, n_tokens, n_known, base_score, score) for every row of docs (doc_id, text); rows for which `apart` holds teach nothing."""
    apart = F.lit(False) if apart is None else apart
    marked = docs.select("doc_id", "text", (~apart).alias("train"))
    model, counts = train(marked.where("train"))
    tokens = model.total + model.total // 4
    cores = docs.sparkSession.sparkContext.defaultParallelism
    buckets = max(1, -(-tokens // BUCKET), min(cores, tokens // (BUCKET // 8)))
    tasks = min(buckets, TASKS)
    parts = table(resolved(steps(marked, model, buckets, tasks), model, buckets, tasks), "lm-parts", scan=True)
    norm = float(model.total + model.distinct + 1)
    # Words outside the dictionary are rare, so no key of this join is hot. What training never saw counts 0.
    rare = counts.select(_unsigned("h").alias("word"), "c")
    if len(model.hashes):
        rare = rare.where(F.col("c") <= int(model.counts[:-1].min()))
    waiting = parts.where("word IS NOT NULL").select("sheet", "doc", "word", "a", "b").join(rare, "word", "left")
    p1 = (F.coalesce("c", F.lit(0)) + 1) / F.lit(norm)
    late = waiting.groupBy("sheet", "doc").agg(F.count("c").alias("known"), F.sum(F.log10(p1)).alias("more_base"), F.sum(F.log10(F.col("a") + F.col("b") * p1)).alias("more"))
    return assembled(parts, late), model


def held_out(modulus: int, rest: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus == rest


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    apart = F.coalesce(held_out(7, 2), F.lit(False))
    df, model = score(docs, apart)
    per_token = F.col("score") / F.col("n_tokens")
    return df.select("doc_id", apart.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", per_token.alias("mean_score"))
