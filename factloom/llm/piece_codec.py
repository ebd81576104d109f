"""SentencePiece encoding and decoding with offsets into the original bytes.

The text is normalised as the model's own normaliser does it: at each place the longest prefix that the compiled
character map knows is replaced, everything else is copied, and for each normalised byte the original byte it came from
is recorded. The map (a double-array trie and a pool of replacements) is read from the model file; segmentation runs on a copy
of the model without it, so that nothing is normalised twice. Spaces become the
space symbol, and the dummy prefix takes no original byte. No piece of the vocabulary holds a space symbol behind another
character, so merges never cross the places where a run of space symbols begins: the normalised text is cut there, the
library segments every distinct unit once, and the pieces' lengths give spans in the normalised text, which the alignment
projects to spans of the original. If a model had such pieces, the whole text would be the unit.

The model of the query has an empty map, so there normalisation is the identity; tests run the same code with a full map.

Null text is empty and has no pieces. Texts of any length are encoded whole; repeated rows stay. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import in_arrow, stretches
from factloom.llm.tokens import CACHE_UNITS, CACHED_LENGTH, tokenizer_path

SPACE = "▁"

#: Code points encoded together.
TOGETHER = 1 << 20


class CharMap:
    """The compiled character map: longest-prefix replacement with source alignment."""

    def __init__(self, blob: bytes):
        self.units = np.zeros(0, "<u4")
        self.pool = b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + size], "<u4")
            self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest known prefix of data[at:]: its length and its replacement."""
        units, found, node = self.units, None, 0
        if not len(units):
            return None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node ^= offset(int(units[0]))
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = int(units[node])
            if unit & ((1 << 31) | 255) != data[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                start = int(units[node]) & ((1 << 31) - 1)
                found = i + 1 - at, self.pool[start : self.pool.index(b"\0", start)]
        return found

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text and, for each of its bytes and one more, the original byte; None where that is the identity."""
        if not len(self.units):
            return text, None
        data, out, source, at = text.encode(), bytearray(), [], 0
        while at < len(data):
            hit = self.longest(data, at)
            if hit is None:
                n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                new, hit = data[at : at + n], (n, b"")
            else:
                new = hit[1]
            out += new
            source += [at] * len(new)
            at += hit[0]
        source.append(len(data))
        return out.decode("utf-8", "replace"), np.asarray(source, np.int64)


class PieceCodec:
    """Encoder and decoder of one model file. The model needs byte fallback, so that no piece is unknown."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as schema

        spec = schema.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        if not spec.trainer_spec.byte_fallback:
            raise ValueError(f"{path}: a model with byte fallback is needed")
        n = spec.normalizer_spec
        if not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError(f"{path}: a model with a dummy prefix that keeps white space is needed")
        self.map = CharMap(n.precompiled_charsmap)
        n.precompiled_charsmap = b""  # what follows sees normalised text
        self.model = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        plain = [p.piece for p in spec.pieces if p.type in (1, 4)]
        #: Whether merges can never cross the place where a run of space symbols begins.
        self.cut = not any(SPACE in p.lstrip(SPACE) for p in plain)
        self.byte = np.asarray([p.type == 6 for p in spec.pieces])
        self.chars = np.asarray([1 if p.type == 6 else len(p.piece) for p in spec.pieces], np.int32)
        #: Bytes of a piece where a space symbol stands for one byte.
        self.width = np.asarray([1 if p.type == 6 else len(p.piece.replace(SPACE, " ").encode()) for p in spec.pieces], np.int32)
        self.lone = [self.model.piece_to_id(SPACE)]
        #: By what follows a unit's first space symbol: its ids as comma-joined decimals.
        self.units: dict[str, str] = {"": self._listed(self.lone)}
        self.runs = re.compile(" +[^ ]*")

    @staticmethod
    def _listed(ids: list[int]) -> str:
        return ",".join(map(str, ids))

    def encode(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """For each text (ids as comma-joined decimals, ids, ends): piece k covers original bytes ends[k-1] to ends[k].

        Texts are worked on some TOGETHER code points at a time, which bounds the memory for whatever batch comes.
        """
        some, size = [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size >= TOGETHER:
                yield from self._some(some)
                some, size = [], 0
        yield from self._some(some)

    def _some(self, texts: list[str]) -> list[tuple[str, np.ndarray, np.ndarray]]:
        normal = [self.map.normalise(t) for t in texts]
        # Behind each space symbol a unit begins; the text's own first unit begins with the dummy prefix.
        keys = [None if SPACE in n or not self.cut else [run[1:] for run in self.runs.findall(" " + n)] if "  " in n or n[-1:] == " " or n[:1] == " " else n.split(" ") for n, _ in normal]
        units, get = self.units, self.units.get
        if len(units) > CACHE_UNITS:
            units.clear()
            units[""] = self._listed(self.lone)
        got = [None if k is None else list(map(get, k)) for k in keys]
        new = {x for k, g in zip(keys, got) if g and None in g for x, y in zip(k, g) if y is None}
        joined = [k for k in new if k[-1:] != " "]
        extra = {k: self._listed(self.model.encode(k)) for k in new if k[-1:] == " "}
        if joined:
            ids = self.model.encode(" ".join(joined))
            at = np.searchsorted(np.cumsum(self.width[ids], dtype=np.int64), np.cumsum([len(k.encode()) + 1 for k in joined])) + 1
            decimals, cuts = list(map(str, ids)), at.tolist()
            extra.update(zip(joined, [",".join(decimals[a:b]) for a, b in zip([0, *cuts], cuts)]))
        units.update((k, u) for k, u in extra.items() if len(k) <= CACHED_LENGTH)
        out = []
        for (norm, source), own, g in zip(normal, keys, got):
            if not norm:
                out.append(("", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            if own is None:
                listed = self._listed(self.model.encode(norm))
            elif None in g:
                listed = ",".join([y or extra[x] for x, y in zip(own, g)])
            else:
                listed = ",".join(g)
            ids = np.fromstring(listed, np.int64, sep=",")
            # the dummy prefix has no byte
            ends = self._walk(norm, ids) if own is None else np.cumsum(self.width[ids], dtype=np.int64) - 1
            out.append((listed, ids, ends if source is None else source[ends]))
        return out

    def _walk(self, norm: str, ids: np.ndarray) -> np.ndarray:
        """Ends in bytes of `norm` where it holds space symbols of its own."""
        at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in norm])])
        ends, byte = np.zeros(len(ids), np.int64), 0
        for k, i in enumerate(ids.tolist()):
            if self.byte[i]:
                byte += 1
            else:
                n = int(self.chars[i]) - (k == 0)
                byte = int(at[int(np.searchsorted(at, byte)) + n])
            ends[k] = byte
        return ends

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist())


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec a worker process."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, begins, ends, decoded): pieces with the original byte span of each."""
    path = model or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part, texts in stretches(batch):
                rows = [(ids, np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends, ends, c.decode(ids)) for _, ids, ends in c.encode(texts)]
                lists = pa.list_(pa.int64())
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), (lists, lists, lists, pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "ids", "begins", "ends", "decoded"])

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<long>, begins array<long>, ends array<long>, decoded string")


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ends): the same work, ids and text digested where they are made."""
    path = model or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part, texts in stretches(batch):
                rows = [(len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest(), ends) for listed, ids, ends in c.encode(texts)]
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ends"])

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ends array<long>")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
