"""Tokenisers of public vocabularies, one of each a worker process."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

#: Units a cache holds before it starts anew; bounds a worker's memory (some 60 MB for usual units).
CACHE_UNITS = 300_000

#: Units longer than this are not kept, so that odd texts cannot fill the memory.
CACHED_LENGTH = 48


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """Ids of the byte-level BPE in `path` as the tokenizers library gives them, as little-endian uint32 bytes.

    The same vocabulary as ranks gives the same ids several times faster and in a third of the memory. Strings of added
    tokens are cut out first, as that library does; it is loaded itself only where an added token has flags that change its
    surroundings.
    """

    def __init__(self, path: str, ranks: str | None = None):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        self.added = {t["content"]: t["id"] for t in added}
        plain = not any(t[flag] for t in added for flag in ("lstrip", "rstrip", "single_word"))
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added and plain else None
        self.path, self.whole = path, None
        with open(ranks or path.replace(".json", ".tiktoken"), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def _ids(self, text: str) -> list[int]:
        if not any(a in text for a in self.added):
            return self.ranks.encode_ordinary(text)
        if self.cuts:
            return [i for part in self.cuts.split(text) if part for i in ([self.added[part]] if part in self.added else self.ranks.encode_ordinary(part))]
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        for text in texts:
            yield array("I", self._ids(text)).tobytes()


_ENCODERS: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One encoder a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path)
    return _ENCODERS[path]
