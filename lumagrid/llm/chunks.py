"""Token ids of texts by way of their distinct space-separated chunks.

The pre-tokenising pattern of the byte-level vocabularies always starts a new match at a space that
follows a non-space, and at the last space of a run before a non-space. Cutting at each space is
therefore safe unless a space stands inside a run of white space or at its end before the text's end;
such texts are cut by the pattern itself. Equal chunks have equal ids, so distinct chunks are encoded once
and known in two generations of tables, bounded in number and in bytes: a full one becomes the old one, from
which what is met again moves on; the rest is forgotten. Where a single block of words overfills a table, both
generations are forgotten, so no long chunk outlives the text that it is from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Unicode White_Space.
WHITE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: What makes a text unsafe to cut at spaces, with the two commonest cases first.
_RARE_WHITE = regex.compile("[\\x0B\\x0C\\x1C-\\x1F\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]")
#: Known chunks of a generation at most, and their bytes at most (a chunk costs some 150 bytes besides its own).
CHUNKS = 300_000
CHUNK_BYTES = 16_000_000
#: Words that are turned into ids at once.
BLOCK = 100_000
#: Characters of texts that are cut together.
SLICE = 4_000_000


def gather(blob: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices blob[starts[i] : starts[i] + lengths[i]] joined."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(total, dtype=at.dtype)
    return blob[at]


def _risky(text: str) -> bool:
    if "  " in text or "\n " in text or "\t" in text or "\r" in text:
        return True
    if text.isascii():
        return any(c in text for c in "\x0b\x0c\x1c\x1d\x1e\x1f")
    return _RARE_WHITE.search(text) is not None


class _Codes(dict):
    """Chunk -> code; an unknown chunk gets the next code and is put down for encoding or moving."""

    def __init__(self, owner: ChunkEncoder, before: str, old: dict[str, int]):
        super().__init__()
        self.owner, self.before, self.old = owner, before, old

    def __missing__(self, word: str) -> int:
        owner = self.owner
        code = self[word] = owner.n
        owner.n += 1
        owner.bytes += len(word)
        known = self.old.get(word)
        if known is None:
            owner.new.append(self.before + word)
            owner.new_codes.append(code)
        else:
            owner.moved.append(known)
            owner.moved_codes.append(code)
        return code


class _Table:
    """Ids of coded chunks: ids[start[code] : start[code] + length[code]]."""

    def __init__(self):
        self.size = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def put(self, codes: list[int], ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.size + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while codes[-1] >= len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.ids[self.size : self.size + len(ids)] = ids
        at = np.array(codes)
        self.start[at] = self.size + np.cumsum(lengths) - lengths
        self.length[at] = lengths
        self.size += len(ids)

    def get(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.length[codes]
        return gather(self.ids, self.start[codes], lengths), lengths


class ChunkEncoder:
    """encode_many: list of strings -> all their ids joined, and each one's number of ids;
    find: text -> matches of the pattern."""

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], find: Callable[[str], list[str]]):
        self.encode_many, self.find = encode_many, find
        self.clear()

    def clear(self) -> None:
        self.table = _Table()
        self.spaced, self.plain = {}, {}
        self._turn()

    def _full(self) -> None:
        """A full generation becomes the old one, or goes if it is too large for that."""
        if self.n > CHUNKS or self.bytes > CHUNK_BYTES:
            if self.n > 2 * CHUNKS or self.bytes > 2 * CHUNK_BYTES:
                self.clear()
            else:
                self._turn()

    def _turn(self) -> None:
        """What is known becomes the old generation."""
        self.old, self.table = self.table, _Table()
        old = self.spaced, self.plain
        for x in old:
            if isinstance(x, _Codes):
                x.old = {}
        self.spaced, self.plain = _Codes(self, " ", old[0]), _Codes(self, "", old[1])
        self.new, self.new_codes, self.moved, self.moved_codes = [], [], [], []
        self.n = self.bytes = 0

    def _learn(self) -> None:
        if self.moved:
            self.table.put(self.moved_codes, *self.old.get(np.array(self.moved)))
        if self.new:
            self.table.put(self.new_codes, *self.encode_many(self.new))
        self.new, self.new_codes, self.moved, self.moved_codes = [], [], [], []

    def _codes(self, names: _Codes, words: list[str]) -> np.ndarray:
        return np.fromiter(map(names.__getitem__, words), np.int64, len(words))

    def blocks(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text, in consecutive blocks (uint32)."""
        if not text:
            return
        risky = _risky(text)
        words = self.find(text) if risky else text.split(" ")
        at = 0
        while at < len(words):
            self._full()
            block = words[at : at + BLOCK]
            if risky:
                codes = self._codes(self.plain, block)
            else:
                codes = self._codes(self.spaced, block[at == 0 :])
                if at == 0:
                    codes = np.concatenate([self._codes(self.plain, block[:1]), codes])
            at += BLOCK
            self._learn()
            yield self.table.get(codes)[0]

    def encode(self, text: str) -> np.ndarray:
        parts = list(self.blocks(text))
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint32), *parts])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Many short texts at once: one lookup for all their words."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        group: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) > SLICE or _risky(text):
                out[i] = self.encode(text)
                continue
            group.append(i)
            size += len(text)
            if size > SLICE:
                self._group(texts, group, out)
                group, size = [], 0
        if group:
            self._group(texts, group, out)
        return out

    def _group(self, texts: list[str], group: list[int], out: list[np.ndarray]) -> None:
        """Arrow cuts at spaces and numbers the distinct words; only those are looked up one by one."""
        self._full()
        split = pc.split_pattern(pa.array([texts[i] for i in group], pa.large_string()), " ")
        words = split.values.dictionary_encode()
        first = split.offsets.to_numpy()
        codes = self._codes(self.spaced, words.dictionary.to_pylist())[words.indices.to_numpy()]
        codes[first[:-1]] = self._codes(self.plain, split.values.take(pa.array(first[:-1])).to_pylist())
        self._learn()
        ids, lengths = self.table.get(codes)
        ends = np.cumsum(np.add.reduceat(lengths, first[:-1])).tolist()
        lo = 0
        for i, hi in zip(group, ends, strict=True):
            out[i] = ids[lo:hi]
            lo = hi
