"""Hashed word shingles of whole texts, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Characters of text that are cut into words together.
SLICE = 4_000_000
_K = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (A-Z lower-cased, cut at ASCII white space), and each
    text's first word (with an end mark). Every distinct word of the batch is hashed once."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    words = split.values.dictionary_encode()
    names = words.dictionary.to_pylist()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    real = np.array([bool(x) for x in names], bool)
    codes = words.indices.to_numpy()
    keep = real[codes] if len(names) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    return table[codes[keep]], before[split.offsets.to_numpy()]


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) of about SLICE characters; a null counts as empty."""
    lo, size, part = 0, 0, []
    for i, t in enumerate(texts):
        part.append(t or "")
        size += len(part[-1])
        if size >= SLICE:
            yield lo, part
            lo, size, part = i + 1, 0, []
    if part:
        yield lo, part


def shingle_sets(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct hashes of k consecutive words; with fewer words, one of all of them;
    without words none."""
    words, first = word_hashes(texts)
    n = len(words) - k + 1
    if n > 0:
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h += _mix(words[j : j + n] + np.uint64(int(_K[j % 5]) * (j + 1) % 2**64)) * _K[(j + 2) % 5]
        h = _mix(h)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= k:
            yield np.unique(h[lo : hi - k + 1])
        elif hi > lo:
            yield np.array([xxhash.xxh3_64_intdigest(words[lo:hi].tobytes(), seed=k)], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
