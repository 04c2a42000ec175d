"""Substring dedup by hashing units of lines.

A text's unit is a line, cut further at sentence ends, because a repeated passage need not start or end
with a line. As it need not start or end with a sentence either, sentences of over LONG words are cut further
after words whose hash is the smallest among NEAR words on both sides: the same words are cut at the same
places whatever is around them, NEAR words from the passage's ends on. Units are normalised (lower case by
character, white space as one space) and hashed to 128 bits (out of 64 bits a word); digests are grouped over all documents and the earliest occurrence (by document id, then place) is the one to keep.
Consecutive units whose earliest occurrence is elsewhere form a run, whichever documents have them; a run is
cut out if it has at least MIN_WORDS words, so that short sentences and single notices, which repeat by chance
or by custom, stay. The spans that were cut are given as character
offsets of the original text.

A removed unit's earliest occurrence always stays, so no passage vanishes from the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging
from .joins import join_hot
from .shingles import _mix
from .worker import claim

#: A run of repeated units is removed from this many words on.
MIN_WORDS = 20
#: A passage of 50 words whose ends lie in sentences of at most LONG words has MIN_WORDS words in whole sentences.
LONG = 16
NEAR = 4
#: Characters that are cut into words at once; longer texts are cut where a word begins.
SLICE = 2_000_000
_KEY = ["__doc", "__text_hash"]
_WORD_START = re.compile(r"\s\S")
_P = 0x9E3779B97F4A7C15
_A, _B = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: Code points from here on have no lower case and are no white space.
_TOP = 0x20000
_SPACE, _FEED, _STOP = 1, 2, 4


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(a number for each lower-cased code point, its class)."""
    low = np.arange(_TOP + 1, dtype=np.uint64)
    kind = np.zeros(_TOP + 1, np.uint8)
    for i in range(_TOP):
        c = chr(i)
        if len(c.lower()) == 1:
            low[i] = ord(c.lower())
        if c.isspace():
            kind[i] = _SPACE
    kind[10] = _SPACE | _FEED
    kind[[ord(c) for c in ".!?"]] = _STOP
    return _mix(low + np.uint64(_P)), kind


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse modulo 2 ** 64."""
    out = []
    for base in (_P, pow(_P, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _scan(text: str) -> tuple[np.ndarray, ...]:
    """(start, end, hash, whether a sentence or line ends after it) of each word; the last one's gap is that of the text's end."""
    values, kinds = _tables()
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(c, _TOP)
    kind = kinds[small]
    space = (kind & _SPACE).astype(np.int8)
    turn = np.flatnonzero(np.diff(space, prepend=np.int8(1), append=np.int8(1)))
    start, end = turn[::2], turn[1::2]
    value = values[small]
    if len(c) and int(c.max()) >= _TOP:
        far = np.flatnonzero(c >= _TOP)
        value[far] = _mix(c[far].astype(np.uint64) + np.uint64(_P))
    power, inverse = _powers(1 << max(16, len(c).bit_length()))
    value *= power[: len(c)]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    h = _mix((total[end] - total[start]) * inverse[start])
    feeds = np.flatnonzero(kind & _FEED)
    after = np.append(start[1:], len(c))
    stops = (kind[end - 1] & _STOP > 0) | (np.searchsorted(feeds, end) < np.searchsorted(feeds, after))
    return start, end, h, stops


def _parts(text: str) -> Iterator[tuple[int, str]]:
    """A long text in parts that begin with a word."""
    lo = 0
    while len(text) - lo > SLICE:
        m = _WORD_START.search(text, lo + SLICE)
        if not m:
            break
        yield lo, text[lo : m.start() + 1]
        lo = m.start() + 1
    yield lo, text[lo:]


class Units:
    """The units of some texts, as arrays: owner (number of the text), start, end, following (start of the next unit,
    or the text's end), words, d1, d2, and place (number of the unit in its text)."""

    def __init__(self, texts: list[str]):
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        joined = "\n".join(texts)
        found = []
        for lo, part in _parts(joined):
            start, end, h, stops = _scan(part)
            found.append((start + lo, end + lo, h, stops))
        start, end, h, stops = (np.concatenate(x) for x in zip(*found, strict=True))
        owner = np.searchsorted(begins, start, "right") - 1
        n = len(start)
        if n:
            stops[-1] = True
        # Sentences, and their cuts.
        last = np.flatnonzero(stops)
        first = np.concatenate([[0], last[:-1] + 1]).astype(np.int64)
        length = last - first + 1
        place = np.arange(n) - np.repeat(first, length)
        size = np.repeat(length, length)
        inner = np.flatnonzero((size > LONG) & (place >= NEAR) & (place < size - NEAR))
        least = h[inner]
        ok = np.ones(len(inner), bool)
        for k in range(1, NEAR + 1):
            ok &= (least < h[inner - k]) & (least <= h[inner + k])
        stops[inner[ok]] = True
        last = np.flatnonzero(stops)
        first = np.concatenate([[0], last[:-1] + 1]).astype(np.int64)
        self.owner, self.words = owner[last], last - first + 1
        place = (np.arange(n) - np.repeat(first, self.words)).astype(np.uint64)
        if n:
            self.d1 = _mix(np.add.reduceat(_mix(h + place * _A), first) + _B)
            self.d2 = _mix(np.add.reduceat(_mix((h ^ _B) + place * _B), first) + _A)
        else:
            self.d1 = self.d2 = np.zeros(0, np.uint64)
        begin = begins[self.owner]
        self.start, self.end = start[first] - begin, end[last] - begin
        same = np.append(self.owner[1:] == self.owner[:-1], False) if n else np.zeros(0, bool)
        self.following = np.where(same, np.append(self.start[1:], 0)[: len(same)], sizes[self.owner] if n else 0)
        self.first = np.searchsorted(self.owner, np.arange(len(texts) + 1))
        self.place = np.arange(len(last)) - self.first[self.owner]
        # Units of one text with one digest: the number of the first of them.
        key = _mix(self.d1 ^ (self.owner.astype(np.uint64) * _A)) ^ self.d2
        order = np.argsort(key, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        self.earliest = np.empty(len(order), np.int64)
        self.earliest[order] = order[new][np.cumsum(new) - 1] if n else order

    def spans(self, i: int) -> list[tuple[int, int, int]]:
        own = slice(self.first[i], self.first[i + 1])
        return list(zip(self.start[own].tolist(), self.end[own].tolist(), self.following[own].tolist(), strict=True))


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) of about SLICE characters; a null counts as empty."""
    lo, size, part = 0, 0, []
    for i, t in enumerate(texts):
        part.append(t or "")
        size += len(part[-1]) + 1
        if size >= SLICE:
            yield lo, part
            lo, size, part = i + 1, 0, []
    if part:
        yield lo, part


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("substring")
    for b in batches:
        for lo, texts in _groups(b.column("__text").to_pylist()):
            u = Units(texts)
            at = np.flatnonzero(u.earliest == np.arange(len(u.earliest)))
            take = pa.array(lo + u.owner[at])
            yield pa.RecordBatch.from_arrays(
                [b.column("__doc").take(take), b.column("__text_hash").take(take), pa.array(u.place[at].astype(np.int32)), pa.array(u.d1[at].view(np.int64)), pa.array(u.d2[at].view(np.int64))], names=["__doc", "__text_hash", "__place", "__d1", "__d2"]
            )


def cut(texts: list[str], u: Units, elsewhere: np.ndarray, min_words: int) -> Iterator[tuple[str, list[tuple[int, int]], int]]:
    """Each text without its repeated runs, the spans cut out, and the number of units in them.

    elsewhere: for each unit that is the first of its digest in its text, whether another text has it earlier. A unit
    is repeated if that is so, or if it isn't the first of its digest in its text.
    """
    n = len(u.earliest)
    repeated = elsewhere[u.earliest] | (u.earliest != np.arange(n))
    begins = np.flatnonzero(repeated & ~((u.place > 0) & np.append(False, repeated[:-1]))) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(repeated & ~np.append((u.place[1:] > 0) & repeated[1:], False)) if n else begins
    words = np.concatenate([[0], np.cumsum(u.words)])
    long = words[ends + 1] - words[begins] >= min_words
    begins, ends = begins[long], ends[long]
    gone: dict[int, list[tuple[int, int, int]]] = {}
    for i, lo, hi, k in zip(u.owner[begins].tolist(), u.start[begins].tolist(), u.following[ends].tolist(), (ends - begins + 1).tolist(), strict=True):
        gone.setdefault(i, []).append((lo, hi, k))
    for i, text in enumerate(texts):
        runs = gone.get(i)
        if not runs:
            yield text, [], 0
            continue
        kept, at = [], 0
        for lo, hi, _ in runs:
            kept.append(text[at:lo])
            if "\n" in text[lo:hi] and hi < len(text) and kept[-1] and not kept[-1].endswith("\n"):
                kept.append("\n")
            at = hi
        kept.append(text[at:])
        yield "".join(kept), [(lo, hi) for lo, hi, _ in runs], sum(k for _, _, k in runs)


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with the text cleaned, and n_units, n_removed, removed_chars, removed_spans.

    removed_spans is an array of structs (start, stop) of character offsets in the original text. Null text
    stays null and has no units; a text that is repeated as a whole becomes empty. Documents with a null id
    rank last and among themselves by a hash of their text. Rows that share an id rank alike, so what only they have
    in common stays. Columns of docs
    that are called like a result column are replaced; an empty table gives no rows.
    """
    spark = docs.sparkSession
    store = Staging(spark, "substring")
    results = ["n_units", "n_removed", "removed_chars", "removed_spans"]
    docs = docs.drop(*results)
    keyed = docs.select(*docs.columns, F.col(id_col).alias("__doc"), F.xxhash64(F.col(text_col)).alias("__text_hash"))
    kind = dict(docs.dtypes)[id_col]
    unit_rows = keyed.select(*_KEY, F.col(text_col).alias("__text")).mapInArrow(_unit_rows, f"__doc {kind}, __text_hash long, __place int, __d1 long, __d2 long")
    # A document names each of its digests once; what it repeats itself is found again when it is cut.
    groups = store.put(unit_rows.groupBy("__d1", "__d2").agg(F.min("__doc").alias("__first"), F.min(F.when(F.col("__doc").isNull(), F.col("__text_hash"))).alias("__least"), F.count("*").alias("__n")).filter("__n > 1"))
    total = groups.agg(F.sum("__n")).first()[0] or 0
    met = join_hot(unit_rows, groups, ["__d1", "__d2"], F.col("__n"), total)
    elsewhere = met.filter(~F.col("__doc").eqNullSafe(F.col("__first")) | (F.col("__doc").isNull() & (F.col("__text_hash") != F.col("__least"))))
    places = elsewhere.groupBy(*_KEY).agg(F.collect_set("__place").alias("__places"))
    places = places.select(F.col("__doc").alias("__pd"), F.col("__text_hash").alias("__ph"), "__places")
    joined = keyed.join(places, keyed["__doc"].eqNullSafe(F.col("__pd")) & (keyed["__text_hash"] == F.col("__ph")), "left").drop("__pd", "__ph", "__doc", "__text_hash")
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substring")
        for whole in batches:
            for lo, texts in _groups(whole.column(text_col).to_pylist()):
                b = whole.slice(lo, len(texts))
                u = Units(texts)
                places = b.column("__places")
                sizes = pc.fill_null(pc.list_value_length(places), 0).to_numpy()
                elsewhere = np.zeros(len(u.place), bool)
                elsewhere[np.repeat(u.first[:-1], sizes) + places.flatten().to_numpy()] = True
                out = list(cut(texts, u, elsewhere, min_words))
                given = b.column(text_col).is_valid().to_pylist()
                columns = {c: b.column(c) for c in names}
                columns[text_col] = pa.array([x[0] if ok else None for x, ok in zip(out, given, strict=True)], pa.string())
                columns["n_units"] = pa.array(np.diff(u.first))
                columns["n_removed"] = pa.array([x[2] for x in out], pa.int64())
                columns["removed_chars"] = pa.array([sum(q - p for p, q in x[1]) for x in out], pa.int64())
                columns["removed_spans"] = pa.array([[{"start": p, "stop": q} for p, q in x[1]] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
                yield pa.RecordBatch.from_pydict(columns)

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return joined.mapInArrow(clean, f"{fields}, n_units long, n_removed long, removed_chars long, removed_spans array<struct<start: long, stop: long>>")
