"""Byte-level BPE encoding and decoding with numpy.

Each match of the pattern is a row of a matrix, padded within its bucket of similar lengths. In every
round each row merges its leftmost pair of minimum rank; ranks come from a hashed table of pairs, rows
are shifted together after a merge, and rows without a pair left leave the matrix.
In wide matrices (from WIDE columns on) a row merges all its pairs of that rank in one round, from left to right,
if none of the pairs that this makes has a lower rank: the one-by-one rounds would then take just these, in a row.
If one has, the row merges its leftmost pair alone, as always.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import WHITE, ChunkEncoder, gather
from .worker import cache, claim

#: Columns from which a row merges several pairs a round.
WIDE = 48
#: Rows of a matrix at most.
ROWS = 50_000
NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file of lines ``base64 rank`` (the vocabulary's size bounds the result)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> id of the joined bytes, by open addressing in two numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:i]] << 20 | ranks[t[i:]], r) for t, r in ranks.items() if len(t) > 1 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys = np.array([k for k, _ in pairs], np.int64)
        values = np.array([v for _, v in pairs], np.int32)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while left.size:  # each slot takes one of those that want it; the others go on to the next slot
            free = self.keys[slot[left]] == -1
            want = left[free]
            self.keys[slot[want]] = keys[want]
            won = want[self.keys[slot[want]] == keys[want]]
            self.values[slot[won]] = values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where there is no such pair or either id is negative."""
        keys = (left.astype(np.int64) << 20) | right
        keys[(left < 0) | (right < 0)] = -2
        shape, keys = keys.shape, keys.ravel()
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((seen != keys) & (seen != -1) & (keys >= 0))
        at = slot[open_]
        while open_.size:
            at = (at + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            go = ~hit & (seen != -1)
            open_, at = open_[go], at[go]
        return out.reshape(shape)


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.table = PairTable(ranks)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        fixed = pattern.replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]")
        self.find = regex.compile(fixed).findall
        top = max(ranks.values()) + 1
        parts = [b""] * top
        for t, r in ranks.items():
            parts[r] = t
        self.known = np.zeros(top, bool)
        self.known[list(ranks.values())] = True
        self.bytes_of = self._blob(parts)
        self.decimal_of = self._blob([b"%d " % i for i in range(top)])
        self.encoder = ChunkEncoder(self.encode_chunks, self.find)

    @staticmethod
    def _blob(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(p) for p in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(n) - n, n

    def _all_of_rank(self, tok: np.ndarray, rank: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tok, rank) after each row has merged its pairs of rank ``best``, or the leftmost of them alone."""
        n, width = tok.shape
        hit = rank == best[:, None]
        column = np.arange(width - 1)
        # Of neighbouring hits every other one is taken, from the left.
        start = np.maximum.accumulate(np.where(hit, -1, column), axis=1)
        take = hit & ((column - start) % 2 == 1)
        row, at = np.nonzero(take)
        new = best[row]
        before = np.where(at > 0, tok[row, at - 1], -1)
        joined = at > 1
        joined[joined] = take[row[joined], at[joined] - 2]
        before = np.where(joined, new, before)
        after = np.where(at + 2 < width, tok[row, np.minimum(at + 2, width - 1)], -1)
        lower = np.minimum(self.table.find(before, new), self.table.find(new, after)) <= new
        if lower.any():
            alone = np.zeros(n, bool)
            alone[row[lower]] = True
            first = hit.argmax(1)
            take[alone] = False
            take[alone, first[alone]] = True
            row, at = np.nonzero(take)
            new = best[row]
        tok[row, at] = new
        gone = tok < 0
        gone[row, at + 1] = True
        kept = ~gone
        place = np.cumsum(kept, axis=1) - 1
        most = int(place[:, -1].max()) + 1
        to, source = np.nonzero(kept)
        column = place[to, source]
        out = np.full((n, most), -1, np.int32)
        out[to, column] = tok[to, source]
        if most == 1:
            return out, np.zeros((n, 0), np.int32)
        ranks = np.full((n, most), NONE, np.int32)
        ranks[to, column] = np.concatenate([rank, np.full((n, 1), NONE, np.int32)], axis=1)[to, source]
        at = place[row, at]
        ranks[row, at] = NONE
        for k in (at - 1, at):  # only the pairs on both sides of a new id have changed
            ok = (k >= 0) & (k < most - 1)
            ranks[row[ok], k[ok]] = self.table.find(out[row[ok], k[ok]], out[row[ok], k[ok] + 1])
        return out, np.ascontiguousarray(ranks[:, :-1])

    def _matrix(self, rows: list[bytes], own: np.ndarray, ended: list) -> None:
        """All merges of rows of one bucket; appends (numbers of rows, their ids joined, counts)."""
        lengths = np.array([len(r) for r in rows])
        width = int(lengths.max())
        raw = np.frombuffer(b"".join(rows) if width == lengths.min() else b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
        tok = self.byte[raw]
        tok[np.arange(width) >= lengths[:, None]] = -1
        rank = self.table.find(tok[:, :-1], tok[:, 1:])
        while own.size:
            if tok.shape[1] == 1:
                ended.append((own, tok[:, 0], np.ones(len(own), np.int64)))
                return
            at = rank.argmin(1)
            best = rank[np.arange(len(own)), at]
            over = best == NONE
            if over.any():
                left = tok[over]
                real = left >= 0
                ended.append((own[over], left[real], real.sum(1)))
                go = ~over
                own, tok, rank, at, best = own[go], tok[go], rank[go], at[go], best[go]
                if not own.size:
                    return
            if tok.shape[1] >= WIDE:
                tok, rank = self._all_of_rank(tok, rank, best)
                continue
            every = np.arange(len(own))
            tok = np.where(np.arange(tok.shape[1] - 1) <= at[:, None], tok[:, :-1], tok[:, 1:])
            tok[every, at] = best
            most = int((tok >= 0).sum(1).max())
            tok = tok[:, :most]
            if most > 1:
                rank = np.where(np.arange(rank.shape[1] - 1) < at[:, None], rank[:, :-1], rank[:, 1:])[:, : most - 1]
                # Only the pairs on both sides of the new id have changed.
                right = np.flatnonzero(at < most - 1)
                rank[right, at[right]] = self.table.find(tok[right, at[right]], tok[right, at[right] + 1])
                left = np.flatnonzero((at > 0) & (at < most))
                rank[left, at[left] - 1] = self.table.find(tok[left, at[left] - 1], tok[left, at[left]])

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and where each piece's start and how many they are."""
        ended: list = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))]
        sizes = np.array([len(p) for p in pieces], np.int64)
        bits = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        bucket = np.where(sizes <= 16, sizes, 16 + bits)
        for k in np.unique(bucket[sizes > 0]):
            members = np.flatnonzero(bucket == k)
            rows = max(1, min(ROWS, 2_000_000 // (1 << int(bits[members].max()))))
            for lo in range(0, len(members), rows):
                part = members[lo : lo + rows]
                self._matrix([pieces[i] for i in part], part, ended)
        own, ids, counts = (np.concatenate(x) for x in zip(*ended, strict=True))
        start, length = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        start[own], length[own] = np.cumsum(counts) - counts, counts
        return ids, start, length

    def cut(self, chunk: str) -> list[str]:
        """The matches of the pattern; words with at most one mark behind need no search."""
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():
            return [chunk]
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.find(chunk)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk is cut by the pattern; every distinct match is encoded once."""
        known: dict[str, int] = {}
        codes: list[int] = []
        counts = np.empty(len(chunks), np.int64)
        for k, chunk in enumerate(chunks):
            got = self.cut(chunk)
            counts[k] = len(got)
            for p in got:
                codes.append(known.setdefault(p, len(known)))
        ids, start, length = self.encode_pieces([p.encode() for p in known])
        at = np.array(codes, np.int64)
        lengths = length[at]
        joined = gather(ids, start[at], lengths)
        before = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(counts)
        return joined.astype(np.uint32), before[ends] - before[ends - counts]

    def encode(self, text: str) -> np.ndarray:
        return self.encoder.encode(text)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        return self.encoder.encode_batch(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; an id outside the vocabulary is an error."""
        if len(ids) and (int(ids.max()) >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id that the vocabulary doesn't have")
        blob, start, length = self.bytes_of
        return gather(blob, start[ids], length[ids]).tobytes()

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, with one space between."""
        blob, start, length = self.decimal_of
        return gather(blob, start[ids], length[ids]).tobytes()[:-1]


_made: dict[tuple[int, str], Bpe] = cache()


def _bpe(ranks: dict[bytes, int], pattern: str) -> Bpe:
    """One per worker process: its tables and known chunks serve all tasks of the process."""
    key = (len(ranks), pattern)
    if key not in _made or _made[key].ranks != ranks:
        _made[key] = Bpe(ranks, pattern)
    return _made[key]


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if asked for).

    Null and empty texts have no ids. Ids and repeated rows are taken as they come; a null doc_id stays null.
    The vocabulary is a file of the driver; its ranks (some 50,000, at most the file's lines) are broadcast.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe")
        bpe = _bpe(ranks.value, pattern)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                got = bpe.encode_batch([t or "" for t in b.column("text").to_pylist()])
                out = {
                    "doc_id": b.column("doc_id"),
                    "n_tokens": pa.array([len(x) for x in got], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(bpe.decimals(x)).hexdigest() for x in got], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in got], pa.string()),
                }
                if keep_ids:
                    out["ids"] = pa.array([x.astype(np.int32) for x in got], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def decode_ids(rows: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) -> (doc_id, decoded binary). Null ids decode to empty bytes."""
    ranks = rows.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe")
        bpe = _bpe(ranks.value, pattern)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "decoded": pa.array([bpe.decode(np.array(x or [], np.int64)) for x in b.column("ids").to_pylist()], pa.binary())})

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, decoded binary")
