"""Packing: sum-of-squares placement of documents into windows of a fixed number of tokens.

A task keeps a level array: for each fill level 1..WINDOW-1 the partially filled windows of that level.
A document's whole windows are cut off first (each is a sequence of its own); the rest goes, without a cut,
into the level (0: a new window) that leaves the smallest sum over levels of the squared number of windows.
When more than MAX_OPEN windows are open, and at a task's end, the open ones are closed: the fullest are filled
up with the pieces of the emptiest, so only those are cut, and what is left at the very end goes into powers of
two, so no token is padded. Packing needs no exchange; sequence ids are (task number << 32) + a count.

Ids are those of the tokenizer file. Its vocabulary is byte-level with ids in the order of its merges, so they
are ranks, and the merging is done by rank (some six times faster than by the file's own library, with the same
ids); texts with white space in a run of RUN characters, which that can't cut, go through the file's library.
Nothing is kept from one text to the next.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .worker import cache, claim

WINDOW = 1024
#: Open windows at most in a task; 4 bytes a token, so at most some 16 MB.
MAX_OPEN = 4096
END_ID = 0
RUN = 4096
_RUN = re.compile(r"\s{%d}" % RUN)
FIELDS = "doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset"


class Levels:
    """Open windows by fill level; ``done`` gets the rows of closed sequences."""

    def __init__(self, window: int, first_sequence: int, max_open: int = MAX_OPEN):
        self.window, self.next, self.max_open = window, first_sequence, max_open
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.count = np.zeros(window + 1, np.int64)
        self.n_open = 0
        self.done: list[tuple] = []
        #: Tokens that were moved to another window when windows were closed.
        self.moved = 0

    def _close(self, pieces: list[tuple]) -> None:
        """pieces: (doc, start, ids, doc_tokens)."""
        offset = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, w = len(ids), self.window
        whole = total - total % w
        for lo in range(0, whole, w):
            self._close([(doc, lo, ids[lo : lo + w], total)])
        size = total - whole
        if size:
            piece = (doc, whole, ids[whole:].copy(), total)
            level = self.choose(size)
            pieces = self.open[level].pop() if level else []
            pieces.append(piece)
            self.count[level] -= level > 0
            self.n_open -= level > 0
            if level + size == w:
                self._close(pieces)
            else:
                self.open[level + size].append(pieces)
                self.count[level + size] += 1
                self.n_open += 1
                if self.n_open > self.max_open:
                    self.settle(last=False)

    def choose(self, size: int) -> int:
        """The level with the smallest change of the sum of squares; the fullest of equals."""
        n = self.count[: self.window]
        source = n[: self.window - size + 1]
        change = 1 - 2 * source
        change[0] = 0
        target = self.count[size : self.window + 1]
        gain = 2 * target + 1
        gain[-1] = 0  # a filled window is no longer partially filled
        change = np.where(source > 0, change + gain, np.iinfo(np.int64).max)
        change[0] = gain[0]
        return int(len(change) - 1 - change[::-1].argmin())

    def settle(self, last: bool) -> None:
        """Close all open windows: the fullest are filled with pieces of the emptiest; at the end also powers of two."""
        windows = [(level, pieces) for level in range(self.window - 1, 0, -1) for pieces in self.open[level]]
        self.open = [[] for _ in range(self.window)]
        self.count[:] = 0
        self.n_open = 0
        at, end = 0, len(windows)
        given: deque[tuple] = deque()  # pieces of the emptiest windows
        now: list[tuple] = []
        while at < end:
            level, now = windows[at]
            at += 1
            while level < self.window:
                if not given:
                    if at == end:
                        break
                    end -= 1
                    given.extend(windows[end][1])
                level += self._move(given, now, self.window - level)
            if level == self.window:
                self._close(now)
                now = []
        now += given
        left = sum(len(p[2]) for p in now)
        if left and not last:
            self.open[left].append(now)
            self.count[left], self.n_open = 1, 1
        elif left:
            given = deque(now)
            while left:
                now, size = [], 1 << (left.bit_length() - 1)
                while sum(len(p[2]) for p in now) < size:
                    self._move(given, now, size - sum(len(p[2]) for p in now))
                self._close(now)
                left -= size

    def _move(self, given: deque, now: list, room: int) -> int:
        """The first of the given pieces, cut if it is larger than room, is moved; its size."""
        doc, start, ids, total = given.popleft()
        if len(ids) > room:
            given.appendleft((doc, start + room, ids[room:], total))
            ids = ids[:room]
        now.append((doc, start, ids, total))
        self.moved += len(ids)
        return len(ids)

    def take(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


_made: dict[str, Callable[[str], np.ndarray]] = cache()


def ranks_of(definition: str) -> dict[bytes, int] | None:
    """Bytes -> id of a byte-level vocabulary whose ids are the order of its merges; None for any other."""
    model = json.loads(definition)["model"]
    # The byte-level alphabet: visible Latin-1 characters stand for their own byte, the others follow from 256 on.
    own = [i for i in range(256) if 33 <= i <= 126 or 161 <= i <= 172 or i >= 174]
    byte = {chr(i): i for i in own} | {chr(256 + k): i for k, i in enumerate(i for i in range(256) if i not in set(own))}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
    try:
        made = [model["vocab"][a + b] for a, b in pairs]
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}
    except (KeyError, ValueError):
        return None
    whole = len(ranks) == 256 + len(made) and all(bytes([i]) in ranks for i in range(256))
    return ranks if whole and made == sorted(set(made)) and (not made or made[0] >= 256) else None


def _long_run(text: str) -> bool:
    """Has white space in a run of RUN characters, in which two of every RUN // 2-th characters are neighbours."""
    if len(text) < RUN:
        return False
    marks = [c.isspace() for c in text[:: RUN // 2]]
    return any(a and b for a, b in zip(marks, marks[1:])) and _RUN.search(text) is not None


def _encoder(definition: str, pattern: str) -> Callable[[str], np.ndarray]:
    """Text -> ids (uint32); one per worker process. definition: the tokenizer's own JSON text."""
    key = f"{pattern}\n{definition}"
    if key not in _made:
        t = Tokenizer.from_str(definition)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        t.no_padding()
        t.no_truncation()
        ranks = ranks_of(definition)
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if ranks else None

        def encode(text: str) -> np.ndarray:
            if fast is None or _long_run(text):
                return np.array(t.encode(text, add_special_tokens=False).ids, np.uint32)
            return fast.encode_to_numpy(text, disallowed_special=())

        _made[key] = encode
    return _made[key]


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty: its document is the end id alone. Rows are packed as they come, so repeated
    rows and null ids are packed like others; an empty table gives no rows. Other columns are ignored.
    The tokenizer's file (of the driver; a few MB) is sent along with the task; pattern is what it cuts texts by.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        claim("packing")
        encode = _encoder(definition.value, pattern)
        context = TaskContext.get()
        levels = Levels(window, (context.partitionId() if context else 0) << 32)
        id_type = None

        def rows(kept: list) -> pa.RecordBatch:
            columns = list(zip(*kept, strict=True)) or [()] * 7
            types = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=FIELDS.split(", "))

        for whole in batches:
            id_type = whole.column("doc_id").type
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    levels.add(doc, np.append(encode(text), np.uint32(END_ID)) if text else np.array([END_ID], np.uint32))
                yield rows(levels.take())
        levels.settle(last=True)
        if id_type is not None:
            yield rows(levels.take())

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
