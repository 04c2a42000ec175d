"""Language model: a probabilistic suffix tree over words.

A text is a sequence of tokens (words, lower-cased A-Z, then one end). A state is the last 0 to ORDER tokens. With
n(s, x) for the times that x follows s in training and c(s) for the sum of these, a token is scored in the longest
retained suffix of what is before it, smoothed by the next shorter one:

    P(x | s) = (n(s, x) + WEIGHT * P(x | suffix of s)) / (c(s) + WEIGHT)

which adds up to 1 over x at every state. The root is (c(x) + 1) / (N + V + 1); all words that training doesn't have
are one more token. A context that occurs LEAST times is retained by a divergence test: the log likelihood (in nats)
that it adds to its own occurrences over its suffix, each occurrence left out when it is predicted itself, has
to exceed DIVERGENCE. All counts come from all training documents and nothing but these absolute numbers prunes them.

The tree grows with the corpus and is never in one place. Texts become chunks of about CHUNK tokens (a row of a
staged table: the hashes of its distinct words, the place of each token among them). A chunk asks for what it needs,
each key once: a round sends sorted keys with the chunk's own counts to the bucket that owns the range of keys; the
bucket adds up and answers in the order of the keys. So a word or context that makes up a third of the corpus is one
entry a chunk. The rounds: counts of words; of pairs; of triples and so on (STEPS), each only where the parts that are
known occur LEAST times, and with each the divergences of the contexts before; then every chunk scores its own documents. Keys are 64-bit hashes: among
10^9 distinct words the chance that any two are taken for one is 3 %.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staging, crc_mod, learned_from
from .shingles import _mix, slices, word_hashes
from .worker import claim

#: Tokens of the longest context.
ORDER = 4
#: Occurrences from which a context can be retained.
LEAST = 2
WEIGHT = 10.0
DIVERGENCE = 1.0
#: Tokens of a chunk (one document more at most).
CHUNK = 1_200_000
#: The lengths of contexts that are asked for together; longer steps are fewer passes and more keys.
STEPS = ((1,), (2,), (3, 4))
#: Buckets are 2 ** bits: so many keys each, and so many buckets at least.
BUCKET_KEYS = 1_500_000
LEAST_BITS = 7
END = xxhash.xxh3_64_intdigest("\n")  # no word has white space
#: Number of the round that asks for the divergence of contexts of o tokens: GAIN + o.
GAIN = 100
_K = np.uint64(0xC2B2AE3D27D4EB4F)

ASKED = "bucket int, round int, chunk long, n int, keys binary, numbers binary"
ANSWERS = "array<struct<round: int, bucket: int, n: int, numbers: binary>>"
ANSWERED = "chunk long, round int, bucket int, n int, numbers binary, total long, distinct long"


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), "zstd", asbytes=True)


def _unsqueeze(raw: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, as their differences."""
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_keys(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unsqueeze(raw, n, np.uint64), dtype=np.uint64)


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, the place of each key among them). Upper bits and places are sorted as one number."""
    n = len(keys)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    order = (keys >> bits << bits) | np.arange(n, dtype=np.uint64)
    order.sort()
    order &= (np.uint64(1) << bits) - np.uint64(1)
    order = order.astype(np.int64)
    s = keys[order]
    wrong = np.flatnonzero(s[1:] < s[:-1])
    if len(wrong):  # keys that agree in the upper bits
        upper = s >> bits
        for u in np.unique(upper[wrong]):
            lo, hi = np.searchsorted(upper, u, "left"), np.searchsorted(upper, u, "right")
            order[lo:hi] = order[lo:hi][np.argsort(keys[order[lo:hi]], kind="stable")]
        s = keys[order]
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    code = np.empty(n, np.int32)
    code[order] = np.cumsum(new, dtype=np.int32) - 1
    return s[new], code


def _chunks(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents -> chunks: names (hashes of distinct words), codes (of tokens), and the documents' ids, folds and lengths."""
        claim("suffixtree")
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        held: list[np.ndarray] = []
        docs: dict[str, list] = {"ids": [], "held_out": [], "learn": [], "lengths": []}
        size, id_type = 0, None

        def chunk() -> pa.RecordBatch:
            names, codes = ranked(np.concatenate(held))
            columns = {
                "chunk": pa.array([number], pa.int64()), "tokens": pa.array([len(codes)], pa.int64()), "distinct": pa.array([len(names)], pa.int64()), "names": pa.array([squeeze_keys(names)], pa.binary()),
                "codes": pa.array([_squeeze(codes)], pa.binary()), "ids": pa.array([docs["ids"]], pa.list_(id_type)), "held_out": pa.array([docs["held_out"]], pa.list_(pa.bool_())),
                "learn": pa.array([docs["learn"]], pa.list_(pa.bool_())), "lengths": pa.array([docs["lengths"]], pa.list_(pa.int64())),
            }
            return pa.RecordBatch.from_pydict(columns)

        for b in batches:
            id_type = b.column("doc_id").type
            ids, held_out, learn = (b.column(c).to_pylist() for c in ("doc_id", "held_out", "learn"))
            for lo, part in slices(b.column("__text").to_pylist()):
                words, first = word_hashes(part)
                lengths = np.diff(first) + 1
                ends = np.cumsum(lengths)
                x = np.full(int(ends[-1]), END, np.uint64)
                inner = np.ones(len(x), bool)
                inner[ends - 1] = False
                x[inner] = words
                at = 0
                for i, (n, end) in enumerate(zip(lengths.tolist(), ends.tolist(), strict=True)):
                    docs["ids"].append(ids[lo + i])
                    docs["held_out"].append(held_out[lo + i])
                    docs["learn"].append(learn[lo + i])
                    docs["lengths"].append(n)
                    size += n
                    if size >= CHUNK:
                        held.append(x[at:end])
                        yield chunk()
                        number += 1
                        held, size, at = [], 0, end
                        docs = {k: [] for k in docs}
                held.append(x[at:])
        if size:
            yield chunk()

    return run, f"chunk long, tokens long, distinct long, names binary, codes binary, ids array<{kind}>, held_out array<boolean>, learn array<boolean>, lengths array<long>"


class Chunk:
    """The tokens of a chunk and what is known of them by the answers so far."""

    def __init__(self, row: dict, answers: dict[int, np.ndarray]):
        """answers: round -> numbers in the order of the keys that were asked."""
        self.answers = answers
        self.names, self.codes = unsqueeze_keys(row["names"], row["distinct"]), _unsqueeze(row["codes"], row["tokens"], np.int32)
        lengths = np.array(row["lengths"], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.place = (np.arange(len(self.codes)) - np.repeat(self.starts, lengths)).clip(0, ORDER).astype(np.int8)  # that many tokens before it are its document's
        self.learn = np.repeat(np.array(row["learn"], bool), lengths)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, counts in training) of the chunk's words."""
        return self.names, np.bincount(self.codes, self.learn, len(self.names)).astype(np.int64)

    def _earlier(self, x: np.ndarray, k: int = 1) -> np.ndarray:
        """What is k tokens before, 0 at the chunk's start."""
        out = np.zeros_like(x)
        out[k:] = x[:-k]
        return out

    def grams(self, upto: int, keep: bool = False) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
        """For the rounds 1..upto: (o, which tokens ask how often they follow the o tokens before, (keys, places of the tokens' keys)).

        ``n[o]`` gets the answers as far as they are there: how often the last o + 1 tokens occur together;
        ``asked[o]`` keeps what is yielded, if asked for.
        """
        self.c = self.answers[0][self.codes]
        self.n, self.asked = [self.c], [None]
        word = key = self.names[self.codes]
        for step in STEPS:
            known = step[0] - 1
            if known >= upto:
                return
            # n is at most the count of the shorter ending: it is known if that is 0, and if that is 1 and it occurs here.
            ending, often = self.n[known], self.n[known] >= LEAST
            unclear = (ending >= 2) | ((ending == 1) & ~self.learn)
            for o in step:
                if o > upto:
                    return
                key = _mix((self._earlier(key) + np.uint64(o)) * _K + word)
                # All parts of the context that are known have to occur LEAST times.
                ok = self.place >= o
                for back in range(1, o - known + 1):
                    ok &= self._earlier(often, back)
                ask = np.flatnonzero(ok & unclear).astype(np.int32)
                keys = ranked(key[ask])
                if o in self.answers:
                    n = (ok & (ending == 1) & self.learn).astype(self.answers[o].dtype)
                    n[ask] = self.answers[o][keys[1]]
                    self.n.append(n)
                self.asked.append((ask, keys) if keep else None)
                if o > 1:
                    self.asked[o - 2] = None
                yield o, ask, keys

    def contexts(self, o: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens whose context of o tokens occurs LEAST times, c of these contexts, places of their keys, keys).

        To be called when ``grams`` has come to o and keeps what it yields.
        """
        before = self.n[o - 1]
        at = np.flatnonzero((self.place >= o) & (self._earlier(before) >= LEAST))
        if o == 1:
            return at, before[at - 1], self.codes[at - 1], self.names
        ask, (keys, own) = self.asked[o - 1]
        codes = np.full(len(self.codes), -1, np.int32)
        codes[ask] = own
        return at, before[at - 1], codes[at - 1], keys

    def gains(self, o: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, what the contexts of o tokens add to the log likelihood of this chunk)."""
        at, c, code, keys = self.contexts(o)
        shorter = (self.c[at] + 1.0) / whole
        if o > 1:
            shorter = (np.maximum(self.n[o - 1][at] - 1, 0) + WEIGHT * shorter) / (self.n[o - 2][at - 1] - 1 + WEIGHT)
        gain = np.log((np.maximum(self.n[o][at] - 1, 0) + WEIGHT * shorter) / (c - 1 + WEIGHT) / shorter)
        learn = self.learn[at]
        there = np.flatnonzero(np.bincount(code, minlength=len(keys)))
        return keys[there], np.bincount(code[learn], gain[learn], len(keys))[there]

    def score(self, whole: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each document: known tokens, log10 of the base, log10 of the model."""
        add = lambda x: np.add.reduceat(x, self.starts)
        p = (self.answers[0][self.codes] + 1.0) / whole
        base = add(np.log10(p))
        for o, _, _ in self.grams(ORDER, keep=True):
            at, c, code, keys = self.contexts(o)
            kept = np.zeros(len(keys), bool)
            kept[np.flatnonzero(np.bincount(code, minlength=len(keys)))] = self.answers[GAIN + o] > 0
            kept = kept[code]
            at, c = at[kept], c[kept]
            p[at] = (self.n[o][at] + WEIGHT * p[at]) / (c + WEIGHT)
        return add((self.c > 0).astype(np.int64)), base, add(np.log10(p))


def _ask(chunk: int, number: int, bits: int, keys: np.ndarray, numbers: np.ndarray) -> Iterator[tuple]:
    """Rows of ASKED, one for each bucket that has some of the (sorted) keys."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    for lo, hi in zip(edges, [*edges, len(keys)][1:], strict=True):
        yield int(bucket[lo]), number, chunk, hi - lo, squeeze_keys(keys[lo:hi]), _squeeze(numbers[lo:hi])


def _rows(rows: list[tuple], types: list[pa.DataType], names: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in names.split(", ")])


def _asking(bits: int, done: list[int], wanted: Callable[[Chunk], Iterator[tuple[int, np.ndarray, np.ndarray]]]):
    """Chunk rows with their answers -> rows of ASKED."""
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("suffixtree")
        for row, chunk in _opened(batches, done):
            for number, keys, numbers in wanted(chunk):
                yield _rows(list(_ask(row["chunk"], number, bits, keys, numbers)), types, ASKED)
                del keys, numbers
            del row, chunk

    return run


def _opened(batches: Iterator[pa.RecordBatch], done: list[int]) -> Iterator[tuple[dict, Chunk]]:
    """done: the rounds that are over; a chunk that had no key in one has an empty answer to it."""
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1).to_pylist()[0]
            parts: dict[int, list] = {r: [np.zeros(0, np.int8 if r > GAIN else np.int32)] for r in done}
            for a in sorted(row.pop("answers", None) or (), key=lambda a: (a["round"], a["bucket"])):
                x = _unsqueeze(a["numbers"], a["n"], _kind(a["round"]))
                parts[a["round"]].append(x.astype(np.int32) if x.itemsize == 8 and x.max() < 2**31 else x)
            chunk = Chunk(row, {r: np.concatenate(x) for r, x in parts.items()})
            del parts
            yield row, chunk
            del row, chunk


def _kind(number: int) -> type:
    """Answers are counts, or whether a context is retained."""
    return np.int8 if number > GAIN else np.int64


def _answering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ASKED, sorted by bucket and round -> rows of ANSWERED; one bucket of a round is held at a time."""
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    held: list[tuple] = []
    at = None

    def close() -> Iterator[pa.RecordBatch]:
        bucket, number = at
        gain = number > GAIN
        sizes = [n for _, n, _, _ in held]
        _, code = ranked(np.concatenate([unsqueeze_keys(k, n) for _, n, k, _ in held]))
        numbers = np.concatenate([_unsqueeze(x, n, np.float32 if gain else np.int64) for _, n, _, x in held])
        total = np.bincount(code, numbers)
        total = (total > DIVERGENCE).astype(np.int8) if gain else total.astype(np.int64)
        ends = np.cumsum(sizes).tolist()
        rows = []
        for (chunk, n, _, _), end in zip(held, ends, strict=True):
            rows.append((chunk, number, bucket, n, _squeeze(total[code[end - n : end]]), None, None))
        # What the bucket has in all: tokens and distinct keys, or retained contexts.
        rows.append((None, number, bucket, None, None, int(total.sum()), int((total > 0).sum())))
        yield _rows(rows, types, ANSWERED)

    for b in batches:
        for bucket, number, chunk, n, keys, numbers in zip(*(b.column(c).to_pylist() for c in ("bucket", "round", "chunk", "n", "keys", "numbers")), strict=True):
            if (bucket, number) != at:
                if held:
                    yield from close()
                at, held = (bucket, number), []
            held.append((chunk, n, keys, numbers))
    if held:
        yield from close()


def _word_round(chunk: Chunk) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    yield 0, *chunk.words()


def _round(step: tuple[int, ...], tested: tuple[int, ...], whole: int):
    """Asks for the contexts of ``step`` with their next tokens and for the divergence of the contexts of ``tested``."""

    def wanted(chunk: Chunk) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for o, ask, (keys, code) in chunk.grams(max(*step, *tested, 0), keep=bool(tested)):
            if o in step:
                yield o, keys, np.bincount(code, chunk.learn[ask], len(keys)).astype(np.int64)
            if o in tested:
                keys, gains = chunk.gains(o, whole)
                # 12 binary digits, so that the others compress to nothing.
                yield GAIN + o, keys, (gains.astype(np.float32).view(np.int32) & ~0x7FF).view(np.float32)

    return wanted


def _scoring(whole: int, total: int, done: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("suffixtree")
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                ((row, chunk),) = _opened(iter([one]), done)
                known, base, score = chunk.score(whole)
                yield pa.RecordBatch.from_arrays(
                    [one.column("ids").flatten(), pa.array(row["held_out"], pa.bool_()), pa.array(row["lengths"], pa.int64()), pa.array(known), pa.array(np.full(len(known), total, np.int64)), pa.array(base), pa.array(score)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
                del row, chunk, one

    return run


def score_texts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text counts as empty: its only token is the end. A null doc_id is neither held out nor learned from.
    Repeated rows are learned from and scored as often as they occur; other columns are ignored. With nothing to
    learn from, all counts are 0. An empty table gives no rows.
    """
    store = Staging(spark, "suffixtree")
    kind = dict(docs.dtypes)["doc_id"]
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text")
    rows = docs.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out"), learned_from(F.col("doc_id"), 7, 2).alias("learn"), text)
    run, fields = _chunks(kind)
    # Chunks with all answers so far, a few bytes for each of a chunk's keys.
    state = store.put(rows.mapInArrow(run, fields).withColumn("answers", F.expr(f"CAST(array() AS {ANSWERS})")))
    tokens = state.agg(F.sum("tokens")).first()[0] or 0
    bits = min(30, max(LEAST_BITS, math.ceil(math.log2(max(1, tokens) / BUCKET_KEYS))))
    done: list[int] = []

    def ask(rounds: list[int], wanted: Callable) -> tuple[int, int]:
        """A round; the new state is written before the next one is asked for, so that one exchange at a time needs disk."""
        nonlocal state
        asked = state.mapInArrow(_asking(bits, list(done), wanted), ASKED)
        answered = store.put(asked.repartition("bucket").sortWithinPartitions("bucket", "round").mapInArrow(_answering, ANSWERED))
        done.extend(rounds)
        own = answered.filter("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("round", "bucket", "n", "numbers")).alias("new"))
        joined = state.join(own, "chunk", "left").withColumn("answers", F.when(F.col("new").isNull(), F.col("answers")).otherwise(F.concat("answers", "new"))).drop("new")
        found = answered.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
        following = store.put(joined)
        store.drop(state)
        store.drop(answered)
        state = following
        return found

    total, distinct = ask([0], _word_round)
    whole = total + distinct + 1
    # The contexts of a step are tested in the round after it, together with the next step.
    for step, tested in zip([*STEPS, ()], [(), *STEPS], strict=True):
        ask([*step, *(GAIN + o for o in tested)], _round(step, tested, whole))
    return state.mapInArrow(_scoring(whole, total, done), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
