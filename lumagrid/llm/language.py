"""Language identification as multilingual mixture inference.

A document is taken as a mixture of languages: each byte trigram (lower case, white space as one space)
comes from language l with probability w_l * P(trigram | l). Expectation-maximisation estimates the
proportions w from the trigrams' likelihoods; of the nested sets made by the largest proportions the one
with the best log likelihood less PENALTY * log(n) for each language is selected. The document's language
is that of the largest proportion in the selected set, and its score that proportion.

P comes from counts over all training documents: hashed trigrams, BUCKETS for each language, so the model
has at most languages * BUCKETS numbers however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, learned_from

BITS = 15
BUCKETS = 1 << BITS
#: Log-likelihood units, times log(n), that one more language has to gain.
PENALTY = 6.0
ROUNDS = 12
#: Bytes of text whose trigrams are made at once.
SLICE_BYTES = 4_000_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def trigrams(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(place in texts, hashed trigrams) of every text; texts longer than a slice come in parts."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > SLICE_BYTES:
            t = texts[at]
            for lo in range(0, len(t), SLICE_BYTES):
                yield at, _hashed(np.frombuffer(t[max(0, lo - 2) : lo + SLICE_BYTES], np.uint8))
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) <= SLICE_BYTES:
            size += len(texts[end])
            end += 1
        codes = _hashed(np.frombuffer(b"".join(texts[at:end]), np.uint8))
        lo = 0
        for i in range(at, end):
            n = len(texts[i])
            yield i, codes[lo : lo + max(0, n - 2)]
            lo += n
        at = end


def _hashed(raw: np.ndarray) -> np.ndarray:
    if raw.size < 3:
        return np.zeros(0, np.int64)
    x = _FOLD[raw].astype(np.uint32)
    return (((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(lang, text) -> (lang, bucket, n): summed in each task over its documents, then by lang and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            for i, codes in trigrams([(t or "").encode() for t in b.column("text").to_pylist()]):
                if langs[i] not in counts:
                    counts[langs[i]] = np.zeros(BUCKETS, np.int64)
                counts[langs[i]] += np.bincount(codes, minlength=BUCKETS)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            at = at if at.size else np.array([0])
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": at.astype(np.int32), "n": n[at]})

    return docs.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Mixture:
    """langs and P(bucket | lang), with half a count for every bucket."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.p = ((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)

    @staticmethod
    def _fit(p: np.ndarray, weight: np.ndarray, w: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        total = weight.sum()
        for _ in range(rounds):
            before = w
            w = w * (p @ (weight / (w @ p))) / total
            if np.abs(w - before).max() < 1e-3:
                break
        return w, float((weight * np.log(w @ p)).sum())

    def infer(self, codes: np.ndarray) -> tuple[str, float]:
        """The language and its proportion; for no trigram at all, the first language of equal ones."""
        n = len(codes)
        if not self.langs:
            return UNKNOWN, 0.0
        if n == 0:
            return self.langs[0], 1.0 / len(self.langs)
        if n > BUCKETS:
            c = np.bincount(codes, minlength=BUCKETS)
            codes = np.flatnonzero(c)
            weight = c[codes].astype(np.float32)
        else:
            weight = np.ones(n, np.float32)
        p = self.p[:, codes]
        k = len(self.langs)
        w, _ = self._fit(p, weight, np.full(k, 1 / k, np.float32), ROUNDS)
        order = np.argsort(-w, kind="stable")
        best, best_value = None, -np.inf
        for size in range(1, k + 1):
            some = order[:size]
            if size > 1 and w[some[-1]] < 1e-3:
                break
            if size == 1:
                v, like = np.ones(1, np.float32), float((weight * np.log(p[some[0]])).sum())
            else:
                v, like = self._fit(p[some], weight, w[some] / w[some].sum(), ROUNDS)
            value = like - PENALTY * np.log(n) * size
            if value > best_value:
                best, best_value = (some, v), value
            elif size > 2:
                break
        some, v = best
        top = int(v.argmax())
        return self.langs[some[top]], float(min(1.0, v[top] / v.sum()))


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learned from text and lang of documents outside the held-out fold with both. Null texts and texts without
    a letter get ``und`` and score 0, as does every text if nothing could be learned. A null doc_id is not
    held out and never learned from. Repeated rows count as often as they occur; other columns are ignored.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learned_from(F.col("doc_id"), 4, 2))
    rows = count_trigrams(known).toArrow()  # at most languages * BUCKETS rows, some 20 bytes each
    named = rows.column("lang").combine_chunks().dictionary_encode()
    names = named.dictionary.to_pylist()
    langs = sorted(names)
    counts = np.zeros((len(langs), BUCKETS))
    place = np.array([langs.index(x) for x in names], np.int64)
    counts[place[named.indices.to_numpy()], rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    model = spark.sparkContext.broadcast(Mixture(langs, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                texts = b.column("text").to_pylist()
                parts: dict[int, list[np.ndarray]] = {}
                out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
                raw = [(t or "").encode() for t in texts]
                for i, codes in trigrams(raw):
                    if len(raw[i]) > SLICE_BYTES:
                        parts.setdefault(i, []).append(codes)
                    elif texts[i] and _LETTER.search(texts[i]):
                        out[i] = m.infer(codes)
                for i, x in parts.items():
                    if _LETTER.search(texts[i]):
                        out[i] = m.infer(np.concatenate(x))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")
