"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of at most PASSAGE bytes. Each passage is encoded as hashed byte-trigram
frequencies and a few ratios, mapped to a hidden vector, weighted by gated attention and the weighted sum
is classified. Only document labels are used; the attention learns which passages matter.

The model is small (about 20,000 numbers) and is trained on the driver from a bounded sample of labelled
documents (TRAIN_DOCS, those of the smallest hashed ids, of at most TRAIN_PASSAGES passages each and TRAIN_ALL in
all, which are 52 MB; they stay bytes until a mini-batch of 64 documents needs them);
scoring runs over all documents in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, learned_from
from .worker import claim

PASSAGE = 512
BUCKETS = 512
HIDDEN = 32
ATTENTION = 16
#: Bounds of the training sample.
TRAIN_DOCS = 4000
TRAIN_PASSAGES = 256
TRAIN_ALL = 100_000
EPOCHS = 12
#: Updates at least, so that a small sample is passed more often.
LEAST_UPDATES = 600
#: Score from which a document is predicted to be good.
THRESHOLD = 0.3
#: Texts are encoded in slices of about this many bytes, so that memory doesn't follow the batch.
SLICE_BYTES = 2_000_000

_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[48:58] = 3
_KIND[[9, 10, 11, 12, 13]] = 4
_KIND[32] = 5
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 6
_KIND[[i for i in range(33, 127) if _KIND[i] == 0]] = 7
KINDS = 8
FEATURES = BUCKETS + KINDS + 2


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Passage features (n_passages, FEATURES) and each document's first passage (with an end mark).

    Every document has at least one passage; an empty text has one of zeros.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(counts)])
    n = int(first[-1])
    out = np.zeros((n, FEATURES), np.float32)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if raw.size:
        starts = np.cumsum(sizes) - sizes
        at = np.arange(raw.size, dtype=np.int64) - np.repeat(starts, sizes)
        passage = np.repeat(first[:-1], sizes) + at // PASSAGE
        code = raw.astype(np.int64)
        tri = (code[:-2] * 65599 + code[1:-1] * 257 + code[2:]) if raw.size > 2 else np.zeros(0, np.int64)
        bucket = ((tri * 2654435761) >> 11) & (BUCKETS - 1)
        same = passage[:-2] == passage[2:] if raw.size > 2 else np.zeros(0, bool)
        grams = np.bincount(passage[:-2][same] * BUCKETS + bucket[same], minlength=n * BUCKETS).reshape(n, BUCKETS) if raw.size > 2 else np.zeros((n, BUCKETS), np.int64)
        total = np.maximum(1, grams.sum(1, keepdims=True))
        out[:, :BUCKETS] = np.sqrt(grams / total)
        kinds = np.bincount(passage * KINDS + _KIND[raw], minlength=n * KINDS).reshape(n, KINDS)
        length = np.maximum(1, kinds.sum(1, keepdims=True))
        out[:, BUCKETS : BUCKETS + KINDS] = 4 * kinds / length
        out[:, -2] = 2 * (grams > 0).sum(1) / total[:, 0]
        out[:, -1] = length[:, 0] / PASSAGE
    return out, first


def _sliced(texts: list[bytes]) -> Iterator[list[bytes]]:
    part: list[bytes] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t) + 64
        if size >= SLICE_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _forward(m: dict, x: np.ndarray, first: np.ndarray) -> dict:
    h = np.tanh(x @ m["w"] + m["b"])
    t, s = np.tanh(h @ m["v"]), 1 / (1 + np.exp(-(h @ m["u"])))
    e = (t * s) @ m["a"]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[doc])
    att = e / np.add.reduceat(e, first[:-1])[doc]
    z = np.add.reduceat(att[:, None] * h, first[:-1], axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["d"], -30, 30)))
    return {"h": h, "t": t, "s": s, "att": att, "z": z, "p": p, "doc": doc}


def _gradients(m: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
    f = _forward(m, x, first)
    n, doc, h, att, t, s = len(y), f["doc"], f["h"], f["att"], f["t"], f["s"]
    dlogit = (f["p"] - y) / n
    dz = dlogit[:, None] * m["c"]
    datt = (dz[doc] * h).sum(1)
    de = att * (datt - np.add.reduceat(att * datt, first[:-1])[doc])
    dt, ds = de[:, None] * m["a"] * s * (1 - t * t), de[:, None] * m["a"] * t * s * (1 - s)
    dh = (att[:, None] * dz[doc] + dt @ m["v"].T + ds @ m["u"].T) * (1 - h * h)
    return {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ de, "c": f["z"].T @ dlogit, "d": dlogit.sum()}


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> dict:
    """Adam on the mean log loss over mini-batches of 64 documents, with weight decay; x may be 64ths as bytes."""
    rng = np.random.default_rng(7)
    scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    m = {"w": scale(FEATURES, HIDDEN) * 2, "b": np.zeros(HIDDEN, np.float32), "v": scale(HIDDEN, ATTENTION), "u": scale(HIDDEN, ATTENTION), "a": scale(ATTENTION), "c": scale(HIDDEN), "d": np.float32(0)}
    if len(y) == 0:
        return m
    m["d"] = np.float32(np.log((y.mean() + 0.01) / (1.01 - y.mean())))
    one, two, step = {k: 0.0 for k in m}, {k: 0.0 for k in m}, 0
    batches = -(-len(y) // 64)
    for _ in range(max(epochs, -(-LEAST_UPDATES // batches))):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), 64):
            part = order[lo : lo + 64]
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in part])
            ends = np.concatenate([[0], np.cumsum(first[part + 1] - first[part])])
            step += 1
            some = x[rows].astype(np.float32) / 64 if x.dtype == np.uint8 else x[rows]
            for k, g in _gradients(m, some, ends, y[part]).items():
                g = g + 1e-4 * m[k]
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                m[k] = (m[k] - 0.005 * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model, from documents outside the held-out fold (crc32(doc_id) mod 5 is 0) with a label.

    A doc_id with several labels counts as good if most of them say so; null ids and labels are left out. A doc_id
    with several rows is learned from once, by the text of the smallest hash.
    """
    known = (
        labels.filter(F.col("quality").isNotNull() & learned_from(F.col("doc_id"), 5, 0))
        .groupBy(F.col("doc_id").alias("__id"))
        .agg((F.avg("quality") >= 0.5).cast("int").alias("__y"))
    )
    # A top-k by hash: every task keeps TRAIN_DOCS rows at most; so do the sample and its broadcast.
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(TRAIN_DOCS)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = docs.select(F.col("doc_id").alias("__id"), text.alias("__text"), F.xxhash64(text).alias("__h")).filter(F.octet_length("__text") <= PASSAGE * TRAIN_PASSAGES)
    # Of each id of the sample one text, and as many ids as have TRAIN_ALL passages together: TRAIN_DOCS short rows.
    size = F.greatest(F.lit(1), F.ceil(F.octet_length("__text") / PASSAGE)).cast("long")
    told = hashed.select("__id", "__h", size.alias("n")).join(F.broadcast(sample), "__id").groupBy("__id").agg(F.min(F.struct("__h", "n")).alias("least"))
    told = told.select("__id", "least.__h", "least.n", F.xxhash64("__id").alias("order")).toArrow().sort_by([("order", "ascending"), ("__id", "ascending")])
    told = told.slice(0, int(np.searchsorted(np.cumsum(told.column("n").to_numpy()), TRAIN_ALL, "right")))
    chosen = docs.sparkSession.createDataFrame(told.select(["__id", "__h"])) if len(told) else None
    if chosen is None:
        return fit(np.zeros((0, FEATURES), np.float32), np.array([0]), np.zeros(0, np.float32))
    rows = hashed.join(F.broadcast(chosen.join(sample, "__id")), ["__id", "__h"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        sent: set = set()  # ids of the sample that this task has had
        for b in batches:
            ids, ys = b.column("__id").to_pylist(), b.column("__y").to_pylist()
            texts = [t.encode() for t in b.column("__text").to_pylist()]
            keep = [i for i, x in enumerate(ids) if x not in sent and not sent.add(x)]
            at = 0
            for part in _sliced([texts[i] for i in keep]):
                x, first = encode(part)
                x = (x * 64 + 0.5).clip(0, 255).astype(np.uint8)
                own = keep[at : at + len(part)]
                at += len(part)
                yield pa.RecordBatch.from_pydict({"id": [ids[i] for i in own], "y": [ys[i] for i in own], "x": [x[first[k] : first[k + 1]].tobytes() for k in range(len(part))]})

    made = rows.select("__id", "__y", "__text").mapInArrow(features, f"id {dict(docs.dtypes)['doc_id']}, y long, x binary")
    got = made.dropDuplicates(["id"]).toArrow().sort_by("id")
    sizes = np.array([len(v) for v in got.column("x").to_pylist()], np.int64) // FEATURES
    first = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"".join(got.column("x").to_pylist()), np.uint8).reshape(-1, FEATURES)
    return fit(raw, first, got.column("y").to_numpy().astype(np.float32))


def score(model: dict, texts: list[bytes]) -> np.ndarray:
    out = [np.zeros(0, np.float32)]
    for part in _sliced(texts):
        x, first = encode(part)
        x = np.floor(x * 64 + 0.5).clip(0, 255) / 64
        out.append(_forward(model, x.astype(np.float32), first)["p"])
    return np.concatenate(out)


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null text counts as empty; it has the score of a document of one empty passage. A null doc_id is not
    held out and is never learned from. Repeated rows are scored alike; an empty table gives no rows, and
    with no labels at all the untrained model's scores are returned.
    """
    model = spark.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for b in batches:
            p = score(model.value, [(t or "").encode() for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p.astype(np.float64))], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_rejected(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be bad, with their columns; scored where they are read."""
    model = spark.sparkContext.broadcast(train(docs, labels))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for b in batches:
            p = score(model.value, [(t or "").encode() for t in b.column("text").to_pylist()])
            yield b.filter(pa.array(p >= THRESHOLD))

    return docs.select(names).mapInArrow(run, docs.schema)
