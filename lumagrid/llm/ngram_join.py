"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its connected groups.

A document is the set of its hashed word shingles, in one global order: rising corpus frequency, then
hash. If two sets of sizes n, m have Jaccard similarity of at least t, they share at least ceil(t * n)
members, and so at least l members of their l-prefixes, the first n - ceil(t * n) + l members. Each document
chooses its own l of MATCHES: the one with the least estimated cost, which is the postings that the
longer prefix makes (by the members' frequencies) plus the candidates that are left if l of
them have to agree. A pair needs min(l, l') common prefix members before its sets are compared. Large sets
always ask for several matches (``least_matches``), so a document with fewer shared prefix members is out.

Steps, each over all documents:
1. sets, digests, and the frequent shingles (those of a share of at least FREQUENT of all shingle
   occurrences, so 1 / FREQUENT at most: the only thing that is broadcast); equal sets form one class;
2. prefixes: (shingle, class), exchanged once by shingle (hot ones in SALTS parts); shingles with a single class are
   out. A shingle of at most SMALL classes yields its pairs, which are counted; a pair is a candidate if its count, with as
   many common ones as both have, reaches the matches that sets of that size ask for. A more common shingle
   never yields pairs. A pair without any shingle of few classes shares a common ones at least, if sets of that
   size ask for a; so the first is among the rarest c - a + 1 of the c that a class has, in the order of the
   exact number of classes: these alone tie a class to the smallest one that uses the same shingle so;
3. the connected groups of candidates: each document's set goes to its own group, once; groups of over
   GROUP_WEIGHT shingles or GROUP_DOCS documents are dealt into overlapping bands of sizes and blocks that meet
   two by two. A task counts common prefix members, verifies exactly, and returns edges that span what is
   linked (fewer than members);
4. the connected components of the edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staging
from .joins import components, join_hot
from .shingles import shingle_sets, slices
from .worker import claim

#: A shingle is frequent from this share of all on (and from LEAST_FREQUENT occurrences).
FREQUENT = 2e-7
#: Classes of a shingle up to which its pairs are counted one by one (at most SMALL * (SMALL - 1) / 2).
SMALL = 12
LEAST_FREQUENT = 8
#: Shingles that a task counts at once; single ones among them are not sent.
COUNT_AT_ONCE = 2_000_000
#: The numbers of prefix matches a document can ask for.
MATCHES = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512)
#: (From this size on, at least so many matches); both rise: from a twentieth of the size down to half of that.
LEAST_MATCHES = ((0, 1), (40, 2), (80, 4), (160, 8), (320, 16), (640, 32), (1280, 64), (2560, 128), (5120, 256))
#: A shingle is hot from so many occurrences and this share of all on (10,000 shingles at most); its prefixes are dealt into SALTS parts.
HOT_TOKEN = (50_000, 1e-4)
SALTS = 64
GROUP_WEIGHT = 1_000_000
#: Documents of a group from which it is dealt into bands and blocks.
GROUP_DOCS = 200
#: Blocks have a quarter of a band's documents, but so many at least and at most: smaller ones would send sets more often.
BLOCK_DOCS = (500, 2000)


def least_matches(n: int) -> int:
    return max(m for size, m in LEAST_MATCHES if n >= size)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    claim("ngrams")
    for b in batches:
        for lo, part in slices(b.column("__text").to_pylist()):
            yield b.slice(lo, len(part)), list(shingle_sets(part, k))


def _digest(s: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist())


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents (what = 0: digest, size) and of counts (what = 1: shingle, occurrences)."""
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            values, n = values[n > 1].view(np.int64), n[n > 1]
            zero = pa.nulls(len(n), ids)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), np.int32)), zero, pa.array(np.zeros(len(n), np.int64)), pa.array(values), pa.array(np.zeros(len(n), np.int64)), pa.array(n.astype(np.int64))], names=names)

        names, ids = ["what", "id", "key", "d1", "d2", "n"], pa.int64()
        for b, sets in _sets(batches, k):
            ids = b.column("__id").type
            d = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(d), np.int32)), b.column("__id"), b.column("__key"), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=names)
            held += sets
            size += sum(map(len, sets))
            if size > COUNT_AT_ONCE:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    return run


class Order:
    """The global order of shingles and the choice of prefixes."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, num: int, den: int, hot_from: int = 1 << 62):
        by = np.argsort(tokens)
        self.tokens, self.counts, self.num, self.den = tokens[by], counts[by], num, den
        self.hot = self.tokens[self.counts >= hot_from]

    def salts(self, s: np.ndarray, d: int) -> np.ndarray:
        """1 to SALTS, by the class, for hot shingles; 0 for others."""
        return np.where(np.isin(s, self.hot), d % SALTS + 1, 0) if len(self.hot) else np.zeros(len(s), np.int64)

    def frequency(self, s: np.ndarray) -> np.ndarray:
        """0 for shingles that are not frequent."""
        if not len(self.tokens):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        return np.where(self.tokens[at] == s, self.counts[at], 0)

    def needed(self, n: int) -> int:
        return -(-self.num * n // self.den)

    def prefix(self, s: np.ndarray, whole: bool = False) -> tuple[np.ndarray, int, int]:
        """(members in order, prefix length, matches asked for); only the start of the members unless whole."""
        n = len(s)
        spare = n - self.needed(n)
        low = min(least_matches(n), n - spare)
        most = min(n, spare + next(m for m in MATCHES if m >= 2 * low))
        part = s if whole else s[: min(n, 2 * most + 16)]
        f = self.frequency(part)
        if not whole and int((f == 0).sum()) < most:
            part, f = s, self.frequency(s)
        if f.any():
            by = np.lexsort((part, f))
            part, f = part[by], f[by]
        cost = np.cumsum(np.maximum(f[:most], 1))
        best = min({low, *(m for m in MATCHES if low <= m and spare + m <= most)}, key=lambda m: cost[spare + m - 1] * (1 + 1 / m))
        return part, spare + best, best


def _postings(k: int, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = order.value
        seen: set[int] = set()  # classes of this task: 60 bytes or so each
        for _, sets in _sets(batches, k):
            prefixes, own, salts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s in sets:
                d = _digest(s)[0]
                if len(s) and d not in seen:
                    seen.add(d)
                    members, p, _ = o.prefix(s)
                    prefixes.append(members[:p])
                    own.append(np.full(p, d))
                    salts.append(o.salts(members[:p], d))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefixes).view(np.int64)), pa.array(np.concatenate(own)), pa.array(np.concatenate(salts).astype(np.int32))], names=["token", "d1", "salt"])

    return run


def _dealt(k: int, order):
    """A document's ordered set for its group, once for each pair of blocks it takes part in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = order.value
        seen: set[int] = set()
        for b, sets in _sets(batches, k):
            wanted, cells = (b.column(c).to_pylist() for c in ("d1", "cells"))
            out: list[tuple] = []
            size = 0
            for i, s in enumerate(sets):
                if not len(s) or wanted[i] in seen or _digest(s)[0] != wanted[i]:
                    continue
                seen.add(wanted[i])
                members, p, m = o.prefix(s, whole=True)
                raw = members.tobytes()
                for cell in cells[i]:
                    n = cell["blocks"]
                    mine = wanted[i] % n
                    for x in range(n):
                        out.append((cell["cell"], cell["band"], min(mine, x), max(mine, x), mine, wanted[i], p, m, raw))
                        size += len(raw)
                if size > 8_000_000:
                    yield _dealt_batch(out)
                    out, size = [], 0
            yield _dealt_batch(out)

    return run


def _dealt_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 9
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["cell", "band", "x", "y", "block", "d1", "p", "m", "members"])


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices of some thousand columns."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, local, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    shared = n > 1
    number = np.cumsum(shared) - 1
    keep = shared[local]
    row, local = row[keep], number[local[keep]]
    out = np.zeros((m, m), np.float32)
    width = max(64, min(8192, 8_000_000 // m))
    by = np.argsort(local, kind="stable")
    row, local = row[by], local[by]
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(local, (lo, lo + width))
        x = np.zeros((m, min(width, int(shared.sum()) - lo)), np.float32)
        x[row[a:b], local[a:b] - lo] = 1
        out += x @ x.T
    return out


def linked(sets: list[np.ndarray], prefix: np.ndarray, matches: np.ndarray, block: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Edges that span the linked documents of a cell; across blocks only, if there are two.

    Pairs are taken row by row, so that no list of all candidates is made.
    """
    m = len(sets)
    if m < 2:
        return []
    n = np.array([len(s) for s in sets], np.int64)
    common = _common([s[:p] for s, p in zip(sets, prefix, strict=True)])
    two = block.min() != block.max()
    ok = np.zeros((m, m), bool)
    for i in range(m - 1):
        j = slice(i + 1, m)
        ok[i, j] = (common[i, j] >= np.minimum(matches[i], matches[j])) & (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j]))
        if two:
            ok[i, j] &= block[i] != block[j]
    del common
    every = _common(sets) if np.count_nonzero(ok) > 4 * m else None
    root = np.arange(m)
    edges = []

    def merge(i: int, others: np.ndarray) -> None:
        edges.extend((i, int(j)) for j in others)
        roots = np.append(root[others], root[i])
        root[np.isin(root, roots)] = roots.min()

    for i in range(m - 1):
        j = np.flatnonzero(ok[i])
        j = j[root[j] != root[i]]
        if every is not None:
            both = every[i, j].astype(np.int64)
            j = j[den * both >= num * (n[i] + n[j] - both)]
            if len(j):
                merge(i, j[np.unique(root[j], return_index=True)[1]])
            continue
        for x in j.tolist():
            if root[x] != root[i]:
                both = len(np.intersect1d(sets[i], sets[x], assume_unique=True))
                if den * both >= num * int(n[i] + n[x] - both):
                    merge(i, np.array([x]))
    return edges


def _verified(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (cell, band, x, y); one cell (or pair of blocks) is held at a time."""
        claim("ngrams")
        key, held, found = None, {}, []

        def close() -> None:
            if len(held) > 1:
                names, rows = list(held), list(held.values())
                args = [np.array(c) for c in zip(*(r[:3] for r in rows), strict=True)]
                for i, j in linked([r[3] for r in rows], *args, num, den):
                    found.append((names[i], names[j]))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

        for b in batches:
            for cell, band, x, y, block, d, p, m, raw in zip(*(b.column(c).to_pylist() for c in ("cell", "band", "x", "y", "block", "d1", "p", "m", "members")), strict=True):
                if (cell, band, x, y) != key:
                    close()
                    key, held = (cell, band, x, y), {}
                held[d] = (p, m, block, np.frombuffer(raw, np.uint64))  # repeated rows of a class come from several tasks
            if found:
                yield batch()
                found.clear()
        close()
        if found:
            yield batch()

    return run


def jaccard_groups(docs: DataFrame, words: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, class_size.

    Documents link if den * |common| >= num * |union| of their sets of ``words``-word shingles. Texts without
    words (also null ones) have an empty set and link with nothing. component_id is the smallest id reachable by
    links, itself included; class_size is the number of rows with an equal set. Each row is a node of its own, also
    where rows share an id; rows with a null id are never linked. Other columns are ignored.
    """
    return _grouped(docs, words, num, den, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "class_size")


def _grouped(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, component, class_size, key, root) of every row; key is a hash of the text, root names the component where ids repeat."""
    spark = docs.sparkSession
    store = Staging(spark, "ngrams")
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    hashed = texts.withColumn("__key", F.xxhash64("__text"))
    told = store.put(hashed.mapInArrow(_describe(words), f"what int, id {kind}, key long, d1 long, d2 long, n long"))
    described = told.filter("what = 0").drop("what")
    total, occurrences = described.agg(F.count("*"), F.sum("n")).first()
    least = max(LEAST_FREQUENT, int((occurrences or 0) * FREQUENT))
    often = told.filter("what = 1").groupBy("d1").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()
    tokens = often.column("d1").to_numpy().view(np.uint64)
    hot_from = max(HOT_TOKEN[0], int((occurrences or 0) * HOT_TOKEN[1]))
    ordered = Order(tokens, often.column("n").to_numpy(), num, den, hot_from)
    order = spark.sparkContext.broadcast(ordered)
    classes = store.put(described.filter("n > 0 AND id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))

    postings = texts.mapInArrow(_postings(words, order), "token long, d1 long, salt int").repartition("token", "salt").dropDuplicates(["token", "salt", "d1"])
    postings = postings.withColumn("met", F.count("*").over(Window.partitionBy("token", "salt")))
    postings = store.put(postings.filter("met > 1 OR salt > 0"))
    staged = postings
    if len(ordered.hot):
        hot = postings.filter("salt > 0").groupBy("token").agg(F.count("*").alias("all"))
        postings = postings.join(F.broadcast(hot), "token", "left").withColumn("met", F.coalesce("all", "met")).filter("met > 1")
    common = postings.filter(F.col("met") > SMALL)
    info = classes.select("d1", "n", "rep").join(common.groupBy("d1").agg(F.count("*").alias("common")), "d1", "left").fillna(0, ["common"])
    info = store.put(info)

    def asked(size):
        return F.least(F.greatest(*[F.when(size >= at, m).otherwise(1) for at, m in LEAST_MATCHES]), F.ceil(size * num / den))

    pairs = F.expr("flatten(transform(ds, (x, i) -> transform(slice(ds, i + 2, size(ds)), y -> struct(least(x, y) AS a, greatest(x, y) AS b))))")
    counted = postings.filter(F.col("met") <= SMALL).groupBy("token").agg(F.collect_list("d1").alias("ds")).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("both"))
    side = lambda x: info.select(F.col("d1").alias(x), F.col("n").alias(f"n_{x}"), F.col("common").alias(f"c_{x}"))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    candidates = counted.join(side("a"), "a").join(side("b"), "b").filter((large * num <= small * den) & (F.col("both") + F.least("c_a", "c_b") >= asked(small))).select("a", "b")
    # A partner's set has at least needed(n) members and asks for the matches of that size at least.
    rarest = F.row_number().over(Window.partitionBy("d1").orderBy("met", "token"))
    ties = common.select("token", "d1", "met").join(info.filter("common > 0").select("d1", "n", F.col("common").alias("own")), "d1").withColumn("at", rarest)
    ties = store.put(ties.filter(F.col("at") <= F.col("own") + 1 - asked(F.ceil(F.col("n") * num / den))).select("token", "d1"))
    pivots = store.put(ties.groupBy("token").agg(F.min("d1").alias("pivot"), F.count("*").alias("users")).filter("users > 1"))
    ties = join_hot(ties, pivots, ["token"], F.col("users"), max(1, ties.count())).filter("d1 != pivot").select(F.col("pivot").alias("a"), F.col("d1").alias("b")).distinct()
    grouped = components(candidates.union(ties), store).select(F.col("node").alias("d1"), F.col("component").alias("cell"))
    members = store.put(grouped.join(info.select("d1", "n", "rep"), "d1"))
    store.drop(staged)
    big = lambda w, m: (w > GROUP_WEIGHT) | (m > GROUP_DOCS)
    weights = members.groupBy("cell").agg(F.sum("n").alias("w"), F.count("*").alias("m"))
    large_cells = weights.filter(big(F.col("w"), F.col("m"))).select("cell", F.lit(True).alias("large"))
    # Sizes that can link differ by den / num at most (with num = den they are equal, and each size is a band).
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + 1e-9).cast("int") if num < den else 2 * F.col("n").cast("int")
    banded = members.join(large_cells, "cell", "left").withColumn("band", F.explode(F.when(F.col("large"), F.array(band, band + 1)).otherwise(F.array(F.lit(0)))))
    banded = store.put(banded.select("cell", "band", "rep", "d1", "n"))
    weights = store.put(banded.groupBy("cell", "band").agg(F.sum("n").alias("w"), F.count("*").alias("m")).filter("m > 1"))
    per_block = F.greatest(F.lit(BLOCK_DOCS[0]), F.least(F.lit(BLOCK_DOCS[1]), F.ceil(F.col("m") / 4)))
    by_docs = F.when(F.col("m") > GROUP_DOCS, F.ceil(F.col("m") / per_block)).otherwise(1)
    blocks = F.greatest(F.ceil(F.col("w") / GROUP_WEIGHT), by_docs).cast("int").alias("blocks")
    in_cells = join_hot(banded, weights, ["cell", "band"], F.col("m"), max(1, total)).select("rep", "d1", F.struct("cell", "band", blocks).alias("c"))
    # A document is in one group and, if that is large, in two bands of it.
    listed = in_cells.groupBy("rep", "d1").agg(F.collect_list("c").alias("cells"))
    dealt = texts.join(listed, texts["__id"] == listed["rep"]).select("__text", "d1", "cells").mapInArrow(_dealt(words, order), "cell long, band int, x int, y int, block int, d1 long, p int, m int, members binary")
    dealt = dealt.repartition("cell", "band", "x", "y").sortWithinPartitions("cell", "band", "x", "y")
    links = store.put(dealt.mapInArrow(_verified(num, den), "a long, b long"))
    # Classes are the nodes; a component's name is the smallest id of its classes.
    groups = components(links, store)
    rooted = store.put(classes.join(groups, classes["d1"] == groups["node"], "left").select("d1", "d2", "n", "rep", "copies", F.coalesce("component", "d1").alias("root")))
    roots = store.put(rooted.groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("classes")))
    named = join_hot(rooted, roots, ["root"], F.col("classes"), max(1, total)).select("d1", "d2", "n", "copies", "component", "root")
    own = described.filter("n > 0 AND id IS NOT NULL")
    grouped = join_hot(own, store.put(named), ["d1", "d2", "n"], F.col("copies"), total)
    alone = described.filter("n = 0 OR id IS NULL").withColumns({"copies": F.lit(1).cast("long"), "component": F.col("id"), "root": F.lit(None).cast("long")})
    return grouped.unionByName(alone).select("id", "n", "component", F.col("copies").alias("class_size"), "key", "root")


def drop_similar(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with all columns: that of the smallest id (of rows that share it, of the smallest text hash).

    Rows with a null id and rows without words are groups of their own and stay. Ids needn't be unique: rows are told
    apart by id and text; of rows that repeat both, any one stays if they have words.
    """
    store = Staging(docs.sparkSession, "similar")
    rows = store.put(_grouped(docs, words, num, den, id_col, text_col).filter("id IS NOT NULL AND n > 0").select("id", "key", "component", "root"))
    # Only rows that have their component's id can stay; where there are several, that of the smallest key.
    first = rows.filter("id = component").groupBy("root").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last").select("root", "first")
    other = rows.filter("id = component").join(F.broadcast(first) if first.count() < 10_000 else first, "root").filter(F.col("key") != F.col("first")).select(*rows.columns)
    gone = rows.filter("id != component").unionByName(other)
    gone = gone.select(F.col("id").alias("__gone"), F.col("key").alias("__key")).distinct()
    kept = docs.join(gone, (docs[id_col] == gone["__gone"]) & (F.xxhash64(docs[text_col]) == gone["__key"]), "left_anti")
    repeated = rows.groupBy("id", "key").count().filter("count > 1").limit(1).count()
    if not repeated:
        return kept
    # A row that repeats another can't be told from it: rows with words are made distinct by id and text.
    named = kept.withColumns({"__words": F.col(id_col).isNotNull() & F.coalesce(F.regexp_like(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]")), F.lit(False)), "__key": F.xxhash64(text_col)})
    single = named.filter("__words").dropDuplicates([id_col, "__key"])
    return single.unionByName(named.filter(~F.col("__words"))).select(*docs.columns)
