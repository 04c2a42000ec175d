"""Embedding near-dedup by collision-counting projections.

Vectors are scaled to length 1 and projected on PROJECTIONS random unit directions. Each projection is sorted; a
vector's window is what lies within half-width WINDOW (in standard deviations of a pair at the threshold) of it,
two places in the sorted order. Two vectors collide in a projection if the one is in the other's window. The
number of collisions that a pair has to have is calibrated: the largest count that a pair exactly at the
threshold reaches with probability COUNT_RECALL. Pairs that pass are verified by their cosine in double precision.

A window is kept as the difference of two prefixes of the sorted order, each a set of bits, and the windows of all
projections are added up in binary counters of such sets, so a pair costs a few bits of work a projection. One
projection's window holds a fixed share of all vectors; so that not all pairs are counted, vectors are first dealt
into cells by the signs of BITS further projections, for each of TABLES tables; BITS follows the number of vectors
(none for a few) and TABLES is what a pair at the threshold needs to share a cell with probability CELL_RECALL. A
pair counts in the first table in which its vectors share a cell, so it is never counted twice. Cells of over BLOCK
vectors are cut into blocks that meet two by two; only counts for each vector and spanning edges leave a task, never
pairs. Equal vectors are one class and count by their number; a class is exchanged once a table, as it is stored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging
from .joins import components, join_hot

PROJECTIONS = 32
WINDOW = 1.0
#: Together about 0.99 for a pair at the threshold, more above it.
COUNT_RECALL = 0.995
CELL_RECALL = 0.995
#: Mean vectors of a cell that BITS aims at.
CELL = 8192
BLOCK = 16384
#: Vectors whose windows are added up at once.
QUERIES = 1024
SEED = 20240


def calibrate(threshold: float, dim: int) -> tuple[float, int]:
    """(half-width of the window, collisions asked for).

    The difference of two unit vectors at the threshold has length sqrt(2 - 2 t); its projection on a random
    unit direction is close to normal with that over sqrt(dim) as deviation.
    """
    half = WINDOW * math.sqrt(max(0.0, 2 - 2 * threshold) / dim)
    p = math.erf(WINDOW / math.sqrt(2))
    tail, k = 0.0, PROJECTIONS + 1
    while k > 0 and tail < COUNT_RECALL:
        k -= 1
        tail += math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)
    return half, k


def plan_tables(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a cell, number of tables) for n vectors."""
    bits = min(30, max(0, math.ceil(math.log2(max(1, n) / CELL))))
    apart = 1 - (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, 1 if apart == 0 else math.ceil(math.log(1 - CELL_RECALL) / math.log(apart))


def unit_vectors(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, vectors as stored, as float64 of length 1) of each length; rows that can't be compared are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values
    valid = flat.is_valid().to_numpy(zero_copy_only=False) if flat.null_count else None
    flat = flat.fill_null(0).to_numpy(zero_copy_only=False)
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == dim)
        at = offsets[rows][:, None] + np.arange(dim)
        raw = flat[at]
        x = raw.astype(np.float64)
        top = np.abs(x).max(axis=1)
        good = np.isfinite(top) & (top > 0) & np.isfinite(x).all(axis=1)
        if valid is not None:
            good &= valid[at].all(axis=1)
        rows, raw, x = rows[good], raw[good], x[good] / top[good][:, None]  # so that squares stay in range
        yield rows, raw, x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, d1, d2, dim, v): digest of the vector as it is; d1, d2 null if it can't be compared."""
    for b in batches:
        n = b.num_rows
        digest, dims = np.zeros((n, 2), np.int64), np.zeros(n, np.int32)
        for rows, raw, _ in unit_vectors(b.column("__v")):
            dims[rows] = raw.shape[1]
            for i, x in zip(rows.tolist(), raw + raw.dtype.type(0), strict=True):  # -0 counts as 0
                digest[i] = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64)
        none = dims == 0
        yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(digest[:, 0], mask=none), pa.array(digest[:, 1], mask=none), pa.array(dims), b.column("__v")], names=["id", "d1", "d2", "dim", "v"])


def _directions(dim: int, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + dim)
    d = rng.standard_normal((PROJECTIONS + bits * tables, dim))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    return d[:PROJECTIONS], d[PROJECTIONS:]


def _cell_codes(u: np.ndarray, directions: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The cell of each vector in each table."""
    signs = (u @ directions.T > 0).reshape(len(u), tables, bits)
    return (signs @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int32)


def _fixed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary."""
    x = np.ascontiguousarray(x)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.strides[0] if x.size else 0)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x.tobytes())])


def _celled(bits: int, tables: int, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each vector and table: the cell, and the vector with its cells of all tables; or the cells' sizes."""
        made: dict[int, np.ndarray] = {}
        sizes: dict[tuple, int] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                for rows, raw, u in unit_vectors(b.column("v")):
                    dim = raw.shape[1]
                    if dim not in made:
                        made[dim] = _directions(dim, bits, tables)[1]
                    codes = _cell_codes(u, made[dim], bits, tables)
                    if count_only:
                        for t in range(tables):
                            cells, n = np.unique(codes[:, t], return_counts=True)
                            for c, k in zip(cells.tolist(), n.tolist(), strict=True):
                                sizes[dim, t, c] = sizes.get((dim, t, c), 0) + k
                        if len(sizes) > 200_000:
                            yield _sizes(sizes)
                            sizes = {}
                        continue
                    take = pa.array(rows)
                    names, copies, code, vector = b.column("d1").take(take), b.column("copies").take(take), _fixed(codes), _fixed(raw)
                    for t in range(tables):
                        n = len(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(codes[:, t]), names, copies, code, vector], names=["dim", "t", "cell", "name", "copies", "codes", "v"])
        if count_only:
            yield _sizes(sizes)

    return run


def _sizes(sizes: dict[tuple, int]) -> pa.RecordBatch:
    keys = np.array(list(sizes), np.int32).reshape(-1, 3)
    return pa.RecordBatch.from_arrays([*(pa.array(keys[:, k]) for k in range(3)), pa.array(list(sizes.values()), pa.int64())], names=["dim", "t", "cell", "m"])


class Windows:
    """The windows of a set of vectors in its sorted projections, as sets of bits."""

    def __init__(self, p: np.ndarray, half: float):
        """p: (projection, vector)."""
        self.half, self.n, self.words = half, p.shape[1], -(-p.shape[1] // 64)
        self.order = np.argsort(p, axis=1, kind="stable")
        self.sorted = np.take_along_axis(p, self.order, axis=1)
        self.bit = np.uint64(1) << (np.arange(self.n, dtype=np.uint64) % np.uint64(64))

    def _prefixes(self, j: int) -> np.ndarray:
        """Row k: the vectors of the first k places of projection j."""
        out = np.zeros((self.n + 1, self.words), np.uint64)
        out[np.arange(1, self.n + 1), self.order[j] // 64] = self.bit[self.order[j]]
        return np.bitwise_or.accumulate(out, axis=0, out=out)

    def passing(self, p: np.ndarray, asked: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Query vectors p (projection, query) -> (first query, numbers of queries, vectors), QUERIES queries at a time,
        of the pairs with at least ``asked`` collisions."""
        queries = p.shape[1]
        parts = [(lo, min(queries, lo + QUERIES)) for lo in range(0, queries, QUERIES)]
        planes = max(1, (PROJECTIONS).bit_length())
        # Counters of a few parts are held together, so that prefixes are made once for them.
        together = max(1, 64_000_000 // max(1, QUERIES * self.words * 8 * planes))
        for first in range(0, len(parts), together):
            group = parts[first : first + together]
            counters = [[np.zeros((hi - lo, self.words), np.uint64) for _ in range(planes)] for lo, hi in group]
            for j in range(len(p)):
                prefix = self._prefixes(j)
                for (lo, hi), counter in zip(group, counters, strict=True):
                    left = np.searchsorted(self.sorted[j], p[j, lo:hi] - self.half, "left")
                    right = np.searchsorted(self.sorted[j], p[j, lo:hi] + self.half, "right")
                    carry = prefix[right] ^ prefix[left]
                    for plane in counter[: (j + 1).bit_length()]:
                        both = plane & carry
                        plane ^= carry
                        carry = both
            for (lo, _), counter in zip(group, counters, strict=True):
                # count >= asked, from the highest plane down.
                more, equal = np.zeros_like(counter[0]), np.full_like(counter[0], ~np.uint64(0))
                for k in range(planes - 1, -1, -1):
                    if asked >> k & 1:
                        equal &= counter[k]
                    else:
                        more |= equal & counter[k]
                        equal &= ~counter[k]
                more |= equal
                i, w = np.nonzero(more)
                bits = np.unpackbits(more[i, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                a, b = np.nonzero(bits)
                vector = w[a] * 64 + b
                real = vector < self.n
                yield lo, i[a[real]], vector[real]


class Forest:
    """Which vectors are known to be linked; each edge that joins two trees is kept."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, k: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[k]
            new = np.flatnonzero(a != b)
            if not len(new):
                return
            _, one = np.unique(np.minimum(a[new], b[new]) * len(self.root) + np.maximum(a[new], b[new]), return_index=True)
            parent: dict[int, int] = {}

            def top(x: int) -> int:
                while x in parent:
                    x = parent[x]
                return x

            for e in new[one].tolist():
                x, y = top(int(a[e])), top(int(b[e]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    self.edges.append((int(i[e]), int(k[e])))
            moved = np.arange(len(self.root))
            moved[list(parent)] = [top(x) for x in parent]
            self.root = moved[self.root]
            i, k = i[new], k[new]


def compare(a: dict, b: dict | None, table: int, half: float, asked: int, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of a block with itself (b is None) or of two blocks: (links of each row of a, of b, spanning edges).

    Pairs are counted by windows, those of an earlier table left out, the others verified.
    """
    other = a if b is None else b
    n = len(a["n"])
    left, right = np.zeros(n, np.int64), np.zeros(len(other["n"]), np.int64)
    forest = Forest(n if b is None else n + len(other["n"]))
    for lo, i, k in Windows(other["p"], half).passing(a["p"], asked):
        i = i + lo
        if b is None:
            i, k = i[i < k], k[i < k]
        for earlier in range(table):
            new = a["codes"][i, earlier] != other["codes"][k, earlier]
            i, k = i[new], k[new]
        if len(i) > 0.05 * QUERIES * len(other["n"]):
            near = (a["u"][lo : lo + QUERIES] @ other["u"].T)[i - lo, k] >= threshold
        else:
            near = np.zeros(len(i), bool)
            for at in range(0, len(i), 100_000):
                s = slice(at, at + 100_000)
                near[s] = np.einsum("ij,ij->i", a["u"][i[s]], other["u"][k[s]]) >= threshold
        i, k = i[near], k[near]
        left += np.bincount(i, other["n"][k], n).astype(np.int64)
        right += np.bincount(k, a["n"][i], len(right)).astype(np.int64)
        forest.add(i, k if b is None else k + n)
    return left, right, forest.edges


def _counted(bits: int, tables: int, threshold: float, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (dim, t, cell, x, y); what = 0: links of a vector, what = 1: an edge."""
        key, held = None, []

        def block(rows: list[tuple], dim: int) -> dict:
            x = np.frombuffer(b"".join(r[3] for r in rows), kind).reshape(len(rows), dim).astype(np.float64)
            x /= np.abs(x).max(axis=1)[:, None]
            u = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            codes = np.frombuffer(b"".join(r[2] for r in rows), np.int32).reshape(len(rows), tables)
            return {"names": np.array([r[0] for r in rows], np.int64), "n": np.array([r[1] for r in rows], np.int64), "codes": codes, "u": u, "p": np.ascontiguousarray(_directions(dim, bits, tables)[0] @ u.T)}

        def close() -> list[pa.RecordBatch]:
            if len(held) < 2:
                return []
            dim, t, _, x, y = key
            half, asked = calibrate(threshold, dim)
            first = block([r for r in held if r[4] == x], dim) if any(r[4] == x for r in held) else None
            second = None if x == y else block([r for r in held if r[4] == y], dim) if any(r[4] == y for r in held) else None
            if first is None or (x != y and second is None):
                return []
            left, right, edges = compare(first, second, t, half, asked, threshold)
            other = first if second is None else second
            names = np.concatenate([first["names"], other["names"]])
            counts = np.concatenate([left, right])
            some = np.flatnonzero(counts)
            all_names = first["names"] if second is None else names
            e = np.array(edges, np.int64).reshape(-1, 2)
            what = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(e), np.int32)])
            a = np.concatenate([names[some], all_names[e[:, 0]]])
            b = np.concatenate([np.zeros(len(some), np.int64), all_names[e[:, 1]]])
            return [pa.RecordBatch.from_arrays([pa.array(what), pa.array(a), pa.array(b), pa.array(np.concatenate([counts[some], np.zeros(len(e), np.int64)]))], names=["what", "a", "b", "n"])]

        for batch in batches:
            for dim, t, cell, x, y, name, n, codes, v, blk in zip(*(batch.column(c).to_pylist() for c in ("dim", "t", "cell", "x", "y", "name", "copies", "codes", "v", "block")), strict=True):
                if (dim, t, cell, x, y) != key:
                    yield from close()
                    key, held = (dim, t, cell, x, y), []
                held.append((name, n, codes, v, blk))
        yield from close()

    return run


def near_vectors(table: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Linked are pairs that are found with a cosine of at least threshold; vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, nor do vectors of different lengths. n_links counts rows, so an
    equal vector in another row is a link. Each row is a node of its own, also where rows share an id; a null id has no
    component and isn't linked. Other columns (labels too) are ignored; an empty table gives no rows.
    """
    spark = table.sparkSession
    store = Staging(spark, "vectors")
    kind = dict(table.dtypes)[id_col]
    number = "float" if dict(table.dtypes)[vector_col] == "array<float>" else "double"
    vector = table.select(F.col(id_col).alias("__id"), F.col(vector_col).cast(f"array<{number}>").alias("__v"))
    rows = store.put(vector.mapInArrow(_classes, f"id {kind}, d1 long, d2 long, dim int, v array<{number}>"))
    good = rows.filter("d1 IS NOT NULL AND id IS NOT NULL")
    classes = store.put(good.groupBy("d1", "d2", "dim").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    n, total = classes.agg(F.count("*"), F.sum("copies")).first()
    bits, tables = plan_tables(n, threshold)
    # The vector of a class is that of its smallest id; classes are named by half of their digest.
    named = good.select(F.col("id").alias("rep"), "d1", "d2", "dim", "v").join(classes, ["rep", "d1", "d2", "dim"]).dropDuplicates(["d1", "d2"]).select("d1", "copies", "v")
    named = store.put(named)
    sizes = store.put(named.mapInArrow(_celled(bits, tables, True), "dim int, t int, cell int, m long").groupBy("dim", "t", "cell").agg(F.sum("m").alias("m")))
    placed = named.mapInArrow(_celled(bits, tables, False), "dim int, t int, cell int, name long, copies long, codes binary, v binary")
    # Cells of over BLOCK vectors: at most n * tables / BLOCK, so they are few; all others are one block.
    large = sizes.filter(F.col("m") > BLOCK)
    dealt = placed.withColumn("blocks", F.lit(1))
    if large.limit(1).count():
        split = large.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).drop("m")
        dealt = placed.join(split, ["dim", "t", "cell"], "left").fillna(1, ["blocks"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("name"), "blocks").cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("dim", "t", "cell", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "name", "copies", "codes", "v", "block")
    dealt = dealt.repartition("dim", "t", "cell", "x", "y").sortWithinPartitions("dim", "t", "cell", "x", "y")
    found = store.put(dealt.mapInArrow(_counted(bits, tables, threshold, np.float32 if number == "float" else np.float64), "what int, a long, b long, n long"))
    counts = found.filter("what = 0").groupBy(F.col("a").alias("d1")).agg(F.sum("n").alias("links"))
    groups = components(found.filter("what = 1").select("a", "b"), store).withColumnRenamed("node", "d1")
    rooted = store.put(classes.join(counts, "d1", "left").join(groups, "d1", "left").select("d1", "d2", "dim", "rep", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "d1").alias("root")))
    roots = store.put(rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("classes")))
    known = store.put(join_hot(rooted, roots, ["root"], F.col("classes"), n or 1).select("d1", "d2", "dim", "copies", "n_links", "component_id"))
    own = join_hot(good.select("id", "d1", "d2", "dim"), known, ["d1", "d2", "dim"], F.col("copies"), total or 1).select("id", "n_links", "component_id")
    alone = rows.filter("d1 IS NULL OR id IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return own.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
