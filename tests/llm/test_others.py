"""Vectors, archives and the pipeline."""

import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumagrid.llm import embedding_dedup, joins, warc
from lumagrid.llm.common import Staging

from ..conftest import DATA


def brute(vectors, threshold):
    ok = {}
    for i, v in vectors:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            ok[i] = x / np.linalg.norm(x)
    links = {i: {j for j in ok if j != i and len(ok[j]) == len(ok[i]) and float(ok[i] @ ok[j]) >= threshold} for i in ok}
    return ok, links


def near(rng, dim, cosine):
    a = rng.standard_normal(dim)
    a /= np.linalg.norm(a)
    b = rng.standard_normal(dim)
    b -= (b @ a) * a
    b /= np.linalg.norm(b)
    return a, cosine * a + math.sqrt(1 - cosine * cosine) * b


def test_vectors(spark):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(150):
        for v in near(rng, 64, rng.uniform(0.85, 0.99)):
            rows.append((len(rows), v.tolist()))
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, None), (1003, [0.0] * 64), (1004, [float("nan")] * 64), (1005, [None] * 64), (1006, []), (1007, [1.0, 2.0]), (1008, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, label string, n long").withColumnRenamed("n", "cell")
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df).collect()}
    ok, links = brute(rows, 0.9)
    assert set(got) == {i for i, _ in rows}
    found, there = sum(got[i]["n_links"] for i in ok), sum(map(len, links.values()))
    assert 0.9 * there <= found <= there and all(got[i]["n_links"] <= len(links[i]) for i in ok)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (1002, 1003, 1004, 1005, 1006))
    assert got[1007]["n_links"] == got[1008]["n_links"] == 1 and got[1008]["component_id"] == 1007
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_vectors_in_many_cells_and_blocks(spark, monkeypatch):
    """Small cells and blocks: pairs are counted once, whichever tables they share."""
    monkeypatch.setattr(embedding_dedup, "CELL", 16)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    monkeypatch.setattr(embedding_dedup, "QUERIES", 3)
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((12, 64))
    rows = [(i, (centers[i % 12] + 0.04 * rng.standard_normal(64)).tolist()) for i in range(360)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    _, links = brute(rows, 0.9)
    assert all(got[i]["n_links"] <= len(links[i]) for i, _ in rows)
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * sum(map(len, links.values()))
    assert all(got[i]["component_id"] == i % 12 for i, _ in rows)


def test_calibration():
    half, asked = embedding_dedup.calibrate(0.9, 64)
    rng = np.random.default_rng(2)
    d, _ = embedding_dedup._directions(64, 0, 0)
    hits = sum((np.abs(d @ (a - b)) <= half).sum() >= asked for a, b in (near(rng, 64, 0.9) for _ in range(2000)))
    assert hits >= 0.97 * 2000


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in joins.components(spark.createDataFrame(edges, "a long, b long"), Staging(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
    assert joins.components(spark.createDataFrame([], "a long, b long"), Staging(spark, "t")).count() == 0


def test_components_of_a_star(spark, monkeypatch):
    """A node that has a third of all links and more."""
    monkeypatch.setattr(joins, "HOT_NODE", 500)
    monkeypatch.setattr(joins, "HOT_ROWS", 3)
    edges = [(0, i) for i in range(1, 1500)] + [(i, i + 1) for i in range(5000, 5100)] + [(1499, 5000)] + [(9000, 9001)]
    got = {r["node"]: r["component"] for r in joins.components(spark.createDataFrame(edges, "a long, b long"), Staging(spark, "t")).collect()}
    assert got == {i: 0 for i in [*range(1500), *range(5000, 5101)]} | {9000: 9000, 9001: 9000}


RECORDS = "record_id string, warc_type string, url string, at long, headers map<string,string>, payload binary, digest string"


def test_revisits(spark):
    rows = [
        ("a", "response", "http://Example.com:80/x/?b=2&utm_source=q&a=1#f", 10, {"etag": '"1"', "content-type": "text/html", "date": "d1"}, b"one", "D1"),
        ("b", "response", "https://www.example.com/x?a=1&b=2", 20, {"etag": '"2"'}, b"two", "D2"),
        ("r1", "revisit", "http://example.com/x?a=1&b=2", 15, {"etag": 'W/"1"', "date": "d2", "content-length": "0"}, None, None),
        ("r2", "revisit", "http://example.com/x?a=1&b=2", 25, {"etag": '"1"'}, None, None),
        ("r3", "revisit", "http://example.com/x?a=1&b=2", 10, {"etag": '"1"'}, None, None),
        ("r4", "revisit", "http://other.com/", 30, {}, None, "D1"),
        ("r5", "revisit", None, 30, {}, None, None),
        ("r6", "revisit", "http://example.com/x?a=1&b=2", None, None, None, None),
        ("r7", "revisit", "http://example.com/x?a=1&b=2", 26, None, None, "D2"),
        ("r7", "revisit", "http://example.com/x?a=1&b=2", 26, None, None, "D2"),
        ("n", "request", "http://other.com/", 1, {}, b"no", None),
    ]
    df = spark.createDataFrame([(*r[:3], r[3], *r[4:]) for r in rows], RECORDS).withColumn("at", F.timestamp_seconds("at")).withColumn("bucket", F.lit("clash"))
    for buckets, hot in ((1, 1), (3, 2), (256, 1000)):
        got = [(r["record_id"], r["outcome"], r["source_id"], r["payload"] and bytes(r["payload"]), r["headers"]) for r in warc.resolve_revisits(df, buckets, hot).collect()]
        merged = {"etag": 'W/"1"', "content-type": "text/html", "date": "d2"}
        assert sorted(got, key=str) == sorted(
            [("r1", "resolved", "a", b"one", merged), ("r2", "changed", "b", None, None), ("r3", "missing", None, None, None), ("r4", "missing", None, None, None), ("r5", "missing", None, None, None), ("r6", "missing", None, None, None)]
            + [("r7", "resolved", "b", b"two", {"etag": '"2"'})] * 2,
            key=str,
        )
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nETag: \"9\"\r\n\r\nbody"
    def record(kind, name, block):
        return b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <%s>\r\nWARC-Target-URI: http://a.b/\r\nWARC-Date: 2024-01-02T03:04:05Z\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, name, len(block), block)
    data = record(b"response", b"1", http) + record(b"revisit", b"2", b"HTTP/1.1 304 Not Modified\r\nETag: \"9\"\r\n\r\n")
    (tmp_path / "x.warc").write_bytes(data + b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\ncut")
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(data))
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r["record_id"], r["warc_type"], r["status"], bytes(r["payload"]), r["headers"]["etag"]) for r in rows) == sorted([("<1>", "response", 200, b"body", '"9"'), ("<2>", "revisit", 304, b"", '"9"')] * 2)


def test_a_hot_response(spark, monkeypatch):
    """A third of all revisits resolve to one response: its copies share them."""
    rows = [("a", "response", "http://h.com/", 1, {"etag": '"1"'}, b"body", "D")] + [(f"o{k}", "response", f"http://o.com/{k}", 1, {}, b"x", f"D{k}") for k in range(40)]
    rows += [(f"r{k}", "revisit", "http://h.com/", 2 + k, {"etag": '"1"'}, None, None) for k in range(200)] + [(f"s{k}", "revisit", f"http://o.com/{k % 40}", 5, {}, None, f"D{k % 40}") for k in range(80)]
    df = spark.createDataFrame(rows, RECORDS).withColumn("at", F.timestamp_seconds("at"))
    for hot in (1, 7, 50):
        got = warc.resolve_revisits(df, 4, hot).collect()
        assert len(got) == 280 and all(r["outcome"] == "resolved" for r in got)
        assert all(bytes(r["payload"]) == (b"body" if r["record_id"][0] == "r" else b"x") for r in got)


def test_damaged_archives(spark, tmp_path):
    """What is there before the damage comes out, and nothing else happens."""
    def record(name, extra, block=b"abc"):
        return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <%s>\r\n%s\r\n\r\n%s\r\n\r\n" % (name, extra, block)

    good = record(b"1", b"Content-Length: 3\r\nWARC-Date: 2024-01-02T03:04:05Z")
    big = record(b"big", b"Content-Length: 5000000", bytes(5_000_000))
    cases = {
        "date": (good + record(b"2", b"Content-Length: 3\r\nWARC-Date: yesterday") + good, ["<1>", "<2>", "<1>"]), "length": (good + record(b"2", b"Content-Length: many") + good, ["<1>"]),
        "cut": (good + good[:40], ["<1>"]), "empty": (b"", []), "noise": (b"no archive at all", []), "large": (big + good + big, ["<big>", "<1>", "<big>"]),
    }
    for name, (data, want) in cases.items():
        for pack in (lambda x: x, gzip.compress, lambda x: b"".join(gzip.compress(p) for p in (x[:100], x[100:]))):
            assert [r["record_id"] for r in warc.parse_warc(pack(data))] == want, name
    whole = gzip.compress(good) + gzip.compress(good)
    assert [r["record_id"] for r in warc.parse_warc(whole[:-20])] in (["<1>"], ["<1>", "<1>"])
    damaged = gzip.compress(good) + b"\x1f\x8b" + b"\xff" * 50
    assert [r["record_id"] for r in warc.parse_warc(damaged)] == ["<1>"]
    (tmp_path / "a.warc").write_bytes(cases["date"][0])
    (tmp_path / "b.warc.gz").write_bytes(whole[:-20])
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert len(got) >= 4 and sum(r["at"] is None for r in got) == 1


def test_pipeline(spark, odd):
    import corpus_pipeline as p

    from .test_texts import brute_cut, brute_groups, check_packing

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    store = Staging(spark, "t")
    kept = [docs]
    for _, stage in p.STAGES[:-1]:
        kept.append(store.put(stage(spark, kept[-1], DATA)))
        assert kept[-1].columns == docs.columns
    rows = [[(r["doc_id"], r["text"]) for r in k.collect()] for k in kept]
    assert len(rows[1]) >= 0.7 * len(rows[0])
    first = {}
    for i, t in sorted(rows[1]):
        first.setdefault(" ".join(t.split()) if t.split() else t, i)
    assert {i for i, _ in rows[2]} <= {i for i, _ in rows[1]} and len(rows[2]) == len({__import__("re").sub("[\x20\x09-\x0d]+", " ", t) for _, t in rows[1]})
    groups = brute_groups(rows[2], 5, 4, 5)
    assert {i for i, _ in rows[3]} == {i for i, (_, c) in groups.items() if i == c}
    assert dict(rows[4]) == brute_cut(rows[3], 20)
    check_packing(p.STAGES[-1][1](spark, kept[-1], DATA).collect(), rows[4])
    assert p.run(spark, DATA).count() > 0


def test_entry_without_the_subpackage(tmp_path):
    """The other queries import when lumagrid.llm and corpus_pipeline.py are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/lumagrid", tmp_path / "lumagrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


@pytest.mark.parametrize("name", ["lumagrid/llm/registry.py", "corpus_pipeline.py"])
def test_no_swallowed_imports(name):
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert "ImportError" not in open(f"{root}/{name}").read() and "ModuleNotFound" not in open(f"{root}/{name}").read()


def test_windows_count_collisions():
    """The counters of bits against counting pair by pair."""
    rng = np.random.default_rng(3)
    for n, m, asked in ((70, 130, 20), (1, 5, 1), (2000, 64, 12), (3, 2, 32)):
        p, q = rng.standard_normal((32, n)), rng.standard_normal((32, m))
        p[:, :1] = q[:, :1]
        counts = sum((np.abs(p[j][:, None] - q[j][None, :]) <= 0.8).astype(int) for j in range(32))
        got = {(lo + a, b) for lo, i, k in embedding_dedup.Windows(q, 0.8).passing(p, asked) for a, b in zip(i.tolist(), k.tolist())}
        assert got == set(zip(*(x.tolist() for x in np.nonzero(counts >= asked))))


def test_vectors_that_share_an_id(spark):
    """Rows are the nodes; very long and very short vectors are compared too."""
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    cases = [[(1, v), (5, v), (3, w), (5, w)], [(1, [1e200, 0.0]), (2, [1e200, 1e190]), (3, [1e-300, 0.0]), (3, None)], [(7, v), (7, v), (7, w), (None, v)], [(1, [0.0, 1.0]), (2, [-0.0, 1.0])]]
    for rows in cases:
        got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
        unit = [None if i is None or x is None else np.array(x) / np.abs(x).max() / np.linalg.norm(np.array(x) / np.abs(x).max()) for i, x in rows]
        near = [[a != b and unit[a] is not None and unit[b] is not None and float(unit[a] @ unit[b]) >= 0.9 for b in range(len(rows))] for a in range(len(rows))]
        want = []
        for a, (i, _) in enumerate(rows):
            seen, new = {a}, {a}
            while new := {b for x in new for b in range(len(rows)) if near[x][b]} - seen:
                seen |= new
            ids = [rows[b][0] for b in seen if rows[b][0] is not None]
            want.append((i, sum(near[a]), min(ids, default=None), i == min(ids, default=None)))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_recall_at_the_threshold(spark, monkeypatch):
    """Pairs just over the threshold are linked, by cells and counts together."""
    for n in (20_000, 10**7, 10**9):
        bits, tables = embedding_dedup.plan_tables(n, 0.9)
        assert bits > 0 and 1 - (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** tables >= 0.995
    monkeypatch.setattr(embedding_dedup, "CELL", 256)  # as many cells as a larger table has
    rng = np.random.default_rng(12)
    a, b = rng.standard_normal((2, 1100, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= np.einsum("ij,ij->i", a, b)[:, None] * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.9005 * a + math.sqrt(1 - 0.9005**2) * b
    rows = [(2 * i + k, v.tolist()) for i in range(len(a)) for k, v in enumerate((a[i], near[i]))]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[2 * i] > 0 for i in range(len(a))) >= 0.98 * len(a)
