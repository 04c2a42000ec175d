"""Operators over documents: edge cases and brute-force versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumagrid.llm import bpe, exact_dedup, language, ngram_join, packing, quality, registry, shingles, substring_dedup, suffix_tree_lm

from ..conftest import DATA, same
from .conftest import prose

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
MODEL = bpe.Bpe(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
HF = Tokenizer.from_file(JSON)
HF.encode_special_tokens = True
PATTERN = public_tokenizers.PATTERN
PACKED = packing._encoder(open(JSON, encoding="utf-8").read(), PATTERN)
PARTS = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\r\n", "　", "\xa0", "'s", "'ll", "a", "B", "12", "é", "ß", "!", "...", "中", "😀", "\x1c", "\x85", "hello", "the", "_", "<|endoftext|>"]), max_size=30).map("".join)


def words(t):
    return [x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if x]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, DATA), duck, registry.ORACLE_SQL[name])


# ---- tokens


@settings(max_examples=300, deadline=None)
@given(PARTS)
def test_encoding_equals_the_libraries(text):
    want = TIKTOKEN.encode_ordinary(text)
    assert MODEL.encode(text).tolist() == want == MODEL.encode_batch([text, "x", text])[2].tolist()
    assert MODEL.decode(np.array(want, np.int64)) == text.encode()
    assert PACKED(text).tolist() == HF.encode(text, add_special_tokens=False).ids


def letters(seed, n, alphabet="abcdefghijklmnopqrstuvwxyz"):
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n))


LONG_PIECES = ["a" * 3000, "ab" * 2000, "aab" * 999, " " * 5000, "\n" * 700, "!" * 600, "=-" * 900, "in " * 4000, prose(5, 3000), prose(6, 900).replace(" ", ""), letters(1, 40_000), letters(2, 5000, "ab"), letters(3, 5000, "the"), letters(4, 3000, "中文字é"), letters(5, 3000, "=-*#_")]


@pytest.mark.parametrize("text", LONG_PIECES)
def test_long_pieces(text):
    assert MODEL.encode(text).tolist() == TIKTOKEN.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["ab", "in", "the", "=-", "aeiou", "stern"]), st.integers(1, 400), st.integers(0, 10**6))
def test_all_pairs_of_a_rank(alphabet, n, seed):
    """Rows that merge several pairs a round end like rows that merge one."""
    text = letters(seed, n, alphabet)
    assert MODEL.encode(text).tolist() == TIKTOKEN.encode_ordinary(text)


def test_known_chunks_are_bounded_in_bytes(monkeypatch):
    from lumagrid.llm import chunks

    monkeypatch.setattr(chunks, "CHUNK_BYTES", 20_000)
    model = bpe.Bpe(bpe.read_ranks(RANKS), PATTERN)
    for i in range(60):
        text = f"\t{letters(i, 3000)}  {prose(i, 50)}" if i % 2 else f"{letters(i, 9000)} {prose(i, 300)}"
        assert model.encode_batch([text])[0].tolist() == TIKTOKEN.encode_ordinary(text)
        held = sum(len(w) for names in (model.encoder.spaced, model.encoder.plain) for d in (names, names.old) for w in d)
        assert held <= 3 * 20_000 + len(text)


def test_unknown_ids():
    with pytest.raises(ValueError):
        MODEL.decode(np.array([10**6]))


def test_bpe_query(spark, odd, nothing):
    rows = bpe.encode_decode(odd, RANKS, public_tokenizers.PATTERN, keep_ids=True).collect()
    assert len(rows) == odd.count() and bpe.encode_decode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    texts = collections.Counter((r["doc_id"], r["text"] or "") for r in odd.collect())
    for r in rows:
        text = next(t for i, t in texts if i == r["doc_id"])
        ids = TIKTOKEN.encode_ordinary(text)
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode_ids(spark.createDataFrame([(r["doc_id"], r["ids"]) for r in rows], "doc_id long, ids array<int>"), RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r["decoded"]).decode() for r in back.collect()) == sorted(t for _, t in texts.elements())


def check_packing(rows, texts):
    sequences, documents = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        documents[r["doc_id"]].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for p in pieces:
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
    for doc, text in texts:
        ids = HF.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(documents[doc], key=lambda r: r["start"])
        at = 0
        for p in pieces:
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)


def test_packing(spark, odd, nothing):
    distinct = odd.dropDuplicates(["doc_id"]).cache()
    check_packing(packing.pack(distinct, JSON, PATTERN).collect(), [(r["doc_id"], r["text"]) for r in distinct.collect()])
    assert packing.pack(nothing, JSON, PATTERN).count() == 0 and packing.pack(odd, JSON, PATTERN).count() >= odd.count()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    check_packing(packing.pack(docs, JSON, PATTERN).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_levels_are_sum_of_squares():
    rng = random.Random(4)
    levels = packing.Levels(32, 0, max_open=20)
    for i in range(400):
        size = rng.randint(1, 70)
        rest = size % 32
        if rest:
            count, best = levels.count.copy(), None
            for h in range(0, 32 - rest + 1):
                if h and not count[h]:
                    continue
                c = count.copy()
                c[h] -= h > 0
                c[h + rest] += h + rest < 32
                value = int((c[1:32] ** 2).sum())
                best = value if best is None or value < best else best
            h = levels.choose(rest)
            c = count.copy()
            c[h] -= h > 0
            c[h + rest] += h + rest < 32
            assert int((c[1:32] ** 2).sum()) == best
        levels.add(i, np.arange(size, dtype=np.uint32))
        assert levels.n_open <= 20 and levels.n_open == sum(map(len, levels.open)) == levels.count[1:32].sum()
    before = levels.count[1:32] @ np.arange(1, 32)
    levels.settle(last=True)
    assert levels.n_open == 0 and levels.moved <= 20 * 32 * 400 and before >= 0
    used = collections.Counter()
    for _, _, length, _, _, sequence, _ in levels.take():
        used[sequence] += length
    assert all(n == 32 or n & (n - 1) == 0 for n in used.values()) and sum(n < 32 for n in used.values()) <= 5


def test_closing_moves_the_emptiest_only():
    """Of what is open at the end, the fullest windows keep their pieces whole."""
    rng = np.random.default_rng(3)
    levels = packing.Levels(1024, 0)
    sizes = rng.integers(1, 1024, 500)
    for i, n in enumerate(sizes):
        levels.add(i, np.full(n, i, np.uint32))
    there = int(levels.count[1:1024] @ np.arange(1, 1024))
    levels.settle(last=True)
    assert levels.moved <= 0.6 * there


def test_packing_ids_of_odd_texts():
    """Ids equal the library's on code, tables, long runs and long pieces, of every length around the fallback's."""
    rng = random.Random(6)
    code = "\n".join("    " * rng.randint(0, 5) + f"if x[{k}] == {rng.random():.4f}:\t# {prose(k, 4)}  |" for k in range(400))
    table = "\n".join("|".join(f" {rng.randint(0, 10**9):>12} " for _ in range(8)) for _ in range(300))
    runs = [a + c * n + b for c in (" ", "\n", "\t \n") for n in (2047, 4095, 4096, 4097, 9000) for a, b in (("", ""), ("x", "y"), ("x ", " "))]
    blob = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    for text in [code, table, *runs, blob, "中文" * 3000, "".join(chr(rng.randrange(1, 0xD800)) for _ in range(3000))]:
        assert PACKED(text).tolist() == HF.encode(text, add_special_tokens=False).ids


def test_packing_keeps_nothing_between_texts():
    """Memory stays bounded over 100,000 texts that no cutting at spaces suits."""
    import resource

    filler = "  \t" + prose(8, 100)
    PACKED(filler + "0")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    levels = packing.Levels(1024, 0)
    for i in range(100_000):
        levels.add(i, PACKED(f"{filler}{i}"))
        levels.take()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


# ---- copies


def test_exact(spark, odd, nothing):
    rows = exact_dedup.exact_groups(odd).collect()
    groups = collections.defaultdict(list)
    for r in odd.collect():
        groups[re.sub("[\x20\x09-\x0d]+", " ", r["text"] or "")].append(r["doc_id"])
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    assert exact_dedup.exact_groups(nothing).count() == 0
    kept = exact_dedup.drop_exact(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(min(i for i in ids if i is not None) if any(i is not None for i in ids) else None) for ids in groups.values())


def test_merge_over_many_runs(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('t', CASE WHEN id % 3 = 0 THEN 0 ELSE id % 97 END) AS text").repartition(37)
    for r in exact_dedup.exact_groups(docs).collect():
        same_text = [i for i in range(3000) if (0 if i % 3 == 0 else i % 97) == (0 if r["doc_id"] % 3 == 0 else r["doc_id"] % 97)]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (same_text[0], len(same_text), same_text[0] == r["doc_id"])


@pytest.mark.parametrize("rows", [
    [(0, "beta"), (1, "alpha"), (1, "beta")], [(3, "u"), (3, "u ")], [(1, "B"), (5, "A"), (5, "B")], [(None, "x"), (None, "x"), (2, "x")], [(None, "y"), (None, "y")],
    [(1, "a  b"), (1, "a b"), (1, "c"), (1, None), (1, "")], [(9, None), (4, ""), (4, "z"), (9, "z")],
])
def test_rows_that_share_an_id(spark, rows):
    """Of each text one row stays, whatever else its id has."""
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n long")
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    least = {}
    for i, t in rows:
        least[norm(t)] = min((x for x in (i, least.get(norm(t))) if x is not None), default=None)
    got = [(r["doc_id"], norm(r["text"])) for r in exact_dedup.drop_exact(docs).collect()]
    assert sorted(got, key=str) == sorted(((i, t) for t, i in least.items()), key=str)
    by_row = [r["n"] for r in exact_dedup.drop_exact(docs).collect()]
    assert len(by_row) == len(set(by_row))


def test_runs_are_sorted_and_merged(spark):
    plan = exact_dedup.merge_runs(spark.range(100).selectExpr("0 AS __run", "unhex(sha2(cast(id AS string), 256)) AS __sha", "id AS __bytes", "id AS __witness", "id AS __id", "1L AS __n"), 40)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in text and "HashAggregate" not in text and "Python" not in text
    with pytest.raises(Exception, match="one digest"):
        exact_dedup.merge_runs(spark.createDataFrame([(0, b"x", 1, 1, 1, 1), (1, b"x", 1, 2, 2, 1)], "__run int, __sha binary, __bytes long, __witness long, __id long, __n long"), 1).collect()


def brute_rows(rows, k, num, den):
    """(set size, smallest id reachable) of every row; rows are the nodes."""
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(zip(*(w[j:] for j in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else []))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and None not in (rows[a][0], rows[b][0]) and den * len(x & y) >= num * len(x | y):
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    least = {}
    for r, (i, _) in enumerate(rows):
        least[top(r)] = min((x for x in (i, least.get(top(r))) if x is not None), default=None)
    return [(len(sets[r]), least[top(r)]) for r in range(len(rows))]


def brute_groups(rows, k, num, den):
    return {i: x for (i, _), x in zip(rows, brute_rows(rows, k, num, den))}


SHARED = prose(31, 40)


@pytest.mark.parametrize("rows", [
    [(1, "B " + SHARED), (5, "A a a a"), (5, "B " + SHARED)], [(1, "A x y z"), (5, "A x y z"), (3, "B x y w"), (5, "B x y w")], [(2, "a b c"), (2, "a b c"), (2, "q r s"), (None, "a b c"), (None, "a b c"), (7, None), (7, ""), (7, None)],
    [(1, SHARED + " end"), (5, SHARED), (3, "else " + prose(40, 30)), (5, "else " + prose(40, 30) + " x"), (5, "third one is here")],
])
def test_similar_rows_that_share_an_id(spark, rows):
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, component long")
    want = brute_rows(rows, 3, 9, 10)
    got = ngram_join.jaccard_groups(docs, 3, 9, 10).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == sorted((str(i), n, str(c)) for (i, _), (n, c) in zip(rows, want))
    kept = [r["component"] for r in ngram_join.drop_similar(docs, 3, 9, 10).collect()]
    alone = [k for k, ((i, _), (n, _)) in enumerate(zip(rows, want)) if i is None or n == 0]
    assert set(alone) <= set(kept) and len(kept) == len(set(kept))
    # One row of every group, and it has the group's id.
    groups = {}
    nodes = brute_rows([(k, t) if i is not None else (None, t) for k, (i, t) in enumerate(rows)], 3, 9, 10)
    for k in set(range(len(rows))) - set(alone):
        groups.setdefault(nodes[k][1], []).append(k)
    for members in groups.values():
        (stays,) = [k for k in kept if k in members]
        assert rows[stays][0] == min(rows[k][0] for k in members)


@pytest.mark.parametrize("num, den", [(1, 50), (1, 1), (1, 3)])
def test_extreme_thresholds(spark, monkeypatch, num, den):
    monkeypatch.setattr(ngram_join, "GROUP_DOCS", 7)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", (3, 5))
    rng = random.Random(den)
    rows = [(k, prose(rng.randrange(6), rng.choice([1, 3, 45, 46, 90])) + rng.choice(["", " xq", " zz vv"])) for k in range(70)]
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, num, den).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(rows, 3, num, den)


@pytest.mark.parametrize("k, num, den", [(3, 90, 100), (5, 4, 5)])
def test_similar(spark, k, num, den):
    rng = random.Random(9)
    rows = []
    for g in range(25):
        base = prose(100 + g, rng.choice([1, 2, 4, 30, 90, 200, 700])).split()
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice("xq zz vv kk".split())
            rows.append((len(rows), " ".join(w)))
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(rows, k, num, den)


def test_similar_edges(spark, odd, nothing):
    got = ngram_join.jaccard_groups(odd, 3, 90, 100).collect()
    assert len(got) == odd.count() and ngram_join.jaccard_groups(nothing, 3, 90, 100).count() == 0
    want = brute_groups([(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None], 3, 90, 100)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert ngram_join.drop_similar(odd).columns == odd.columns


@pytest.mark.parametrize("frequent", [8, 10**9])
@pytest.mark.parametrize("hot", [(1, 1e-9), (50_000, 1e-4)])
def test_common_shingles_tie_what_links(spark, monkeypatch, frequent, hot):
    """Passages that many otherwise unlike documents share, with hot shingles dealt into parts or not, in any order."""
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "HOT_TOKEN", hot)
    rng = random.Random(31)
    passages = [prose(900 + i, 40) for i in range(5)]
    rows = []
    for g in range(30):
        base = f"{prose(300 + g, rng.choice([2, 20, 60, 150]))} {rng.choice(passages)} {rng.choice(passages)}".split()
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice("xq zz vv kk".split())
            rows.append((len(rows), " ".join(w)))
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 4, 5).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(rows, 3, 4, 5)


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_DOCS", 7)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", (4, 6))
    rng = random.Random(2)
    base = prose(77, 150).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(150)] = rng.choice("xq zz vv kk".split())
        rows.append((i, " ".join(w)))
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(rows, 3, 90, 100)


def test_prefixes_always_meet():
    """The claim behind the prefixes, on random sets and frequencies."""
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        t = np.unique(np.where(rng.random(len(s)) < 0.05, rng.integers(0, 2**63, len(s)).astype(np.uint64), s))
        heavy = rng.choice(s, max(1, len(s) // 3))
        order = ngram_join.Order(np.unique(heavy), rng.integers(8, 500, len(np.unique(heavy))), 9, 10)
        if 10 * len(np.intersect1d(s, t)) >= 9 * len(np.union1d(s, t)):
            (a, p, m), (b, q, k) = order.prefix(s), order.prefix(t)
            assert len(np.intersect1d(a[:p], b[:q])) >= min(m, k)
        whole, partly = order.prefix(s, whole=True), order.prefix(s)
        assert whole[1:] == partly[1:] and (whole[0][: whole[1]] == partly[0][: partly[1]]).all()


def test_shingle_sets():
    texts = ["", " ", "a", "A b", "a  b\n", "a b c", "a b c d\x0b", "a\xa0b c"]
    sizes = [len(x) for x in shingles.shingle_sets(texts, 3)]
    assert sizes == [0, 0, 1, 1, 1, 1, 2, 1]
    a, b = (next(shingles.shingle_sets([t], 3))[0] for t in ("A b", "a  b\n"))
    assert a == b


# ---- passages


def mixed(x):
    x = ((x ^ x >> 29) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ x >> 32) * 0x94D049BB133111EB) % 2**64
    return x ^ x >> 29


def word_number(word):
    """What decides where long sentences are cut: a polynomial over the lower-cased characters."""
    total = 0
    for k, c in enumerate(word):
        low = c.lower() if len(c.lower()) == 1 else c
        total += mixed((ord(low) + 0x9E3779B97F4A7C15) % 2**64) * pow(0x9E3779B97F4A7C15, k, 2**64)
    return mixed(total % 2**64)


def brute_units(text):
    """Units by their definition, word by word: (start, end, start of the next)."""
    ends = [(m.start() + (text[m.start()] != "\n"), m.end()) for m in re.finditer(r"[.!?]\s+|\n\s*", text)]
    sentences, at = [], len(text) - len(text.lstrip())
    for end, following in [*ends, (len(text), len(text))]:
        if end >= at and text[at:end].strip():
            sentences.append((at, end, following))
            at = following
        elif end >= at or following > at:
            at = max(at, following)
    out = []
    for start, end, following in sentences:
        found = [(m.start(), m.end()) for m in re.finditer(r"\S+", text[start:end])]
        h = [word_number(text[start + a : start + b]) for a, b in found]
        cuts, last = [], -99
        for i in range(4, len(h) - 4) if len(h) > 16 else ():
            if i - last > 4 and all(h[i] < x for x in h[i - 4 : i]) and all(h[i] <= x for x in h[i + 1 : i + 5]):
                cuts.append(i)
                last = i
        base = start
        for i in cuts:
            out.append((start, base + found[i][1], base + found[i + 1][0]))
            start = out[-1][2]
        out.append((start, end, following))
    return out


def brute_cut(rows, least):
    """Texts without the runs of repeated units, from the definitions: the earliest occurrence of each normalised unit stays."""
    spans = {i: brute_units(t or "") for i, t in rows}
    norm = lambda t, u: " ".join(t[u[0] : u[1]].lower().split())
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for k, u in enumerate(spans[i]):
            first.setdefault(norm(t, u), (i, k))
    out = {}
    for i, t in rows:
        if not t:
            out[i] = t
            continue
        again = [first[norm(t, u)] != (i, k) for k, u in enumerate(spans[i])]
        drop, k = set(), 0
        while k < len(again):
            end = k
            while end < len(again) and again[end]:
                end += 1
            if end > k and sum(len(t[a:b].split()) for a, b, _ in spans[i][k:end]) >= least:
                drop |= set(range(k, end))
            k = max(end, k + 1)
        text, at = "", 0
        for k, u in enumerate(spans[i]):
            if k in drop:
                if k - 1 not in drop:
                    text += t[at : u[0]]
                    cut_from = u[0]
                if k + 1 not in drop:
                    at = u[2]
                    if "\n" in t[cut_from:at] and at < len(t) and text and not text.endswith("\n"):
                        text += "\n"
        out[i] = text + t[at:]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["one ", "two ", "Three. ", "four\n", " \n\n", "five! ", "six? seven ", "a.b ", "end.", "x y z w v u t s r q p o n m ", "ß é\t"]), max_size=25).map("".join))
def test_units_by_definition(text):
    got = substring_dedup.Units(["x", text, "", text]).spans(1)
    want = brute_units(text)
    assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in want]
    assert [text[a:b].split() for a, b, _ in got] == [text[a:b].split() for a, b, _ in want]


def test_units_of_long_texts(monkeypatch):
    """Cutting a text into parts for the scan changes nothing; digests follow the words alone."""
    text = "\n".join(prose(k, 50) + random.Random(k).choice([".", "", "!  ", "\U0001F600"]) for k in range(60))
    whole = substring_dedup.Units([text, text.upper().replace(" ", "  "), prose(2, 30)])
    monkeypatch.setattr(substring_dedup, "SLICE", 97)
    parts = substring_dedup.Units([text, text.upper().replace(" ", "  "), prose(2, 30)])
    for name in ("start", "end", "following", "words", "d1", "d2", "earliest", "owner"):
        assert (getattr(whole, name) == getattr(parts, name)).all()
    one, two = (whole.owner == 0), (whole.owner == 1)
    assert (whole.d1[one] == whole.d1[two]).all() and (whole.d2[one] == whole.d2[two]).all() and len(set(whole.d1.tolist())) > 60


@pytest.mark.parametrize("least", [1, 20])
def test_substring_of_any_length(spark, least):
    """With min_words=1 every repeated unit goes, however short."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs, min_words=least).collect()}
    assert {i: r["text"] for i, r in got.items()} == brute_cut(rows, least)
    if least == 1:
        left = collections.Counter(" ".join(r["text"][a:b].lower().split()) for r in got.values() if r["text"] for a, b, _ in brute_units(r["text"]))
        whole = collections.Counter(" ".join(t[a:b].lower().split()) for _, t in rows if t for a, b, _ in brute_units(t))
        assert sum(n - 1 for n in left.values()) < 0.02 * sum(n - 1 for n in whole.values())  # some are made anew where texts were cut


def test_passages_of_rows_without_id(spark):
    passage = ". ".join(prose(80 + k, 9) for k in range(5)) + "."
    docs = spark.createDataFrame([(None, f"{prose(k, 30)}. {passage}") for k in range(3)], "doc_id long, text string")
    got = [r["text"] for r in substring_dedup.dedup_substrings(docs).collect()]
    assert sum(passage in t for t in got) == 1


def test_substring(spark, odd, nothing):
    passage = ". ".join(prose(50 + k, 9) for k in range(8))
    rows = [(k, f"{prose(k, 40)} {passage} {prose(k + 500, 40)}.\nLast line {k}.") for k in range(6)] + [(6, "Short. Short. Short."), (7, prose(900, 60) + "\n" + prose(900, 60)), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs).collect()}
    assert {i: r["text"] for i, r in got.items()} == brute_cut(rows, substring_dedup.MIN_WORDS)
    inner = passage.split(". ", 1)[1].rsplit(". ", 1)[0]
    assert [inner in got[k]["text"] for k in range(6)] == [True] + [False] * 5
    for k in range(1, 6):
        text, (span,) = dict(rows)[k], got[k]["removed_spans"]
        assert inner in text[span["start"] : span["stop"]] and got[k]["removed_chars"] == span["stop"] - span["start"]
    assert got[6]["text"] == rows[6][1] and got[7]["text"].count(prose(900, 60)) == 1 and got[8]["text"] is None
    assert substring_dedup.dedup_substrings(nothing).count() == 0 and substring_dedup.dedup_substrings(odd).count() == odd.count()


def test_runs_of_many_sources(spark):
    """Eight sentences that eight documents had first are cut together."""
    parts = [prose(300 + k, 12) + f" source{k}" for k in range(8)]
    rows = [(k, f"{prose(k, 30)} a{k}. {p}. {prose(k + 40, 30)} b{k}.") for k, p in enumerate(parts)] + [(k, f"Own start {k}. " + ". ".join(parts) + f". Own end {k}.") for k in (8, 9)]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_cut(rows, substring_dedup.MIN_WORDS) and got[0] == rows[0][1]
    assert [got[8], got[9]] == ["Own start 8. Own end 8.", "Own start 9. Own end 9."]


def test_passages_inside_sentences(spark):
    """A passage without any sentence end, inside other words, is cut out but for a few words at its ends."""
    for seed in range(20):
        passage = prose(600 + seed, 60)
        rows = [(k, f"{prose(k + 7 * seed, 21 + k)} x{k} {passage} y{k} {prose(k + 700, 23)}.") for k in range(3)]
        out = brute_cut(rows, substring_dedup.MIN_WORDS)
        assert out[0] == rows[0][1] and all(len(out[k].split()) <= len(rows[k][1].split()) - 30 for k in (1, 2))
        assert all(out[k].startswith(rows[k][1].split(passage)[0]) and out[k].endswith(rows[k][1].split(passage)[1]) for k in (1, 2))
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == out


# ---- models


def test_language(spark, odd, nothing):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language.identify(spark, docs).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)
    got = language.identify(spark, odd).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (4, 5, 6, 7, 12)} == {"und"}
    assert language.identify(spark, nothing).count() == 0
    assert {r["lang_pred"] for r in language.identify(spark, odd.filter("lang IS NULL")).collect()} == {"und"}


def brute_mixture(m, codes, penalty=language.PENALTY, rounds=language.ROUNDS):
    """The same inference with loops over plain Python floats."""
    k = len(m.langs)
    p = [[float(m.p[l][c]) for c in codes] for l in range(k)]

    def fit(ls, w):
        for _ in range(rounds):
            new = [0.0] * len(ls)
            for j in range(len(codes)):
                whole = sum(w[a] * p[l][j] for a, l in enumerate(ls))
                for a, l in enumerate(ls):
                    new[a] += w[a] * p[l][j] / whole
            new = [x / len(codes) for x in new]
            moved = max(abs(a - b) for a, b in zip(new, w))
            w = new
            if moved < 1e-3:
                break
        return w, sum(math.log(sum(w[a] * p[l][j] for a, l in enumerate(ls))) for j in range(len(codes)))

    w, _ = fit(list(range(k)), [1 / k] * k)
    order = sorted(range(k), key=lambda l: -w[l])
    tried = []
    for size in range(1, k + 1):
        some = order[:size]
        if size > 1 and w[some[-1]] < 1e-3:
            break
        v, like = fit(some, [w[l] / sum(w[x] for x in some) for l in some])
        tried.append((like - penalty * math.log(len(codes)) * size, some, v))
        if size > 2 and tried[-1][0] <= max(t[0] for t in tried[:-1]):
            break
    _, some, v = max(tried, key=lambda t: t[0])
    return m.langs[some[v.index(max(v))]], max(v) / sum(v)


def test_mixtures_against_loops():
    rng = np.random.default_rng(11)
    counts = rng.gamma(0.3, 40, (4, language.BUCKETS))
    m = language.Mixture(["a", "b", "c", "d"], counts)
    for n, shares in ((40, [1, 0, 0, 0]), (200, [0.6, 0.4, 0, 0]), (300, [0.5, 0.3, 0.2, 0]), (90, [0.1, 0.1, 0.1, 0.7])):
        codes = np.concatenate([rng.choice(language.BUCKETS, int(n * s), p=m.p[l] / m.p[l].sum()) for l, s in enumerate(shares)])
        lang, share = m.infer(codes)
        want, other = brute_mixture(m, codes.tolist())
        assert lang == want and abs(share - other) < 0.01


def test_mixture_of_two():
    rng = np.random.default_rng(1)
    counts = np.zeros((3, language.BUCKETS))
    for k in range(3):
        counts[k, k * 100 : k * 100 + 400] = 1000
    m = language.Mixture(["a", "b", "c"], counts)
    codes = np.concatenate([rng.integers(0, 100, 700), rng.integers(500, 600, 300)])
    lang, share = m.infer(codes)
    assert lang == "a" and abs(share - 0.7) < 0.05
    assert m.infer(rng.integers(0, 100, 900)) == ("a", 1.0)


def brute_lm(rows):
    c = collections.Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    return {i: (len(words(t)) + 1, sum(x in c for x in [*words(t), None]), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*words(t), None])) for i, t in rows}


def test_language_model(spark, odd, nothing):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for table in (docs, odd):
        want = brute_lm([(r["doc_id"], r["text"]) for r in table.collect()])
        rows = suffix_tree_lm.score_texts(spark, table).collect()
        assert len(rows) == table.count()
        for r in rows:
            a = want[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == a[:3] and math.isclose(r["base_score"], a[3], rel_tol=1e-9)
            assert r["score"] <= 0
        if table is docs:
            held = [r for r in rows if r["held_out"]]
            assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert suffix_tree_lm.score_texts(spark, nothing).count() == 0


def brute_tree(rows, order=4, weight=10.0, divergence=1.0):
    """(log10 of each row's text, counts, retained contexts) with plain dictionaries."""
    seqs = [(i is not None and zlib.crc32(str(i).encode()) % 7 != 2, [*words(t), "\n"]) for i, t in rows]
    grams = collections.Counter(tuple(s[k : k + n]) for learn, s in seqs if learn for n in range(1, order + 2) for k in range(len(s) - n + 1))
    total, distinct = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
    root = lambda x: (grams[(x,)] + 1) / (total + distinct + 1)
    gain = collections.Counter()
    for learn, s in seqs:
        for k, x in enumerate(s if learn else ()):
            for o in range(1, min(order, k) + 1):
                c, n = grams[tuple(s[k - o : k])], grams[tuple(s[k - o : k + 1])]
                if c >= 2:
                    shorter = root(x) if o == 1 else (grams[tuple(s[k - o + 1 : k + 1])] - 1 + weight * root(x)) / (grams[tuple(s[k - o + 1 : k])] - 1 + weight)
                    gain[tuple(s[k - o : k])] += math.log((n - 1 + weight * shorter) / (c - 1 + weight) / shorter)
    kept = {s for s, g in gain.items() if g > divergence}
    unsure = {s for s, g in gain.items() if abs(g - divergence) < 1e-4}

    def probability(before, x):
        p = root(x)
        for o in range(1, min(order, len(before)) + 1):
            s = tuple(before[-o:])
            if s in kept:
                p = (grams[(*s, x)] + weight * p) / (grams[s] + weight)
        return p

    return [sum(math.log10(probability(s[:k], x)) for k, x in enumerate(s)) for _, s in seqs], probability, kept, unsure, grams


@pytest.mark.parametrize("chunk", [50, 2_500_000])
def test_tree_against_dictionaries(spark, monkeypatch, chunk):
    """Passages of two documents among other text, contexts of up to four tokens, many chunks and one."""
    monkeypatch.setattr(suffix_tree_lm, "CHUNK", chunk)
    passage = " ".join(f"rare{k}" for k in range(30))
    rows = [(k, prose(k, 60)) for k in range(1, 41)] + [(k, f"{prose(k, 20)} {passage} {prose(k + 1, 20)}") for k in (101, 102, 103, 103)] + [(None, passage), (104, passage[:60]), (105, "w1 w2 w3 w4 w5 " * 5), (106, "x w2 w3 w4 w5 y " * 3), (107, None), (108, "A a\tA")]
    want, probability, kept, unsure, grams = brute_tree(rows)
    assert {len(s) for s in kept} == {1, 2, 3, 4} and not unsure
    got = suffix_tree_lm.score_texts(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert any(i == r["doc_id"] and math.isclose(r["score"], w, rel_tol=1e-9, abs_tol=1e-9) for (i, _), w in zip(rows, want)), r
    (rare,) = [r for r in got if r["doc_id"] is None]
    assert rare["score"] > 0.6 * rare["base_score"]
    # At every state the probabilities of all tokens and of one unknown token add up to 1.
    names = [g[0] for g in grams if len(g) == 1]
    for before in ([], ["w1"], ["w2", "w3"], ["x", "w2", "w3", "w4"], ["rare3", "rare4", "rare5", "rare6"], ["the", "of"]):
        assert math.isclose(sum(probability(before, x) for x in [*names, "never seen"]), 1.0)


def test_tree_gains_over_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in suffix_tree_lm.score_texts(spark, docs).collect() if r["held_out"]]
    n = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] for r in held) / n > sum(r["base_score"] for r in held) / n + 0.1


def test_ranked():
    rng = np.random.default_rng(4)
    for n, top in ((1, 2**63), (1000, 2**63), (5000, 40), (3000, 2**13)):
        keys = rng.integers(0, top, n, dtype=np.uint64) << np.uint64(0 if top > 100 else 3)
        values, code = suffix_tree_lm.ranked(keys)
        assert (values == np.unique(keys)).all() and (values[code] == keys).all()
        assert (suffix_tree_lm.unsqueeze_keys(suffix_tree_lm.squeeze_keys(values), len(values)) == values).all()


def test_quality(spark, odd, nothing):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(spark, docs, labels).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    known = [r for r in rows if r["doc_id"] in truth and not r["held_out"]]
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in known) >= 0.95 * len(known)
    none = labels.limit(0)
    for table in (odd, nothing):
        assert quality.quality_scores(spark, table, labels).count() == table.count() == quality.quality_scores(spark, table, none).count()


def test_quality_of_documents_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    unseen = [r for r in quality.quality_scores(spark, docs, labels).collect() if r["doc_id"] in truth and r["held_out"]]
    assert len(unseen) >= 50 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in unseen)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in unseen) >= 0.95 * len(unseen)


def test_quality_of_repeated_rows(spark, monkeypatch):
    """An id with many rows is learned from once, and the sample has a bound in passages."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    first = labels.filter("crc32(cast(cast(doc_id AS string) AS binary)) % 5 != 0").first()["doc_id"]
    one = docs.filter(docs.doc_id == first)
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, at, y: seen.append((x.copy(), at.copy(), y.copy())) or fit(x[:0], np.array([0]), y[:0]))
    many = docs
    for _ in range(3):
        many = many.unionByName(one)
    quality.train(docs, labels)
    quality.train(many, labels)
    assert all((a == b).all() for a, b in zip(*seen)) and seen[0][0].dtype == np.uint8
    monkeypatch.setattr(quality, "TRAIN_ALL", 40)
    quality.train(docs, labels)
    assert 0 < len(seen[2][0]) <= 40 and len(seen[2][2]) < len(seen[0][2])


def test_attention_against_loops():
    """The forward pass with plain Python numbers."""
    rng = np.random.default_rng(5)
    m = {k: np.asarray(v, np.float64) for k, v in quality.fit(np.zeros((0, quality.FEATURES), np.float32), np.array([0]), np.zeros(0)).items()}
    bags = [rng.random((n, quality.FEATURES)) for n in (1, 4, 2)]
    got = quality._forward(m, np.concatenate(bags), np.array([0, 1, 5, 7]))["p"]
    for bag, p in zip(bags, got):
        hidden = [[math.tanh(sum(x * m["w"][f][h] for f, x in enumerate(passage)) + m["b"][h]) for h in range(quality.HIDDEN)] for passage in bag.tolist()]
        gate = []
        for h in hidden:
            value = 0.0
            for a in range(quality.ATTENTION):
                t, s = (sum(h[j] * m[k][j][a] for j in range(quality.HIDDEN)) for k in ("v", "u"))
                value += m["a"][a] * math.tanh(t) / (1 + math.exp(-s))
            gate.append(math.exp(value))
        z = [sum(g * h[j] for g, h in zip(gate, hidden)) / sum(gate) for j in range(quality.HIDDEN)]
        assert math.isclose(p, 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, m["c"])) - m["d"])), rel_tol=1e-9)


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, first = rng.standard_normal((7, quality.FEATURES)), np.array([0, 1, 4, 7])
    y = np.array([1.0, 0.0, 1.0])
    m = {k: np.asarray(v, np.float64) + 0.01 for k, v in quality.fit(np.zeros((0, quality.FEATURES), np.float32), np.array([0]), np.zeros(0)).items()}

    def loss(m):
        p = quality._forward(m, x, first)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = quality._gradients(m, x, first, y)
    for k, at in (("w", (3, 2)), ("v", (1, 1)), ("u", (2, 3)), ("a", (4,)), ("c", (5,)), ("b", (0,))):
        up, down = ({**m, k: m[k].copy()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert math.isclose((loss(up) - loss(down)) / 2e-5, g[k][at], rel_tol=1e-3, abs_tol=1e-7)
