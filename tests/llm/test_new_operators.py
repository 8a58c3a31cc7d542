"""Byte-level BPE, ranked search and periodic runs against the library, SQL and brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import bytebpe as B
from quillon.llm import runs as R
from quillon.llm import search as S
from quillon.llm.common import pack_numbers, unpack_numbers

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  ", "a", "a  b", " a", "a ", "x\n\ny", "tab\t tab", "it's 'st I'LL don'T we'll", "日本語 text 12345 ½ ٣", "😀😀 x", "x" * 5000, "ab " * 3000, "a\x1cb\x85c\x0bd e\xa0f", "İstanbul ΑΣ", "<|endoftext|> q", "same text here", "same text here"]


def documents(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    df = spark.createDataFrame([(i, t) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string")
    return df.withColumns({k: F.lit(1) for k in ("row", "mark", "at", "n", "data", "ids", "_key", "_text", "term", "shard", "item", "score", "runs", "start", "lang")})


def real_texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_numbers_pack_and_unpack():
    rng = np.random.default_rng(1)
    for v in ([], [0], [127, 128, 16383, 16384, 1 << 40, (1 << 62) - 1], rng.integers(0, 1 << 33, 5000)):
        raw, ends = pack_numbers(v)
        assert unpack_numbers(raw.tobytes()).tolist() == list(v) and len(ends) == len(v) and (not len(v) or ends[-1] == len(raw))


# -- byte-level BPE ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(words, units):
    """The tables of frequent words and stretches, as ``frequent_words`` gives them."""
    import pyarrow as pa

    ranks = B.Ranks(B.vocabulary_path())
    one = pa.table({"word": pa.array(words, pa.string()), "ids": B.packed_rows(np.array([i for w in words for i in ranks.encode(w.encode())], np.int64), [len(ranks.encode(w.encode())) for w in words])})
    two = pa.table({"unit": pa.array([*units], pa.string()), "words": B.packed_rows(np.array([x for n in units.values() for x in n], np.int64), [*map(len, units.values())])})
    return B._stream(one), B._stream(two)


def test_words_and_merges_equal_library(library):
    import pyarrow as pa

    words = [" b", " ab", ","]
    ranks, rng = B.Ranks(B.vocabulary_path()), random.Random(5)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab'stredvml  \n\t  é1２½٣.,!😀日\x1c\x85\x0b\xa0 İΣ") for _ in range(rng.randrange(40))) for _ in range(6000)]
    texts += [" ".join(rng.choice(["b", "ab", "b,", "ab.", "x", "'s", "1a", "é", "\x0bq", "b\n\nb", "b\xa0c"]) for _ in range(rng.randrange(9))) for _ in range(3000)] + ["a" * 3000, "xyz" * 900, "\n" * 700]
    for units in ({"b": [1], "ab": [2], "b,": [1, 3], "ab,": [2, 3]}, {"b": [1], "ab": [2]}):
        numbers, sizes, rare = B.Cutter(packed(words, units), B.word_pattern()).cut(pa.array(texts))
        at = 0
        for t, n in zip(texts, sizes.tolist(), strict=True):
            own = [words[x - 1] if x > 0 else rare[-1 - x] for x in numbers[at : at + n].tolist()]
            assert [i for w in own for i in ranks.encode(w.encode())] == library.encode_ordinary(t), t
            at += n
        assert at == len(numbers) and [-1 - x for x in numbers.tolist() if x < 0] == [*range(len(rare))] and not set(rare) & set(words)
    numbers, sizes, rare = B.Cutter(packed([], {}), B.word_pattern()).cut(pa.array(["b ab"]))
    assert numbers.tolist() == [-1, -2] and rare == ["b", " ab"] and sizes.tolist() == [2]


def test_frequent_words_are_looked_up_without_a_table_for_each_call(library):
    import pyarrow as pa

    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcé😀") for _ in range(rng.randrange(40))) for _ in range(5000)})
    look = B.Lookup(pa.array(words))
    asked = words[::3] + [w + "x" for w in words] + ["a" * 5000, "\0", ""]
    rng.shuffle(asked)
    at = look.find(pa.array(asked)).tolist()
    assert all(k < 0 or words[k] == w for w, k in zip(asked, at, strict=True))
    known = [k for w, k in zip(asked, at, strict=True) if w in set(words)]
    assert sum(k < 0 for k in known) <= len(known) // 50  # those without a free slot travel as rare words
    look.hashes[:] = 7  # all hashes alike: the texts decide
    assert all(k < 0 or words[k] == w for w, k in zip(asked, look.find(pa.array(asked)).tolist(), strict=True))
    assert B.Lookup(pa.array([], pa.string())).find(pa.array(["a"])).tolist() == [-1] and look.find(pa.array([], pa.string())).tolist() == []


def test_every_character_is_cut_as_the_library_does(library):
    import pyarrow as pa

    cutter, ranks = B.Cutter(packed([], {}), B.word_pattern()), B.Ranks(B.vocabulary_path())
    chars = [chr(c) for c in [*range(0x3100), *range(0x3100, 0x110000, 61)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{ch}1 {ch}{ch} b {ch}c\n{ch}" for ch in chars]
    numbers, sizes, rare = cutter.cut(pa.array(texts))
    at = 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        assert [i for x in numbers[at : at + n].tolist() for i in ranks.encode(rare[-1 - x].encode())] == library.encode_ordinary(t), repr(t)
        at += n


@pytest.mark.parametrize(("sample", "most"), [(B.SAMPLE_ROWS, B.FREQUENT), (60, 40), (1, 1)])
def test_byte_bpe_equals_library(spark, library, sample, most):
    texts = ODD + real_texts(spark)[:60]
    ids = [None, 7, 7, *range(len(texts) - 3)]
    got = B.encode_documents(documents(spark, texts, ids), sample=sample, most=most).collect()
    want = sorted(((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in zip(ids, texts, strict=True)), key=repr)
    assert sorted(((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got), key=repr) == want and all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_byte_bpe_digests_and_decoding(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in B.op11_byte_bpe_codec(spark, SF).collect()}
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]] == (len(ids), sha(" ".join(map(str, ids))), sha(r["text"] or ""))
    assert B.encode_digests(documents(spark, [])).count() == 0
    rows = spark.createDataFrame([(1, [0, 50255, 220]), (2, []), (3, None)], "k int, ids array<int>")
    assert [r["decoded"] and bytes(r["decoded"]) for r in B.decode_ids(rows).orderBy("k").collect()] == [library.decode_bytes([0, 50255, 220]), b"", None]
    with pytest.raises(Exception, match="vocabulary does not have"):
        B.decode_ids(spark.createDataFrame([([50_256],)], "ids array<int>")).collect()


def test_byte_bpe_notices_another_order():
    import pyarrow as pa

    rows = lambda at, n, data: pa.table({"at": pa.array(at, pa.int32()), "n": pa.array(n, pa.int64()), "_key": pa.array([1] * len(at)), "data": pa.array(data, pa.binary())})
    got = [[x.tolist() for x in parts] for _, *parts in B._reassembled(rows([-1, 1], [3, None], [b"\x01\x00\x01", b"\x07\x08"]))]
    assert got == [[[1, -1, 1], [3], [7, 8], [2]]]
    for wrong in (rows([-1, 2], [3, None], [b"\x01\x00\x01", b"\x07"]), rows([-1], [3], [b"\x01\x00\x01"]), rows([1], [None], [b"\x07"])):
        with pytest.raises(RuntimeError):
            list(B._reassembled(wrong))


# -- ranked search -----------------------------------------------------------------------------------------------------


def brute_search(docs, items, most=10):
    from collections import Counter
    from math import floor, log

    terms = [(i, Counter(S.terms_of(t))) for i, t in docs]
    n_all, l_all = sum(bool(c) for _, c in terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in terms:
            m = 25 + (75 * sum(c.values()) * n_all) // l_all if l_all else 0
            score = sum(k * floor(1000 * log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in Counter(S.terms_of(text)).items() if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=repr)


def search_of(spark, docs, items, shard_bytes=S.SHARD_BYTES):
    ds = documents(spark, [t for _, t in docs], [i for i, _ in docs])
    it = spark.createDataFrame(items, "item_id long, text string").withColumns({k: F.lit(1) for k in ("item", "term", "n", "_key", "rank", "doc_id", "score")})
    return sorted((tuple(r) for r in S.search(S.build_index(ds, shard_bytes=shard_bytes), it).collect()), key=repr)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(30)] + ["É", "Ab", "ab", "x9"]
    docs = [(k, " ".join(rng.choices(words, weights=[40, 30, 20, *[3] * (len(words) - 3)], k=rng.choice([0, 1, 5, 40, 300])))) for k in range(120)]
    docs += [(500, docs[3][1]), (7, docs[4][1]), (None, docs[5][1]), (None, None), (501, ""), (502, "- . ,")]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 4, 20])))) for k in range(12)] + [(3, "w1 w1 w2"), (None, "ab"), (98, None), (99, "nowhere"), (97, "")]
    want = brute_search(docs, items)
    assert search_of(spark, docs, items) == want and len(want) > 100
    assert search_of(spark, docs, items, shard_bytes=500) == want  # many shards, heaps that go from one to the next
    monkeypatch.setattr(S, "BLOCK_TERMS", 20)
    monkeypatch.setattr(S, "BROADCAST_TERMS", 0)
    assert search_of(spark, docs, items) == want  # blocks of items, postings met by a shuffle


def test_search_of_empty_tables(spark):
    assert search_of(spark, [], [(1, "a")]) == [] and search_of(spark, [(1, "a b")], []) == [] and search_of(spark, [(1, None)], [(1, "a")]) == []


def test_merge_skips_no_document():
    """The bounded merge against sums over all documents, with thresholds that rise on the way and across shards."""
    rng = random.Random(2)
    for _ in range(300):
        n, lists = rng.choice([1, 5, 60]), []
        for _ in range(rng.randrange(1, 7)):
            p = S.Postings.__new__(S.Postings)
            p.places = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
            p.gains = [rng.choice([0, 1, 5, 5, 100]) for _ in p.places]
            p.most = max(p.gains)
            lists.append((p, rng.choice([1, 1, 2])))
        ids = sorted(rng.sample(range(1000), n))
        best = [(5, -2000)] * rng.choice([0, 1])
        total = {d: sum(dict(zip(p.places, p.gains, strict=True)).get(k, 0) * m for p, m in lists) for k, d in enumerate(ids)}
        want = sorted([*best, *((s, -d) for d, s in total.items() if s > 0)], reverse=True)[:4]
        S.rank_shard(lists, ids, 4, best)
        assert sorted(best, reverse=True) == want


# -- periodic runs -----------------------------------------------------------------------------------------------------


def brute_runs(w, least=6, times=4):
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            seg = w[i : j + q]
            if len(seg) >= max(least, times * q) and not any(seg[d:] == seg[:-d] for d in range(1, q)):
                out.append((i, len(seg), q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            n, k = rng.choice([0, 1, 2, 5, 8, 20, 40, 90, 200]), rng.choice([1, 2, 3, 5, 30])
            w = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.6 and n:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            if rng.random() < 0.2 and n > 10:
                w[rng.randrange(n)] = 99
            texts.append(w)
        times, least = rng.choice([2, 3, 4, 4, 4, 5]), rng.choice([2, 6])
        assert R.runs_of([np.array(x, np.int64) for x in texts], least, times) == [brute_runs(x, least, times) for x in texts]


def test_long_runs():
    fib = [1]
    while len(fib) < 300:
        fib = [y for x in fib for y in ((1, 0) if x else (1,))]
    assert R.runs_of([np.array(fib)], 2, 2) == [brute_runs(fib, 2, 2)] and len(brute_runs(fib, 2, 2)) > 50
    assert R.runs_of([np.zeros(200_000, np.int64)]) == [[(0, 200_000, 1)]]
    period = np.random.default_rng(3).permutation(5000)
    assert R.runs_of([np.concatenate([np.arange(9000, 9100), np.tile(period, 5), [7777]])]) == [[(100, 25_000, 5000)]]


def want_runs(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_query_equals_brute_force(spark):
    got = R.op13_periodic_runs(spark, SF)
    want = [want_runs(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and sum(w[1] > 0 for w in want) > 10
    texts = [*ODD, "a a a a a a b", "é é é é é é", "a b a b a\x0bb a\tb a b", "a b c a b c a b c a b c a b c x x x x x x x x"]
    ids = [None, 3, 3, *range(40, 40 + len(texts) - 3)]
    got = R.run_digests(R.find_runs(documents(spark, texts, ids), arrange=R.planted))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((want_runs(i, t) for i, t in zip(ids, texts, strict=True)), key=repr)
    assert R.find_runs(documents(spark, [])).count() == 0
    one = R.find_runs(documents(spark, ["a b a b a b a b z"])).first()
    assert [tuple(r) for r in one["runs"]] == [(0, 8, 2)] and one["collapsed"] == "a b z" and one["n_words"] == 9
