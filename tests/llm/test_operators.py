"""The ten training-data operators against brute force, round trips, held-out accuracy and awkward rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontaminate as D
from quillon.llm import embeddings as E
from quillon.llm import langid as L
from quillon.llm import licenses as C
from quillon.llm import neardup as N
from quillon.llm import queries
from quillon.llm import sharding as S
from quillon.llm import tokens as K
from quillon.llm import toxicity as X
from quillon.llm import warc as W
from quillon.llm.common import components

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "...", "a<|endoftext|>b <|startoftext|>", "it's 'st I'LL don'T", " x y", "ΑΣ ΟΔΥΣΣΕΥΣ İstanbul", "école ́x", "日本語 text 12345 ½ ٣", "😀😀 🏳️‍🌈", "x" * 9000, "a\x1cb\x85c\x0bd", "ab " * 4000, "<|endoftext", "ﬁ Ǆ ß ẞ × ÷", "same text here", "same text here"]
#: Columns that clash with names used inside the operators.
CLASH = {"id": 1, "size": 2, "_key": 3, "n": 4, "label2": 5, "bucket": 6, "score": 0.5, "ids": "z", "_text": "q", "root": 1, "sig": 2, "_gone": 9, "r": 1}


def documents(spark, texts=None, ids=None):
    texts = ODD if texts is None else texts
    ids = list(range(len(texts))) if ids is None else ids
    df = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "src0", len(t or "")) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(K.vocabulary_path())


def real_texts(spark, n=120):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(n).collect()]


def test_bpe_equals_library(spark, library):
    texts = ODD + real_texts(spark)
    got = by_id(K.encode_documents(documents(spark, texts)), "ids", "n_tokens", "decoded")
    sums = by_id(K.encode_digests(documents(spark, texts)), "n_tokens", "ids_sha256", "decoded_sha256")
    for k, t in enumerate(texts):
        e = library.encode(t or "", add_special_tokens=False)
        assert got[k] == (" ".join(map(str, e.ids)), len(e.ids), library.decode(e.ids, skip_special_tokens=False)), t
        assert sums[k] == (len(e.ids), hashlib.sha256(got[k][0].encode()).hexdigest(), hashlib.sha256(got[k][2].encode()).hexdigest())


def test_chunks_are_reused(spark):
    coder = K.ChunkEncoder(K.vocabulary_path())
    text = " ".join(real_texts(spark, 8)).encode()
    one = list(coder.encode([text]))
    missed = coder.misses
    again = list(coder.encode([b"a new head " + text, text]))
    assert again[1] == one[0] and coder.misses - missed <= 3 and coder.disagreed == 0
    small = K.ChunkEncoder(K.vocabulary_path(), chunk_bytes=9000, word_bytes=3000)
    assert list(small.encode([text]))[0] == one[0] and list(small.encode([text, text]))[1] == one[0]
    assert small.chunks_held <= 9000


def test_joins_are_repaired(library):
    """A chunk entry whose end tokens are wrong disagrees with the window, and the text is encoded whole."""
    coder = K.ChunkEncoder(K.vocabulary_path())
    text = ("some words of a text that goes on and on, with a few numbers 12 34 " * 60).encode()
    want = list(coder.encode([text]))[0]
    for p, e in coder.chunks.items():
        if e:
            coder.chunks[p] = (*e[:3], (e[3][0], (1, 2)), e[4])
    assert list(coder.encode([text]))[0] == want and coder.disagreed == 1
    e = library.encode(text.decode(), add_special_tokens=False)
    assert want == e.ids


def test_texts_without_blanks(spark, library):
    """CJK, base64 and one long word: no cache keeps them, and ids and counts equal the library's."""
    rng = random.Random(4)
    cjk = ["".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n)) for n in (3000, 6001, 20_000)]
    texts = [*cjk, base64.b64encode(rng.randbytes(30_000)).decode(), "ab" * 9000, "x" * 40_000, "é" * 9000 + "<|endoftext|>" + "ß" * 5000, cjk[0] + "\u3000" + cjk[0]]
    got = by_id(K.encode_documents(documents(spark, texts)), "ids", "decoded")
    counted = by_id(K.count_tokens(documents(spark, texts)), "n_tokens")
    for k, t in enumerate(texts):
        e = library.encode(t, add_special_tokens=False)
        assert got[k] == (" ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False)) and counted[k] == (len(e.ids),), k
    coder, counter = K.ChunkEncoder(K.vocabulary_path()), K.HeapCounter(K.vocabulary_path())
    for t in cjk * 3:
        list(coder.encode([t.encode()]))
        counter.count(t.encode())
    assert not coder.units and not counter.units and coder.chunks_held <= K.CHUNK_BYTES


def test_long_texts_in_parts(spark, library, monkeypatch):
    monkeypatch.setattr(K, "SLICE_BYTES", 500)
    text = " ".join(real_texts(spark, 20)) + " é日本" * 300
    n = len(library.encode(text, add_special_tokens=False).ids)
    counter, coder = K.HeapCounter(K.vocabulary_path(), most=2000), K.ChunkEncoder(K.vocabulary_path(), word_bytes=2000)
    assert [counter.count(text.encode()) for _ in range(2)] == [n, n] and [len(x) for x in coder.encode([text.encode()] * 2)] == [n, n]
    assert b"".join(K._parts(text.encode())) == text.encode()


def test_other_vocabularies_are_refused(spark):
    for f in (K.encode_documents, K.encode_digests):
        with pytest.raises(ValueError):
            f(documents(spark), "byte_bpe_50k.json")
    with pytest.raises(ValueError):
        K.count_tokens(documents(spark), vocabulary="byte_bpe_50k.json")
    assert K.checked_path(K.VOCABULARY) == K.vocabulary_path()


def test_token_edges(spark):
    empty = documents(spark, [])
    assert K.encode_documents(empty).count() == K.encode_digests(empty).count() == K.count_tokens(empty).count() == 0
    rows = documents(spark, ["same", "same", None], [None, 7, 7])
    none = hashlib.sha256(b"").hexdigest()
    assert sorted(((r["doc_id"] or 0), r["n_tokens"], r["ids_sha256"] == none) for r in K.encode_digests(rows).collect()) == [(0, 1, False), (7, 0, True), (7, 1, False)]
    assert sorted(((r["doc_id"] or 0), r["n_bytes"], r["n_tokens"]) for r in K.count_tokens(rows).collect()) == [(0, 4, 1), (7, 0, 0), (7, 4, 1)]


def test_cuts_keep_characters():
    raw = ("é日本😀" * 9000).encode()
    ends = K.cut_points(np.frombuffer(raw, np.uint8))
    assert ends[-1] == len(raw) and all((raw[e] & 0xC0) != 0x80 for e in ends[:-1]) and b"".join(raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)) == raw


def test_token_counts_equal_library(spark, library):
    texts = ODD + real_texts(spark)
    got = by_id(K.count_tokens(documents(spark, texts), limit=20), "n_bytes", "n_tokens", "over_limit")
    for k, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[k] == (len((t or "").encode()), n, n > 20), t


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.op3_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.96 and all(0 <= r["score"] <= 1 for r in rows)


def taught_filters(spark, texts, languages):
    counts = sorted(((x, languages.count(x)) for x in set(languages)), key=lambda c: (-c[1], c[0]))
    return L.fit(spark.createDataFrame([*zip(texts, languages, strict=True)], "text string, lang string"), counts)


def test_language_filters_answer_like_sets(spark):
    texts = ["the quick brown fox jumps over the lazy dog " * 9, "der schnelle braune fuchs springt über den faulen hund " * 9]
    m = taught_filters(spark, texts, ["en", "de"])
    own = [{*L.grams(*L.byte_view(pa.array([texts[["en", "de"].index(name)]])))[0].tolist()} for name in m.languages]
    for bit, codes in enumerate(own):  # every chosen n-gram is in its filter: no false negatives
        chosen = np.array([c for c in codes if c not in own[1 - bit]], np.uint32)
        at = L._cells_of(chosen)
        assert ((m.cells[0][at[0]] & m.cells[0][at[1]]) >> np.uint8(bit) & 1).all()
    names, scores = L.predict(m, pa.array(["the dog", "der hund", None, "", "123 !?", "日本", "½", "²", "①"]))
    assert names[:2] == ["en", "de"] and names[2:5] == ["und"] * 3 and names[5] in ("en", "de") and scores[2] == 0 and names[6:] == ["und"] * 3


def test_many_languages(spark):
    """More than one word of 64 bits, and languages of two texts each."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:03}": ["".join(rng.choice(letters) for _ in range(7)) for _ in range(30)] for k in range(150)}
    text = lambda x: " ".join(rng.choice(words[x]) for _ in range(40))
    m = taught_filters(spark, [text(x) for x in words for _ in range(2)], [x for x in words for _ in range(2)])
    assert m.cells.shape == (3, L.SLOTS)
    names, _ = L.predict(m, pa.array([text(x) for x in words]))
    assert sum(n == x for n, x in zip(names, words, strict=True)) >= 145


def test_language_sample_is_stratified(spark):
    df = spark.createDataFrame([(k, f"text {k}", "rare" if k % 1000 == 0 else "few" if k % 100 == 1 else "common") for k in range(20_000)], "doc_id long, text string, lang string")
    n = {r["lang"]: r["count"] for r in L.bounded_sample(df, "doc_id", 900, "lang").groupBy("lang").count().collect()}
    assert n["rare"] == 20 and n["few"] == 200 and 560 < n["common"] <= 905


def test_language_edges(spark):
    m = L.fit_from(documents(spark, []))
    assert m.languages == []
    assert {r["lang_pred"] for r in L.identify(documents(spark), m).collect()} == {"und"}
    assert L.identify(documents(spark, []), m).count() == 0
    m = taught_filters(spark, ["the quick brown fox " * 20], ["en"])
    kept = L.keep_identified(documents(spark), m)
    assert kept.columns == documents(spark).columns and None not in {r["text"] for r in kept.collect()}
    odd = documents(spark, ["the fox", "the fox", None, "the fox " * 30_000], [None, 4, 4, 5])
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in L.identify(odd, m).collect()) == [(0, "en"), (4, "en"), (4, "und"), (5, "en")]
    assert L.keep_identified(odd, m).count() == 3 and L.keep_identified(documents(spark, []), m).count() == 0


def test_grams_stay_within_rows():
    raw, at = L.byte_view(pa.array(["ab  cd", "", "xyz", "Éa bc"]))
    codes, offsets = L.grams(raw, at)
    alone = [L.grams(*L.byte_view(pa.array([t])))[0] for t in ("ab  cd", "", "xyz", "Éa bc")]
    assert np.array_equal(np.concatenate(alone), codes) and list(np.diff(offsets)) == [len(a) for a in alone]


def test_toxicity_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = X.op6_toxicity(spark, sf).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    y, s, p = (np.array([r[c] for r in held], float) for c in ("toxic", "score", "predicted"))
    assert y.sum() >= 50 and (p * y).sum() >= 0.8 * y.sum() and (p * y).sum() >= 0.9 * p.sum()  # recall, precision
    ranks = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
    bins = np.minimum((s * 5).astype(int), 4)
    error = sum(abs(s[bins == k].mean() - y[bins == k].mean()) * (bins == k).mean() for k in np.unique(bins))
    assert ranks > 0.97 and error < 0.08 and ((s - y) ** 2).mean() < 0.05


def brute_features(text, lexicon):
    """Letter by letter and word by word."""
    if not text:
        return [0.0] * len(X.FEATURES)
    data = text.encode()
    n = len(data)
    low = [b + 32 if 65 <= b <= 90 else b for b in data]
    letter = lambda b: 97 <= b <= 122 or 65 <= b <= 90 or b >= 128
    words, now = [], b""
    for b in [*low, 32]:
        if letter(b) or 48 <= b <= 57:
            now += bytes([b])
        elif now:
            words.append(now)
            now = b""
    kinds = [[w in X.INSULTS for w in words], [w in lexicon.words for w in words], [w[: X.PREFIX] in lexicon.prefixes for w in words], [w in X.SECOND_PERSON for w in words]]
    bad = [any(k) for k in zip(*kinds[:3], strict=True)]
    near = sum(b and any(kinds[3][j] for j in range(max(0, i - X.NEAR_WORDS), min(len(words), i + X.NEAR_WORDS + 1))) for i, b in enumerate(bad))
    m = max(1, len(words))
    share = lambda f, k=1: sum(f(i) for i in range(n - k + 1)) / n
    is_in = lambda chars: lambda i: data[i] in chars
    up = lambda i: 65 <= data[i] <= 90
    symbols, digits = b"#$%&*@^~|+=<>_\\/", b"0123456789"
    inner = lambda chars: share(lambda i: data[i + 1] in chars and letter(data[i]) and letter(data[i + 2]), 3)
    counts = [sum(k) for k in kinds]
    return [
        *(v for c in counts[:3] for v in (np.log1p(c), c / m)), near / m, counts[3] / m, share(up), share(lambda i: up(i) and up(i + 1), 2), share(is_in(b"!?.,;:\"'()-")), share(is_in(b"!")), share(is_in(symbols)),
        inner(symbols), inner(digits), share(lambda i: data[i] == data[i + 1] == data[i + 2] and letter(data[i + 2]), 3), share(is_in(digits)), share(lambda i: data[i] >= 128), np.log1p(len(words)), n / m,
    ]


def test_toxicity_features_equal_brute_force(spark):
    lexicon = X.Lexicon(frozenset([b"trash", b"1d10t", "blöd".encode()]), frozenset([b"idio", b"some"]))
    texts = [*ODD, "You are an IDIOT!!! i-d-i-o-t tra$h 1d10t sooo blöd, you", "idiot a b c d you", "a b", "you idiotic", *real_texts(spark, 60)]
    for t in texts:
        assert np.allclose(X.features(t, lexicon), brute_features(t, lexicon)), t


def test_boosting_equals_exhaustive_search(monkeypatch):
    for name, value in (("TREES", 3), ("DEPTH", 2), ("LEAST_ROWS", 2.0), ("BINS", 6)):
        monkeypatch.setattr(X, name, value)
    rng = np.random.default_rng(3)
    x = rng.random((80, 3)).round(1)
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.6) | (rng.random(80) < 0.1)).astype(float)
    forest = X.boost(x, y)
    b = forest.binned(x)
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(3):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        gain = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1)
        leaves = [np.ones(len(y), bool)]
        for _ in range(2):
            split = []
            for rows in leaves:
                best, cut = 1e-9, None
                for f in range(3):
                    for limit in range(X.BINS + 2):
                        low = rows & (b[:, f] <= limit)
                        high = rows & ~low
                        if min(low.sum(), high.sum()) >= 2 and (v := gain(low) + gain(high) - gain(rows)) > best + 1e-12:
                            best, cut = v, (low, high)
                split += cut or (rows, rows & False)
            leaves = split
        for rows in leaves:
            score = score + np.where(rows, -X.RATE * g[rows].sum() / (h[rows].sum() + 1), 0)
    assert np.allclose(forest.raw(x), score)


def test_isotonic_is_least_squares():
    """Against projected increasing fits found by dynamic programming over pool borders; the prior only shrinks pools."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        s = np.sort(rng.random(9))
        y = (rng.random(9) < s).astype(float)
        best = [(0.0, -1.0)]  # over all ways to cut into pools with rising means
        for mask in range(1 << 8):
            cuts = [0, *[k + 1 for k in range(8) if mask >> k & 1], 9]
            means = [y[a:b].mean() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            if all(u <= v for u, v in zip(means[:-1], means[1:], strict=True)):
                best.append((1.0, -sum(((y[a:b] - m) ** 2).sum() for a, b, m in zip(cuts[:-1], cuts[1:], means, strict=True))))
        least = -max(v for k, v in best if k)
        xs, ys = X.isotonic(s, y, prior=0.0)
        fit = np.interp(s, xs, ys)
        assert abs(((y - fit) ** 2).sum() - least) < 1e-9 and (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()
        shrunk = X.isotonic(s, y)[1]
        assert (np.diff(shrunk) >= 0).all() and (shrunk > 0).all() and (shrunk < 1).all()


def labelled(spark, n=700):
    texts = [("you idiot " if k % 3 == 0 else "a kind word ") + f"number {k} here" for k in range(n)]
    return documents(spark, texts), spark.createDataFrame([(k, 0, int(k % 3 == 0)) for k in range(n)], "doc_id long, quality int, toxic int")


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    m = X.fit_from(documents(spark), labels)
    rows = X.score_documents(documents(spark), m).collect()
    assert len(rows) == len(ODD) and len({r["score"] for r in rows}) == 1
    assert X.score_documents(documents(spark, []), m).count() == 0 and X.fit_from(documents(spark, []), labels).forest is None
    docs, labels = labelled(spark)
    m = X.fit_from(docs, labels)
    s = m.score(["you IDIOT number 7 here", "a kind word number 7 here", None, "", "x" * 5000, "you idiot " * 20_000])
    assert s[0] > 0.5 > s[1] and s[2] == s[3] and np.isfinite(s).all()
    kept = X.keep_civil(documents(spark, ["you idiot number 5 here", "a kind word", None, "a kind word"], [None, None, 3, 3]), m)
    assert sorted(r["text"] or "" for r in kept.collect() if r["text"]) == ["a kind word"] * 2 and kept.columns == documents(spark).columns


def test_toxicity_takes_text_ids(spark):
    docs, labels = labelled(spark)
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    a, b = (X.fit_from(d.withColumn("doc_id", name).repartition(k), t.withColumn("doc_id", name)) for k, (d, t) in enumerate([(docs, labels)] * 2, 1))
    texts = ["you idiot", "a kind word number 7", "you"]
    assert np.allclose(a.score(texts), b.score(texts))  # the fit does not depend on the rows' order


def test_warc_round_trip(spark, tmp_path):
    html = [None, "", "z", "z", "z" * 200_000, "é\r\n\r\nWARC/1.1", *[f"<p>page {k % 40}</p>" * 20 for k in range(300)]]
    pages = spark.createDataFrame([(k, None if k == 3 else f"http://x/{k}\r\n é", h) for k, h in enumerate(html)] + [(None, "u", "z"), (2, "again", "z")], "page_id long, url string, html string").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    out = f"file://{tmp_path}/w"
    files = W.write_archives(pages, out).collect()
    rows = W.read_archives(spark, out).collect()
    assert sum(f["records"] for f in files) == len(rows) == len(html) + 2
    last = defaultdict(lambda: -1)
    for k, h in enumerate(html):
        last[h or ""] = max(last[h or ""], k)
    for r in rows:
        h = "z" if r["page_id"] is None else html[r["page_id"]] or ""
        assert r["payload_bytes"] == len(h.encode()) and r["payload_digest"] == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == last[h] else ("revisit", last[h]))
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == h.encode()
    assert W.write_archives(pages.limit(0), out + "0").count() == 0


def test_warc_frames():
    import struct

    import zstandard

    records = [W.record(k, "u", 3, "D", None, f"<p>{k} some words that repeat {k % 7}</p>".encode() * 9) for k in range(200)]
    data = W.pack(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == W.MAGIC and size > 0 and list(W.unpack(data)) == records
    first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj().decompress(data[8 + size :])
    assert first == records[0]
    assert list(W.unpack(W.pack(records[:2]))) == records[:2]


def test_warc_record_ids(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "a", "y"), (None, "a", "x"), (None, "b", "q"), (2, "c", "x")], "page_id long, url string, html string")
    out = f"file://{tmp_path}/w"
    W.write_archives(pages, out).collect()
    heads = [W.parse(r)["fields"] for f in (tmp_path / "w").glob("*.zst") for r in W.unpack(f.read_bytes())]
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(set(ids)) == 6 and {h["WARC-Refers-To"] for h in heads if "WARC-Refers-To" in h} <= set(ids)
    rows = W.read_archives(spark, out).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in rows) == [(0, "response", 0), (0, "revisit", 2), (1, "response", 0), (1, "revisit", 2), (1, "revisit", 2), (2, "response", 0)]


def brute_shards(texts, ids, shards=16):
    """Rows in the order of (hash of the text, id), cut where the middle of a row passes a multiple of total / shards."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    size = [len((t or "").encode()) + 1 for t in texts]
    order = sorted(range(len(texts)), key=lambda k: (signed(xxhash.xxh64_intdigest((texts[k] or "").encode(), seed=42)), ids[k]))
    total, upto, out, count = sum(size), 0, {}, defaultdict(int)
    for k in order:
        shard = min(shards - 1, (2 * upto + size[k]) * shards // (2 * total))
        upto += size[k]
        out[ids[k]] = (shard, count[shard])
        count[shard] += 1
    return out


def test_sharding_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "SAMPLES_A_RANGE", 4)  # coarse samples: ranges turn out overfull and are divided again
    rng = random.Random(5)
    texts = [None, "", *["w" * rng.randrange(1, 300) + str(k) for k in range(900)], *["copy of a text" * 9] * 500, "x" * 90_000]
    ids = rng.sample(range(10**6), len(texts))
    assert by_id(S.assign(documents(spark, texts, ids)), "shard", "slot") == brute_shards(texts, ids)


def test_sharding(spark):
    rng = random.Random(3)
    texts = [None, "", *["w" * rng.randrange(1, 400) for _ in range(1500)], *["copy of a text" * 9] * 800, "x" * 6000]
    rows = S.assign(documents(spark, texts, [k * 7 % 4001 for k in range(len(texts))])).collect()
    total = sum(len((t or "").encode()) + 1 for t in texts)
    assert len(rows) == len(texts) and sum(r["size"] for r in rows) == total and {r["law"] for r in rows} == {"bytes"}
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(sizes) == list(range(16)) and all(abs(s - total / 16) <= 6001 for s in sizes.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    crc = {r["doc_id"]: r["text_crc32"] for r in rows}
    assert all(crc[k * 7 % 4001] == zlib.crc32((t or "").encode()) for k, t in enumerate(texts))


def test_sharding_edges(spark, tmp_path):
    assert S.assign(documents(spark, [])).count() == 0
    rows = S.assign(documents(spark, ["same"] * 5, [1] * 5)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == 5
    S.write_shards(documents(spark).withColumn("_slot", F.lit(1)), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(ODD) and {"_key", "size", "_slot"} <= set(back.columns)
    with pytest.raises(ValueError):
        S.write_shards(documents(spark).withColumn("_SHARD", F.lit(1)), str(tmp_path / "t"))
    nulls = S.assign(documents(spark, ["same", None, "same"], [None, None, 3])).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in nulls) == [(0, 1), (0, 5), (3, 5)] and len({(r["shard"], r["slot"]) for r in nulls}) == 3


def test_range_of_matches_tuples():
    rng = random.Random(1)
    splitters = sorted({(rng.randrange(5), rng.randrange(9)) for _ in range(12)})
    rows = [(rng.randrange(-1, 6), rng.randrange(-1, 10)) for _ in range(300)]
    got = S.range_of(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), splitters)
    assert list(got) == [sum(s <= r for s in splitters) for r in rows]


_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(_LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(texts):
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {k: (len(sets[k]), find(k), find(k) == k) for k in range(len(texts))}


def near_texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(6):  # groups that drift: neighbours link, the ends do not
        t = [word() for _ in range(120)]
        for _ in range(12):
            texts.append(" ".join(t))
            for _ in range(2):
                t = [*t]
                t[rng.randrange(len(t))] = word()
    base = [word() for _ in range(100)]
    for _ in range(40):  # copies of one text around the threshold
        t = [*base]
        for _ in range(rng.randrange(8)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randrange(5, 120))) for _ in range(40)]
    return texts + [t or "" for t in ODD] + ["A b", "a B", "a", "one two three four", "one two three four five", "ONE two three four five"]


def test_near_duplicates_equal_brute_force(spark):
    texts = near_texts()
    assert by_id(N.near_duplicates(documents(spark, texts)), "n_shingles", "component_id", "kept") == brute_groups(texts)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "SMALL", 3)
    texts = near_texts()[72:152]
    assert by_id(N.near_duplicates(documents(spark, texts)), "n_shingles", "component_id", "kept") == brute_groups(texts)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_near_duplicates_of_repeated_ids(spark, seed):
    rng = random.Random(seed)
    texts = near_texts()[:150]
    ids = [rng.randrange(60) for _ in texts]
    a, b = [" ".join(rng.choice("pqrs") * 3 + str(rng.randrange(999)) for _ in range(60)) for _ in range(2)]
    texts += [a, b, b + " more", a + " more"]
    ids += [1005, 1005, 1003, 1004]
    order = [*range(len(texts))]
    rng.shuffle(order)
    rows = N.near_duplicates(documents(spark, [texts[k] for k in order], [ids[k] for k in order])).collect()
    alone = brute_groups(texts)  # by row; then rows of one id join
    root = {i: i for i in ids}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, (_, r, _) in alone.items():
        u, v = sorted((find(ids[k]), find(ids[r])))
        root[v] = u
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows) == sorted((i, alone[k][0], find(i), find(i) == i) for k, i in enumerate(ids))
    assert {r["component_id"] for r in rows if r["doc_id"] > 1000} == {1003}


def test_near_duplicates_with_a_hub(spark, monkeypatch):
    """A hot first class, hot text and null ids, with every key of more than four rows dealt over parts."""
    monkeypatch.setattr("quillon.plans.skew.LEAST_HOT", 4)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(80)]
    texts = [" ".join(base)] * 40
    for _ in range(60):
        t = [*base]
        t[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += [" ".join(f"z{rng.randrange(10**6)}" for _ in range(40)) for _ in range(30)] + ["long " * 60_000]
    assert by_id(N.near_duplicates(documents(spark, texts)), "n_shingles", "component_id", "kept") == brute_groups(texts)
    nulls = documents(spark, [texts[0], texts[0], None, texts[0]], [None, None, None, 4])
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in N.near_duplicates(nulls).collect())
    assert got == [(0, 0, True)] * 3 + [(4, 4, True)] and N.keep_first(nulls).count() == 4


def test_near_duplicate_edges(spark):
    assert N.near_duplicates(documents(spark, [])).count() == 0
    rows = N.near_duplicates(documents(spark, ["a b c d e f", "a b c d e f", None], [5, 5, 7])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(5, 5), (5, 5), (7, 7)]
    kept = N.keep_first(documents(spark, ["a b c d e f", "A b c d e f", None, ""]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3] and kept.columns == documents(spark).columns


def test_estimate_is_corrected():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = np.concatenate([a[:3000], rng.integers(0, 1 << 63, 1000, dtype=np.uint64)])
    sig = [N.pack_bits(N.sketch(x, np.array([0, len(x)]))) for x in (a, b)]
    assert abs(float(N.estimate(*sig)[0]) - 3000 / 5000) < 0.15 and float(N.estimate(sig[0], sig[0])[0]) == 1.0


def test_components_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (102, 100)], "a long, b long")
    got = {r["id"]: r["root"] for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100}


def license_base(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(_LOW))
    hits = [(k, label) for phrase, label in C.BASE for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p]
    at = [k for k, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_license_base_equals_brute_force(spark):
    texts = [*ODD, "Released UNDER the-MIT (License)!", "under the mit licenses", "CC BY-NC 4.0; cc by nc cc by nc", "Apache License, Version 2.0. apache license version 20", "sunder the mit license", "é under the mit license", *real_texts(spark, 200)]
    got = by_id(C.scan(documents(spark, texts)), "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == {k: license_base(t) for k, t in enumerate(texts)}
    assert C.scan(documents(spark, [])).count() == 0


def expansions(pattern):
    """All texts that a rule's expression matches: literals, groups of alternatives, optional parts and classes."""

    def alternatives(at):
        out, now = [], [""]
        while at < len(pattern) and pattern[at] != ")":
            c = pattern[at]
            if c == "|":
                out, now, at = out + now, [""], at + 1
                continue
            if pattern.startswith("(?:", at):
                got, at = alternatives(at + 3)
                at += 1
            elif c == "[":
                end = pattern.index("]", at)
                body = pattern[at + 1 : end]
                got = [chr(x) for x in range(ord(body[0]), ord(body[2]) + 1)] if "-" in body else [*body]
                at = end + 1
                if pattern.startswith("{2}", at):
                    got, at = [x + y for x in got for y in got], at + 3
            else:
                got, at = [c], at + 1
            if pattern.startswith("?", at):
                got, at = ["", *got], at + 1
            now = [x + y for x in now for y in got]
        return out + now, at

    return alternatives(0)[0]


def test_license_filters_lose_no_match():
    for r in C.rules():
        keys = r.keyword.split("|")
        assert all(any(f" {g}" in f" {k}" for g in C.GATE) for k in keys), r
        every = expansions(r.pattern)
        assert all(re.fullmatch(r.pattern, x) for x in every[:50])
        missed = [x for x in every if not any(f" {k}" in f" {x}" for k in keys)]
        assert not missed, (r, missed[:3])
        assert all(x == x.strip() and "  " not in x for x in every), r


def license_labels(text):
    """Every rule over the whole text, then containment and priority, pair by pair."""
    w = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOW))) + " "
    spans = {(m.start(), m.end(), r.priority, r.label, r.weight) for r in C.rules() for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", w)}
    best = {}
    for s in sorted(spans, key=lambda s: (-s[2], s[3], s[4])):
        best.setdefault(s[:2], s)
    alone = [s for s in best.values() if not any(o[0] <= s[0] and s[1] <= o[1] and o[:2] != s[:2] for o in best)]
    kept = []
    for s in sorted(alone, key=lambda s: (-s[2], s[0])):
        if not any(k[0] < s[1] and s[0] < k[1] for k in kept):
            kept.append(s)
    base = license_base(text)[4]
    labels = sorted({x for x in base.split(",") if x} | {s[3] for s in kept})
    return ",".join(labels), 1.0 if base else max([s[4] for s in kept], default=0.0)


def license_texts(spark):
    rng = random.Random(9)
    every = [x for r in C.rules() for x in expansions(r.pattern)]
    texts = [rng.choice(every).title() for _ in range(250)]
    texts += [", ".join(rng.choice(["the", "this file is", "distributed", "mit dem Hund", "gnu", "license"]) + " " + rng.choice(every) for _ in range(rng.randrange(2, 7))) for _ in range(250)]
    words = sorted({w for x in every for w in x.split()})
    texts += [" ".join(rng.choice(words) for _ in range(40)) for _ in range(150)]
    return [*ODD, *texts, "word " * 30_000 + "under the WTFPL", *real_texts(spark, 200)]


def test_license_labels_equal_brute_force(spark):
    texts = license_texts(spark)
    got = by_id(C.scan(documents(spark, texts)), "labels", "score")
    want = {k: license_labels(t) for k, t in enumerate(texts)}
    assert {k: (got[k], want[k], texts[k][:300]) for k in got if got[k] != want[k]} == {}
    assert len({x for v, _ in want.values() for x in v.split(",")}) > 60


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the GNU General Public License, version 3.", "gpl-3"), ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"), ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0"), ("All rights reserved.", "all-rights-reserved"),
        ("die Lizenz mit dem Hund", ""), ("the Apache tribe", ""), ("BSD 3-Clause License; Copyright (c) 2020", "bsd-3-clause,copyright"), ("", ""), (None, ""),
        ("Distributed under the WTFPL", "wtfpl"), ("released under EUPL version 1.2 terms", "eupl-1.2"), ("distributed under the BSD 3-clause terms", "bsd-3-clause"), ("available under the MPL 2.0", "mpl-2.0"),
    ],
)
def test_license_rules(spark, text, labels):
    r = C.scan(documents(spark, [text])).first()
    assert r["labels"] == labels and 0 <= r["score"] <= 1


def test_license_priority_goes_both_ways(spark):
    def kept(*spans):
        rows = spark.createDataFrame([([(b, -e, -p, f"{b}-{e}", 1.0) for b, e, p in spans],)], f"x {C._SPAN}")
        return sorted(s["label"] for s in rows.select(C._resolve(F.col("x")).alias("k")).first()["k"])

    assert kept((0, 10, 50), (5, 20, 90)) == ["5-20"] and kept((0, 10, 90), (5, 20, 50)) == ["0-10"]
    assert kept((0, 20, 50), (5, 15, 90)) == ["0-20"] and kept((0, 10, 50), (5, 20, 50)) == ["0-10"]


def test_license_plan_is_native(spark):
    plan = C.op9_license_scan(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan) and len(C.rules()) > 200 and len(set(C.rules())) == len(C.rules())


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for label in (1, 2, None):
        for _ in range(12):
            base = rng.normal(size=24)
            for _ in range(int(rng.integers(1, 60))):
                rows.append((k, [float(x) for x in (base + rng.normal(size=24) * 0.3).astype("f4")], label))
                k += 1
    rows += [(k + n, rows[0][1], 1) for n in range(30)]
    k += 30
    rows += [(k, None, 1), (k + 1, [0.0] * 24, 1), (k + 2, [float("nan")] * 24, 1), (k + 3, [None, *[1.0] * 23], 1), (k + 4, [float("inf"), *[1.0] * 23], 1), (k + 5, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(v) for c, v in CLASH.items()})
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.near_embeddings(df).collect()}
    n, root = np.zeros(len(rows), int), list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for label in (1, 2):
        own = [i for i, v, x in rows if x == label and v and None not in v and np.isfinite(v).all() and any(v)]
        m = np.array([rows[i][1] for i in own])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= 0.93, 1)), strict=True):
            n[own[a]] += 1
            n[own[b]] += 1
            u, v = sorted((find(own[a]), find(own[b])))
            root[v] = u
    assert n.sum() > 500 and sum(got[i][0] for i in range(len(rows))) >= 0.98 * n.sum() and all(got[i][0] <= n[i] for i in range(len(rows)))
    assert sum(got[i][1] == find(i) for i in range(len(rows))) >= 0.98 * len(rows)
    assert E.near_embeddings(df.limit(0)).count() == 0


def brute_links(rows):
    n, root = np.zeros(len(rows), int), list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in range(len(rows)):
        for b in range(a):
            x, y = (np.array(rows[k][1], float) for k in (a, b))
            if rows[a][2] == rows[b][2] is not None and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                n[a] += 1
                n[b] += 1
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return n, [find(k) for k in range(len(rows))]


def test_embeddings_with_hot_groups(spark, monkeypatch):
    """Chains that a bucket's first class does not reach, groups over many blocks, several lengths, hot keys."""
    monkeypatch.setattr(E, "BLOCK", 8)
    monkeypatch.setattr(E, "SMALL", 3)
    monkeypatch.setattr("quillon.plans.skew.LEAST_HOT", 4)
    rng = np.random.default_rng(8)
    rows = []
    for dim, spread, many in ((16, 0.12, 50), (33, 0.25, 30), (7, 0.35, 30)):
        for _ in range(3):
            base = rng.normal(size=dim)
            rows += [(0, [float(x) for x in (base + rng.normal(size=dim) * spread).astype("f4")], int(rng.integers(2))) for _ in range(many)]
    rows = [(k, v, x) for k, (_, v, x) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_embeddings(df).collect()}
    n, root = brute_links(rows)
    assert sum(got[k][0] == n[k] for k in range(len(rows))) >= 0.98 * len(rows) and sum(got[k][1] == root[k] for k in range(len(rows))) >= 0.98 * len(rows) and n.sum() > 2000


def test_embedding_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v, 1), (5, [-1.0, 2.0, 0.5], 1), (9, [-1.0, 2.0, 0.5], 1), (None, v, 1), (7, v, None), (8, [2.0, 4.0, 6.0], 1), (6, [1e308, 2e308 / 2, 1e308], 1)]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in E.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert [g for g in got if g[0] != 6] == [(0, 0, 0, True), (5, 1, 5, True), (5, 1, 5, True), (7, 0, 7, True), (8, 1, 5, False), (9, 1, 5, False)]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(E.hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(E.hadamard(E.hadamard(x)), x)


def test_recall_of_codes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    a, b = E.codes(x), E.codes(0.93 * x + np.sqrt(1 - 0.93**2) * z)
    assert (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean() > 0.98


def test_contamination(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r["item_id"]: r["text"].replace("ß", "ss") for r in items.collect()}
    items = spark.createDataFrame([*texts.items()], "item_id long, text string")
    rng = random.Random(2)
    docs, want = [None, "", "..."], {}
    filler = lambda n: " ".join("".join(rng.choice("qwxyz") for _ in range(6)) for _ in range(n))
    for k, t in texts.items():
        w = t.split()
        want[len(docs)] = k
        docs.append(f"{filler(rng.randrange(90))} {t.upper()} {filler(rng.randrange(40))}")
        for _ in range(max(1, len(w) // 12)):
            w[rng.randrange(len(w))] = "edited"
        want[len(docs)] = k
        docs.append(f"{filler(rng.randrange(90))} {' '.join(w)} {filler(9)}")
        docs.append(filler(120))
    rows = D.find_contamination(documents(spark, docs), items).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    exact = {(d, k) for d, k in want.items() if texts[k].upper() in docs[d]}
    assert exact <= found and len(found & set(want.items())) >= 0.95 * len(want) and {d for d, _ in found} <= set(want)
    assert all(r["edits"] == 0 for r in rows if (r["doc_id"], r["item_id"]) in exact) and all(r["edits"] <= 0.2 * r["item_words"] for r in rows)
    clean = D.keep_clean(documents(spark, docs), items)
    assert clean.columns == documents(spark).columns and {r["doc_id"] for r in clean.collect()} == set(range(len(docs))) - {d for d, _ in found}


def test_contamination_edges(spark):
    items = spark.createDataFrame([(1, None), (None, "a b c"), (2, ""), (3, "one"), (4, "Two words"), (5, "a text of five words"), (6, "a text of five words")], "item_id long, text string").withColumn("doc_id", F.lit(8))
    got = {(r["doc_id"], r["item_id"]) for r in D.find_contamination(documents(spark, ["x one y", "two  WORDS", "a text of five words", None, "nothing"]), items).collect()}
    assert got == {(0, 3), (1, 4), (2, 5), (2, 6)}
    assert D.find_contamination(documents(spark, []), items).count() == 0 and D.find_contamination(documents(spark), items.limit(0)).count() == 0


def brute_edits(item, doc):
    """Least word edits between the item and any part of the document, by the full table."""
    d = np.zeros(len(doc) + 1, int)
    for i, w in enumerate(item):
        new = np.empty_like(d)
        new[0] = i + 1
        for j, x in enumerate(doc):
            new[j + 1] = min(d[j + 1] + 1, new[j] + 1, d[j] + (w != x))
        d = new
    return int(d.min())


def test_contamination_equals_exhaustive_search(spark):
    """Every item against every part of every document: nothing beyond the bound is found, nearly all within it is."""
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (5, 8, 13, 20, 31, 50, 70) for _ in range(3)]
    docs = []
    for k in range(150):
        body = [*items[k % len(items)]]
        for _ in range(rng.randrange(0, int(0.3 * len(body)) + 1)):
            at = rng.randrange(len(body))
            body[at : at + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
        docs.append([rng.choice(vocabulary) for _ in range(rng.randrange(60))] + body + [rng.choice(vocabulary) for _ in range(rng.randrange(60))])
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in D.find_contamination(documents(spark, [" ".join(d) for d in docs]), table).collect()}
    want = {(d, i): e for d, doc in enumerate(docs) for i, item in enumerate(items) if (e := brute_edits(item, doc)) <= int(D.MOST_EDITS * len(item))}
    assert set(got) <= set(want) and all(got[k] >= want[k] for k in got) and len(got) >= 0.93 * len(want) > 90
    assert all(k in got for k, e in want.items() if e == 0)


def test_contamination_in_long_texts(spark):
    item = " ".join(f"item{k}" for k in range(40))
    docs = documents(spark, ["word " * 60_000 + item + " word" * 9, "word " * 90_000, item, item], [None, 2, 3, 3])
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["edits"]) for r in D.find_contamination(docs, table).collect()) == [(0, 0), (3, 0), (3, 0)]
    assert [r["doc_id"] for r in D.keep_clean(docs, table).collect()] == [2]


def test_semi_global_equals_table():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 14)).astype(np.uint64)
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0] = np.arange(len(a) + 1)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        assert D.semi_global(a, b[None, :])[0] == d[-1].min()


def test_walks_reach_the_target(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    index = D.index_items([r["item_id"] for r in items], [r["text"] for r in items])
    assert D.measured_recall(index, 0.0, seed=9) == 1.0 and D.measured_recall(index, D.MOST_EDITS, seed=9, trials=2000) >= 0.9


def test_walks_meet_crowded_edits():
    """Every second word edited at the front, in the middle or at the back, and edits everywhere, in items with and without repeats."""
    rng = np.random.default_rng(8)
    for pool in (10**9, 12):
        texts = [" ".join(f"w{x}" for x in rng.integers(0, pool, rng.integers(30, 80))) for _ in range(80)]
        index = D.index_items([*range(80)], texts)
        assert not index.counted and index.walks < 8
        for where in D.PLACEMENTS:
            assert D.measured_hits(index, D.MOST_EDITS, where, 800, seed=31)[1].mean() >= 0.92, where


def test_items_that_walks_miss_are_counted():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, n)) for n in (4, 9, 25, 60)]
    index = D.index_items([1, 2, 3, 4], texts, target=1.01, most=2)  # out of reach, so all are counted
    assert index.counted == (0, 1, 2, 3)
    for where in D.PLACEMENTS:
        assert D.measured_hits(index, D.MOST_EDITS, where, 400, seed=2)[1].all()
    # The places by counting hold every place from which an exhaustive search finds the item.
    words = np.concatenate([D.words_of(pa.array(["x y " + texts[1] + " z w1 w2"]))[0], index.words[1][:3]])
    got = {(int(r), int(p)) for r, _, p in D._by_counting(1, index.words[1], words, np.array([0, len(words) - 3, len(words)]))}
    assert (0, 2) in got and not any(r for r, _ in got)


def test_languages_equal_sets_of_ngrams(spark):
    """The bitmask filters against plain sets of the same n-grams: the same language wherever no false hit can decide."""
    rng = random.Random(6)
    letters = {"aa": "abcdeo", "bb": "aeioustr", "cc": "klmnoae", "dd": "éñabcr"}
    text = lambda lang: " ".join("".join(rng.choices(letters[lang], k=rng.randrange(2, 8))) for _ in range(rng.randrange(3, 60)))
    taught = [(text(k), k) for k in letters for _ in range(40)]
    order = sorted(((k, 40) for k in letters), key=lambda x: (-x[1], x[0]))
    model = L.fit(spark.createDataFrame(taught, "text string, lang string"), order)

    def grams_of(t):
        return L.grams(*L.byte_view(pa.array([t])))[0].tolist()

    counts = {k: defaultdict(int) for k in letters}
    for t, k in taught:
        for g in grams_of(t):
            counts[k][g] += 1
    total = {k: sum(c.values()) for k, c in counts.items()}
    share = {k: {g: n / total[k] for g, n in c.items()} for k, c in counts.items()}
    least = min(L.LEAST_SEEN, 1 + 40 // L.ROWS_A_SIGHT)
    held = {k: {g for g, n in c.items() if n >= least and share[k][g] >= L.LEAST_SHARE * max(share[j].get(g, 0) for j in letters)} for k, c in counts.items()}
    texts = [text(rng.choice([*letters])) for _ in range(400)] + ["", "123 456", None, "aeo"]
    names, scores = L.predict(model, pa.array(texts, pa.string()))
    decided = 0
    for t, name, s in zip(texts, names, scores, strict=True):
        if not t or not any(map(str.isalpha, t)):
            assert name == "und" and s == 0
            continue
        own = grams_of(t)
        hits = sorted(((sum(g in held[k] for g in own), -order.index((k, 40)), k) for k in letters), reverse=True)
        if hits[0][0] - hits[1][0] > 1 + 3 * len(own) * max(model.false_rates):
            assert name == hits[0][2] and s >= 0.5
            decided += 1
    assert decided > 300


def test_held_out_is_never_null(spark):
    docs = documents(spark, ["some words here", "others there"], [None, 4])
    found = L.identify(docs, L.fit_from(docs))
    assert found.count() == 2
    for name in ("op3_language_id", "op6_toxicity"):
        df = queries.queries()[name](spark, SF)
        assert df.where("held_out is null").count() == 0 and df.schema["held_out"].dataType.simpleString() == "boolean"


def test_a_row_repeated_is_divided(spark):
    rows = S.assign(documents(spark, ["same text"] * 3000, [7] * 3000)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == [*range(16)] and all(sorted(v) == [*range(len(v))] and abs(len(v) - 187.5) <= 1 for v in by.values())


def test_license_scan_of_many_matches(spark):
    said = "this is under the mit license and gnu general public license version 2 or apache license version 2 "
    n = 3400
    began = time.time()
    r = C.scan(documents(spark, [said * n, said])).orderBy("doc_id").collect()
    assert time.time() - began < 120
    many, one = r
    assert len(many["detections"]) == n * len(one["detections"]) > 10_000 and many["n_base"] == n * one["n_base"] and many["labels"] == one["labels"]
    step = len(said)
    assert [(d["label"], d["b"] % step) for d in many["detections"][: len(one["detections"])]] == [(d["label"], d["b"]) for d in one["detections"]]


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run_and_scan_whole_tables(spark, name):
    df = queries.queries()[name](spark, SF)
    source = {"op5_warc_dictionary": "pages", "op10_embedding_near_dedup": "embeddings"}.get(name, "documents")
    n = spark.read.parquet(f"{SF}/{source}.parquet").count()
    assert df.count() == n or name == "op1_benchmark_decontamination"
