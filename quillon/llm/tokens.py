"""BPE encoding with chunk reuse (operator 2) and token counts by heap merging (operator 4).

Both work on one fact of the vocabulary files in JSON form with word ends: white space always separates words and is
then dropped, no merge crosses a word, and special strings hold no white space.  ``word_vocabulary`` refuses files of
another make.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import SLICE_BYTES, bounded_batches, held, schema, slices, table

VOCABULARY = "word_bpe_49k.json"
#: Chunks are cut where the low MASK_BITS bits of the rolling hash are zero: 2**MASK_BITS bytes on average.
MASK_BITS, WINDOW, MAX_CHUNK = 9, 32, 8192
#: Bytes of the caches of a Python worker: encoded chunks, of which the longest unused go; words and units, held in two
#: generations of WORD_BYTES each, of which the older goes; the counter's numbers, which all go at once.
CHUNK_BYTES, WORD_BYTES, COUNT_BYTES = 16 << 20, 16 << 20, 64 << 20
#: Words and units longer than this are not cached, and longer words are cut where no merge can reach before merging.
LONGEST, CUT_WORD = 256, 4096
# What a vocabulary file must say of normalisation and words.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_vocabulary(path: str) -> dict:
    """The vocabulary file's content; ValueError if its words, normalisation, decoder or special strings are others than assumed."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    plain = model["type"] == "BPE" and model.get("end_of_word_suffix") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    special = all(t["special"] and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    if not (plain and special and spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _PRE_TOKENIZER and spec["decoder"] is None and spec["post_processor"] is None):
        raise ValueError(f"{path}: only BPE vocabularies with word ends, lower case and dropped white space are understood")
    return spec


def cut_points(raw: np.ndarray) -> np.ndarray:
    """Ends of the content-defined chunks of UTF-8 bytes, the last being its length.

    The hash at a byte is the sum of gear values of the last WINDOW bytes, each shifted by its distance; it is built
    by doubling, so a whole text takes log2(WINDOW) vector steps.  No cut falls inside a character.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64)
    h, span = _GEAR[raw], 1
    while span < WINDOW:
        h[span:] += h[:-span].copy() << np.uint64(span)
        span *= 2
    cuts = np.flatnonzero(h >> np.uint64(64 - MASK_BITS) == 0) + 1
    cuts = cuts[cuts < n]
    bounds = np.concatenate([[0], cuts, [n]])
    gaps = np.diff(bounds)
    if (gaps > MAX_CHUNK).any():
        more = [np.arange(a + MAX_CHUNK, b, MAX_CHUNK) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b - a > MAX_CHUNK]
        cuts = np.unique(np.concatenate([cuts, *more]))
    for _ in range(3):
        inside = (raw[np.minimum(cuts, n - 1)] & 0xC0) == 0x80
        inside &= cuts < n
        if not inside.any():
            break
        cuts = cuts + inside
    cuts = np.unique(cuts[cuts < n])
    return np.append(cuts, n)


Ids = tuple[int, ...]


class ChunkEncoder:
    """Encodes texts as the tokenizers library does, each distinct chunk once while it stays in the cache.

    A chunk's own tokens are those of its units between white space.  What lies across a cut is encoded again by the
    library in one window, which reaches over the nearest unit of the chunks on both sides: its tokens must agree with
    those chunks' own at both ends, else the text is encoded whole.
    """

    def __init__(self, path: str, chunk_bytes: int = CHUNK_BYTES, word_bytes: int = WORD_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.tokens = [""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.tokens[i] = t
        #: Every id as one object that all caches share, and as decimal text.
        self.number = [*range(len(self.tokens))]
        self.decimal = [*map(str, self.number)]
        end = self.tokenizer.model.end_of_word_suffix
        # A special string is a token of its own and separates what stands beside it.
        self.mark_id, mark = next((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special)
        self.mark, self.mark_start = mark, mark[:2].encode()
        self.ends_word = np.array([t.endswith(end) for t in self.tokens])
        #: Per chunk: text before its first white space, ids of what lies between, text after its last white space, and
        #: the pieces that a window reaches over at both ends with their ids; or None for a chunk without white space.
        self.chunks: OrderedDict[bytes, tuple | None] = OrderedDict()
        self.words: dict[str, Ids] = {}
        self.units: dict[bytes, Ids] = {}
        self.old_words: dict[str, Ids] = {}
        self.old_units: dict[bytes, Ids] = {}
        # Texts of printable ASCII (without the first byte of a special string) and precomposed Latin letters are split
        # into words here, by the vocabulary's own pattern, so that capitals and marks beside a word cost nothing.
        self.simple = re.compile(r"[ -;=-~\t\n\r\x0b\x0cÀ-ÖØ-öø-įı-ſ]*")
        self.words_of = re.compile(_WORDS.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}").replace(r"[^\s\p{L}\p{N}]", r"[^\sa-zß-öø-ſ0-9]").replace(r"\p{L}", "[a-zß-öø-ſ]").replace(r"\p{N}", "[0-9]"))
        self.edge = re.compile(rb"(\S*)(\s(?:.*\s)?)(\S*)", re.DOTALL)
        self.chunk_bytes, self.word_bytes = chunk_bytes, word_bytes
        self.chunks_held = self.words_held = 0
        self.hits = self.misses = self.disagreed = 0

    def rendered(self, ids) -> tuple[str, int, str]:
        """Decimal ids joined by blanks, their number, and the decoded text: the tokens joined by blanks."""
        return " ".join(map(self.decimal.__getitem__, ids)), len(ids), " ".join(map(self.tokens.__getitem__, ids))

    def _ids(self, texts: list[str]) -> Iterator[Ids]:
        number = self.number.__getitem__
        for start in range(0, len(texts), 20_000):
            for e in self.tokenizer.encode_batch_fast(texts[start : start + 20_000], add_special_tokens=False):
                yield tuple(map(number, e.ids))

    def _window_ids(self, windows: list[bytes]) -> dict[bytes, Ids]:
        """The ids of windows; those in which no special string can begin are encoded many at a time, one between them."""
        plain = [w for w in windows if self.mark_start not in w]
        texts = [plain[k : k + 64] for k in range(0, len(plain), 64)]
        out: dict[bytes, Ids] = {}
        for own, ids in zip(texts, self._ids([self.mark.join([w.decode() for w in t]) for t in texts]), strict=True):
            at = np.flatnonzero(np.array(ids, np.int64) == self.mark_id).tolist()
            out.update(zip(own, [ids[a:b] for a, b in zip([0, *(x + 1 for x in at)], [*at, len(ids)], strict=True)], strict=True))
        rest = [w for w in windows if w not in out]
        out.update(zip(rest, self._ids([w.decode() for w in rest]), strict=True))
        return out

    def _word_ids(self, words: list[str]) -> list[Ids]:
        """The ids of single words, many encoded as one text: a word's last token, and no other, ends a word."""
        texts = [words[k : k + 256] for k in range(0, len(words), 256)]
        out: list[Ids] = []
        for own, ids in zip(texts, self._ids([" ".join(t) for t in texts]), strict=True):
            ends = (np.flatnonzero(self.ends_word[np.array(ids, np.int64)]) + 1).tolist()
            if len(ends) != len(own) or ends[-1] != len(ids):
                raise ValueError("a word of the vocabulary's pattern has other tokens beside others than alone")
            out += [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def _fill(self, wanted: set, known: dict, older: dict) -> list:
        """Puts what is wanted into ``known``: from the older generation, or else by the tokenizer; returns the long ones."""
        missing = wanted - known.keys()
        kept = missing & older.keys()
        known.update((w, older[w]) for w in kept)
        new = [*(missing - kept)]
        got = [*self._ids([w.decode() for w in new])] if known is self.units else self._word_ids(new)
        known.update(zip(new, got, strict=True))
        self.words_held += 250 * len(missing) + sum(map(len, missing)) + 8 * sum(map(len, got))
        return [w for w in new if len(w) > LONGEST]

    def _own_tokens(self, parts: list[bytes]) -> list[tuple[Ids, Ids, Ids]]:
        """Of every run of units: its ids, and those of its first and of its last unit."""
        if self.words_held > self.word_bytes:
            self.old_words, self.old_units = self.words, self.units
            self.words, self.units, self.words_held = {}, {}, 0
        words, units, split = set(), set(), []
        for p in parts:
            text = p.decode()
            ends = p.split(None, 1)[:1] + p.rsplit(None, 1)[-1:]
            if self.simple.fullmatch(text):
                whole = self.words_of.findall(text.lower())
                words.update(whole)
                split.append((self.words, whole, [self.words_of.findall(e.decode().lower()) for e in ends]))
            else:
                whole = p.split()
                units.update(whole)
                split.append((self.units, whole, [[e] for e in ends]))
        long = [(self.words, self._fill(words, self.words, self.old_words)), (self.units, self._fill(units, self.units, self.old_units))]
        out = []
        for known, whole, ends in split:
            ids, *sides = (tuple(chain.from_iterable(map(known.__getitem__, x))) for x in (whole, *ends))
            out.append((ids, sides[0] if sides else (), sides[-1] if sides else ()))
        for known, over in long:
            for w in over:  # once is enough for what is long
                self.words_held -= 250 + len(w) + 8 * len(known.pop(w))
        return out

    def _learn(self, fresh: list[bytes]) -> dict[bytes, tuple | None]:
        """The entries of chunks, a bounded share of them at a time."""
        made: dict[bytes, tuple | None] = {}
        group: list[tuple[bytes, tuple[bytes, bytes, bytes]]] = []
        held_bytes = 0

        def close() -> None:
            for (p, (head, inner, tail)), (own, first, last) in zip(group, self._own_tokens([g[1][1] for g in group]), strict=True):
                body = inner.rstrip()
                front = inner[: len(inner) - len(inner.lstrip())] + (body.split(None, 1)[0] if body else b"")
                back = (body.rsplit(None, 1)[-1] if body else b"") + inner[len(body) :]
                made[p] = (head, own, tail, (front, first), (back, last))

        for p in fresh:
            m = self.edge.fullmatch(p)
            if not m:
                made[p] = None
                continue
            group.append((p, m.groups()))
            held_bytes += len(p)
            if held_bytes > SLICE_BYTES:
                close()
                group, held_bytes = [], 0
        close()
        return made

    def _cost(self, p: bytes, entry: tuple | None) -> int:
        return 300 if entry is None else 900 + 2 * len(p) + 8 * len(entry[1])

    def encode(self, texts: list[bytes]) -> Iterator[list[int]]:
        """The ids of each text."""
        cut, fresh, made = [], {}, {}
        for data in texts:
            ends = cut_points(np.frombuffer(data, np.uint8)).tolist()
            parts = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            cut.append(parts)
            for p in parts:
                if p in self.chunks:
                    self.hits += 1
                    self.chunks.move_to_end(p)
                    made[p] = self.chunks[p]
                elif p in fresh:
                    self.hits += 1
                else:
                    self.misses += 1
                    fresh[p] = None
        made |= self._learn([*fresh])
        # A plan alternates windows (before, bytes, after) and the chunks' own tokens between them.
        plans, windows = [], {}
        for parts in cut:
            plan, carry, before = [], [], (b"", ())
            for p in parts:
                entry = made[p]
                if entry is None:  # no white space: the window grows over the whole chunk
                    carry.append(p)
                    continue
                head, own, tail, front, back = entry
                carry.append(head)
                plan += [(before, b"".join(carry), front), own]
                before, carry = back, [tail]
            plan.append((before, b"".join(carry), (b"", ())))
            plans.append(plan)
            windows.update((x[0][0] + x[1] + x[2][0], None) for x in plan[::2] if x[1])
        windows = self._window_ids([*windows])
        for data, plan in zip(texts, plans, strict=True):
            out: list[int] = []
            for k, x in enumerate(plan):
                if k % 2:
                    out.extend(x)
                elif x[1]:
                    (back, left), carry, (front, right) = x
                    ids = windows[back + carry + front]
                    end = len(ids) - len(right)
                    if len(left) > end or ids[: len(left)] != left or ids[end:] != right:
                        self.disagreed += 1
                        out = [*next(self._ids([data.decode()]))]
                        break
                    out.extend(ids[len(left) : end])
            yield out
        for p in fresh:
            self.chunks[p] = made[p]
            self.chunks_held += self._cost(p, made[p])
        while self.chunks_held > self.chunk_bytes:
            self.chunks_held -= self._cost(*self.chunks.popitem(last=False))


def checked_path(vocabulary: str) -> str:
    """The vocabulary file's place; ValueError before any task runs if it is of another make."""
    path = vocabulary_path(vocabulary)
    word_vocabulary(path)
    return path


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ids (decimal, joined by one blank), n_tokens and decoded text of every row.

    A null text counts as empty; empty texts have no tokens and decode to the empty text; a null key stays null,
    repeated keys give repeated rows, an empty table none; further columns are ignored, whatever their names.  Memory: SLICE_BYTES of
    text, or one longer text, and caches bounded in bytes per worker.
    """
    checked_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held(ChunkEncoder, vocabulary_path(vocabulary))
        for b in slices(batches, "_text", holding=True):
            got = [coder.rendered(ids) for ids in coder.encode([x.encode() if x else b"" for x in b.column(1).to_pylist()])]
            yield pa.record_batch([b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.string())], names=["_key", "ids", "n_tokens", "decoded"])

    source = bounded_batches(docs).select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, schema(f"_key {kind}, ids string, n_tokens bigint, decoded string")).withColumnRenamed("_key", key)


def encode_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; the digests are taken beside the encoder so that no ids travel.

    Nulls, empty and long texts, repeated rows, empty tables and further columns as in ``encode_documents``; texts
    without tokens have the digests of empty strings.
    """
    checked_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held(ChunkEncoder, vocabulary_path(vocabulary))
        for b in slices(batches, "text", holding=True):
            n, ids, decoded = [], [], []
            for a, k, d in map(coder.rendered, coder.encode([x.encode() if x else b"" for x in b.column(1).to_pylist()])):
                n.append(k)
                ids.append(hashlib.sha256(a.encode()).hexdigest())
                decoded.append(hashlib.sha256(d.encode()).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = bounded_batches(docs).select("doc_id", docs["text"].cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, schema(f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"))


def _byte_letters() -> list[str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class HeapCounter:
    """Counts the tokens of a text without making identifiers.

    Per word: symbols in a doubly linked list, every adjacent pair with a rank in a heap; the lowest (rank, place) is
    popped, stale entries are skipped, and the count is the number of first symbols less the merges made.
    """

    def __init__(self, path: str, most: int = COUNT_BYTES):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.ranks: dict[tuple[str, str], tuple[int, str]] = {}
        for i, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((a, b), (i, a + b))
        self.words_of = regex.compile(_WORDS)
        #: Letters that stand side by side within some token: a merge reaches over no other pair.
        self.beside = {x[k : k + 2] for t in spec["model"]["vocab"] for x in [t.removesuffix(self.end)] for k in range(len(x) - 1)}
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.any_special = min((t["content"] for t in spec["added_tokens"]), key=len)[:2].encode()
        self.letters = _byte_letters()
        self.units: dict[bytes, int] = {}
        self.words: dict[str, int] = {}
        self.most, self.held = most, 0

    def merge_count(self, word: str) -> int:
        """Tokens of a word.  A long word is cut first between letters that no token holds side by side."""
        letters = [self.letters[b] for b in word.encode()]
        if len(letters) <= CUT_WORD:
            return self._merged(letters, self.end)
        total, start = 0, 0
        for k in range(1, len(letters)):
            if letters[k - 1] + letters[k] not in self.beside:
                total, start = total + self._merged(letters[start:k], ""), k
        return total + self._merged(letters[start:], self.end)

    def _merged(self, symbols: list[str], end: str) -> int:
        n = len(symbols)
        if n < 2:
            return n
        symbols[-1] += end
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        ranks, heap = self.ranks, []
        for i in range(n - 1):
            got = ranks.get((symbols[i], symbols[i + 1]))
            if got:
                heap.append((got[0], i, got[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i, whole = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j < 0:
                continue
            now = ranks.get((symbols[i], symbols[j]))
            if now is None or now[0] != rank:
                continue
            merges += 1
            symbols[i], symbols[j] = whole, None
            k = after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                got = ranks.get((whole, symbols[k]))
                if got:
                    heapq.heappush(heap, (got[0], i, got[1]))
            p = before[i]
            if p >= 0:
                got = ranks.get((symbols[p], whole))
                if got:
                    heapq.heappush(heap, (got[0], p, got[1]))
        return n - merges

    def _plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # One letter at a time: no final sigma.
            text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        total = 0
        for m in self.words_of.finditer(text):
            w = m[0]
            got = self.words.get(w)
            if got is None:
                got = self.merge_count(w)
                if len(w) <= LONGEST:
                    self.words[w] = got
                    self.held += 200 + len(w)
            total += got
        return total

    def unit(self, u: bytes) -> int:
        text = u.decode()
        if self.any_special in u:
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self._plain(p) for p in parts)
        return self._plain(text)

    def count(self, data: bytes) -> int:
        if self.held > self.most:
            self.words.clear()
            self.units.clear()
            self.held = 0
        known, total = self.units, 0
        # A long text goes in parts that end at white space, so that its list of units stays short.
        for part in [data] if len(data) <= SLICE_BYTES else _parts(data):
            units = part.split()
            try:
                total += sum([known[u] for u in units])
            except KeyError:
                for u in units:
                    got = known.get(u)
                    if got is None:
                        got = self.unit(u)
                        if len(u) <= LONGEST:
                            known[u] = got
                            self.held += 200 + len(u)
                    total += got
        return total


def _parts(data: bytes) -> Iterator[bytes]:
    """The bytes in parts of about SLICE_BYTES, each ending before white space."""
    start = 0
    for m in re.finditer(rb"\s", data):
        if m.start() - start >= SLICE_BYTES:
            yield data[start : m.start()]
            start = m.start()
    yield data[start:]


def count_tokens(docs: DataFrame, limit: int = 2048, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    A null text counts as empty: no bytes, no tokens.  A null key stays null, repeated keys give repeated rows, an
    empty table none; further columns are ignored, whatever their names.  Memory: SLICE_BYTES of text, or one longer
    text, and a cache bounded in bytes per worker.
    """
    checked_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(HeapCounter, vocabulary_path(vocabulary))
        for b in slices(batches, "_text", holding=True):
            data = [x.encode() if x else b"" for x in b.column(1).to_pylist()]
            n = [counter.count(x) for x in data]
            yield pa.record_batch([b.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["_key", "n_bytes", "n_tokens", "over_limit"])

    source = bounded_batches(docs).select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, schema(f"_key {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")).withColumnRenamed("_key", key)


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
