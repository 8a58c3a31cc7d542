"""Byte-level BPE by a global shuffle of distinct words (operator 11).

Texts are cut into words by the vocabulary's pattern.  The words that a bounded sample shows to be frequent get numbers,
which every worker knows; every other word travels with its position to where all its occurrences meet, is encoded once,
and its ids travel back to their positions.  Cutting works on stretches between blanks: those that the sample shows to be
frequent are looked up by the million, the others are cut by the pattern.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, byte_view, give_back, held, hot_keys, pack_numbers, passing_shuffles, release, salted_join, schema, settle, slices, table, unpack_numbers, whole_groups

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Rows of the sample in which frequent words are sought, stretches between blanks that may count as frequent, and their
#: longest in characters.
SAMPLE_ROWS, FREQUENT, LONGEST = 1 << 17, 1 << 20, 64
#: Bytes of text that are cut at a time; distinct stretches that a task counts before it hands them on.
GATHERED, COUNTED = 4 << 20, 1 << 18
#: Words put together at a time when texts are reassembled.
STEP_WORDS = 1 << 20
#: Words of more bytes are merged by a heap.
SHORT = 64
#: White space next to a blank, or at an end: such texts are cut as a whole.
_ODD = r"^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]| [\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] |[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]$|^\x0B|\x0B | \x0B"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Ranks:
    """The vocabulary: ids by bytes, and the merging of a word's bytes by lowest rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.id_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        if missing := [b for b in range(256) if bytes([b]) not in self.id_of]:
            raise ValueError(f"{path}: no ranks for the bytes {missing[:9]}")
        self.most = max(self.id_of.values())
        #: The bytes of every id; None where there is none.
        self.token: list[bytes | None] = [None] * (self.most + 1)
        for t, i in self.id_of.items():
            self.token[i] = t

    def encode(self, word: bytes) -> list[int]:
        """The ids of one word: the word itself if it has one, else adjacent parts merged, the lowest rank first."""
        whole = self.id_of.get(word)
        if whole is not None:
            return [whole]
        return self._short(word) if len(word) <= SHORT else self._long(word)

    def _short(self, word: bytes) -> list[int]:
        parts, get = [word[k : k + 1] for k in range(len(word))], self.id_of.get
        ranks = [get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            known = [r for r in ranks if r is not None]
            if not known:
                return [self.id_of[p] for p in parts]
            k = ranks.index(min(known))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = get(parts[k] + parts[k + 1])
            if k:
                ranks[k - 1] = get(parts[k - 1] + parts[k])

    def _long(self, word: bytes) -> list[int]:
        n, get = len(word), self.id_of.get
        parts: list[bytes | None] = [word[k : k + 1] for k in range(n)]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, k) for k in range(n - 1) if (r := get(word[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k]
            if parts[k] is None or j < 0 or get(parts[k] + parts[j]) != rank:
                continue
            parts[k] += parts[j]
            parts[j] = None
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (r := get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [self.id_of[p] for p in parts if p is not None]


_POINTS = frozenset(".,;:!?)\"")


def after_blank(unit: str, find: Callable[[str], list[str]]) -> list[str]:
    """The words of a stretch that stands after a blank; plain ones need no pattern."""
    if unit.isalpha():
        return [" " + unit]
    if unit[-1:] in _POINTS and unit[:-1].isalpha():
        return [" " + unit[:-1], unit[-1]]
    return find(" " + unit)


#: Odd factors of the hashes, and masks of the lowest bytes of a number by how many of them count.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Lookup:
    """Places of words in a list, found many at a time by hashes; the texts decide.

    A word that finds no free slot in any table, or shares its hash with another, is not found: this costs time and changes no result.
    """

    def __init__(self, values: pa.Array):
        self.values = values
        self.longest = pc.max(pc.binary_length(values)).as_py() or 0
        self.hashes = self._hashes(values)
        self.shift = np.uint64(64 - max(4, (2 * len(values)).bit_length()))
        self.tables, left = [], np.arange(len(values), dtype=np.int32)
        for factor in _FACTORS:
            table = np.full(1 << 64 - int(self.shift), -1, np.int32)
            slots = (self.hashes[left] * factor) >> self.shift
            table[slots] = left
            left = left[table[slots] != left]
            self.tables.append(table)
            if not len(left):
                break

    def _hashes(self, values: pa.Array) -> np.ndarray:
        raw, offsets = byte_view(values)
        raw = np.append(raw, np.zeros(8, np.uint8))
        eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        starts, sizes = offsets[:-1], np.diff(offsets)
        found, rows = sizes.astype(np.uint64) * _FACTORS[0], np.flatnonzero(sizes)
        for at in range(0, self.longest, 8):
            left = sizes[rows] - at
            mixed = (found[rows] ^ (eight[starts[rows] + at] & _LOWEST[np.minimum(left, 8)])) * _FACTORS[1]
            found[rows] = mixed ^ (mixed >> np.uint64(31))
            rows = rows[left > 8]
        return found

    def find(self, words: pa.Array) -> np.ndarray:
        """For each word its place in the list, -1 where it has none."""
        found = np.full(len(words), -1, np.int32)
        if not len(self.values) or not len(words):
            return found
        own, left = self._hashes(words), np.arange(len(words))
        for factor, table in zip(_FACTORS, self.tables, strict=False):
            at = table[(own[left] * factor) >> self.shift]
            same = (at >= 0) & (self.hashes[at] == own[left])
            found[left[same]] = at[same]
            left = left[~same]
        likely = np.flatnonzero(found >= 0)
        same = pc.equal(self.values.take(pa.array(found[likely])), words.take(pa.array(likely))).to_numpy(zero_copy_only=False)
        found[likely[~same]] = -1
        return found


def _cutter(shared: Broadcast, pattern: str) -> Cutter:
    return Cutter(shared.value, pattern)


def _finish(shared: Broadcast, path: str) -> Finish:
    return Finish(shared.value, path)


def _listed(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all().combine_chunks()


def spread_out(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The parts of ``flat`` that begin at ``starts`` and have ``sizes``, end to end."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


class Cutter:
    """Cuts texts into words and names each by its number from 1, rare ones by negative numbers that count a call's rare words.

    Between two characters that are no white space a single blank always opens a word, so what stands between such blanks
    can be cut by itself.  Texts with other white space beside a blank, or at an end, are cut as a whole.
    """

    def __init__(self, packed: tuple[bytes, bytes], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.words = Lookup(_listed(packed[0]).column("word").combine_chunks())
        units = _listed(packed[1])
        self.units = Lookup(units.column("unit").combine_chunks())
        flat, sizes = unpacked_rows(units.column("words"))
        self.unit_words, self.unit_sizes, self.unit_starts = (x.astype(np.int32) for x in (flat, sizes, np.cumsum(sizes) - sizes))

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(numbers of the words of all texts, how many each text has, the rare words in order)."""
        find = self.find
        odd = pc.match_substring_regex(texts, pattern=_ODD)
        split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        units, first = split.flatten(), split.offsets.to_numpy()[:-1] - split.offsets.to_numpy()[0]
        at = self.units.find(units)
        at[first] = -1  # no blank before it
        missing = np.flatnonzero(at < 0)
        words: list[str] = []
        ends = []
        opens = np.zeros(len(at), bool)
        opens[first] = True
        whole = iter(zip(odd.to_pylist(), texts.to_pylist(), strict=True))
        for unit, begins in zip(units.take(pa.array(missing)).to_numpy(zero_copy_only=False).tolist(), opens[missing].tolist(), strict=True):
            if begins:
                is_odd, text = next(whole)
                words += find(text if is_odd else unit)
            else:
                words += after_blank(unit, find)
            ends.append(len(words))
        number = self.words.find(pa.array(words, pa.string())) + 1
        none = np.flatnonzero(number == 0)
        number[none] = -1 - np.arange(len(none), dtype=np.int32)
        rare = [words[k] for k in none.tolist()]
        sizes, starts = (x[at] if len(x) else np.zeros(len(at), np.int32) for x in (self.unit_sizes, self.unit_starts))
        sizes[missing] = np.diff(np.array([0, *ends]))
        starts[missing] = len(self.unit_words) + np.array([0, *ends[:-1]])
        numbers = spread_out(np.concatenate([self.unit_words, number]), starts, sizes)
        upto = np.append(0, np.cumsum(sizes))
        return numbers, np.diff(upto[np.append(first, len(sizes))]), rare


def gathered(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about GATHERED bytes of text, nulls of the column as empty texts."""

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        k = whole.schema.get_field_index(column)
        return whole.set_column(k, column, pc.fill_null(whole.column(k), "")).combine_chunks().to_batches()[0]

    held_batches, size = [], 0
    for b in slices(batches, column, holding=True):
        held_batches.append(b)
        size += pc.sum(pc.binary_length(b.column(column))).as_py() or 0
        if size >= GATHERED:
            yield joined(held_batches)
            held_batches, size = [], 0
    if held_batches:
        yield joined(held_batches)


def encode_distinct(words: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(word, ids) of the column ``word``, each row encoded by itself; the ids are packed (``pack_numbers``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = held(Ranks, vocabulary_path(vocabulary))
        for b in slices(batches, "word", holding=True):
            ids = [ranks.encode(w.encode()) for w in b.column(0).to_pylist()]
            yield pa.record_batch([b.column(0), packed_rows(np.fromiter(chain.from_iterable(ids), np.int64), [*map(len, ids)])], names=["word", "ids"])

    return bounded_batches(words.select("word")).mapInArrow(run, schema("word string, ids binary"))


def packed_rows(values: np.ndarray, sizes) -> pa.Array:
    """The packed numbers of each of the rows that stand end to end in ``values``, as binary."""
    raw, ends = pack_numbers(values)
    bounds = np.append(0, ends)[np.append(0, np.cumsum(sizes, dtype=np.int64))].astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).cast(pa.binary())


def unpacked_rows(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers of all rows end to end, how many each row has) of packed numbers."""
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    rows = rows.cast(pa.large_binary())
    offsets = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
    data = (rows.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[offsets[0] : offsets[-1]]
    last = np.append(0, np.cumsum(np.frombuffer(data, np.uint8) < 128))
    return unpack_numbers(data), np.diff(last[offsets - offsets[0]])


def _stream(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _most(rows: DataFrame, most: int) -> DataFrame:
    """The rows of greatest n, up to ``most`` of them: how many there are by (coarse) n tells from which one on they fit."""
    level, left, least = F.floor(F.log2("n") * 16), most, None
    for r in sorted(rows.groupBy(level.alias("level")).count().collect(), reverse=True):
        if r["count"] > left:
            break
        left, least = left - r["count"], r["level"]
    return rows.where(level >= least) if least is not None else rows.limit(0)


def frequent_words(docs: DataFrame, text: str, vocabulary: str, pattern: str, rows: int = SAMPLE_ROWS, most: int = FREQUENT) -> tuple[bytes, bytes]:
    """Up to ``most`` words that occur repeatedly in a sample of about ``rows`` rows, with ids and the most frequent first,
    and up to ``most`` stretches between blanks that do so, with the numbers of their words.

    Only which words are spared the shuffle hangs on the sample, no result.  The lists are bounded (``most`` stretches of up
    to LONGEST characters), so the driver may hold them and hand them to the workers.
    """
    n = docs.count()
    chosen = docs.select(docs[text].cast("string").alias("_text"), F.monotonically_increasing_id().alias("_row"))
    if n > rows:
        chosen = chosen.where(F.pmod(F.xxhash64(F.lit(11), "_row"), F.lit(1 << 31)) < int(rows / n * (1 << 31)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()

        def rows_of() -> pa.RecordBatch:
            kept = {u: k for u, k in seen.items() if u and len(u) <= LONGEST and not (u[0].isspace() or u[-1].isspace())}
            seen.clear()
            return pa.record_batch([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], names=["unit", "n"])

        for b in slices(batches, "_text"):
            for t in b.column(0).to_pylist():
                seen.update(t.split(" ")[1:] if t else ())
            if len(seen) > COUNTED:
                yield rows_of()
        yield rows_of()

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        for b in slices(batches, "unit"):
            yield pa.record_batch([b.column(0), b.column(1), pa.array([after_blank(u, find) for u in b.column(0).to_pylist()], pa.list_(pa.string()))], names=["unit", "n", "words"])

    units = bounded_batches(chosen.select("_text")).mapInArrow(count, schema("unit string, n bigint")).groupBy("unit").agg(F.sum("n").alias("n"))
    units = settle(units.mapInArrow(words_of, schema("unit string, n bigint, words array<string>")))
    words = settle(units.select(F.explode("words").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"))
    counted = (words, units)
    words, units = _most(words, most), _most(units.where("n > 1"), most)
    found = encode_distinct(words, vocabulary).join(words, "word").toArrow().combine_chunks()
    found = found.take(pc.sort_indices(found, [("n", "descending"), ("word", "ascending")])).select(["word", "ids"]).combine_chunks()
    names = found.column("word").combine_chunks() if found.num_rows else pa.array([], pa.string())
    first = _stream(found)
    del found
    give_back()
    own = units.select("unit", "words").toArrow().combine_chunks()
    release(*counted)
    lists = own.column("words").combine_chunks() if own.num_rows else pa.array([], pa.list_(pa.string()))
    numbers = Lookup(names).find(lists.flatten()).astype(np.int64) + 1
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    packs = packed_rows(numbers, sizes.tolist())
    # Stretches with a word that is not listed are cut by the pattern.
    whole = np.diff(np.append(0, np.cumsum(numbers > 0))[np.append(0, np.cumsum(sizes))]) == sizes
    listed, packs = (x.filter(pa.array(whole)) for x in (own.column("unit").combine_chunks() if own.num_rows else pa.array([], pa.string()), packs))
    # Each word after a blank is a stretch of its own, too.
    alone = pc.and_(pc.starts_with(names, " "), pc.greater(pc.utf8_length(names), 1))
    stretch = pc.utf8_slice_codeunits(names, 1)
    alone = np.flatnonzero(pc.and_(alone, pc.invert(pc.is_in(stretch, value_set=listed))).to_numpy(zero_copy_only=False))
    del own, lists
    units = pa.concat_arrays([listed, stretch.take(pa.array(alone))])
    second = _stream(pa.table({"unit": units, "words": pa.concat_arrays([packs, packed_rows(alone + 1, np.ones(len(alone), np.int64))])}))
    del units, listed, packs, stretch, names
    give_back()
    return first, second


def _rare_words(source: DataFrame, shared: Broadcast, pattern: str) -> DataFrame:
    """(word, row, mark, at): every occurrence of a word that is not frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = held(_cutter, shared, pattern)
        for b in gathered(batches, "_text"):
            numbers, sizes, rare = cutter.cut(b.column(3))
            at = np.flatnonzero(numbers < 0)
            begins = np.cumsum(sizes) - sizes
            row = np.searchsorted(begins + sizes, at, side="right")
            for k in range(0, len(at), 50_000):
                part = pa.array(row[k : k + 50_000])
                yield pa.record_batch([pa.array(rare[k : k + 50_000], pa.string()), b.column(0).take(part), b.column(1).take(part), pa.array((at[k : k + 50_000] - begins[row[k : k + 50_000]]).astype(np.int32))], names=["word", "row", "mark", "at"])

    return source.mapInArrow(run, schema("word string, row bigint, mark int, at int"))


def _numbered_texts(source: DataFrame, shared: Broadcast, pattern: str) -> DataFrame:
    """(row, mark, at, _key, n, data): every text as the packed numbers of its n words, 0 where a rare one stands."""
    kind = source.schema[2].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = held(_cutter, shared, pattern)
        for b in gathered(batches, "_text"):
            numbers, sizes, _ = cutter.cut(b.column(3))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.full(len(sizes), -1, np.int32)), b.column(2), pa.array(sizes, pa.int64()), packed_rows(np.maximum(numbers, 0), sizes)], names=["row", "mark", "at", "_key", "n", "data"])

    return source.mapInArrow(run, schema(f"row bigint, mark int, at int, _key {kind}, n bigint, data binary"))


def _reassembled(rows: pa.Table) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of whole texts, each followed by its rare words by position: keys, the words of all texts end to end (numbers of
    frequent ones, -1, -2, ... for the rare ones in order), how many each text has, and the rare words' ids and their numbers."""
    at = rows.column("at").to_numpy()
    opens = np.flatnonzero(at < 0)
    n = rows.column("n").combine_chunks().drop_null().to_numpy()
    begins = np.append(0, np.cumsum(n))
    if len(opens) != len(n) or (len(at) and not len(opens)) or (len(opens) and opens[0]):
        raise RuntimeError("rare words without their text: the input was not read twice in the same order")
    starts = [0]
    while starts[-1] < len(n):  # texts of about STEP_WORDS words at a time
        starts.append(max(starts[-1] + 1, int(np.searchsorted(begins, begins[starts[-1]] + STEP_WORDS, side="right")) - 1))
    bounds = np.append(opens, len(at))
    for a, b in zip(starts, starts[1:], strict=False):
        part = rows.slice(bounds[a], bounds[b] - bounds[a])
        own = part.column("at").to_numpy()
        texts, sizes = own < 0, n[a:b]
        base = np.cumsum(sizes) - sizes
        data = part.column("data")
        numbers, _ = unpacked_rows(data.filter(pa.array(texts)))
        holes = np.flatnonzero(numbers == 0)
        places = np.repeat(base, np.diff(np.append(np.flatnonzero(texts), len(own))) - 1) + own[~texts]
        if len(places) != len(holes) or (places != holes).any():
            raise RuntimeError("rare words do not fit their text: the input was not read twice in the same order")
        numbers[holes] = -1 - np.arange(len(holes))
        yield part.column("_key").filter(pa.array(texts)).combine_chunks(), numbers, sizes, *unpacked_rows(data.filter(pa.array(~texts)))


class Table:
    """Values by number, looked up many at a time: what stands for each, one after the other."""

    def __init__(self, values: list[bytes] | pa.Array):
        self.values = values if isinstance(values, pa.Array) else pa.array(values, pa.large_binary())

    def by_word(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """For each word of ``sizes`` ids its values in one."""
        found = self.values.take(pa.array(ids))
        offsets = np.frombuffer(found.buffers()[1], np.int64)[: len(ids) + 1][np.append(0, np.cumsum(sizes))]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), found.buffers()[2] or pa.py_buffer(b"")])

    def joined(self, numbers: np.ndarray, sizes: np.ndarray) -> Iterator[memoryview]:
        """For each text of ``sizes`` numbers its values in one."""
        whole = self.by_word(numbers, sizes)
        offsets = np.frombuffer(whole.buffers()[1], np.int64)[: len(sizes) + 1].tolist()
        data = memoryview(whole.buffers()[2])
        for a, b in zip(offsets, offsets[1:], strict=False):
            yield data[a:b]


def _token_table(path: str) -> Table:
    return Table([t or b"" for t in Ranks(path).token])


class Finish:
    """What a worker needs to put texts together: of every id its bytes and its decimal form, and both of every frequent word."""

    def __init__(self, packed: tuple[bytes, bytes], path: str):
        flat, sizes = unpacked_rows(_listed(packed[0]).column("ids"))
        #: The ids of all words end to end; number 0 is left for the rare ones.
        self.flat, self.sizes = flat.astype(np.int32), np.append(0, sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        tokens = Ranks(path).token
        self.tokens, self.decimal = Table([t or b"" for t in tokens]), Table([b"%d " % k for k in range(len(tokens))])
        self.word_bytes, self.word_decimal = (t.by_word(self.flat, self.sizes) for t in (self.tokens, self.decimal))

    def _at(self, numbers: np.ndarray) -> np.ndarray:
        """Places in a table of the frequent words and then the rare ones."""
        return np.where(numbers < 0, len(self.sizes) - 1 - numbers, numbers)

    def ids(self, numbers: np.ndarray, sizes: np.ndarray, rare: np.ndarray, rare_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts end to end, how many each text has)."""
        at = self._at(numbers)
        length = np.append(self.sizes, rare_sizes)
        start = np.append(self.starts, len(self.flat) + np.cumsum(rare_sizes) - rare_sizes)
        return spread_out(np.concatenate([self.flat, rare]), start[at], length[at]), self.counts(numbers, sizes, rare_sizes)

    def counts(self, numbers: np.ndarray, sizes: np.ndarray, rare_sizes: np.ndarray) -> np.ndarray:
        upto = np.append(0, np.cumsum(np.append(self.sizes, rare_sizes)[self._at(numbers)]))
        return np.diff(upto[np.append(0, np.cumsum(sizes))])

    def joined(self, words: pa.Array, of_ids: Table, numbers: np.ndarray, sizes: np.ndarray, rare: np.ndarray, rare_sizes: np.ndarray) -> Iterator[memoryview]:
        """Each text's words as they stand in ``words``, the rare ones by their ids."""
        return Table(pa.concat_arrays([words, of_ids.by_word(rare, rare_sizes)])).joined(self._at(numbers), sizes)


def _encoded(docs: DataFrame, key: str, text: str, vocabulary: str, finish: Callable, ddl: str, sample: int, most: int) -> DataFrame:
    """The rows that ``finish`` makes of (worker's tables, keys, ids, ends)."""
    Ranks(vocabulary_path(vocabulary))
    pattern = word_pattern()
    docs = bounded_batches(docs)
    with passing_shuffles(docs.sparkSession):
        # Shared by all steps, so that the driver and each worker hold them once.
        shared = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, text, vocabulary, pattern, sample, most))
    value = docs[text].cast("string")
    # Texts are read twice, once for their rare words and once for themselves; ``mark`` and the places of
    # rare words tell whether a row is the same.
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.pmod(F.xxhash64(value), F.lit(1 << 16)).cast("int").alias("mark"), docs[key].alias("_key"), value.alias("_text"))
    kind = source.schema[2].dataType.simpleString()
    rare = settle(_rare_words(source, shared, pattern))
    with passing_shuffles(docs.sparkSession):
        counts = settle(rare.groupBy("word").agg(F.count("*").alias("n")))
    hot = hot_keys(counts, ["word"], "n", max(1, counts.agg(F.sum("n")).first()[0] or 0))
    words = encode_distinct(counts, vocabulary)
    back = salted_join(rare, words, ["word"], "row", hot).select("row", "mark", "at", F.lit(None).cast(kind).alias("_key"), F.lit(None).cast("bigint").alias("n"), F.col("ids").alias("data"))
    both = _numbered_texts(source, shared, pattern).unionByName(back)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = held(_finish, shared, vocabulary_path(vocabulary))
        for rows, _ in whole_groups(batches, ("row", "mark")):
            for keys, *words in _reassembled(rows):
                yield finish(tables, keys, *words)

    dealt = both.repartition("row").sortWithinPartitions("row", "mark", "at")
    return dealt.mapInArrow(run, schema(ddl.format(kind=kind))).withColumnRenamed("_key", key)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_ROWS, most: int = FREQUENT) -> DataFrame:
    """Key, n_tokens, ids (array) and decoded bytes of every row.

    Special strings are ordinary text.  A null text counts as empty; empty texts have no tokens; a null key stays null;
    repeated keys and texts give repeated rows, an empty table none; further columns are ignored, whatever their names.
    ``docs`` is read three times (a sample, rare words, texts) and must give its rows in the same order each time, as a
    table read from files does; else an error is raised, never a wrong row given.  Memory: GATHERED bytes of text or one
    longer text, STEP_WORDS words or one longer text, and the frequent words.
    """

    def finish(tables, keys, *words):
        ids, n = tables.ids(*words)
        decoded = [bytes(x) for x in tables.tokens.joined(ids, n)]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids, pa.int32()))
        return pa.record_batch([keys, pa.array(n, pa.int64()), lists, pa.array(decoded, pa.binary())], names=["_key", "n_tokens", "ids", "decoded"])

    return _encoded(docs, key, text, vocabulary, finish, "_key {kind}, n_tokens bigint, ids array<int>, decoded binary", sample, most)


def encode_digests(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_tokens, ids_sha256 and decoded_sha256, taken where the ids arise, so that no ids travel further.

    Odd rows as in ``encode_documents``; texts without tokens have the digests of empty strings.
    """

    def finish(tables, keys, numbers, sizes, rare, rare_sizes):
        n = tables.counts(numbers, sizes, rare_sizes)
        words = (numbers, sizes, rare, rare_sizes)
        digests = [hashlib.sha256(x[:-1] if len(x) else x).hexdigest() for x in tables.joined(tables.word_decimal, tables.decimal, *words)]
        decoded = [hashlib.sha256(x).hexdigest() for x in tables.joined(tables.word_bytes, tables.tokens, *words)]
        return pa.record_batch([keys, pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["_key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(docs, key, text, vocabulary, finish, "_key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", SAMPLE_ROWS, FREQUENT)


def decode_ids(rows: DataFrame, vocabulary: str = VOCABULARY, ids: str = "ids") -> DataFrame:
    """The columns of ``rows`` and ``decoded``: the bytes of its array of ids, looked up in the table of tokens.

    Null arrays give null, empty ones no bytes; an id that the vocabulary does not have (or null) is an error.
    """
    most = Ranks(vocabulary_path(vocabulary)).most
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = held(_token_table, vocabulary_path(vocabulary))
        for b in batches:
            given = b.column(names.index(ids))
            own = given.flatten()
            flat = own.to_numpy(zero_copy_only=False)
            if own.null_count or len(flat) and (flat.min() < 0 or flat.max() > most):
                raise ValueError("ids that the vocabulary does not have")
            sizes = pc.fill_null(pc.list_value_length(given), 0).to_numpy(zero_copy_only=False)
            texts = [None if v is None else bytes(x) for v, x in zip(given.is_valid().to_pylist(), tokens.joined(flat.astype(np.int64), sizes), strict=True)]
            yield pa.record_batch([*b.columns, pa.array([None if not v else t for v, t in zip(given.is_valid().to_pylist(), texts, strict=True)], pa.binary())], names=[*b.schema.names, "decoded"])

    out = schema("decoded binary")
    return bounded_batches(rows).mapInArrow(run, type(out)([*rows.schema.fields, *out.fields]))


def op11_byte_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
