"""Interpolated modified Kneser-Ney language model of any order, counted in Spark and memory-mapped by workers.

Words are counted first and numbered by their 64-bit hashes, frequent ones with small numbers. Texts are padded with
order - 1 begin marks and an end mark. Counting: tasks reduce their texts to arrays of distinct n-grams with counts, cut by
ranges of a key of the n-gram's context, so each range is of even size however frequent a word is. What one range gathers
becomes one file of the highest level; what it tells of shorter n-grams is additive and gathered in the same way, level by
level: how many different words stand before an n-gram, which is its count there. From level 3 on a range has all that
follows its contexts, so how many words do, by count, stands in its own file; level 2 tells level 1. Files hold tables
(class Table) in the shared folder; they grow with the corpus and never pass the driver, which gets a few sums and the name
for each file.

Scoring: workers map the files, look up each block's n-grams and sum log10 probabilities.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.llm.shared import Scratch, crc32_of, map_arrow

#: No text has a word with white space, so these two can't be words.
BEGIN, END = b"\n<", b"\n>"
#: Characters of text for each range of hashes; of tokens that a worker handles at once; of distinct n-grams a task holds.
RANGE_CHARS, BLOCK_TOKENS, HELD_PAIRS = 12_000_000, 400_000, 2_000_000
#: Distinct words a task counts before it passes them on.
HELD_WORDS = 500_000
#: Words of context beside the predicted one, in the query.
ORDER = 3
#: Values of this and more stand in columns of their own: the entry's number and the value.
LARGE = 255
PACKED = "kind string, part int, blob binary"


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * np.uint64(0x9E3779B97F4A7C15) ^ (right + np.uint64(0x632BE59BD9B4E019))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    """Of n-grams by their words, one array for each place; a single word's is its own."""
    out = words[0]
    for w in words[1:]:
        out = pair_hash(out, w)
    return out


def mixed(keys: np.ndarray, bits: int) -> np.ndarray:
    """Other numbers of as many bits, one for each key, evenly spread."""
    mask = np.uint64((1 << bits) - 1)
    x = keys * np.uint64(0x9E3779B97F4A7C15) & mask
    x ^= x >> np.uint64((bits + 1) // 2)
    return x * np.uint64(0xBF58476D1CE4E5B9) & mask


def gram_key(words: list[np.ndarray], width: int) -> tuple[np.ndarray, int]:
    """Evenly spread keys of n-grams by their words' numbers of `width` bits, and the keys' bits: exact where all numbers fit in 64 bits, else hashes of 64."""
    if width * len(words) > 64:
        return gram_hash([w.astype(np.uint64) for w in words]), 64
    out = words[0].astype(np.uint64)
    for w in words[1:]:
        out = out << np.uint64(width) | w
    return mixed(out, width * len(words)), width * len(words)


def cut_by(level: int) -> int:
    """How many first words of n-grams ranges are cut by: the context, but whole n-grams where that is a single word, which may be in most texts."""
    return level if level <= 2 else level - 1


def part_of(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Which of `parts` even ranges of numbers with so many bits each is in."""
    top = keys >> np.uint64(bits - 32) if bits > 32 else keys << np.uint64(32 - bits)
    return (top * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def tokens(text: bytes | None, hashes: WordHashes, order: int = 2) -> np.ndarray:
    """Hashes of order - 1 begin marks, the words, end."""
    words = [*[BEGIN] * (order - 1), *(text or b"").lower().split(), END]
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def ends_of(row: np.ndarray, order: int, end: int) -> np.ndarray:
    """Where n-grams of texts laid end to end have their last word: those that end in a word or end mark, none over two texts."""
    last = np.arange(order - 1, len(row))
    for back in range(1, order):
        last = last[row[last - back] != end]
    return last


def grams_of(row: np.ndarray, last: np.ndarray, order: int) -> list[np.ndarray]:
    """The n-grams that end there, by place."""
    return [row[last - back] for back in range(order - 1, -1, -1)]


def _squeezed(column: np.ndarray, ordered: bool = False) -> bytes:
    """Numbers byte by byte, so equal bytes lie together; of ordered ones the differences."""
    body = np.diff(column, prepend=column.dtype.type(0)) if ordered else column
    return body.view(np.uint8).reshape(-1, column.itemsize).T.tobytes()


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of unsigned integers of any lengths and widths; the first is in order."""
    head = np.array([len(columns), *(x for c in columns for x in (len(c), c.itemsize))], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(_squeezed(c, k == 0) for k, c in enumerate(columns)))


def unpacked(blob: bytes) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    count = int.from_bytes(body[:8], "little")
    at, out = 8 + 16 * count, []
    for k, (n, width) in enumerate(np.frombuffer(body, "<i8", 2 * count, 8).reshape(-1, 2).tolist()):
        column = np.ascontiguousarray(np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T).view(f"<u{width}").reshape(n)
        out.append(np.cumsum(column, dtype=column.dtype) if k == 0 else column)
        at += n * width
    return out


def summed(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, a place of each in the input, and sums of the values."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], order[starts], [np.add.reduceat(v[order], starts) if len(keys) else v[:0] for v in values]


def least_type(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max()))) if len(values) else values.astype(np.uint8)


def _starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers begin, and how long they are."""
    starts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
    return starts, np.diff(starts, append=len(first))


def _rows(kind: str, parts: int, words: list[np.ndarray], values: list[np.ndarray], width: int, by: int) -> Iterator[pa.RecordBatch]:
    """A packed row for each range that the first `by` words are in. Its n-grams are in order of their first two words; the second stand as differences."""
    part = part_of(*gram_key(words[:by], width), parts)
    order = np.argsort(words[0].astype(np.uint64) << np.uint64(min(32, 64 - width)) | words[min(1, len(words) - 1)])
    order = order[np.argsort(part[order].astype(np.min_scalar_type(parts)), kind="stable")]
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p, a, b in zip(range(parts), edges, edges[1:]):
        if a < b:
            at = order[a:b]
            own = [w[at] for w in words]
            if len(own) > 1:
                starts, _ = _starts(own[0])
                second = np.diff(own[1], prepend=own[1].dtype.type(0))
                second[starts] = own[1][starts]
                own[1] = second
            yield _table([kind], [p], [packed([*own, *(least_type(v[at]) for v in values)])])


def _unpacked_row(blob: bytes) -> list[np.ndarray]:
    """Columns of a row with n-grams of two words or more, with the second words restored."""
    columns = unpacked(blob)
    starts, sizes = _starts(columns[0])
    sums = np.cumsum(columns[1], dtype=columns[1].dtype)
    columns[1] = sums - np.repeat(sums[starts] - columns[1][starts], sizes)
    return columns


def _table(kinds: list[str], parts: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["kind", "part", "blob"])


def _merged(words: list[np.ndarray], values: list[np.ndarray], width: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Keys of the distinct n-grams in order, their words, and sums of values."""
    keys, at, sums = summed(gram_key(words, width)[0], values)
    return keys, [w[at] for w in words], sums


def _words(parts: int):
    """Packed rows of word hashes and counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
            hashes, _, (counts,) = summed(hashes, [np.fromiter(found.values(), np.uint64, len(found))])
            edges = np.searchsorted(part_of(hashes, 64, parts), np.arange(parts + 1))
            for p, a, b in zip(range(parts), edges, edges[1:]):
                if a < b:
                    yield _table(["word"], [p], [packed([hashes[a:b], least_type(counts[a:b])])])
            found.clear()

        for batch in batches:
            for text in batch.column(0):
                found.update((text.as_py() or b"").lower().split())
                found[END] += 1
                if len(found) >= HELD_WORDS:
                    yield from rows()
        if found:
            yield from rows()

    return count


def _numbered(folder: str):
    """Writes a range's words in order of their hash with their counts and their places among words of as many bits in the count; tells how many there are of each."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _groups(batches, 0):
            columns = [c for _, c in held]
            hashes, _, (counts,) = summed(np.concatenate([c[0] for c in columns]), [np.concatenate([c[1].astype(np.uint64) for c in columns])])
            size = sizes(counts)
            order = np.argsort(size, kind="stable")
            each = np.bincount(size, minlength=64)
            place = np.empty(len(order), "<u4")
            place[order] = np.arange(len(order)) - np.repeat(np.cumsum(each) - each, each)
            name = write_arrays(f"{folder}/words-{part}", [hashes, place, *with_large(counts)])
            yield _table([name], [part], [np.array([int(counts.sum()), *each], "<i8").tobytes()])

    return reduce


def sizes(counts: np.ndarray) -> np.ndarray:
    """63 less the bits of each count: 62 for 1, 61 for 2 and 3, and so on."""
    return (63 - np.frexp(counts.astype(np.float64))[1]).astype(np.uint8)


@dataclass(frozen=True)
class Vocabulary:
    """Files by part; first: the number of the first word of each part with each size; words: how many; tokens: sum of counts; width: bits of numbers."""

    folder: str
    parts: int
    files: dict[int, str]
    first: np.ndarray
    words: int
    tokens: int
    width: int


def vocabulary(texts: DataFrame, folder: str, parts: int) -> Vocabulary:
    rows = map_arrow(texts, _words(parts), PACKED)
    told = map_arrow(rows.repartition(parts, "part").sortWithinPartitions("part"), _numbered(folder), PACKED).collect()
    each = np.zeros((parts, 64), np.int64)
    tokens, files = 0, {}
    for r in told:
        tally = np.frombuffer(r["blob"], "<i8")
        tokens += int(tally[0])
        each[r["part"]] = tally[1:]
        files[r["part"]] = r["kind"]
    ends = np.cumsum(each.T).reshape(64, parts).T  # frequent words first
    count = int(each.sum())
    # beside the words there are an unknown one, the begin mark, and an end mark that no text had
    return Vocabulary(folder, parts, files, ends - each, count, tokens, (count + 2).bit_length())


class Numbers:
    """Words' numbers and counts, by files opened when first needed."""

    def __init__(self, known: Vocabulary):
        self.known, self.files = known, {}
        self.marks = np.array([xxhash.xxh64_intdigest(x) for x in (BEGIN, END)], np.uint64)
        self.end = int(self.of(self.marks)[0][1])

    def _found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For distinct hashes in order."""
        known = self.known
        numbers, counts = np.full(len(hashes), known.words, np.uint32 if known.width <= 32 else np.uint64), np.zeros(len(hashes), np.int64)
        edges = np.searchsorted(part_of(hashes, 64, known.parts), np.arange(known.parts + 1))
        for p, (a, b) in enumerate(zip(edges, edges[1:])):
            if a == b or p not in known.files:
                continue
            if p not in self.files:
                self.files[p] = map_arrays(f"{known.folder}/{known.files[p]}")
            keys, place, *raw = self.files[p]
            at = np.minimum(np.searchsorted(keys, hashes[a:b]), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == hashes[a:b])
            at, own = at[hit], a + hit
            counts[own] = got = large_at(raw, at)
            numbers[own] = known.first[p, sizes(got)] + place[at]
        numbers[hashes == self.marks[0]] = known.words + 1
        numbers[(hashes == self.marks[1]) & (counts == 0)] = known.words + 2
        return numbers, counts

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of words."""
        distinct, back = np.unique(hashes, return_inverse=True)
        numbers, counts = self._found(distinct)
        return numbers[back], counts[back]


def _counted(known: Vocabulary, parts: int, order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, numbers, width = WordHashes(), Numbers(known), known.width
        held: list[list[np.ndarray]] = []
        texts: list[np.ndarray] = []
        size = 0

        def reduced() -> list[np.ndarray]:
            columns = [np.concatenate(c) for c in zip(*held)]
            _, words, sums = _merged(columns[:-1], columns[-1:], width)
            return [*words, *sums]

        def gather() -> None:
            row = numbers.of(np.concatenate(texts))[0]
            grams = grams_of(row, ends_of(row, order, numbers.end), order)
            _, words, sums = _merged(grams, [np.ones(len(grams[0]), np.uint32)], width)
            held.append([*words, *sums])
            texts.clear()

        for batch in batches:
            for text in batch.column(0):
                texts.append(tokens(text.as_py(), hashes, order))
                size += len(texts[-1])
                if size >= BLOCK_TOKENS:
                    gather()
                    size = 0
                    if sum(len(h[0]) for h in held) >= HELD_PAIRS:
                        held[:] = [reduced()]
                        if len(held[0][0]) >= HELD_PAIRS // 2:
                            yield from _rows("left", parts, held[0][:-1], held[0][-1:], width, cut_by(order))
                            held.clear()
        if texts:
            gather()
        if held:
            whole = reduced()
            yield from _rows("left", parts, whole[:-1], whole[-1:], width, cut_by(order))

    return count


def _groups(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[tuple[int | pa.RecordBatch, list[tuple[str, list[np.ndarray]]]]]:
    """Unpacked rows of each part with their kind; rows come in order of part. Sums of higher levels come out as they are, in place of the part."""
    part, held = None, []
    for batch in batches:
        for kind, p, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if kind.startswith("sums"):
                yield _table([kind], [p], [blob]), []
                continue
            if p != part and held:
                yield part, held
                held = []
            part = p
            held.append((kind, _unpacked_row(blob) if level > 1 else unpacked(blob)))
    if held:
        yield part, held


def _place(uri: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pfs.LocalFileSystem(), uri)


def write_arrays(uri: str, columns: list[np.ndarray]) -> str:
    """One file: a line with how many columns, then the entries and width of each, then the columns; its name, which each attempt has for itself."""
    fs, path = _place(uri)
    own = f"{path}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(np.array([len(columns), *(x for c in columns for x in (len(c), c.itemsize))], "<i8").tobytes())
        for column in columns:
            out.write(column.tobytes())
    return os.path.basename(own)


def with_large(values: np.ndarray) -> list[np.ndarray]:
    """Values in a byte each, and the places and values of those that don't fit."""
    large = np.flatnonzero(values >= LARGE)
    return [np.minimum(values, LARGE).astype(np.uint8), large.astype("<u8"), values[large].astype("<u8")]


def large_at(columns: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Values at these places, of columns made by with_large."""
    small, place, value = columns
    got = small[at].astype(np.int64)
    where = np.flatnonzero(got == LARGE)
    if len(where):
        got[where] = value[np.searchsorted(place, at[where])]
    return got


def map_arrays(uri: str) -> list[np.ndarray]:
    """The columns, memory-mapped; a file in a remote store is copied first and unlinked once mapped."""
    fs, path = _place(uri)
    local = None
    if not isinstance(fs, pfs.LocalFileSystem):
        handle, local = tempfile.mkstemp()
        os.close(handle)
        pfs.copy_files(path, local, source_filesystem=fs, destination_filesystem=pfs.LocalFileSystem())
    whole = np.asarray(np.memmap(local or path, np.uint8, "r"))
    if local:
        os.unlink(local)
    count = int(whole[:8].view("<i8")[0])
    at, out = 8 + 16 * count, []
    for n, width in whole[8:at].view("<i8").reshape(-1, 2).tolist():
        out.append(whole[at : at + n * width].view(f"<u{width}"))
        at += n * width
    return out


def classes(counts: np.ndarray, up_to: int) -> list[np.ndarray]:
    """For k from 1: where the count is k; at up_to: is that or more."""
    return [(counts == k).astype(np.uint64) for k in range(1, up_to)] + [(counts >= up_to).astype(np.uint64)]


def coded(values: list[np.ndarray]) -> list[np.ndarray]:
    """A byte for each entry: which of the commonest combinations of values it has, or LARGE; then the places of those that have none of them; then for each column the combinations' values and the values at those places."""
    width = np.uint64(min(32, 64 // len(values)))
    mask = (np.uint64(1) << width) - np.uint64(1)
    small = np.flatnonzero(np.logical_and.reduce([v <= mask for v in values]))
    whole = np.zeros(len(small), np.uint64)
    for v in values:
        whole = whole << width | v[small]
    kinds, back, often = np.unique(whole, return_inverse=True, return_counts=True)
    common = np.argsort(-often, kind="stable")[:LARGE]
    code = np.full(len(kinds), LARGE, np.uint8)
    code[common] = np.arange(len(common))
    codes = np.full(len(values[0]), LARGE, np.uint8)
    codes[small] = code[back]
    rest = np.flatnonzero(codes == LARGE)
    out = [codes, rest.astype("<u4")]
    for k, v in enumerate(values):
        out += [least_type(kinds[common] >> width * np.uint64(len(values) - 1 - k) & mask), least_type(v[rest])]
    return out


class Table:
    """Keys in order with values, in columns that can be mapped: what all keys share is left out, and of the rest the first bits, by which about eight keys each have a place in `edges`.

    Columns: five numbers (bits, depth, least key, planes of the keys' last bits, values), edges, planes, and those of `coded`.
    """

    def __init__(self, columns: list[np.ndarray]):
        bits, depth, self.least, planes, self.values = (int(x) for x in columns[0])
        self.size = 2 + planes + 2 + 2 * self.values
        self.edges, self.planes, (self.codes, self.places, *self.combinations) = columns[1], columns[2 : 2 + planes], columns[2 + planes : self.size]
        self.bits, self.last = bits, bits - depth

    @staticmethod
    def columns(keys: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
        least = int(keys[0]) if len(keys) else 0
        keys = keys - np.uint64(least)
        bits = int(keys[-1]).bit_length() if len(keys) else 0
        depth = min(bits, max(0, (len(keys) // 8).bit_length()))
        last = bits - depth
        edges = np.append(np.searchsorted(keys, np.arange(1 << depth, dtype=np.uint64) << np.uint64(last)), len(keys)).astype("<u4")
        keys = keys & np.uint64((1 << last) - 1)
        planes, shift, wide = [], 0, -(-last // 8)
        for width in (8, 4, 2, 1):
            if wide & width:
                planes.append((keys >> np.uint64(shift)).astype(f"<u{width}"))
                shift += 8 * width
        return [np.array([bits, depth, least, len(planes), len(values)], "<u8"), edges, *planes, *coded(values)]

    def _key(self, at: np.ndarray) -> np.ndarray:
        out, shift = np.zeros(len(at), np.uint64), 0
        for plane in self.planes:
            out |= plane[at].astype(np.uint64) << np.uint64(shift)
            shift += 8 * plane.itemsize
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are there, and their places."""
        own = keys - np.uint64(self.least)  # lesser keys become large ones
        inside = np.flatnonzero((keys >= np.uint64(self.least)) & (own <= np.uint64((1 << self.bits) - 1)))
        own = own[inside]
        first = (own >> np.uint64(self.last)).astype(np.int64)
        own &= np.uint64((1 << self.last) - 1)
        low, high = self.edges[first].astype(np.int64), self.edges[first + 1].astype(np.int64)
        end = high
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            middle = low + high >> 1
            less = (low < high) & (self._key(np.minimum(middle, len(self.codes) - 1)) < own)
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        hit = np.flatnonzero(low < end)
        hit = hit[self._key(low[hit]) == own[hit]]
        return inside[hit], low[hit]

    def at(self, places: np.ndarray) -> list[np.ndarray]:
        code = self.codes[places]
        rest = np.flatnonzero(code == LARGE)
        where = np.searchsorted(self.places, places[rest])
        out = []
        for k in range(self.values):
            common, other = self.combinations[2 * k : 2 * k + 2]
            got = common[np.minimum(code, len(common) - 1)].astype(np.int64) if len(common) else np.zeros(len(code), np.int64)
            got[rest] = other[where]
            out.append(got)
        return out


def gram_in(context: np.ndarray, word: np.ndarray, contexts: int, width: int) -> np.ndarray:
    """Exact keys of n-grams by their context's place in its table and their last word."""
    bits = min(64, contexts.bit_length() + width)
    return mixed(context.astype(np.uint64) << np.uint64(width) | word, bits)


def _files(folder: str, parts: int, level: int, width: int):
    """Writes the files of a level from its packed rows, and gives packed rows for the level below and sums of this one."""

    def gathered(held: list[tuple[str, list[np.ndarray]]]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Rows tell of counts (left), at level 1 also of what follows (right): how many words follow once, twice, more often, and how often any does."""
        words: list[list[np.ndarray]] = [[] for _ in range(level)]
        values: list[list[np.ndarray]] = [[] for _ in range(5 if level == 1 else 1)]
        while held:
            kind, columns = held.pop()
            for place, w in zip(words, columns):
                place.append(w)
            found = [c.astype(np.uint64) for c in columns[level:]]
            zero = np.zeros(len(columns[0]), np.uint64)
            for place, v in zip(values, [zero, *found] if kind == "right" else [*found, zero, zero, zero, zero]):
                place.append(v)
        return _merged([np.concatenate(w) for w in words], [np.concatenate(v) for v in values], width)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _groups(batches, level):
            if isinstance(part, pa.RecordBatch):
                yield part
                continue
            keys, words, values = gathered(held)
            count = values[0]
            if level > 2:
                context, bits = gram_key(words[:-1], width)
                order = np.argsort(context)
                starts, size = _starts(context[order])
                follow = [np.add.reduceat(v[order], starts) for v in (*classes(count, 3), count)]
                grams = gram_in(np.repeat(np.arange(len(starts)), size), words[-1][order], len(starts), width)
                sort = np.argsort(grams)
                columns = [*Table.columns(context[order][starts], follow), *Table.columns(grams[sort], [count[order][sort]])]
            else:
                columns = Table.columns(keys, values)
            name = write_arrays(f"{folder}/level{level}-{part}", columns)
            tally = [*(int((count == k).sum()) for k in range(1, 5)), int((count >= 3).sum()), int(count.sum()), len(count)]
            if level > 1:
                lower = [("left", words[1:], [np.ones(len(count), np.uint64)])]
                if level == 2:
                    lower.append(("right", words[:1], [*classes(count, 3), count]))
                for kind, own, found in lower:
                    _, own, found = _merged(own, found, width)
                    yield from _rows(kind, parts, own, found, width, cut_by(level - 1))
            yield _table([f"sums of {level}, {name}"], [part], [np.array(tally, "<i8").tobytes()])

    return reduce


def discounts(n: list[int]) -> list[float]:
    """Of counts 0, 1, 2 and 3 or more, from how many have count 1 to 4; where one is missing, fixed shares."""
    plain = [0.0, 0.5, 1.0, 1.5]
    if min(n) <= 0:
        return plain
    y = n[0] / (n[0] + 2 * n[1])
    found = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return [0.0] + [d if 0 < d < k else plain[k] for k, d in zip((1, 2, 3), found)]


@dataclass(frozen=True)
class Model:
    """discounts, by level from 1 on; files by level and part; word_classes: how many words stand behind one, two, more different words; pairs: their sum."""

    folder: str
    parts: int
    order: int
    known: Vocabulary
    discounts: list[list[float]]
    files: dict[tuple[int, int], str]
    word_classes: list[int]
    pairs: int


def train(docs: DataFrame, scratch: Scratch, order: int = ORDER) -> Model:
    """The model of all rows of `docs` (text); of order 2 or more."""
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4, -(-size // RANGE_CHARS))
    folder = f"{scratch.folder}/model"
    fs, path = _place(folder)
    fs.create_dir(path, recursive=True)
    known = vocabulary(texts, folder, parts)
    rows = map_arrow(texts, _counted(known, parts, order), PACKED)
    for level in range(order, 0, -1):
        # what one range gathers is bounded by its width; sorting keeps its rows together
        rows = map_arrow(rows.repartition(parts, "part").sortWithinPartitions("part", "kind"), _files(folder, parts, level, known.width), PACKED)
    told = rows.collect()  # a few sums and a name for each file
    sums = np.zeros((order + 1, 7), np.int64)
    files = {}
    for r in told:
        level, name = r["kind"].removeprefix("sums of ").split(", ")
        sums[int(level)] += np.frombuffer(r["blob"], "<i8")
        files[int(level), r["part"]] = name
    found = sums.tolist()
    word = found[1]
    return Model(folder, parts, order, known, [[], *(discounts(found[m][:4]) for m in range(1, order + 1))], files, [word[0], word[1], word[4]], word[5])


class Mapped:
    """A model's files, opened when first needed."""

    def __init__(self, model: Model):
        self.model = model
        self.files: dict[tuple[int, int], list[Table]] = {}

    def tables(self, level: int, part: int) -> list[Table]:
        """What follows contexts, from level 3 on, and counts."""
        if (level, part) not in self.files:
            columns = map_arrays(f"{self.model.folder}/{self.model.files[level, part]}")
            own = [Table(columns)]
            if level > 2:
                own.append(Table(columns[own[0].size :]))
            self.files[level, part] = own
        return self.files[level, part]

    def values(self, level: int, grams: list[np.ndarray]) -> np.ndarray:
        """Rows of values for n-grams, 0 where one is unknown: the count, and how many words follow it (level 1) or its context (level 3 on) once, twice, more often, and how often any does."""
        m = self.model
        key, bits = gram_key(grams[: cut_by(level)], m.known.width)
        order = np.argsort(key)
        key = key[order]
        starts, size = _starts(key)
        key = key[starts]
        out = np.zeros((1 if level == 2 else 5, len(key)), np.int64)
        count = np.zeros(len(order), np.int64)
        edges = np.searchsorted(part_of(key, bits, m.parts), np.arange(m.parts + 1))
        for p, (a, b) in enumerate(zip(edges, edges[1:])):
            if a == b or (level, p) not in m.files:
                continue
            table, *lower = self.tables(level, p)
            hit, place = table.find(key[a:b])
            out[-table.values :, a + hit] = table.at(place)
            if lower:
                each = size[a + hit]
                own = np.repeat(starts[a + hit] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                found, at = lower[0].find(gram_in(np.repeat(place, each), grams[-1][order[own]], len(table.codes), m.known.width))
                count[own[found]] = lower[0].at(at)[0]
        whole = np.empty((len(out), len(order)), np.int64)
        whole[:, order] = np.repeat(out, size, axis=1)
        if level > 2:
            whole[0, order] = count
        return whole

    def log10(self, grams: list[np.ndarray]) -> np.ndarray:
        """log10 probability of the last word of each n-gram of the model's order behind the others."""
        m = self.model
        count = self.values(1, grams[-1:])[0]
        d = np.array(m.discounts[1])
        if m.pairs:
            spread = sum(x * n for x, n in zip(m.discounts[1][1:], m.word_classes)) / m.pairs / (m.known.words + 1)
            p = (count - d[np.minimum(count, 3)]) / m.pairs + spread
        else:
            p = np.ones(len(count))
        for level in range(2, m.order + 1):
            d = np.array(m.discounts[level])
            count, *after = self.values(level, grams[-level:])
            n1, n2, n3, follow = after or self.values(1, grams[-2:-1])[1:]
            many = np.maximum(follow, 1)
            rest = np.where(follow > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / many, 1.0)
            p = (count - d[np.minimum(count, 3)]) / many + rest * p
        return np.log10(p)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """SCORED for rows (doc_id, held_out, text)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.known
        hashes, numbers, mapped = WordHashes(), Numbers(known), Mapped(model)
        floor = np.log10(known.tokens + 0.1 * (known.words + 1))

        def block(rows: list[np.ndarray]) -> np.ndarray:
            words, raw = numbers.of(np.concatenate(rows))
            last = ends_of(words, model.order, numbers.end)
            logs, raw = mapped.log10(grams_of(words, last, model.order)), raw[last]
            sizes = np.array([len(r) - model.order + 1 for r in rows])
            starts = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(v, starts) for v in (logs, np.log10(raw + 0.1) - floor, (raw > 0).astype(np.float64))]
            return np.array([sizes, *sums])

        for batch in batches:
            rows, out, size = [], [], 0
            for text in batch.column(2):
                rows.append(tokens(text.as_py(), hashes, model.order))
                size += len(rows[-1])
                if size >= BLOCK_TOKENS:
                    out.append(block(rows))
                    rows, size = [], 0
            if rows:
                out.append(block(rows))
            if out:
                n, logs, base, known = np.concatenate(out, axis=1)
                columns = [batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(logs)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("binary").alias("text"))
    return map_arrow(texts, score, SCORED)


def perplexities(docs: DataFrame, held_out: Column, order: int = ORDER) -> DataFrame:
    """SCORED, train_tokens and perplexity for each row, by a model of this order of the rows where `held_out` is false.

    A null or empty text has one token, its end. Rows with a null doc_id count like others. Repeated rows are counted
    and scored each. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "kneser-ney")
    marked = docs.select("doc_id", held_out.alias("held_out"), "text")
    model = train(marked.where("not held_out"), scratch, order)
    out = scored(marked, model).withColumn("train_tokens", F.lit(model.known.tokens).cast("long"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op8_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """A row for each row of `documents`: its tokens, log10 probability by the model of nine tenths of the documents, and the base score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return perplexities(docs, F.pmod(crc32_of(F.col("doc_id")), F.lit(10)) == 0).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
